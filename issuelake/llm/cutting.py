"""Cutting oversized items at natural boundaries, with a lookback overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_LINES, OVERLAP = 1500, 120, 10
EOL = r"(?>\r\n|[\r\n])"
LINE = r"[^\r\n]*+" + EOL


def line_count(text: Column) -> Column:
    """Lines of a text: LF, CR LF and CR end one, an end after the last line opens no new one; 0 for an empty text."""
    ends = F.regexp_count(text, F.lit(r"\r\n|\r|\n"))
    return F.when(text.isNull(), F.lit(None)).otherwise(ends + F.when(text.rlike(r"[^\r\n]\z"), 1).otherwise(0))


def oversized(text: Column, max_tokens: int = MAX_TOKENS, max_lines: int = MAX_LINES) -> Column:
    """Whether a text is above the limit: characters div 4 or lines; null is not."""
    return F.coalesce((F.floor(F.length(text) / 4) > max_tokens) | (line_count(text) > max_lines), F.lit(False))


def _by_lines(most: Column) -> Column:
    """Pattern of runs of at most `most` lines: the rest of the text, else a run of over half that many up to a blank line, else up to a line that starts at the margin, else up to any line end."""
    half = F.greatest(F.floor(most / 2), F.lit(1)).cast("string")
    n, less = most.cast("string"), (most - 1).cast("string")
    return F.concat(
        F.lit(f"(?:{LINE}){{0,"), less, F.lit(r"}[^\r\n]++\z|(?:" + LINE + "){1,"), n, F.lit(r"}+\z"),
        F.lit(f"|(?:{LINE}){{"), half, F.lit(","), n, F.lit(r"}(?<=[\r\n][ \t]{0,40}(?:\r\n|\r|\n))"),
        F.lit(f"|(?:{LINE}){{"), half, F.lit(","), n, F.lit(r"}(?=[^\s)\]}])"),
        F.lit(f"|(?:{LINE}){{1,"), n, F.lit(r"}|[^\r\n]++\z"),
    )


def _by_characters(most: Column) -> Column:
    """Pattern of runs of at most `most` characters: the rest, else over half of it up to a blank line, a line end, the end of a sentence or statement, white space, else cut anywhere but inside a CR LF."""
    n, half = most.cast("string"), F.greatest(F.floor(most / 2), F.lit(1)).cast("string")
    run = lambda low, after: F.concat(F.lit("|(?s:.){"), low, F.lit(","), n, F.lit("}" + after))
    return F.concat(
        F.lit("(?s:.){1,"), n, F.lit(r"}\z"),
        run(half, r"(?<=\n\n|\r\r|\n\r\n)"),
        run(half, r"(?<=\n|\r(?!\n))"),
        run(half, r"(?<=[.;!?。！？][ \t]|[;}。！？])"),
        run(half, r"(?<=[\s,])(?<!\r(?=\n))"),
        run(F.lit("1"), r"(?<!\r(?=\n))"),
        F.lit("|(?s:.)"),
    )


def cut(
    chunks: DataFrame, max_tokens: int = MAX_TOKENS, max_lines: int = MAX_LINES, overlap: int = OVERLAP, small_too: bool = False,
    id_col: str = "chunk_id", text_col: str = "raw_content", carry: tuple[str, ...] = ("file_path", "qualified_symbol_name"), start_col: str = "start_line",
) -> DataFrame:
    """Cut every distinct chunk above the limit into pieces within it.

    Returns `id_col`, the `carry` columns, piece (from 0), n_pieces,
    line_from, line_to, shared_lines, shared_chars, content. A piece has at
    most 4 * max_tokens + 3 characters and max_lines lines. Without their
    first shared_chars characters, the pieces of a chunk put together are its
    text, character for character. shared_lines whole lines, `overlap` where
    they fit, are repeated from the end of the piece before; none where a piece
    begins inside a line. Line numbers count from start_col, or from 1 where
    that is null; end_line and token_estimate are never trusted.

    All of it runs in the JVM on one row at a time: two regular expressions
    with bounded quantifiers, whose alternatives stand in the order of boundary
    strength and fall back to single characters, are extracted one after the
    other (lines, then characters within runs that are still too large), then
    a fold looks back from each piece on the end of the text so far for the
    overlap; a row of a piece holds that piece alone. Only rows above the limit
    meet the one shuffle, which removes repeated rows.

    Null and empty texts are never above the limit. With small_too the rows
    within it come out as one piece. Rows that agree in all columns used count
    once. An empty table gives no rows; further columns are ignored.
    """
    room = 4 * max_tokens + 3
    if not 0 <= overlap < max_lines or room < 8:
        raise ValueError("the overlap must be below max_lines, and max_tokens positive")
    big = oversized(F.col("t"), max_tokens, max_lines)
    base = chunks.select(
        F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(start_col).cast("long"), F.lit(1)).alias("first"), F.col(text_col).alias("t")
    )
    base = base.where(F.col("t").isNotNull() if small_too else big).dropDuplicates()
    core_lines = max_lines - overlap
    # characters kept free for the lines shared: ten times a wide line of this text, within bounds
    widths = F.array_sort(F.transform(F.split("t", r"\r\n|\r|\n"), lambda x: F.length(x) + 1))
    sized = base.select("*", big.alias("big"), F.length("t").alias("chars"), line_count(F.col("t")).alias("lines"), widths.alias("w"))
    sized = sized.select(
        *[c for c in sized.columns if c != "w"],
        F.greatest(F.lit(room * 6 // 10), F.lit(room) - F.lit(overlap) * F.element_at("w", F.ceil(F.size("w") * 0.95).cast("int"))).cast("int").alias("core"),
    )
    # as many runs as either limit needs, evenly long but for some slack to reach a boundary
    runs = F.greatest(F.lit(1), F.ceil(F.col("lines") / core_lines), F.ceil(F.col("chars") / F.col("core")))
    sized = sized.withColumn("most", F.least(F.lit(core_lines), F.ceil(F.col("lines") / runs * 1.15) + 2).cast("int"))
    rough = sized.withColumn("rough", F.when(F.col("big"), F.filter(F.regexp_extract_all("t", _by_lines(F.col("most")), F.lit(0)), lambda x: x != "")).otherwise(F.array("t")))

    def finer(x: Column) -> Column:
        parts = F.ceil(F.length(x) / F.col("core"))
        even = F.least(F.col("core"), F.ceil(F.length(x) / parts * 1.15) + 40).cast("int")
        return F.when(F.length(x) <= F.col("core"), F.array(x)).otherwise(F.regexp_extract_all(x, _by_characters(even), F.lit(0)))

    fine = rough.withColumn("ps", F.when(F.col("big"), F.flatten(F.transform("rough", finer))).otherwise(F.col("rough"))).drop("rough")
    ends = lambda x: F.regexp_count(x, F.lit(r"\r\n|\r|\n"))
    # one fold over the pieces: `tail` is the end of the text so far, as much of it as any piece may look back on;
    # the line feed set before the text marks its first line start as well
    none = F.array().cast("array<struct<piece:int,core:string,back:string,ends:bigint>>")
    start = F.struct(F.lit("\n").alias("tail"), F.lit(0).cast("bigint").alias("ends"), none.alias("out"))

    def step(s, p):
        back = F.lit("")
        if overlap:
            reach = F.lit(room) - F.length(p) + 1
            back = F.when(F.size(s["out"]) > 0, F.regexp_extract(F.substring(s["tail"], -reach, reach), r"(?<=[\r\n])(?<!\r(?=\n))((?:" + LINE + r"){1," + str(overlap) + r"})\z", 1)).otherwise(back)
        piece = F.struct(F.size(s["out"]).alias("piece"), p.alias("core"), back.alias("back"), s["ends"].alias("ends"))
        return F.struct(F.substring(F.concat(s["tail"], p), F.lit(-(room + 1)), F.lit(room + 1)).alias("tail"), (s["ends"] + ends(p)).alias("ends"), F.concat(s["out"], F.array(piece)).alias("out"))

    # the number of pieces comes out of the array with them: a condition on it must not be tried by cutting every row before repeated ones are gone
    folded = F.aggregate("ps", start, step, lambda s: F.transform(s["out"], lambda x: F.struct(x["piece"].alias("piece"), x["core"].alias("core"), x["back"].alias("back"), x["ends"].alias("ends"), F.size(s["out"]).alias("n_pieces"))))
    cores = fine.select("id", *[f"c{i}" for i in range(len(carry))], "first", F.explode(folded).alias("x"))
    out = cores.select("*", "x.piece", "x.core", "x.back", "x.ends", "x.n_pieces").drop("x")
    shared = F.regexp_count("back", F.lit(r"\r\n|\r|\n"))
    content = F.concat("back", "core")
    line_from = F.col("first") + F.col("ends") - shared
    return out.select(
        F.col("id").alias(id_col), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "piece", "n_pieces",
        line_from.alias("line_from"), (line_from + F.greatest(line_count(content), F.lit(1)) - 1).alias("line_to"),
        shared.alias("shared_lines"), F.length("back").alias("shared_chars"), content.alias("content"),
    )
