"""Text quality statistics of documents, their exact tail probabilities, and the kind of text they tell."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuelake.session import spread, stored

#: More common words than this are refused rather than sent to every task.
MOST_WORDS = 100_000
EOL = re.compile(r"\r\n|\r|\n")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
QUOTE = re.compile(r"(?:\s*>)+\s?")
MARKER = re.compile(r"\s*(?:[-*+•→–—·▪▫◦‣●○■□✓✔☐☑»]|\(?\d{1,4}(?:\.\d{1,3})*[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX]?\])\s+\S")
TAGS = re.compile(r"</?(?:table|thead|tbody|tfoot|tr|td|th|caption|colgroup|col)\b[^>]*>", re.I)
RULE = re.compile(r"[\s|+:=─━═│┃║┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬-]{3,}")
COLUMNS = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
STOPS, PAUSES, CLOSERS = frozenset(".!?…。！？"), frozenset(":;"), "'\")]»”’*_`"
PARTS = re.compile(r"\s*[;·•|]\s+|,\s+|\s+/\s+")
MIXED = re.compile(r"[A-Za-z]\d+[A-Za-z]|\d[A-Za-z]{1,3}\d")
SENTENCES = re.compile(r"[.!?]+\s+|[\r\n]+")
#: What a reader takes for a word or a number, between signs at its edges; and what parts tokens, or only draws lines.
READABLE = re.compile(r"[^\W\d_]+(?:['’._/-]+[^\W\d_]+)*|[+-]?\d+(?:[.,:/-]\d+)*(?:%|[^\W\d_]{1,3})?")
APART = re.compile(r"[|│┃║,;/]+")
DRAWN = frozenset("&\\-=|+:_*~#>.`─━═│┃║┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬,;/")
BOXES = frozenset("─━═│┃║┌┐└┘├┤┬┴┼╔╗╚╝╠╣╦╩╬")
EDGES = "'\"([{<«„“”‘’»>}]).,:;!?*_`~=+-"
PAIRS = 27


#: Letters a-z as 1..26 whatever their case, anything else as 0.
CODES = bytes((c | 0x20) - 96 if 65 <= c <= 90 or 97 <= c <= 122 else 0 for c in range(256))


def letter_codes(text: str) -> np.ndarray:
    """CODES of every character."""
    return np.frombuffer(text.encode("ascii", "replace").translate(CODES), dtype=np.uint8)


def pair_counts(text: str) -> np.ndarray:
    """How often each of the 27 x 27 pairs of letters, or letter and edge, occurs."""
    c = letter_codes(text)
    if len(c) < 2:
        return np.zeros(PAIRS * PAIRS, dtype=np.int64)
    return np.bincount(c[:-1].astype(np.intp) * PAIRS + c[1:], minlength=PAIRS * PAIRS)


def _ends(line: str) -> bool:
    """Whether a line ends a sentence, or pauses in one at a colon or semicolon."""
    x = line.rstrip()
    return x[-1:] in PAUSES or x.rstrip(CLOSERS)[-1:] in STOPS


def _one_cell_row(line: str) -> bool:
    """Whether a line is a row of cells, or the markup of one."""
    s = line.strip()
    if not s[0].isalnum() and RULE.fullmatch(s):
        return len(s) >= 3 and bool(re.search(r"[|+│┃├┼─═]|-{3}|={3}", s)) and bool(set(s) - set("-=_ ") or " " in s)
    if "<" in s and TAGS.search(s):
        return True
    if s.count("|") >= 2 or s.count("│") >= 2 or s.count("┃") >= 2 or s.count("║") >= 2:
        return s[0] in "|│┃║" or s[-1] in "|│┃║" or not ("||" in s or "`" in s) and all(len(c.split()) <= 5 for c in re.split(r"[|│┃║]", s))
    if "\t" in line.strip("\r\n ").strip(" "):
        return True
    return ("  " in s and len(COLUMNS.findall(s)) >= 2) or (s.endswith("\\\\") and " & " in s)


def _separated_rows(lines: list[str]) -> int:
    """Lines that agree with most others in their number of commas or semicolons, and have short cells."""
    best = 0
    for mark in ",;":
        counts = Counter(n for x in lines if (n := x.count(mark)) >= 1)
        if not counts:
            continue
        often, _ = counts.most_common(1)[0]
        rows = [x for x in lines if x.count(mark) == often]
        if len(rows) >= 3:
            cells = [c for x in rows for c in x.split(mark)]
            # prose has long cells and a blank after its commas, rows of cells have neither
            if sum(len(c.split()) for c in cells) <= 1.6 * len(cells) and (often >= 2 or sum(c.startswith(" ") for c in cells) < len(cells) / 4):
                best = max(best, len(rows))
    return best


def _items_of(line: str, common: dict[str, tuple[str, ...]]) -> float:
    """Share of a single line taken by items of an enumeration: four or more short parts without sentences in them."""
    for mark in (r"\s*;\s+", r"\s+[·•|/–]\s+", r"\s*,\s+", r"\s+(?=\(?\d{1,2}[.)]\s)"):
        parts = [p for p in re.split(mark, line.strip().rstrip(".")) if p.strip()]
        if len(parts) >= 4 and 2 * len({p.strip().lower() for p in parts}) > len(parts):
            words = [WORD.findall(p.lower()) for p in parts]
            short = sum(1 for w in words if len(w) <= 6 and sum(x in common for x in w) <= len(w) / 3)
            if short >= 0.8 * len(parts):
                return short / len(parts)
    return 0.0


def _characters(text: str) -> dict[str, int]:
    """How often each character occurs."""
    if not text.isascii():
        return Counter(text)
    counts = np.bincount(np.frombuffer(text.encode("ascii"), dtype=np.uint8), minlength=128).tolist()
    return {chr(i): n for i, n in enumerate(counts) if n}


def text_digest(text: str) -> bytes:
    """What tells equal texts."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def languages_of(common: dict[str, set[str]]) -> dict[str, tuple[str, ...]]:
    """The languages that list each common word."""
    out: dict[str, tuple[str, ...]] = {}
    for lang in sorted(common):
        for w in common[lang]:
            out[w] = (*out.get(w, ()), lang)
    return out


def token_traits(token: str) -> tuple[int, int, int, int]:
    """(readable, all, mixed, longest): words and numbers of a token, whether it mixes letters and digits, and the most characters; the parts between bars, commas and slashes count on their own."""
    n = len(token)
    bare = token.strip(EDGES)
    if bare.isalpha():
        return 1, 1, 0, n if token.isascii() else 0
    parts = [x for x in APART.split(token) if x and not DRAWN.issuperset(x)]
    good = 0
    for x in parts:
        bare = x.strip(EDGES)
        good += bool(bare and len(x) - len(bare) <= 4 and READABLE.fullmatch(bare))
    return good, len(parts), int(bool(MIXED.search(token))), max(map(len, parts), default=0) if token.isascii() else 0


class Tokens:
    """What is known of each token, as rows of numbers: words, their letters, common words of any language and of each, and the traits. Tokens met before are looked up."""

    MOST = 500_000

    def __init__(self, common: dict[str, tuple[str, ...]]):
        self.common = common
        self.langs = sorted({x for langs in common.values() for x in langs})
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.zeros((1024, 7 + len(self.langs)), dtype=np.int64)

    def place(self, token: str) -> int:
        """The row of a token not met before."""
        at = self.places[token] = len(self.places)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        words = WORD.findall(token.lower())
        hits = [langs for w in words if (langs := self.common.get(w))]
        self.rows[at] = [len(words), sum(map(len, words)), len(hits), *token_traits(token), *[sum(x in langs for langs in hits) for x in self.langs]]
        return at

    def sums(self, counts: Counter) -> tuple[list[int], int]:
        """The rows of the tokens, as often as they occur, added up, the longest token aside."""
        if not counts:
            return [0] * self.rows.shape[1], 0
        if len(self.places) > self.MOST:
            self.clear()
        known = self.places.get
        at = [self.place(t) if (p := known(t)) is None else p for t in counts]
        held = self.rows[at]
        return (np.fromiter(counts.values(), dtype=np.int64, count=len(at)) @ held).tolist(), int(held[:, 6].max())


def statistics(text: str, tokens: Tokens, pair_scores: np.ndarray) -> dict:
    """The statistics of one text, rounded to four digits; see document_statistics."""
    lines = [x for x in EOL.split(text) if x.strip()]
    bare = [QUOTE.sub("", x, count=1) if x.lstrip().startswith(">") else x for x in lines]
    bare = [x for x in bare if x.strip()] or lines
    common = tokens.common
    # no word goes beyond a token
    (n, letters, listed, readable, seen, mixed, _, *shares), longest = tokens.sums(counts := Counter(text.split()))
    if "<" in text and TAGS.search(text):
        (_, _, _, readable, seen, mixed, *_), longest = tokens.sums(counts := Counter(TAGS.sub(" ", text).split()))
    most_common = max(shares, default=0)
    lang = tokens.langs[shares.index(most_common)] if most_common else ""
    best = most_common / n if n else 0.0
    chars = _characters(text)
    solid = symbols = most = 0
    for c, count in chars.items():
        if c.isspace():
            continue
        solid += count
        if count > most and c not in BOXES:
            most = count
        if not c.isalnum():
            symbols += count
    solid = solid or 1
    codes = letter_codes(text)
    inner = (codes[:-1] > 0) & (codes[1:] > 0)
    pairs = codes[:-1][inner].astype(np.intp) * PAIRS + codes[1:][inner]
    marked = sum(1 for x in bare if MARKER.match(x) and not RULE.fullmatch(x.strip()))
    # one line alone is no table, unless it is marked up as one
    cells = max(sum(1 for x in bare if _one_cell_row(x)), _separated_rows(bare)) if len(bare) > 1 or TAGS.search(text) else 0
    ends = [_ends(x) for x in bare]
    plain = 0
    for x, ended in zip(bare, ends):
        if ended or x.count(" ") > 16 or x.lstrip().startswith("#") or MARKER.match(x):
            continue
        w = WORD.findall(x.lower())
        if 0 < len(w) <= 7 and sum(v in common for v in w) <= 0.25 * len(w):
            plain += 1
    in_line = _items_of(bare[0], common) if len(bare) == 1 and listed <= n / 3 else 0.0
    items = max(marked, plain if len(bare) >= 3 else 0) / len(bare) if bare else 0.0
    said = [x for x in map(str.strip, SENTENCES.split(text.lower())) if x]
    again = 1 - len(set(said)) / len(said) if len(said) >= 3 else 0.0
    out = {
        "word_count": n,
        "mean_word_length": letters / n if n else 0.0,
        "symbol_ratio": symbols / solid,
        "line_end_share": sum(ends) / len(bare) if bare else 0.0,
        "common_share": best,
        "marker_share": marked / len(bare) if bare else 0.0,
        "item_share": max(items, in_line),
        "cell_share": cells / len(bare) if bare else 0.0,
        "pair_score": float(pair_scores[pairs].mean()) if len(pairs) else None,
        "mixed_share": mixed / counts.total() if counts else 0.0,
        "longest_token": math.log2(longest) if longest else 0.0,
        "again_share": again,
        "char_share": most / solid,
        "readable_share": readable / seen if seen else 0.0,
        "all_common_share": listed / n if n else 0.0,
        "language": lang if best > 0.02 else "",
        "n_lines": len(bare),
    }
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in out.items()}


#: Statistics whose tails are combined: which side is the odd one, and the least scale on which a difference counts.
RANKED = {
    "readable_share": (-1, 0.03), "symbol_ratio": (1, 0.01), "pair_score": (-1, 0.04), "again_share": (1, 0.04), "char_share": (1, 0.02), "mixed_share": (1, 0.02), "longest_token": (1, 0.25), "all_common_share": (1, 0.03),
}
DOUBLES = ["mean_word_length", "line_end_share", "common_share", "marker_share", "item_share", "cell_share", *RANKED]
WHOLE = ("word_count", "n_lines")
#: The body of a distribution ends at its last fifth; half of the texts lie before its middle.
MIDDLE, BODY = 0.5, 0.8
#: Summed -ln of tail probabilities, beyond that of the body's end, from which a text is junk.
JUNK = 10.0
#: A language of fewer distinct texts is measured by all texts.
LEAST_RANKED = 50


def letter_pair_scores(docs: DataFrame, text_col: str) -> np.ndarray:
    """Log probability of each pair of letters within words, over all distinct texts; 729 numbers whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PAIRS * PAIRS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    total += pair_counts(text)
        yield pa.RecordBatch.from_arrays([pa.array(range(PAIRS * PAIRS), pa.int32()), pa.array(total)], names=["pair", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).distinct().mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    m = np.zeros(PAIRS * PAIRS)
    for r in rows:
        m[r["pair"]] = r["n"]
    m = m.reshape(PAIRS, PAIRS)
    m[0, :] = m[:, 0] = 0
    inner = m[1:, 1:] + 1
    scores = np.zeros((PAIRS, PAIRS))
    scores[1:, 1:] = np.log(inner / inner.sum())
    return scores.ravel()


def exact_ranks(values: DataFrame) -> DataFrame:
    """grp, stat, value, upto, total for every distinct value: how many values there are up to it, and in all. Exact.

    `values` has grp, stat, value. Equal values are counted first, so ties,
    even those of a third of all rows, are one row. The distinct values are
    range-partitioned and numbered within each partition; what precedes a
    partition is added as an offset from one tally of (partition, grp, stat).
    No group is sorted in one task.
    """
    counted = values.groupBy("grp", "stat", "value").agg(F.count("*").alias("c"))
    placed = stored(counted.repartitionByRange("grp", "stat", "value").withColumn("pid", F.spark_partition_id()))
    part = placed.groupBy("grp", "stat", "pid").agg(F.sum("c").alias("held"))
    whole = Window.partitionBy("grp", "stat")
    offsets = part.select(
        "grp", "stat", "pid",
        (F.sum("held").over(whole.orderBy("pid")) - F.col("held")).alias("offset"), F.sum("held").over(whole).alias("total"),
    )
    within = F.sum("c").over(Window.partitionBy("pid", "grp", "stat").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("within", within).join(F.broadcast(offsets), ["grp", "stat", "pid"])
    return ranked.select("grp", "stat", "value", (F.col("offset") + F.col("within")).alias("upto"), "total")


def tail_scales(ranks: DataFrame) -> DataFrame:
    """grp, stat, total, body, scale: where the body of a statistic ends, and what -ln of the tail probability grows by one on.

    The empirical tail probabilities of the middle and of the body's end tell
    how fast the tail falls. What lies beyond the body is given the tail that
    the body foretells, since the empirical one is made by the very texts that
    are looked for: many junk texts would make each of them look usual.
    """
    reach = lambda share: F.min(F.when(F.col("upto") >= F.col("total") * share, F.col("value")))
    found = ranks.groupBy("grp", "stat").agg(F.max("total").alias("total"), reach(MIDDLE).alias("middle"), reach(BODY).alias("body"))
    least = F.lit(0.0)
    for stat, (_, scale) in RANKED.items():
        least = F.when(F.col("stat") == stat, scale).otherwise(least)
    return found.select("grp", "stat", "total", "body", F.greatest((F.col("body") - F.col("middle")) / math.log((1 - MIDDLE) / (1 - BODY)), least).alias("scale"))


def document_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, language, the statistics, outlier_score, kind.

    word_count: runs of letters. mean_word_length: their letters. symbol_ratio:
    neither letter, digit nor white space among what is not white space.
    line_end_share: non-blank lines that end a sentence. common_share: words
    among the common words of the document's language; all_common_share: of any
    language. marker_share, item_share and cell_share: lines that begin with a
    bullet or number, that are short and without a sentence, that are rows of
    cells. pair_score: mean log probability of the letter pairs, as counted over
    the distinct texts. again_share: sentences that stood there before.
    char_share: the most frequent character. readable_share: tokens that are
    words or numbers. mixed_share: tokens with letters and digits mixed.
    longest_token: binary logarithm of the characters between white space, bars,
    commas and slashes. Frames of tables are no characters here. All rounded to four digits.

    language is the one with most common words, if that is a tenth of all
    words; else what lang_col says, if known; else null.

    Texts of which most lines are rows of cells, else items, are candidates for
    'table' and 'list'; all others are running text. Each text is then ranked
    among its like: the distinct texts of its language, for running text, or
    the candidates of its form. The exact ranks give the tail probabilities of
    each statistic of RANKED, on its odd side; beyond the body of the
    distribution the tail is carried on as tail_scales says. outlier_score sums
    -ln(tail / tail at the end of the body) over the statistics. From JUNK on
    the text is 'junk', whatever its form; below, a candidate is what it is a
    candidate for, and running text is 'prose'. A text copied into any share of
    the rows is one text and moves no rank.

    Null, empty and blank texts have no statistics, score or kind and count in
    no rank. Every input row gives one row, repeated ids and null ids too. An
    empty table gives no rows. Columns beside the three are not read.
    """
    listed = common_words.select(F.lower("lang"), F.lower("word")).where("lang is not null and word is not null").distinct().limit(MOST_WORDS + 1).collect()
    if len(listed) > MOST_WORDS:
        raise ValueError(f"the list of common words has more than {MOST_WORDS} rows")
    common: dict[str, set[str]] = {}
    for lang, word in sorted((r[0], r[1]) for r in listed):
        common.setdefault(lang, set()).add(word)
    listing = languages_of(common)
    scores = letter_pair_scores(docs, text_col)
    source = spread(docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), F.lower(F.trim(F.col(lang_col).cast("string"))).alias("declared")))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(listing)
        for batch in batches:
            rows = [statistics(t, tokens, scores) if t and t.strip() else None for t in batch.column(1).to_pylist()]
            langs = [None if r is None else r["language"] if r["common_share"] >= 0.1 and r["language"] else d if d in common else None for r, d in zip(rows, batch.column(2).to_pylist())]
            column = lambda name, of: pa.array([None if r is None else r[name] for r in rows], of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if r is None else text_digest(t) for r, t in zip(rows, batch.column(1).to_pylist())], pa.binary()), pa.array(langs, pa.string()), *[column(c, pa.int64()) for c in WHOLE], *[column(c, pa.float64()) for c in DOUBLES]],
                names=[id_col, "digest", "language", *WHOLE, *DOUBLES],
            )

    schema = ", ".join([f"`{id_col}` {kind}", "digest binary", "language string", *[f"{c} bigint" for c in WHOLE], *[f"{c} double" for c in DOUBLES]])
    form = F.when(F.col("cell_share") > 0.5, "table").when((F.col("marker_share") > 0.5) | (F.col("item_share") > 0.5), "list")
    stats = stored(source.mapInArrow(run, schema).withColumn("form", form))
    # copies are one text, and count once over all and once in each language that they are given
    texts = stats.where("digest is not null").select("digest", "language", "form", *RANKED).dropDuplicates(["digest", "language"])
    first = F.row_number().over(Window.partitionBy("digest").orderBy("language")) == 1
    groups = F.array_compact(F.array(F.when(first, "*"), F.concat(F.lit("lang:"), "language"), F.when(first, F.concat(F.lit("form:"), "form"))))
    long = (
        texts.select(groups.alias("grps"), *RANKED).select(F.explode("grps").alias("grp"), *RANKED)
        .select("grp", F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), (F.col(c) * side).alias("value")) for c, (side, _) in RANKED.items()])).alias("x"))
        .select("grp", "x.stat", "x.value").where("value is not null")
    )
    # one row for each language and form: as many as the list of common words has languages, and three
    scales = tail_scales(exact_ranks(long)).groupBy("grp").agg(F.max("total").alias("texts"), *[F.max(F.when(F.col("stat") == c, F.struct("body", "scale"))).alias(f"{c}_tail") for c in RANKED])
    usable = stored(scales.where((F.col("texts") >= LEAST_RANKED) | ~F.col("grp").startswith("lang:")))
    large = F.broadcast(usable.where("grp like 'lang:%'").select("grp"))
    placed = stats.join(large.withColumnRenamed("grp", "known"), F.concat(F.lit("lang:"), "language") == F.col("known"), "left")
    placed = placed.withColumn("within", F.coalesce(F.concat(F.lit("form:"), "form"), F.col("known"), F.lit("*"))).join(F.broadcast(usable.withColumnRenamed("grp", "within").drop("texts")), "within", "left")
    beyond = [F.coalesce(F.greatest(F.lit(0.0), (F.col(c) * side - F.col(f"{c}_tail")["body"]) / F.col(f"{c}_tail")["scale"]), F.lit(0.0)) for c, (side, _) in RANKED.items()]
    score = beyond[0]
    for x in beyond[1:]:
        score = score + x
    told = F.when(F.col("outlier_score") >= JUNK, "junk").otherwise(F.coalesce("form", F.lit("prose")))
    scored = placed.withColumn("outlier_score", F.when(F.col("n_lines").isNotNull(), F.round(score, 6)))
    return scored.withColumn("kind", F.when(F.col("n_lines").isNotNull(), told)).select(id_col, "language", *WHOLE, *DOUBLES, "outlier_score", "kind")
