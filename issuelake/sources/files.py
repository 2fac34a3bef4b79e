"""Sources of files: JSON lines, CSV, directories and archives; and sinks."""

from __future__ import annotations

import io
import json
import re
import tarfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from issuelake.operators.records import decisions, flat_rows
from issuelake.operators.relational import first_of

#: Limits of an archive: packed and unpacked bytes, members, bytes of a member.
PACKED, UNPACKED, MEMBERS, MEMBER = 50 << 20, 250 << 20, 10_000, 5 << 20


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, keys: Sequence[Column] = (), order: str | None = None) -> DataFrame:
    """Records of JSON lines; blank and broken lines are skipped. With `keys`, the last record of each by `order`."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if not keys:
        return rows
    named = rows.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)])
    return first_of(named, [f"__k{i}" for i in range(len(keys))], [F.desc_nulls_last(order)]).drop(*[f"__k{i}" for i in range(len(keys))])


def read_golden(spark: SparkSession, path: str, list_col: str = "ground_truth_files") -> DataFrame:
    """A CSV file with a header; one column is a list parted by commas, blanks around its items trimmed, empty ones dropped."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    items = F.filter(F.transform(F.split(list_col, ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumn(list_col, F.coalesce(items, F.array().cast("array<string>")))


def document_rows(files: DataFrame, path: Column, content: Column) -> DataFrame:
    """relative_path, content, loc, size_bytes, is_binary of (path, bytes): a NUL in the first 1,024 bytes means binary; loc is the number of line feeds and one, 0 for an empty file."""
    binary = F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "\x00") > 0
    text = F.when(~binary, F.decode(content, "UTF-8"))
    lines = F.when(F.length(text) == 0, 0).otherwise(F.regexp_count(text, F.lit("\n")) + 1)
    return files.select(path.alias("relative_path"), text.alias("content"), lines.cast("int").alias("loc"), F.length(content).cast("bigint").alias("size_bytes"), binary.alias("is_binary"))


def read_tree(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files below a folder as document rows, paths relative to it. Files of no length are not listed by the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return document_rows(raw, F.substring_index("path", folder.rstrip("/") + "/", -1), F.col("content"))


def unpack(data: bytes) -> list[tuple[str, bytes]]:
    """Regular members of a tar.gz archive within the limits; links and paths that leave the archive are refused."""
    if len(data) > PACKED:
        raise ValueError("the archive is too large")
    out, total = [], 0
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
        for m in tar:
            parts = m.name.split("/")
            if not m.isfile() or m.name.startswith("/") or ".." in parts or m.size > MEMBER:
                continue
            total += m.size
            if total > UNPACKED or len(out) >= MEMBERS:
                raise ValueError("the archive holds too much")
            out.append(("/".join(parts[1:]) or m.name, tar.extractfile(m).read()))
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, relative_path, content, loc, size_bytes, is_binary, error of the members of tar.gz archives, the top folder taken off.

    An archive that is broken or above a limit is one row with its error and
    nothing else; the others are read all the same.
    """
    raw = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows, error = unpack(data), None
                except (ValueError, OSError, EOFError, tarfile.TarError) as e:
                    rows, error = [(None, None)], str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([error] * len(rows), pa.string())],
                    names=["archive", "member", "bytes", "error"],
                )

    members = raw.mapInArrow(run, "archive string, member string, bytes binary, error string")
    docs = document_rows(members.withColumn("__m", F.struct("archive", "member", "error")), F.col("__m"), F.col("bytes"))
    return docs.select("relative_path.archive", F.col("relative_path.member").alias("relative_path"), "content", "loc", "size_bytes", "is_binary", "relative_path.error")


def write_jsonl(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """JSON lines, in folders by the columns `by`."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).json(path)


def write_csv(df: DataFrame, path: str, cut: dict[str, int] | None = None) -> None:
    """CSV with a header; columns named in `cut` lose line ends and what is beyond so many characters, arrays are joined by '; '."""
    cut = cut or {}

    def flat(f):
        c = F.col(f.name)
        if f.dataType.typeName() == "array":
            c = F.array_join(c, "; ")
        return F.substring(F.regexp_replace(c, "[\r\n]+", " "), 1, cut[f.name]).alias(f.name) if f.name in cut else c.alias(f.name)

    df.select(*[flat(f) for f in df.schema.fields]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_snapshot(df: DataFrame, base: str, snapshot_id: str) -> str:
    """One version of a table in a folder of its own; readers follow the pointer that activate_snapshot writes last."""
    path = f"{base}/snapshot_id={snapshot_id}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_settings(path: str) -> dict:
    """Settings in the plain part of YAML: nested maps by indentation, lists of scalars or of maps, scalars, comments. A small file of the driver."""
    lines = []
    with open(path, encoding="utf-8") as f:
        for raw in f:
            text = re.sub(r"(?:^|\s)#.*$", "", raw.rstrip("\n")) if not re.search(r"""["'][^"']*#""", raw) else raw.rstrip("\n")
            if text.strip() and text.strip() != "---":
                lines.append((len(text) - len(text.lstrip()), text.strip()))

    def scalar(v: str):
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x.strip()) for x in v[1:-1].split(",") if x.strip()]
        if v.lower() in ("true", "false", "null", "~", ""):
            return {"true": True, "false": False}.get(v.lower())
        for kind in (int, float):
            try:
                return kind(v)
            except ValueError:
                pass
        return v

    def block(i: int, indent: int):
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            items = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if re.match(r"[\w.-]+:(\s|$)", rest):  # a map that begins behind the dash
                    inner = indent + lines[i][1].index(rest)
                    lines[i] = (inner, rest)
                    value, i = block(i, inner)
                elif rest:
                    value, i = scalar(rest), i + 1
                else:
                    value, i = block(i + 1, lines[i + 1][0])
                items.append(value)
            return items, i
        out = {}
        while i < len(lines) and lines[i][0] == indent:
            key, _, rest = lines[i][1].partition(":")
            if rest.strip():
                out[scalar(key.strip())], i = scalar(rest.strip()), i + 1
            elif i + 1 < len(lines) and (lines[i + 1][0] > indent or lines[i + 1][0] == indent and lines[i + 1][1].startswith("-")):
                out[scalar(key.strip())], i = block(i + 1, lines[i + 1][0])
            else:
                out[scalar(key.strip())], i = None, i + 1
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, replaced, by the file system that the path names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_manifest(df: DataFrame, path: str, facts: dict | None = None) -> dict:
    """A JSON file with the number of rows, the columns and the facts given; returned too."""
    manifest = {"rows": df.count(), "columns": {f.name: f.dataType.simpleString() for f in df.schema.fields}, **(facts or {})}
    write_text(df.sparkSession, path, json.dumps(manifest, indent=2, sort_keys=True, default=str) + "\n")
    return manifest


def write_markdown(rows: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small result as a table in Markdown; more than `most` rows are refused."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rows for a report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    body = [f"| {' | '.join(map(cell, r))} |" for r in held]
    write_text(rows.sparkSession, path, "\n".join([f"# {title}", "", f"| {' | '.join(rows.columns)} |", "|" + "-|" * len(rows.columns), *body, ""]))


def write_traces(nested: DataFrame, folder: str) -> None:
    """Traces in four forms: trace.jsonl with the nested rows, trace.csv with the flat ones, summary.json and summary.md with the decisions of each stage."""
    flat = flat_rows(nested)
    counts = decisions(flat).orderBy("stage", "decision")
    write_jsonl(nested, f"{folder}/trace.jsonl")
    write_csv(flat, f"{folder}/trace.csv")
    write_text(nested.sparkSession, f"{folder}/summary.json", json.dumps([r.asDict() for r in counts.collect()], indent=2) + "\n")
    write_markdown(counts, f"{folder}/summary.md", "Decisions of each stage")


def append_results(df: DataFrame, path: str, run_id: str) -> None:
    """Rows of one evaluation run, added to a table in a folder of the run; a run is written once."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").parquet(f"{path}/run={run_id}")
