"""Cutting sources into symbols, and what chunks are called."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_id(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of the digest of the parts, colons between them; nulls count as empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def information_class(path: Column) -> Column:
    """TESTS before DOCUMENTATION before CONFIGURATION before SOURCE_CODE, by the path."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"(^|/)(tests?|spec|__tests__)/|(^|/)test_[^/]*$|[._-](test|spec)\.[a-z]+$"), "TESTS")
        .when(p.rlike(r"\.(md|rst|txt|adoc)$|(^|/)docs?/"), "DOCUMENTATION")
        .when(p.rlike(r"\.(ya?ml|toml|json|ini|cfg|lock)$"), "CONFIGURATION")
        .otherwise("SOURCE_CODE")
    )


def kept_or_reason(path: Column) -> Column:
    """Why a file is left out, by the first rule that holds; null if it is kept."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"(^|/)(node_modules|vendor|third_party|dist|build|\.git)/"), "directory")
        .when(p.rlike(r"\.(png|jpe?g|gif|svg|ico|lock|map|css|html|md|txt)$|\.min\.js$"), "not_source")
        .when(~p.rlike(r"\.(py|js|ts|go|rs|java|c)$"), "extension")
    )


def context_header(path: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
    """[File: path | Kind: name (Lines a-b)]"""
    return F.format_string("[File: %s | %s: %s (Lines %d-%d)]", path, F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), name, start, end)


def python_symbols(source: str) -> list[tuple[str, str, str | None, int, int]]:
    """(type, qualified name, parent, first line, last line) of the docstring, functions, classes and methods; nothing where the source does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple[str, str, str | None, int, int]] = []
    if ast.get_docstring(tree) is not None:
        out.append(("module_docstring", "module", None, tree.body[0].lineno, tree.body[0].end_lineno))
    stack = [(n, None) for n in reversed(tree.body)]
    while stack:
        node, parent = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *[x.lineno for x in node.decorator_list]])
            name = f"{parent}.{node.name}" if parent else node.name
            is_class = isinstance(node, ast.ClassDef)
            out.append(("class" if is_class else "method" if parent else "function", name, parent, first, node.end_lineno))
            if is_class:
                stack += [(n, name) for n in reversed(node.body)]
    return out


def bounded_windows(lines: list[str], size: int = 50, overlap: int = 10, most_tokens: int = 1500) -> list[tuple[int, int]]:
    """First and last line of windows of `size` lines, shorter by five at a time while they have more than most_tokens; single lines may."""
    ends = [0]
    for x in lines:
        ends.append(ends[-1] + len(x))
    out, at = [], 0
    while at < len(lines):
        end = min(at + size, len(lines))
        while end - at > 1 and (ends[end] - ends[at]) // 4 > most_tokens:
            end = max(at + 1, end - 5)
        out.append((at + 1, end))
        if end == len(lines):
            break
        at = max(at + 1, end - overlap)
    return out


def file_chunks(path: str | None, source: str, most_lines: int = 120, most_tokens: int = 1500) -> list[tuple[str, str, str | None, int, int]]:
    """As python_symbols, with symbols above the bounds cut into windows; windows of the whole file where there are no symbols or it is not Python."""
    lines = [x for x in re.split(r"(?<=\n)|(?<=\r)(?!\n)", source) if x]
    out: list[tuple[str, str, str | None, int, int]] = []
    for kind, name, parent, first, last in python_symbols(source) if (path or "").lower().endswith(".py") else []:
        own = lines[first - 1 : last]
        if kind != "module_docstring" and (len(own) > most_lines or sum(map(len, own)) // 4 > most_tokens):
            out += [(f"{kind}_part", name, parent, first + a - 1, first + b - 1) for a, b in bounded_windows(own, most_tokens=most_tokens)]
        else:
            out.append((kind, name, parent, first, last))
    return out or [("text_block", f"{path or ''}:{a}-{b}", None, a, b) for a, b in bounded_windows(lines, most_tokens=most_tokens)]


def symbol_chunks(docs: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """id, symbol_type, qualified_symbol_name, parent_symbol, start_line, end_line of the chunks of every file with a text; see file_chunks."""
    source = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(path_col).alias("p"), F.col(text_col).alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    names = [id_col, "symbol_type", "qualified_symbol_name", "parent_symbol", "start_line", "end_line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *s) for k, p, t in zip(*[c.to_pylist() for c in b.columns]) for s in file_chunks(p, t)]
            cols = list(zip(*rows)) or [[]] * 6
            types = [b.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return source.mapInArrow(run, f"`{id_col}` {kind}, symbol_type string, qualified_symbol_name string, parent_symbol string, start_line int, end_line int")
