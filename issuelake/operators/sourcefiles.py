"""Which files of a repository are taken, why others are not, and in which order."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, from here to the end of the lists.
EXCLUDED_DIRS = [
    "test/", "tests/", "__tests__/", "spec/", "docs/", "docs_src/", "documentation/", "examples/", "example/", "samples/", "sample/", "benchmarks/", "benchmark/", "fixtures/", "fixture/",
    "node_modules/", "vendor/", "venv/", "env/", ".git/", ".github/", "dist/", "build/", "out/", "target/", "tools/", "scripts/", "playground/",
]
NON_SOURCE = [".json", ".lock", ".yml", ".yaml", ".toml", ".md", ".txt", ".rst", ".csv", ".html", ".css", ".svg", ".png", ".jpg", ".gif", ".ico", ".woff", ".ttf"]
#: Parts of a language's name, the first that fits decides; "=c" means the whole name.
LANGUAGES = [
    (("python",), [".py"]), (("type", "ts"), [".ts", ".tsx", ".js", ".jsx"]), (("javascript", "js"), [".js", ".jsx", ".ts", ".mjs", ".cjs"]), (("rust", "rs"), [".rs"]), (("go",), [".go"]), (("dart",), [".dart"]), (("java",), [".java"]),
    (("kotlin",), [".kt", ".kts", ".java", ".ts", ".tsx"]), (("scala",), [".scala", ".sc", ".java"]), (("c++", "cpp"), [".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".h", ".c"]), (("c#", "csharp"), [".cs"]), (("=c",), [".c", ".h"]),
    (("haskell",), [".hs", ".lhs"]), (("php",), [".php"]), (("ruby",), [".rb"]), (("shell", "bash"), [".sh", ".bash"]),
]
ANY_LANGUAGE = [".py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".go", ".dart", ".java", ".kt", ".c", ".cpp", ".h", ".hpp", ".cs", ".hs", ".scala"]
SOURCE_ROOTS = ["src", "lib", "core", "app", "include", "pkg", "internal", "packages"]
KEYWORDS = [
    "router", "routing", "model", "controller", "handler", "middleware", "auth", "client", "server", "service", "db", "database", "utils", "config", "application", "app", "main", "index", "core", "base",
    "resolver", "dispatcher", "scheduler", "worker", "pipeline", "rules", "lint", "parser", "compiler", "engine", "transform",
]
PERIPHERAL = ["compiler/", "devtools/", "playground/", "tools/", "scripts/", "bench-report/", "benchmark/"]
IGNORED_DIRS = [".git", "node_modules", "vendor", "dist", "build", "__pycache__", ".venv", "venv", "env", ".idea", ".vscode", "target", "out", ".next", "coverage", ".pytest_cache", ".mypy_cache", ".drift"]
IGNORED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".pdf", ".zip", ".tar", ".gz", ".7z", ".rar", ".exe", ".dll", ".so", ".dylib", ".pyc", ".pyo", ".class", ".jar", ".war", ".lock", ".map", ".wasm", ".db", ".sqlite", ".bin", ".dat",
    ".woof", ".woff", ".woff2", ".eot", ".ttf", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".svd",
]
GENERATED_ENDS = [".g.dart", ".steps.dart", ".freezed.dart", ".generated.dart", ".pb.go", "_pb2.py", ".min.js", ".min.css", ".bundle.js"]
DATA_DIRS, TEST_DIRS, DATA_EXTENSIONS, DATA_BYTES = ["data", "fixtures", "testdata", "__fixtures__"], ["test", "tests", "__tests__", "spec", "specs"], [".csv", ".tsv", ".json", ".txt", ".dat"], 30 * 1024
# End of the fixed values.


def _list(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def first_held(text: Column, parts: Sequence[str]) -> Column:
    """The first of the parts, in their order, that the text holds; null if none."""
    return F.get(F.filter(_list(parts), lambda x: text.contains(x)), F.lit(0))


def ends_with_any(text: Column, ends: Sequence[str]) -> Column:
    return F.exists(_list(ends), lambda x: text.endswith(x))


def extensions_for(language: Column) -> Column:
    """The extensions of a language's files; those of all known ones where nothing fits."""
    name = F.lower(F.coalesce(language, F.lit("")))
    out = None
    for parts, extensions in LANGUAGES:
        fits = F.lit(False)
        for p in parts:
            fits = fits | (F.concat(F.lit(" "), name, F.lit(" ")).contains(f" {p[1:]} ") if p.startswith("=") else name.contains(p))
        out = F.when(fits, _list(extensions)) if out is None else out.when(fits, _list(extensions))
    return out.otherwise(_list(ANY_LANGUAGE))


def source_reason(path: Column, extensions: Column) -> Column:
    """Why a file is no source to index: the folder, 'non_source_ext' or 'wrong_ext'; null if it is one."""
    p = F.lower(path)
    return F.coalesce(
        F.trim(F.translate(first_held(p, EXCLUDED_DIRS), "/", " ")), F.when(ends_with_any(p, NON_SOURCE), "non_source_ext"), F.when(~F.exists(extensions, lambda x: p.endswith(x)), "wrong_ext")
    )


def gitignore(lines: Sequence[str]) -> list[tuple[bool, str]]:
    """(ignored, pattern) of the lines of an ignore file, in order: the last that matches a path decides. *, ?, [...], ** and leading or trailing slashes are known."""
    rules = []
    for line in lines:
        s = line.rstrip()
        if not s or s.startswith("#"):
            continue
        keep = s.startswith("!")
        s = s[1:] if keep else s
        folder, anchored = s.endswith("/"), "/" in s.rstrip("/")
        body, i, s = "", 0, s.strip("/")
        while i < len(s):
            if s.startswith("**/", i):
                body, i = body + "(?:.*/)?", i + 3
            elif s.startswith("**", i):
                body, i = body + ".*", i + 2
            elif s[i] == "[" and (end := s.find("]", i + 2)) > 0:
                body, i = body + "[" + ("^" + s[i + 2 : end] if s[i + 1] == "!" else s[i + 1 : end]) + "]", end + 1
            else:
                body, i = body + {"*": "[^/]*", "?": "[^/]"}.get(s[i], re.escape(s[i])), i + 1
        rules.append((not keep, ("^" if anchored else "(?:^|/)") + body + ("/" if folder else "(?:/|$)")))
    return rules


def ignored(path: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """Whether the rules of gitignore() leave the path out."""
    out = F.lit(False)
    for leave, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(leave)).otherwise(out)
    return out


def filter_reason(path: Column, size: Column, rules: Sequence[tuple[bool, str]] = ()) -> Column:
    """Why a file is left out of the corpus: 'directory', 'extension', 'generated', 'schema', 'fixture' or 'ignored'; null if it is taken."""
    p = F.lower(path)
    parts = F.split(p, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.element_at(parts, -1)
    extension = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    among = lambda dirs: F.arrays_overlap(folders, _list(dirs))
    bulk = among(DATA_DIRS) & extension.isin(DATA_EXTENSIONS) & ((size > DATA_BYTES) | among(TEST_DIRS))
    return (
        F.when(among(IGNORED_DIRS), "directory").when(extension.isin(IGNORED_EXTENSIONS), "extension").when(ends_with_any(name, GENERATED_ENDS), "generated")
        .when(among(["generated", "drift"]) & name.startswith("schema_v"), "schema").when(F.coalesce(bulk, F.lit(False)), "fixture").when(ignored(path, rules), "ignored")
    )


def structural_score(path: Column, package: Column) -> Column:
    """15 for a source root among the segments, 12 for the package's own top folder, 5 for a keyword, less 3 for each level and 8 for a side project."""
    p = F.lower(path)
    parts = F.split(p, "/")
    top = F.when(F.coalesce(package, F.lit("")) != "", parts[0] == F.lower(package))
    points = lambda hit, n: F.when(F.coalesce(hit, F.lit(False)), n).otherwise(0)
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return points(F.arrays_overlap(parts, _list(SOURCE_ROOTS)), 15) + points(top, 12) + points(first_held(p, KEYWORDS).isNotNull(), 5) - depth * 3 - points(first_held(p, PERIPHERAL).isNotNull(), 8)


def selected(files: DataFrame, keys: Sequence[str], most: int = 50) -> DataFrame:
    """The first `most` files of each key, with `tier` and `place`: those that a trace names, by path; then those with keywords, the most first; then the rest by structure.

    `files` has traced boolean, hits int, structure int and path.
    """
    tier = F.when(F.col("traced"), 1).when(F.col("hits") > 0, 2).otherwise(3)
    worth = F.when(F.col("tier") == 2, F.col("hits")).when(F.col("tier") == 3, F.col("structure")).otherwise(0)
    w = Window.partitionBy(*keys).orderBy("tier", F.desc("worth"), "path")
    return files.withColumn("tier", tier).withColumn("worth", worth).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("worth")
