"""Telling hand-written source files from generated, minified, vendored ones and from data kept as code."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelake.llm.repair import Grammar, infer
from issuelake.session import spread, stored

GRAM = 24  #: tokens of a fingerprinted run, and the least size of a rule that tells of copying
WINDOW = 8  #: of so many neighbouring runs one at least is a fingerprint, the smallest
BLOCK = 48  #: classes of files that share a fingerprint and are put into one grammar
RULE, USES = 5, 6  #: tokens of a rule, and times that it has to be used, to count as reused
REUSED = 0.8  #: share of a file that reused rules have to make up, one of any length or several of the first of MIXED
MIXED = ((16, REUSED), (12, 0.92))  #: tokens of rules that count together, and the share from which they do; written code stays below
LEAST_TOKENS = 150  #: shorter files are not called generated by their form
LITERAL = 0.6  #: share of the characters that literals have to make up
LEAST_LITERALS = 800  #: characters in literals from which they are bulk data
LEAST_PACKED = 0.2  #: grammar size of the literals against their length; repeated text is below it
FEW_WORDS = 20  #: names and keywords that may stand beside bulk data
SPACE = 0.09  #: share of white space that written code has at least
ODD = np.uint64(0x9E3779B97F4A7C15)
SHARED = 0.5  #: share of a file covered by rules that other repositories have too

TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`|[^\W\d][\w$]*|0[xX][0-9a-fA-F]+|\d[\w.]*|[^\s\w]")
COMMENT = re.compile(r"/\*.*?\*/|(?<![:\w'\"])//[^\n\r]*|(?m:^[ \t]*#(?!include|define|if|endif|pragma)[^\n\r]*)|(?m:^[ \t]*--[^\n\r]*)|\"\"\".*?\"\"\"|'''.*?'''|<!--.*?-->", re.S)
WORDS = frozenset(
    "if else elif for while do return def class import from function const let var new this self pub fn mut use mod impl public private protected static final int long void char bool string "
    "null None nil err is not and or in try except catch finally throw throws raise export default await async yield package func range struct enum interface type len true false True False "
    "switch case break continue with as lambda unsigned signed namespace partial get set insert into values select create table".split()
)
EOL = re.compile(r"\r\n|\r|\n")

DOCUMENTATION = re.compile(r"\.(?:md|markdown|rst|adoc|txt|tex)$|(?:^|/)(?:readme|license|licence|contributing|changelog|notice|authors)(?:\.\w+)?$")
CONFIGURATION = re.compile(r"\.(?:ya?ml|toml|ini|cfg|conf|properties|env|editorconfig|gitignore)$|(?:^|/)(?:dockerfile|makefile)$")
LOCK = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|go\.sum|flake\.lock|packages\.lock\.json)$")
THIRD = re.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|third[_-]?party|3rd[_-]?party|externals?|pods|carthage/checkouts|site-packages|dist-packages|vendored|_vendor|contrib/upstream)/(?:@?[\w.-]+/)+[\w.-]+$"
    r"|(?:^|/)(?:vendor|deps)/[\w.-]+/(?:[\w.-]+/)*[\w.-]+$"
)
VERSIONED = re.compile(r"(?:^|/)[a-z][\w.]*(?:-[a-z][\w.]*)*-v?\d+\.\d+(?:\.\d+)*(?:[.-](?:min|bundle|slim|prod))*\.(?:m?js|css|c|h|py|go|rs|java|ts)$")
MINIFIED = re.compile(r"[.-]min\.(?:m?js|css)$")

#: Comments by which a program marks its output; and comments that only speak of such things.
OUTPUT = re.compile(
    r"<auto-?generated|@generated\b|\bcode generated by\b|\bauto-?generated (?:by|from|file)|\b(?:automatically|machine)[ -](?:generated|written|created|produced|made)\b|\bgenerated (?:by|from|with) \S+.*\b(?:do not|don't|never)\b.*\b(?:edit|modify|change)|"
    r"\bproduced by \S+ v?\d.*\b(?:do not|don't)\b|\boutput of \S+.*\b(?:instead|replaced|overwritten|build)\b|\btables?, written by \S+ v?\d|\b(?:manual )?(?:changes|edits)\b.*\b(?:will be lost|are overwritten|are lost|be overwritten)|\breplaced on every build\b|\b(?:built|made|rendered) from a template\b|\bchanges belong in the (?:template|schema|source)\b|\b(?:edit|change) (?:the \w+|that) instead\b|"
    r"\bautomatisch (?:erzeugt|generiert|erstellt)|\b(?:produit|généré|créé)e? automatiquement|\b(?:creado|generado|producido)a? automáticamente|\bgenerato automaticamente|\bgerado automaticamente",
    re.I,
)
DENIED = re.compile(r"\bnothing\b.*\bgenerated\b|\bnot (?:auto-?)?generated\b|\bwritten by hand\b|\bhand-?written\b|\bfrom scratch\b", re.I)
COPIED = re.compile(
    r"\bvendored (?:from|copy)\b|\blocal copy of \S+,? (?:release|version|v?\d)|\bcopied (?:verbatim )?from \S+ v?\d|\bcopied verbatim from\b|\bimported from the \S+ (?:project|library|repository)\b|\bsee their own licen[cs]e\b|\b(?:unmodified|patched|bundled) copy of \S+ v?\d|^\W*[a-z][\w.-]* v\d+\.\d+(?:\.\d+)?\W*$",
    re.I | re.M,
)

#: Compiled modules begin so, behind comments if any; lock files have their version on a line of its own or behind the brace.
COMPILED = re.compile(r"^[ \t]*[\"']use strict[\"'];?\s*(?:\r\n|\r|\n)\s*Object\.defineProperty\(exports", re.M)
LOCKED = re.compile(r"(?:^|[{,])\s*\"lockfileVersion\"\s*:", re.M)


def plain_path(path: str | None) -> str:
    """Forward slashes, no leading ./ or /, lower case."""
    p = re.sub(r"/{2,}", "/", (path or "").strip().replace("\\", "/")).lower()
    while p.startswith(("./", "/")):
        p = p[2:] if p.startswith("./") else p[1:]
    return p


def comment_lines(text: str, ahead: int = 24, behind: int = 6) -> list[str]:
    """Lines of comments, wherever they stand. Strings of code are none, nor are lines of long strings between the first and the last lines that are not blank."""
    lines = [x for x in EOL.split(text) if x.strip()]
    picked, open_, quoted = [], False, ""
    for i, line in enumerate(lines):
        s = line.strip()
        within, inside = quoted, open_
        if not quoted and (s.startswith("/*") or s.startswith("<!--")):
            open_ = inside = True
        if open_ and ("*/" in s or "-->" in s):
            open_ = False
        comment = inside or s.startswith(("//", "#", "--", ";", "%", "*"))
        if quoted:
            quoted = "" if s.count(quoted) % 2 else quoted
        elif not comment:
            quoted = next((q for q in ('"""', "'''", "`") if s.count(q) % 2), "")
        if comment and (not within or i < ahead or i >= len(lines) - behind) and not s.startswith("#include"):
            picked.append(s)
    return picked


def marks(path: str, text: str) -> list[str]:
    """Reasons given by the path and by comments."""
    found = []
    if LOCK.search(path):
        found.append("generated:lock")
    if THIRD.search(path):
        found.append("vendored:path")
    if VERSIONED.search(path):
        found.append("vendored:name")
    if MINIFIED.search(path):
        found.append("minified:name")
    comments = comment_lines(text)
    together = "\n".join(comments)
    if OUTPUT.search(together) and any(OUTPUT.search(x) and not DENIED.search(x) for x in comments):
        found.append("generated:comment")
    if COPIED.search(together) and any(COPIED.search(x) and not DENIED.search(x) for x in comments):
        found.append("vendored:comment")
    # what the patterns cannot do without is looked for first
    if ("Object.defineProperty(exports" in text and COMPILED.search(text)) or "sourceMappingURL=" in together:
        found.append("generated:compiled")
    if '"lockfileVersion"' in text and LOCKED.search(text):
        found.append("generated:lock")
    return found


def tokens_of(text: str) -> list[str]:
    """The tokens of the code, without comments and white space."""
    return TOKEN.findall(COMMENT.sub(" ", text))


@lru_cache(maxsize=200_000)
def shape(token: str) -> str:
    """A token without what a template fills in."""
    c = token[0]
    if c in "\"'`":
        return "S"
    if c.isdigit():
        return "N"
    return token if token in WORDS or token.lower() in WORDS or not (c.isalpha() or c == "_") else "I"


def may_reuse(shapes: list[str]) -> bool:
    """Whether a rule of RULE tokens or more, used USES times or more, or the rules of MIXED together, can make up enough of the file.

    Every run of RULE tokens inside such a rule of z tokens occurs as often as
    the rule, u times; so z is at least REUSED n / (most occurrences of a run),
    and u (z - RULE + 1) places begin a run that occurs USES times or more.
    Rules that count together lie in runs of their least length that occur so
    often. Files below these bounds need no grammar; no other is left out.
    """
    n = len(shapes)
    if n < RULE * USES:
        return False
    counts = Counter(zip(*[shapes[i:] for i in range(RULE)])).values()
    most = max(counts)
    if most < USES:
        return False
    z = max(RULE, REUSED * n / most)
    often = sum(c for c in counts if c >= USES)
    if often >= REUSED * n * (1 - (RULE - 1) / z) - 1e-6:
        return True
    return any(often >= share * n * (1 - (RULE - 1) / size) - 1e-6 and often_covered(shapes, size) >= share * n - 1e-6 for size, share in MIXED)


def often_covered(shapes: list[str], size: int) -> int:
    """Tokens that lie in runs of `size` that occur USES times or more."""
    _, which, counts = np.unique(run_hashes(shapes, size), return_inverse=True, return_counts=True)
    edge = np.zeros(len(shapes) + 1, dtype=np.int64)
    begins = np.flatnonzero(counts[which] >= USES)
    edge[begins] += 1
    edge[begins + size] -= 1
    return int((np.cumsum(edge) > 0).sum())


def reuse_of(g: Grammar, n: int) -> float:
    """The share of n tokens made up by the one rule used most, or by all maximal rules of MIXED together."""
    uses, sizes = g.uses(), g.sizes()
    best = max((u * z / n for u, z in zip(uses, sizes) if z >= RULE and u >= USES), default=0.0)
    for size, share in MIXED:
        held, stack = 0, list(g.sequence)
        while stack:
            s = stack.pop() - g.first
            if s < 0 or sizes[s] < size:
                continue
            if uses[s] >= USES:
                held += sizes[s]
            else:
                stack.extend(g.rules[s])
        if held >= share * n:
            best = max(best, held / n)
    return best


def form(text: str) -> dict:
    """What the grammars of one file tell.

    reuse: the share of the token shapes made up by the one rule of five or
    more of them that is used most, six times at least, or by all longer ones
    of MIXED; None where may_reuse shows that they stay too rare. literal_share: characters
    in numbers and strings. packed: grammar size of the literals against their
    length, character by character, for files made of literals with few words
    beside them, None for others. words: names and
    keywords. space: share of white space, literals left out. literal_chars: what
    literals hold.
    """
    code = tokens_of(text)
    n = len(code)
    shapes = [shape(t) for t in code]
    reuse = None
    if may_reuse(shapes):
        # a rule is used as often as its pair occurs when it is made: rarer pairs cannot give a rule used so often
        g = infer(shapes, least=USES)
        reuse = reuse_of(g, n)
    chars = sum(map(len, code))
    literals = [t for t, s in zip(code, shapes) if s in "SN"]
    held = sum(map(len, literals))
    share = held / chars if chars else 0.0
    words = sum(1 for t in code if t[0].isalpha() or t[0] == "_")
    packed = infer("".join(literals), least=4).compression() if share >= LITERAL and words <= FEW_WORDS else None
    return {"n_tokens": n, "reuse": reuse, "literal_share": share, "packed": packed, "words": words, "literal_chars": held, "space": (len(text) - sum(map(len, text.split()))) / max(1, len(text) - held), "code": code}


@lru_cache(maxsize=500_000)
def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))


@lru_cache(maxsize=64)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
    one = np.ones(1, dtype=np.uint64)
    up = np.cumprod(np.concatenate((one, np.full(length - 1, ODD))), dtype=np.uint64)
    return up, np.cumprod(np.concatenate((one, np.full(length - 1, inverse))), dtype=np.uint64)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ODD and of its inverse modulo 2^64, `length` of them or more."""
    return _powers(1 << max(10, (length - 1).bit_length()))


def run_hashes(code: list[str], length: int) -> np.ndarray:
    """64-bit hashes of all runs of `length` tokens."""
    n = len(code) - length + 1
    h = np.array([token_hash(t) for t in code], dtype=np.uint64)
    up, down = powers(len(code) + 1)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * up[: len(code)], dtype=np.uint64)))
    run = (total[length:] - total[:-length]) * down[:n]
    run = (run ^ (run >> np.uint64(29))) * ODD
    return run ^ (run >> np.uint64(32))


def fingerprints(code: list[str]) -> tuple[list[int], list[int]]:
    """Places and 64-bit hashes of the winnowed runs of GRAM tokens: the smallest of every WINDOW neighbouring ones.

    Their number grows with the file, and two files that have any GRAM + WINDOW - 1
    tokens in a row in common have a fingerprint in common.
    """
    n = len(code) - GRAM + 1
    if n < 1:
        return [], []
    run = run_hashes(code, GRAM)
    w = min(WINDOW, n)
    places = np.unique(np.lib.stride_tricks.sliding_window_view(run, w).argmin(axis=1) + np.arange(n - w + 1))
    return places.tolist(), run.view(np.int64)[places].tolist()


def most_shared(places: list[int], prints: list[int], shared: set[int], n: int) -> float:
    """A bound on the share of a file of n tokens that lies in stretches with a fingerprint of other repositories and none that only its own has."""
    stretches, start, held = [], 0, False
    for place, x in zip(places, prints):
        if x in shared:
            held = True
            continue
        if held:
            stretches.append((start, place + GRAM - 1))
        start, held = place + 1, False
    if held:
        stretches.append((start, n))
    covered = end = 0
    for low, high in stretches:
        covered += high - max(low, end)
        end = high
    return covered / n if n else 0.0


NUMBERS = ("reuse", "literal_share", "packed", "space")
COUNTS = ("n_tokens", "words", "literal_chars")


def file_forms(files: DataFrame, id_col: str, repo_col: str | None, path_col: str, text_col: str, known: str | None = None) -> DataFrame:
    """One row per file with a text: row data, marks, the numbers of form(), sig, places and prints of fingerprints, and body (tokens, joined)."""
    repo = F.col(repo_col).cast("string") if repo_col else F.lit("")
    source = spread(files.select(F.col(id_col).alias("k"), repo.alias("repo"), F.col(path_col).cast("string").alias("p"), F.col(text_col).cast("string").alias("t")))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("k", "repo", "path", "marks", *NUMBERS, *COUNTS, "sig", "places", "prints", "body")}
            for k, repo, path, text in zip(*[c.to_pylist() for c in batch.columns]):
                out["k"].append(k)
                out["repo"].append(repo)
                p = plain_path(path)
                out["path"].append(p)
                if not text or not text.strip():
                    for c in ("marks", *NUMBERS, *COUNTS, "sig", "places", "prints", "body"):
                        out[c].append(None)
                    continue
                f = form(text)
                code = f.pop("code")
                body = "\x1f".join(code)
                out["marks"].append(marks(p, text))
                for c in (*NUMBERS, *COUNTS):
                    out[c].append(f[c])
                out["sig"].append(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest())
                places, prints = fingerprints(code)
                out["places"].append(places)
                out["prints"].append(prints)
                out["body"].append(body)
            types = {"k": batch.schema.field(0).type, "marks": pa.list_(pa.string()), "places": pa.list_(pa.int32()), "prints": pa.list_(pa.int64()), **{c: pa.float64() for c in NUMBERS}, **{c: pa.int64() for c in COUNTS}}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.string())) for c, v in out.items()], names=list(out))

    schema = f"k {kind}, repo string, path string, marks array<string>, " + ", ".join([f"{c} double" for c in NUMBERS] + [f"{c} bigint" for c in COUNTS]) + ", sig string, places array<int>, prints array<bigint>, body string"
    return source.mapInArrow(run, schema)


def shared_cover(bodies: list[list[str]], repos: list[set[str]]) -> list[float]:
    """For each body, the share of its tokens that lie in rules of GRAM tokens or more used in two repositories, by one grammar of all."""
    seq: list = []
    for i, b in enumerate(bodies):
        seq += b
        seq.append(("end", i))
    g = infer(seq, breaks=frozenset(("end", i) for i in range(len(bodies))))
    sizes = g.sizes()
    # the left sequence holds the bodies in their order: cut it at their lengths
    parts: list[list[int]] = []
    at = 0
    for b in bodies:
        part, held = [], 0
        while held < len(b):
            s = g.sequence[at]
            part.append(s)
            held += 1 if s < g.first else sizes[s - g.first]
            at += 1
        parts.append(part)
    where = [0] * len(g.rules)
    for i, part in enumerate(parts):
        for s in part:
            if s >= g.first:
                where[s - g.first] |= 1 << i
    for r in range(len(g.rules) - 1, -1, -1):
        for s in g.rules[r]:
            if s >= g.first:
                where[s - g.first] |= where[r]
    told: dict[int, bool] = {}

    def common(mask: int) -> bool:
        if mask not in told:
            seen: set[str] = set()
            for i in range(len(bodies)):
                if mask >> i & 1:
                    seen |= repos[i]
            told[mask] = len(seen) > 1
        return told[mask]

    out = []
    for b, part in zip(bodies, parts):
        covered, stack = 0, list(part)
        while stack:
            s = stack.pop()
            if s < g.first or sizes[s - g.first] < GRAM:
                continue
            if common(where[s - g.first]):
                covered += sizes[s - g.first]
            else:
                stack.extend(g.rules[s - g.first])
        out.append(covered / len(b) if b else 0.0)
    return out


def shared_code(forms: DataFrame) -> DataFrame:
    """sig, shared: how much of each class of equal files is shared with other repositories.

    `forms` has sig, repo, known, n_tokens, places, prints, body. Equal files
    are one class, whatever their number, with its least and greatest
    repository. Classes whose most_shared stays below SHARED need no grammar.
    All others, the wanted ones, meet every class that has a fingerprint in
    common with them, from two repositories, in a block; one Re-Pair grammar of
    the block tells which rules they share. Fingerprints of the same classes
    make one block.
    A fingerprint of more than BLOCK classes is split into groups of half a
    block, and every group of wanted classes meets every group of all classes;
    a file that is shared within any block is shared.
    """
    ids = forms.where("sig is not null")
    classes = ids.groupBy("sig").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.max("known").alias("known"), F.first("n_tokens").alias("n"), F.first("places").alias("places"), F.first("prints").alias("prints"))
    prints = classes.select(
        F.unhex("sig").alias("id"), "known", F.least(F.xxhash64("lo"), F.xxhash64("hi")).alias("l"), F.greatest(F.xxhash64("lo"), F.xxhash64("hi")).alias("h"), F.explode(F.array_distinct("prints")).alias("print")
    )
    alike = Window.partitionBy("print")
    # the classes of a fingerprint, told by their number and two sums: equal ones give equal blocks
    who = [F.count("*").over(alike).alias("c"), *[F.bit_xor(F.xxhash64("id", F.lit(i))).over(alike).alias(f"x{i}") for i in (0, 1)]]
    met = stored(
        prints.select("print", "id", "known", F.min("l").over(alike).alias("l"), F.max("h").over(alike).alias("h"), *who)
        .where("l <> h and c > 1").select("print", F.lower(F.hex("id")).alias("sig"), "known", "c", "x0", "x1")
    )
    own = classes.join(met.groupBy("sig").agg(F.collect_list("print").alias("shared")), "sig").select("sig", "n", "places", "prints", "shared")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, n, places, hashes, shared = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, *x in zip(sig, places, hashes, shared, n) if most_shared(x[0], x[1], set(x[2]), x[3]) >= SHARED], pa.string())], names=["sig"])

    wanted = own.mapInArrow(bound, "sig string").withColumn("wanted", F.lit(1))
    one = met.withColumn("first", F.min("print").over(Window.partitionBy("c", "x0", "x1"))).where("print = first")
    counted = one.join(wanted, "sig", "left").withColumn("k", F.count("wanted").over(alike)).where("k > 0")
    groups = lambda c: F.when(F.col("c") <= BLOCK, 1).otherwise(F.ceil(F.col(c) / (BLOCK // 2))).cast("int")
    group = lambda n: F.pmod(F.xxhash64("sig"), F.col(n)).cast("int")
    asked = F.when(F.col("wanted") == 1, F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: group("few") * F.col("all") + j)).otherwise(F.array().cast("array<int>"))
    answers = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: i * F.col("all") + group("all"))
    seats = counted.withColumn("few", groups("k")).withColumn("all", groups("c")).select("print", "sig", F.explode(F.array_union(asked, answers)).alias("part"))
    bodies = ids.select("sig", "body").dropDuplicates(["sig"])
    rows = seats.join(classes.select("sig", "lo", "hi"), "sig").join(bodies, "sig").repartition("print", "part").sortWithinPartitions("print", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def cover() -> pd.DataFrame:
            split = [r[1].split("\x1f") for r in held]
            return pd.DataFrame({"sig": [r[0] for r in held], "shared": shared_cover(split, [{r[2], r[3]} for r in held])})

        for batch in batches:
            for p, part, sig, lo, hi, body in zip(batch["print"], batch["part"], batch["sig"], batch["lo"], batch["hi"], batch["body"]):
                if (p, part) != key:
                    if len(held) > 1:
                        yield cover()
                    key, held = (p, part), []
                held.append((sig, body, lo, hi))
        if len(held) > 1:
            yield cover()

    near = rows.select("print", "part", "sig", "lo", "hi", "body").mapInPandas(run, "sig string, shared double")
    same = classes.where("lo <> hi").select("sig", F.lit(1.0).alias("shared"))
    return near.union(same).groupBy("sig").agg(F.max("shared").alias("shared"))


def classify_files(docs: DataFrame, upstream: DataFrame, id_col: str = "document_id", repo_col: str = "repo_full_name", path_col: str = "relative_path", text_col: str = "content") -> DataFrame:
    """One row per file: id, kinds, reasons, handwritten, and the numbers they rest on.

    kinds holds what applies of 'generated', 'minified', 'vendored', 'data':

    * generated: rules of the grammar of token shapes, reused, make up most of
      the file; or a comment says that a program wrote
      it; or it is a lock file or compiled output.
    * minified: hardly any white space, or named so.
    * data: literals make up most of the file, and neither does their own
      grammar pack them nor do other words accompany them; or one rule of
      literals is repeated throughout.
    * vendored: rules of its grammar are shared with a known upstream file or
      with another repository; or its folder, name or comments say so.

    Documentation and configuration are never called so by their form, lock
    files apart. Null and blank files have no kinds and count as hand-written,
    and so do null paths with ordinary contents. Repeated files get a row each;
    copies within one repository are not vendored by that. A null repository is
    one of its own. Empty tables are fine, of upstream files as well. Only the
    named columns are read (and upstream's library_name, file_name, content).
    """
    own = file_forms(docs, id_col, repo_col, path_col, text_col).withColumn("known", F.lit(False)).withColumn("repo", F.coalesce("repo", F.lit("")))
    other = (
        file_forms(upstream.where("content is not null"), "library_name", None, "file_name", "content")
        .withColumn("repo", F.concat(F.lit("upstream:"), F.coalesce(F.col("k").cast("string"), F.lit(""))))
        .withColumn("known", F.lit(True))
    )
    forms = stored(own)
    of = ["sig", "repo", "known", "n_tokens", "places", "prints", "body"]
    cover = shared_code(forms.select(*of).unionByName(stored(other.select(*of))))
    c = F.col
    prose = c("path").rlike(DOCUMENTATION.pattern) | c("path").rlike(CONFIGURATION.pattern)
    templated = ~prose & (c("n_tokens") >= LEAST_TOKENS) & (c("reuse") >= REUSED) & ~c("path").rlike(r"\.json$")
    dense = ~prose & (c("space") < SPACE) & (c("n_tokens") >= 60) & (c("literal_share") < LITERAL)
    blob = ~prose & (c("literal_share") >= LITERAL) & (c("literal_chars") >= LEAST_LITERALS) & (((c("packed") >= LEAST_PACKED) & (c("words") <= FEW_WORDS)) | ((c("reuse") >= REUSED) & (c("n_tokens") >= LEAST_TOKENS)))
    shared = ~prose & (c("shared") >= SHARED) & (c("n_tokens") >= 60)
    reasons = F.array_distinct(
        F.array_compact(
            F.concat(
                c("marks"),
                F.array(
                    F.when(templated & (c("literal_share") < LITERAL), "generated:form"), F.when(dense, "minified:form"), F.when(blob, "data:form"), F.when(shared, "vendored:shared"),
                ),
            )
        )
    )
    judged = forms.drop("places", "prints", "body", "known").join(cover, "sig", "left").withColumn("reasons", F.coalesce(reasons, F.array().cast("array<string>")))
    return judged.select(
        c("k").alias(id_col), F.array_distinct(F.transform("reasons", lambda r: F.substring_index(r, ":", 1))).alias("kinds"), "reasons", (F.size("reasons") == 0).alias("handwritten"),
        "n_tokens", *[F.round(x, 4).alias(x) for x in (*NUMBERS, "shared")],
    )
