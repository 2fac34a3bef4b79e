"""The training-data operators against brute force, round trips and edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuelake.llm import bpe, components, cutting, handwritten, neardup, packing, pii, quality, queries, repair, splits
from issuelake.session import checkpoint_dir, table

SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ 1 near duplicates


def brute_pairs(rows, threshold, size, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if i is not None and len(w) >= max(least, size):
            sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def near(spark, rows, threshold, size, least=1):
    df = spark.createDataFrame(rows, "evidence_id bigint, t string").withColumn("class_id", F.lit("clash")).withColumn("a", F.lit(1))
    m, p = neardup.similar_pairs(df, F.col("t"), threshold=threshold, size=size, least_words=least)
    return {tuple(r) for r in neardup.expand_pairs(m, p).collect()}, m, p


@pytest.mark.parametrize("threshold,size", [(0.6, 3), (0.8, 5)])
def test_near_duplicates_equal_brute_force(spark, threshold, size):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        if rows and rng.random() < 0.5:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            w = w or ["x"]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        rows.append((i, " ".join(w)))
    got, m, p = near(spark, rows, threshold, size)
    assert got == brute_pairs(rows, threshold, size, 1)
    groups = neardup.similar_groups(m, p).collect()
    assert len(groups) == m.count() and all(r.group_size >= 1 for r in groups)


def test_near_duplicates_with_hot_parts_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 2)
    monkeypatch.setattr(neardup, "NOISE", 0)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "SLICE", 50)
    monkeypatch.setattr(neardup, "FAN", 2)
    monkeypatch.setattr(neardup, "COPIES", 3)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(40)] = f"e{rng.randrange(5)}"
        rows.append((i, " ".join(w)))
    assert near(spark, rows, 0.6, 3)[0] == brute_pairs(rows, 0.6, 3, 1)


def test_near_duplicates_edges(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "  "), (4, "a b c d"), (5, "A, b; C d"), (6, long), (7, long + " more"), (None, "a b c d"), (4, "a b c d"), (8, "x y")]
    got, m, _ = near(spark, rows, 0.6, 3)
    assert got == {(4, 5), (6, 7)}
    assert {r.id for r in m.collect()} == {4, 5, 6, 7}
    assert near(spark, [], 0.6, 3)[0] == set()


@pytest.mark.parametrize("n", [1, 6, 50])
def test_keys_are_spread_over_all_partitions(spark, n):
    keys = neardup.spread_keys(n).tolist()
    df = spark.createDataFrame([(k,) for k in keys], "k int").repartition(n, "k").withColumn("p", F.spark_partition_id())
    assert sorted((r.k, r.p) for r in df.collect()) == sorted((k, i) for i, k in enumerate(keys))


def test_prefix_tree_finds_what_overlaps():
    rng = random.Random(2)
    lists = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(80)]
    tree = neardup.PrefixTree()
    for i, x in enumerate(lists):
        tree.add(x, i, len(x))
    for q in lists:
        want = {i for i, x in enumerate(lists) if len(set(q) & set(x)) >= 0.375 * (len(q) + len(x)) - 1e-9}
        assert {m for m, _, _ in tree.probe(q, len(q), 0.6)} == want


# ------------------------------------------------------------------ 2 splits


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(60)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [(None, "1"), ("9", "9")]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components.hash_to_min(spark.createDataFrame([], "a string, b string")).count() == 0


def test_repository_and_dataset_keys(spark):
    rows = [
        ("Owner/Name", "owner/name"), (" owner/name.git\n", "owner/name"), ("https://forge.example/Owner/name/issues/87", "owner/name"), ("git@forge.example:owner/name.git", "owner/name"),
        ("http://www.forge.example/owner/name/", "owner/name"), ("https://api.forge.example/repos/owner/name", "owner/name"), ("owner%2Fname", "owner/name"), ("ssh://git@forge.example:22/owner/name.js", "owner/name.js"),
        ("owner-fork/name", "owner-fork/name"), ("N/A", None), ("unknown", None), ("-", None), ("", None), (None, None), ("name", None),
    ]
    got = spark.createDataFrame(rows, "v string, want string").select("want", splits.repository_key(F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    ids = [("ds_raw_0123456789ab", "0123456789ab"), (" DS-RAW-0123456789AB\n", "0123456789ab"), ("0123456789ab", "0123456789ab"), ("0123456789abc", None), ("unknown", None), (None, None),
           ("gn_raw_000000000000", None), ("FFFFFFFFFFFF", None), ("ds_0123456789ab_ba9876543210", None), ("0123456789ab/0123456789AB", "0123456789ab"), ("000000000001", "000000000001")]
    got = spark.createDataFrame(ids, "v string, want string").select("want", splits.dataset_key(F.col("v")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(3)
    rows = [(i, f"o/r{min(rng.randrange(400), 300)}", f"ds_raw_{rng.randrange(3000):012x}") for i in range(3000)] + [(None, None, None), (None, None, None), (7000, "unknown", "")]
    df = spark.createDataFrame(rows, "record_id bigint, repo_name string, dataset_id string").withColumn("split", F.lit("x")).withColumn("n", F.lit(1))
    out = splits.grouped_splits(df).collect()
    assert len(out) == len(rows)
    assert len({r.component for r in out}) == len({(r.component, r.split) for r in out})
    loose = spark.createDataFrame([(i, f"o/r{i}", None) for i in range(4000)], df.select("record_id", "repo_name", "dataset_id").schema)
    share = Counter(r.split for r in splits.grouped_splits(loose).collect())
    assert abs(share["train"] / 4000 - 0.7) < 0.03 and abs(share["test"] / 4000 - 0.15) < 0.03
    assert splits.grouped_splits(df.limit(0)).count() == 0


def test_fillers_join_nothing(spark):
    rows = [(i, f"o/r{i}", "gn_raw_000000000000") for i in range(5)] + [(10, "unknown", "0123456789ab"), (11, "o/r1", "0123456789AB"), (12, "-", "000000000000"), (13, None, "ds-0123456789ab")]
    df = spark.createDataFrame(rows, "record_id bigint, repo_name string, dataset_id string")
    got = {r.record_id: r.group_key for r in splits.related_groups(df).collect()}
    assert got == {**{i: f"o/r{i}" for i in range(5)}, 10: "o/r1", 11: "o/r1", 12: None, 13: "o/r1"}


def test_splits_meet_their_shares_around_a_component_of_a_third(spark):
    rows = [(i, "big/one", None) for i in range(1500)] + [(i, f"mid/r{i % 20}", None) for i in range(1500, 2700)] + [(i, f"o/r{i}", None) for i in range(2700, 4500)]
    df = spark.createDataFrame(rows, "record_id bigint, repo_name string, dataset_id string")
    out = splits.grouped_splits(df).collect()
    share = Counter(r.split for r in out)
    assert abs(share["train"] / 4500 - 0.7) < 0.03 and abs(share["test"] / 4500 - 0.15) < 0.03
    # one record more moves few of the others
    more = {r.record_id: r.split for r in splits.grouped_splits(df.union(spark.createDataFrame([(9999, "new/one", None)], df.schema))).collect()}
    assert sum(more[r.record_id] != r.split for r in out) <= 45


# ------------------------------------------------------------------ 3 cutting


def lines_of(t):
    return len(re.findall(r"\r\n|\r|\n", t)) + (1 if t and t[-1] not in "\r\n" else 0)


CHUNK = "chunk_id string, file_path string, qualified_symbol_name string, start_line int, raw_content string"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_pieces_put_together_are_the_text(spark, end):
    rng = random.Random(4)
    texts = [
        end.join("x" * rng.randint(0, 90) for _ in range(400)), end.join("" if i % 7 == 0 else f"    line {i};" for i in range(300)) + end, "y" * 30_000, "漢字。" * 5_000, "😀" * 6_004,
        end * 500, ("word " * 3000).strip(), end.join("z" * rng.choice([3, 7000]) for _ in range(30)), "a" * 6003, end.join(["q"] * 121), end.join(["q"] * 120) + end,
    ]
    rows = [(str(i), "f", "s", None if i % 2 else 10, t) for i, t in enumerate(texts)]
    rows += [rows[0], ("n", "f", "s", 1, None), ("e", "f", "s", 1, "")]
    df = spark.createDataFrame(rows, CHUNK).withColumn("piece", F.lit(1)).withColumn("t", F.lit("clash"))
    got: dict = {}
    for r in cutting.cut(df).collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {str(i) for i, t in enumerate(texts) if len(t) // 4 > 1500 or lines_of(t) > 120}
    for key, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        text, start = texts[int(key)], rows[int(key)][3] or 1
        assert "".join(r.content[r.shared_chars :] for r in pieces) == text
        at = 0
        for r in pieces:
            assert len(r.content) <= 6003 and lines_of(r.content) <= 120
            before = at - r.shared_chars
            assert text[before : before + len(r.content)] == r.content
            assert r.line_from == start + len(re.findall(r"\r\n|\r|\n", text[:before]))
            at += len(r.content) - r.shared_chars
            assert not (text[at - 1 : at + 1] == "\r\n")
    assert all(r.shared_lines == 10 for r in got["1"][1:])


def test_cutting_small_ones_and_nothing(spark):
    df = spark.createDataFrame([("a", "f", "s", 3, "one\ntwo"), ("b", "f", "s", 3, None)], CHUNK)
    (r,) = cutting.cut(df, small_too=True).collect()
    assert (r.content, r.line_from, r.line_to, r.n_pieces) == ("one\ntwo", 3, 4, 1)
    assert cutting.cut(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 4 not hand-written


def test_grammar_derives_its_input_and_has_no_pair_left():
    rng = random.Random(0)
    for _ in range(200):
        x = [rng.randrange(rng.choice([1, 2, 5, 20])) for _ in range(rng.randint(0, 120))]
        g = repair.infer(x)
        ids: dict = {}
        want = [ids.setdefault(v, len(ids)) for v in x]

        def spell(s):
            return [s] if s < g.first else spell(g.rules[s - g.first][0]) + spell(g.rules[s - g.first][1])

        assert sum((spell(s) for s in g.sequence), []) == want
        assert all(u >= 2 for u in g.uses())
        assert g.sizes() == [len(spell(g.first + i)) for i in range(len(g.rules))]


def test_files_of_each_kind(spark):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    forms = ["{a} = {b}.{c}({d})", "if {a} is None: return {b}", "for {a} in {b}: {c}.{d}()", "{a}.{b} = [{c} for {c} in {d}]", "log.debug('{a}', {b})", "assert {a} > 3, '{b}'", "with {a}({b}) as {c}: {d}.run()"]
    hand = lambda: "import os\n" + "\n".join(rng.choice(forms).format(a=name(), b=name(), c=name(), d=name()) for _ in range(40))
    library = hand()
    rows = [
        (1, "o/a", "src/x.py", hand()), (2, "o/a", "src/y.py", "// Code generated by tool. DO NOT EDIT.\n" + hand()), (3, "o/a", "src/z.py", 'HEADER = "// Code generated by tool. DO NOT EDIT."\n' + hand()),
        (4, "o/a", "src/g.ts", "\n".join(f"  get{name().title()}{i}(): number {{ return this._{name()}{i}; }}" for i in range(40))), (5, "o/a", "src/d.h", "static const unsigned char d[] = {\n" + ", ".join(f"0x{rng.randrange(256):02x}" for _ in range(900)) + "\n};"),
        (6, "o/a", "web/m.js", "".join(f"e.{name()}=function(a,b){{return a?b():{name()}(b)}};" for _ in range(60))), (7, "o/a", ".\\third_party\\lib\\a.py", hand()), (8, "o/a", "app/models/vendor.py", hand()),
        (9, "o/b", "src/copy.py", library.replace("import os", "import sys")), (10, "o/a", "package-lock.json", '{\n "lockfileVersion": 3\n}'), (11, "o/a", "settings.yml", "\n".join(f"{name()}:\n  {name()}: {i}" for i in range(60))),
        (12, "o/a", "README.md", "# Code\n\nThis file was automatically written."), (13, "o/a", None, None), (14, None, "a.py", "  \n"), (15, "o/a", "src/e.py", "# nothing here is generated by a tool\n" + hand()),
        (16, "o/c", "src/f.py", f"KEY = '{''.join(rng.choice('abcXYZ0189') for _ in range(900))}'\n" + hand()), (1, "o/a", "src/x.py", None),
    ]
    docs = spark.createDataFrame(rows, "document_id bigint, repo_full_name string, relative_path string, content string").withColumn("kinds", F.lit(0)).withColumn("repo", F.lit("clash"))
    upstream = spark.createDataFrame([("lib", "copy.py", library), (None, None, None)], "library_name string, file_name string, content string")
    out = handwritten.classify_files(docs, upstream).collect()
    assert len(out) == len(rows)
    kinds = {}
    for r in out:
        kinds.setdefault(r.document_id, set()).update(r.kinds)
    want = {2: "generated", 4: "generated", 5: "data", 6: "minified", 7: "vendored", 9: "vendored", 10: "generated"}
    assert {k for k, v in kinds.items() if v} == set(want)
    assert all(v in kinds[k] for k, v in want.items())
    assert handwritten.classify_files(docs.limit(0), upstream.limit(0)).count() == 0


def source_of(rng, lines):
    """Statements of names that occur nowhere else."""
    name = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(8))
    forms = ["{a} = {b}.{c}({d})", "if {a} is None: return {b}", "for {a} in {b}: {c}.{d}()", "{a}.{b} = [{c} for {c} in {d}]", "log.debug('{a}', {b})", "assert {a} > 3, '{b}'", "with {a}({b}) as {c}: {d}.run()"]
    return "\n".join(rng.choice(forms).format(a=name(), b=name(), c=name(), d=name()) for _ in range(lines))


def vendored(spark, rows, upstream=()):
    docs = spark.createDataFrame(rows, "document_id bigint, repo_full_name string, relative_path string, content string")
    known = spark.createDataFrame(list(upstream), "library_name string, file_name string, content string")
    return {r.document_id for r in handwritten.classify_files(docs, known).collect() if "vendored" in r.kinds}


def test_parts_of_a_bundle_are_vendored(spark):
    rng = random.Random(11)
    parts = [source_of(rng, 30) for _ in range(40)]
    rows = [(i, f"o/{i}", "src/a.py", p + "\n" + source_of(rng, 10)) for i, p in enumerate(parts)] + [(100 + i, f"o/h{i}", "src/a.py", source_of(rng, 40)) for i in range(10)]
    assert vendored(spark, rows, [("lib", "bundle.py", "\n".join(parts))]) == set(range(40))


def test_fingerprints_meet_in_any_long_stretch():
    rng = random.Random(12)
    for _ in range(200):
        common = [str(rng.random()) for _ in range(handwritten.GRAM + handwritten.WINDOW - 1)]
        a, b = ([str(rng.random()) for _ in range(rng.randrange(300))] + common + [str(rng.random()) for _ in range(rng.randrange(300))] for _ in range(2))
        assert set(handwritten.fingerprints(a)[1]) & set(handwritten.fingerprints(b)[1])


def test_copies_meet_whose_fingerprints_are_all_frequent(spark, monkeypatch):
    monkeypatch.setattr(handwritten, "BLOCK", 4)
    rng = random.Random(13)
    rows, copies = [], set()
    for lib in range(3):
        pieces = [source_of(rng, 12) for _ in range(4)]
        for side in "ab":
            copies.add(len(rows))
            rows.append((len(rows), f"o/{lib}{side}", "src/a.py", "\n".join(piece + "\n" + source_of(rng, 2) for piece in pieces)))
        for piece in pieces:
            for _ in range(12):
                rows.append((len(rows), f"o/{len(rows)}", "src/a.py", piece + "\n" + source_of(rng, 40)))
    assert vendored(spark, rows) == copies


def test_markers_anywhere_in_a_file():
    licence = "\n".join(f"// line {i} of a licence" for i in range(40)) + "\n"
    code = "\n".join(f"let a{i} = b{i}(c);" for i in range(40)) + "\n"
    assert handwritten.marks("a.ts", licence + "// Code generated by tool. DO NOT EDIT.\n" + code) == ["generated:comment"]
    assert handwritten.marks("a.ts", code + "// copied from left-pad v1.2\n" + code) == ["vendored:comment"]
    assert handwritten.marks("a.js", "/* banner */\n" + '"use strict";\nObject.defineProperty(exports, "__esModule", {});\n' + code) == ["generated:compiled"]
    assert handwritten.marks("deps.json", '{\n "name": "' + "x" * 500 + '",\n "lockfileVersion": 3\n}') == ["generated:lock"]
    # a program that writes such comments is not marked by them
    assert handwritten.marks("a.ts", code + "const head = `\n// Code generated by tool. DO NOT EDIT.\n`;\n" + code) == []


def test_several_templates_in_mixed_order_are_reuse():
    rng = random.Random(14)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    forms = ["  get_{a}(): number {{ return this.{b}; }}", "  set_{a}({b}: number): void {{ this.{c} = {b}; this.{d}(); }}"]
    text = "\n".join(rng.choice(forms).format(a=name(), b=name(), c=name(), d=name()) for _ in range(120))
    assert handwritten.form(text)["reuse"] >= handwritten.REUSED
    assert max(handwritten.form(source_of(rng, 150))["reuse"] or 0.0 for _ in range(20)) < handwritten.REUSED


def test_grammars_decide_without_paths_and_comments(spark, monkeypatch):
    found = lambda: {r.document_id: set(r.reasons) for r in queries.p4_files(spark, "/root/testdata/sf0.01").where("not handwritten").collect()}
    whole = found()
    monkeypatch.setattr(handwritten, "marks", lambda path, text: [])
    by_form = found()
    # what paths and comments alone tell is gone, all else stays, and rests on grammars or on white space
    assert set(by_form) == {k for k, v in whole.items() if any(x.endswith((":form", ":shared")) for x in v)}
    assert len(by_form) >= 0.5 * len(whole)
    with_grammars = handwritten.form
    monkeypatch.setattr(handwritten, "form", lambda text: with_grammars(text) | {"reuse": None, "packed": None})
    monkeypatch.setattr(handwritten, "shared_cover", lambda bodies, repos: [0.0] * len(bodies))
    assert len(found()) < 0.5 * len(by_form)


def test_recall_of_copies_of_a_part_of_a_much_longer_file(spark):
    rng = random.Random(15)
    rows, upstream = [], []
    for i in range(40):
        lines = source_of(rng, 400).splitlines()
        at = rng.randrange(360)
        rows.append((i, f"o/{i}", "src/a.py", "\n".join(lines[at : at + 30]) + "\n" + source_of(rng, 18)))
        upstream.append((f"lib{i}", "long.py", "\n".join(lines)))
    assert len(vendored(spark, rows, upstream)) >= 38


# ------------------------------------------------------------------ 5 personal information


@pytest.fixture(scope="module")
def names(spark):
    return pii.Names([tuple(r) for r in table(spark, SMALL, "known_name").select("name", "name_part").collect()])


CASES = [
    ("Mail a.b+c@mail.brindle.example now.", [("EMAIL", "a.b+c@mail.brindle.example")]),
    ('cc "x y"@example.com', [("EMAIL", '"x y"@example.com')]),
    ("at ysaova_e at ops dot kelda dot example.", [("EMAIL", "ysaova_e at ops dot kelda dot example")]),
    ("see k.l [at] post [dot] tarnow [dot] test", [("EMAIL", "k.l [at] post [dot] tarnow [dot] test")]),
    ("git clone git@forge.example:a/b.git and npm install x@8.3.1", []),
    ("build@runner-02:~$ make, ${DB_USER}@${DB_HOST}, @app.route('/x')", []),
    ("The desk ((312) 555-0119) saw it", [("PHONE", "(312) 555-0119")]),
    ("Call +44 (0)1632 960234 or (0033 1.99.00.29.55)", [("PHONE", "+44 (0)1632 960234"), ("PHONE", "0033 1.99.00.29.55")]),
    ("job 0053070223, epoch 1786612721509 vs 1728093336609, trace id 520-1490-92, partition 935-16-1391, 10.39.79.90:2932", []),
    ("my SSN 945 25 2582 although", [("ID_NUMBER", "945 25 2582")]),
    ("validator=DNI value=09988161-U result", [("ID_NUMBER", "09988161-U")]),
    ("driver's licence X558-3475-6250", [("ID_NUMBER", "X558-3475-6250")]),
    ("ship to Flat 14, 780 Harrow Lane, Tillingham as usual", [("ADDRESS", "Flat 14, 780 Harrow Lane, Tillingham")]),
    ("at Amselstr. 29a, Rehwalde gives", [("ADDRESS", "Amselstr. 29a, Rehwalde")]),
    ("7 rue des Orfèvres, 00655 Saint-Arvil", [("ADDRESS", "7 rue des Orfèvres, 00655 Saint-Arvil")]),
    ("The Nimble Street View layer is empty.", []),
    ("ask Dr. Tesner, Pellena J. or ORIK O'MAREC", [("NAME", "Tesner, Pellena J."), ("NAME", "ORIK O'MAREC")]),
    ("It is @Own-Name1 here; own-name12 and xown-name1 are others", [("HANDLE", "Own-Name1")]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_spans(names, text, want):
    assert [(k, text[s:e]) for s, e, k in pii.find_spans(text, names, "own-name1")] == want


@pytest.mark.parametrize("text", ['{"ni": "QQ123456C"}', "NI#QQ123456C", "NI\nQQ123456C", "NI\u00a0QQ123456C", "id\ncard 12345678", "id  card: 12345678", "ann[at\t]example[dot]org"])
def test_gates_are_no_narrower_than_their_patterns(names, text):
    ungated = {(s, e, kind) for f, kind in ((pii.propose_ids, "ID_NUMBER"), (pii.propose_emails, "EMAIL")) for s, e, score in f(text) if score >= pii.ACCEPT}
    assert ungated <= set(pii.find_spans(text, names))
    low = text.lower()
    if pii.ID_NUMBER.search(text):
        assert any(x in low for x in pii.LABEL_PARTS) or pii.SHORT_LABELS.search(text)


def test_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and not pii.luhn("")
    assert pii.mod97("WEST12345698765432" + "GB82".replace("GB", "1611")) and not pii.mod97("1234")
    assert pii.letter23("12345678", "z") and not pii.letter23("12345678", "A")
    assert pii.mod11_10("36574261809") and not pii.mod11_10("36574261808")


def test_checksums_decide_where_no_label_does(names, monkeypatch):
    find = lambda t: [(k, t[a:b]) for a, b, k in pii.find_spans(t, names)]
    good = ["On my identity papers it reads 12345678Z, see above.", "The passport office has 36574261809 on file.", "Please use my IBAN: pay to GB82 WEST 1234 5698 7654 32 today."]
    bad = ["On my identity papers it reads 12345678A, see above.", "The passport office has 36574261808 on file.", "Please use my IBAN: pay to GB83 WEST 1234 5698 7654 32 today.", "The cache key 12345678Z is stale."]
    assert [find(t) for t in good] == [[("ID_NUMBER", "12345678Z")], [("ID_NUMBER", "36574261809")], [("ID_NUMBER", "GB82 WEST 1234 5698 7654 32")]]
    assert [find(t) for t in bad] == [[]] * 4
    # behind a line end a label alone is not enough
    assert find("DNI:\n12345678Z") == [("ID_NUMBER", "12345678Z")] and find("DNI:\n12345678A") == []
    monkeypatch.setattr(pii, "confirmed", lambda value: False)
    assert [find(t) for t in good] == [[]] * 3 and find("DNI:\n12345678Z") == []


def test_names_beyond_the_list_whatever_its_length():
    rng = random.Random(17)
    part = lambda n: "".join(rng.choice("abdefgiklmnoprstuvz") for _ in range(n))
    heads, tails = sorted({part(5) for _ in range(500)}), sorted({part(5) for _ in range(500)})
    listed = [(h + tails[(i * 7 + k * 11) % len(tails)], "family") for i, h in enumerate(heads) for k in range(6)]
    known = pii.Names([*listed, ("Orik", "given")])
    fresh = heads[0] + tails[200]
    assert fresh not in {n for n, _ in listed} and len(heads) * len(tails) > 200_000
    assert known.of(fresh) == {"family"} and not known.of("qx" + tails[0])
    assert [k for _, _, k in pii.find_spans(f"ask Orik {fresh.title()} first", known)] == ["NAME"]


def test_scan_edges(spark):
    rows = [(1, None, None), (2, "", ""), (3, "😀 Mail a@b.example", "Orik Tesner"), (4, "x" * 300_000 + " a@b.example", "a@b.example"), (None, "hi", "ghost"), (3, "😀 Mail a@b.example", "Orik Tesner")]
    df = spark.createDataFrame(rows, "evidence_id bigint, body string, reporter_username string").withColumn("pii_type", F.lit(1))
    out = pii.scan(df, table(spark, SMALL, "known_name"))
    got = Counter(tuple(r) for r in pii.occurrences(out).collect())
    assert got == Counter({(3, "body", "EMAIL", 7): 2, (3, "reporter_username", "NAME", 0): 2, (4, "body", "EMAIL", 300_001): 1, (4, "reporter_username", "EMAIL", 0): 1})
    red = {r.evidence_id: r.body_redacted for r in out.collect()}
    assert red[3] == "😀 Mail [EMAIL]" and red[1] is None and red[2] == ""
    assert pii.scan(df.limit(0), table(spark, SMALL, "known_name").limit(0)).count() == 0


# ------------------------------------------------------------------ 6 encoding


@pytest.fixture(scope="module")
def reference():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_encoding_equals_the_library(reference, text):
    assert bpe.encoder().encode(text) == reference.encode_ordinary(text)


def test_encoding_of_long_pretokens_and_special_strings(reference):
    rng = random.Random(1)
    for text in ("<|endoftext|>", "a" * 50_000, "".join(rng.choice("abcde") for _ in range(50_000)), " " * 3000, "漢字" * 4000, "\r\n\t " * 99):
        assert bpe.encoder().encode(text) == reference.encode_ordinary(text)


def test_rank_queue_is_a_priority_queue():
    rng, q, held = random.Random(3), bpe.RankQueue(50_257), {}
    for i in range(3000):
        if held and rng.random() < 0.4:
            r = q.least()
            assert r == min(held) and q.take(r) == held.pop(r)
        else:
            r = rng.randrange(50_257)
            q.push(r, i)
            held.setdefault(r, []).append(i)
    while held:
        r = q.least()
        assert q.take(r) == held.pop(r)
    assert q.least() == -1


def test_corpus_encoding_edges(spark, reference):
    rows = [(1, None), (2, ""), (3, "hello world"), (None, "x"), (3, "hello world")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    out = bpe.encode_corpus(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert sorted(((r.doc_id, r.ids) for r in out.collect()), key=str) == sorted([(1, []), (2, []), (3, reference.encode_ordinary("hello world")), (None, reference.encode_ordinary("x")), (3, reference.encode_ordinary("hello world"))], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 7 packing


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 64).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_is_best_fit_decreasing(case):
    capacity, items = case
    rests: list[int] = []
    for size in sorted(items, reverse=True):
        fits = [x for x in rests if x >= size]
        if fits:
            rests.remove(min(fits))
            rests.append(min(fits) - size)
        else:
            rests.append(capacity - size)
    used: Counter = Counter()
    for n, first, until, per, base in packing.plan_bins(Counter(items).items(), capacity):
        for k in range(first, until):
            used[base + (k - first) // per] += n
    assert sorted(capacity - v for v in used.values()) == sorted(rests)


@pytest.mark.parametrize("part", [packing.PART, 7])
def test_packing_places_everything_once(spark, monkeypatch, part):
    monkeypatch.setattr(packing, "PART", part)
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 5, 900, 2048, 2049, rng.randint(1, 5000)])) for i in range(3000)] + [(None, 7), (1, 5), (9999, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("piece", F.lit(3)).withColumn("container_id", F.lit("x"))
    out = packing.pack_sizes(df).collect()
    bins: Counter = Counter()
    for r in out:
        bins[r.container_id] += r.n_tokens
    assert max(bins.values()) <= 2048
    assert sum(bins.values()) == sum(n for _, n in rows if n and n > 0)
    assert sorted(bins) == list(range(len(bins)))
    assert len(bins) <= 1.02 * sum(bins.values()) / 2048 + 1
    assert all(r.piece == 0 for r in out if dict(rows).get(r.doc_id, 0) and dict(rows)[r.doc_id] <= 2048 and r.doc_id != 1)
    assert packing.pack_sizes(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 8 quality


def test_ranks_are_exact_and_give_the_tails(spark):
    rng = random.Random(2)
    stats = list(quality.RANKED)[:2]
    rows = [(rng.choice("ab"), rng.choice(stats), round(rng.choice([0.0, rng.random()]), 2)) for _ in range(800)]
    ranks = quality.exact_ranks(spark.createDataFrame(rows, "grp string, stat string, value double"))
    got = {(r.grp, r.stat, r.value): (r.upto, r.total) for r in ranks.collect()}
    scales = {(r.grp, r.stat): r for r in quality.tail_scales(ranks).collect()}
    for g, s, v in set(rows):
        same = sorted(x for a, b, x in rows if (a, b) == (g, s))
        assert got[g, s, v] == (sum(x <= v for x in same), len(same))
        middle, body = (next(x for x in same if sum(y <= x for y in same) >= p * len(same)) for p in (0.5, 0.8))
        assert scales[g, s].body == body and scales[g, s].scale == pytest.approx(max((body - middle) / quality.math.log(2.5), quality.RANKED[s][1]))


def test_statistics_by_hand():
    common = quality.Tokens(quality.languages_of({"en": {"the", "is"}, "de": {"ist"}}))
    s = quality.statistics("The cat is here.\nno end\n\n- item one", common, quality.np.zeros(729))
    assert (s["word_count"], s["n_lines"], s["language"]) == (8, 3, "en")
    assert s["mean_word_length"] == 3.0 and s["common_share"] == 0.25
    assert s["line_end_share"] == pytest.approx(1 / 3, abs=1e-4) and s["marker_share"] == pytest.approx(1 / 3, abs=1e-4)


def test_kinds(spark):
    rng = random.Random(7)
    words = [w for (w,) in table(spark, SMALL, "common_word").where("lang = 'en'").select("word").collect()]
    nouns = ["window", "buffer", "report", "reader", "change", "server", "answer", "column", "module", "button"]
    prose = lambda: " ".join(f"{rng.choice(words)} {rng.choice(nouns)} {rng.choice(nouns)}" for _ in range(30)).capitalize() + "."
    rows = [(i, prose(), "en") for i in range(200)]
    special = {
        1000: ("- one thing\n- another thing\n- third thing\n- last thing", "list"), 1001: ("quiet reader\nloud server\nnew column\nred button", "list"), 1002: ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"),
        1003: ("a\tb\tc\n1\t2\t3\n4\t5\t6", "table"), 1004: ("xkq zzvt qqpw jjk " * 20, "junk"), 1005: ("9f8a7c6b5e4d3c2b1a" * 30, "junk"), 1006: ("{}[]<>?!&%$ " * 30, "junk"), 1007: ("Loading, please wait. " * 30, "junk"),
    }
    rows += [(i, t, None) for i, (t, _) in special.items()] + [(2000, None, "en"), (2001, "", None), (2002, " \n ", "xx"), (None, prose(), "EN"), (5, prose(), "en"), (3000, prose() * 3000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("kind", F.lit(1)).withColumn("row", F.lit(2))
    out = quality.document_statistics(df, table(spark, SMALL, "common_word")).collect()
    assert len(out) == len(rows)
    kinds = {r.doc_id: r.kind for r in out if r.doc_id is not None and r.doc_id >= 1000}
    assert kinds == {**{i: k for i, (_, k) in special.items()}, 2000: None, 2001: None, 2002: None, 3000: "prose"}
    assert all(r.kind == "prose" for r in out if r.doc_id is not None and r.doc_id < 1000)
    assert quality.document_statistics(df.limit(0), table(spark, SMALL, "common_word")).count() == 0


@pytest.mark.parametrize(("text", "kind"), [
    ("- one thing\n- another thing\n- third thing\n- last thing", "list"), ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"), ("xkq zzvt qqpw jjk " * 20, "junk"),
])
def test_kinds_of_texts_copied_into_a_third_of_the_rows(spark, text, kind):
    rng = random.Random(8)
    words = [w for (w,) in table(spark, SMALL, "common_word").where("lang = 'en'").select("word").collect()]
    nouns = ["window", "buffer", "report", "reader", "change", "server", "answer", "column", "module", "button"]
    rows = [(i, " ".join(f"{rng.choice(words)} {rng.choice(nouns)} {rng.choice(nouns)}" for _ in range(30)).capitalize() + ".", "en") for i in range(120)]
    # declared in two languages, the copies are still one text over all
    rows += [(1000 + i, text, "en" if i % 2 else "de") for i in range(60)]
    out = quality.document_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), table(spark, SMALL, "common_word")).collect()
    assert len(out) == len(rows)
    assert {r.kind for r in out if r.doc_id >= 1000} == {kind} and {r.kind for r in out if r.doc_id < 1000} == {"prose"}
    assert all((r.outlier_score >= quality.JUNK) == (kind == "junk") for r in out if r.doc_id >= 1000)


def test_tails_decide(spark, monkeypatch):
    count = lambda: Counter(r.kind for r in queries.p8_found(spark, SMALL).collect())
    whole = count()
    assert whole["junk"] > 0
    monkeypatch.setattr(quality, "JUNK", 1e9)
    without = count()
    assert without["junk"] == 0 and sum(without.values()) < sum(whole.values())


# ------------------------------------------------------------------ queries

COLUMNS = {
    "p1_found": "evidence_id_a bigint, evidence_id_b bigint", "p2_found": "record_id bigint, group_key string", "p3_found": "chunk_id string, file_path string, qualified_symbol_name string", "p4_found": "document_id bigint",
    "p5_found": "evidence_id bigint, field_name string, pii_type string, start_pos int", "p6_ids": "doc_id bigint, ids array<int>", "p8_found": "doc_id bigint, kind string",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_smallest_data(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    if name in COLUMNS:
        assert df.dtypes == [(f.name, f.dataType.simpleString()) for f in T._parse_datatype_string(COLUMNS[name]).fields]
    assert df.count() > 0


def test_checkpoints_go_where_the_session_says(spark):
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
