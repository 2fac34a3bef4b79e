"""The core operators: parity with SQL, pinned values, folds against plain models, sources and streams."""

from __future__ import annotations

import datetime
import decimal
import io
import json
import math
import random
import tarfile

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from issuelake.functions import sql
from issuelake.functions import text as tx
from issuelake.operators import allocate, chunking, evaluate, index, profile, ranking, records, retrieval, search, sourcefiles
from issuelake.operators import relational as rel
from issuelake.plans import ORACLES, QUERIES
from issuelake.sources import files
from issuelake.sources.paged import PagedIssues
from issuelake.streaming import feeds

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    import os

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    rows = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted(want, key=key)


def test_pages_are_bounded(spark):
    df = spark.range(10)
    with pytest.raises(ValueError):
        rel.page(df, [F.col("id")], 0)
    with pytest.raises(ValueError):
        rel.page(df, [F.col("id")], 101)
    assert [r.id for r in rel.page(df, [F.desc("id")], 2, 1).collect()] == [8, 7]


def test_upsert_of_a_null_and_of_columns(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    s = spark.createDataFrame([(2, None, 9), (3, "c", 3)], "k int, x string, y int")
    assert sorted(map(tuple, rel.upsert(t, s, ["k"]).collect())) == [(1, "a", 1), (2, None, 9), (3, "c", 3)]
    assert sorted(map(tuple, rel.upsert(t, s, ["k"], ["y"]).collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]


def test_fusion_has_its_published_value(spark):
    v = spark.createDataFrame([("a", 1), ("b", 2)], "id string, vrank int")
    w = spark.createDataFrame([("b", 1), ("c", 2)], "id string, lrank int")
    got = {r.id: r.raw_rrf_score for r in retrieval.fuse(v, w, "id").collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


def test_covers():
    assert retrieval.cover_score(["a", "b"], ["a", "b"], 0.1) == 0.1
    assert retrieval.cover_score(["a", "x", "b", "a"], ["a", "b"], 0.1) == pytest.approx(0.1 / 2 + 0.1)
    assert retrieval.cover_score(["a", "x"], ["a", "b"], 0.1) == 0


def test_nearest_handles_zero_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = retrieval.nearest(df, df.where("vec_id = 1"), 5).collect()
    assert [r.vec_id for r in got] == [1, 3, 2, 4, 5] and got[2].similarity is None
    each = retrieval.nearest_each(df, df, 3, dims=2).collect()
    assert {(r.query_id, r.id) for r in each} == {(1, 3), (3, 1)}


def test_nearest_of_many_copies_are_those_of_least_id(spark):
    rng = random.Random(4)
    rows = [(i, [1.0, 1.0] if i % 3 == 0 else [rng.random(), -rng.random()]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    got = {}
    for r in retrieval.nearest_each(df, df.where("vec_id < 5"), 10, dims=2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    copies = [i for i in range(400) if i % 3 == 0]
    for q in (0, 3):
        assert [got[q][n] for n in range(1, 11)] == [i for i in copies if i != q][:10]


def test_suffixes(spark):
    df = spark.createDataFrame([("a/b.py", "b.py", True), ("ab.py", "b.py", False), ("b.py", "b.py", True)], "x string, y string, want boolean")
    assert all(r.got == r.want for r in df.select("want", tx.ends_with_path(F.col("x"), F.col("y")).alias("got")).collect())


def test_measures(spark):
    df = spark.createDataFrame([(["x/a.py", "b.py", "a.py"], ["a.py", "c.py"]), ([], ["a.py"]), (["a.py"], [])], "got array<string>, want array<string>")
    g, w = F.col("got"), F.col("want")
    rows = df.select(evaluate.recall_at(g, w, 1).alias("r"), evaluate.precision_at(g, w, 2).alias("p"), evaluate.reciprocal_rank(g, w, 5).alias("m")).collect()
    assert [tuple(r) for r in rows] == [(0.5, 0.5, 1.0), (0.0, 0.0, 0.0), (None, 0.0, None)]


def test_published_classification_scores(spark):
    counts = {("HIGH", "HIGH"): 48, ("HIGH", "MED"): 2, ("MED", "HIGH"): 10, ("MED", "MED"): 14, ("MED", "LOW"): 2, ("LOW", "MED"): 2, ("LOW", "LOW"): 12}
    m = spark.createDataFrame([(t, p, n) for (t, p), n in counts.items()], "truth string, predicted string, n bigint")
    assert {r.label: r.f1 for r in evaluate.class_scores(m).collect()} == {"HIGH": 0.8889, "MED": 0.6364, "LOW": 0.8571}


def test_upper_median_with_ties(spark):
    for values in ([3], [1, 2], [5, 5, 1, 5], [4, 1, 3, 2, 2]):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert profile.upper_median(df, "v").first()[0] == sorted(values)[len(values) // 2]


def test_ring_turns_around(spark):
    df = spark.createDataFrame([("a", "x", 3), ("b", "x", 2), ("c", "y", 1)], "n string, g string, s int")
    ring = ranking.rotation_ring(df, F.col("g"), [F.desc("s")])
    assert [r.n for r in ring.orderBy("pos").collect()] == ["a", "c", "b"]
    assert [r.n for r in ranking.ring_slice(ring, 2, 2).orderBy("turn").collect()] == ["b", "a"]


def test_windows_and_sections_of_edge_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "\n".join(map(str, range(76)))), (5, "# A\ntext\n## B\n#no")], "id int, t string")
    got = [(r.id, r.start_line, r.end_line) for r in ranking.line_windows(df, F.col("t")).where("id < 5").orderBy("id", "start_line").collect()]
    assert got == [(3, 1, 1), (4, 1, 40), (4, 36, 75), (4, 71, 76)]
    sections = [(r.section, r.heading, r.content) for r in ranking.heading_sections(df, ["id"], F.col("t")).where("id = 5").orderBy("section").collect()]
    assert sections == [(1, "A", "# A\ntext"), (2, "B", "## B\n#no")]


def test_every_file_gives_chunks(spark):
    long = "def f():\n" + "    x = 1\n" * 129
    rows = [(1, "a.go", "x\n" * 60), (2, "b.py", "def ("), (3, "c.py", "x = 1\n"), (4, "d.py", long), (5, "e.js", "y" * 8000 + "\nz\n"), (6, None, "q"), (7, "g.py", None), (8, "h.c", "")]
    df = spark.createDataFrame(rows, "id int, path string, content string")
    got = sorted((r.id, r.symbol_type, r.start_line, r.end_line) for r in chunking.symbol_chunks(df, "id", "path", "content").collect())
    assert got == [
        (1, "text_block", 1, 50), (1, "text_block", 41, 60), (2, "text_block", 1, 1), (3, "text_block", 1, 1), (4, "function_part", 1, 50), (4, "function_part", 41, 90), (4, "function_part", 81, 130),
        (5, "text_block", 1, 1), (5, "text_block", 2, 2), (6, "text_block", 1, 1),
    ]


def test_python_symbols():
    source = '"""Doc."""\n@x\ndef f():\n    def inner(): pass\n\nclass A:\n    def m(self): pass\n    class B:\n        async def n(self): pass\n'
    assert [s[:2] for s in chunking.python_symbols(source)] == [("module_docstring", "module"), ("function", "f"), ("class", "A"), ("method", "A.m"), ("class", "A.B"), ("method", "A.B.n")]
    assert chunking.python_symbols("def (") == [] and chunking.python_symbols("") == []


@given(st.lists(st.tuples(st.sampled_from(sorted(allocate.SHARES)), st.lists(st.integers(1, 50), min_size=1, max_size=5)), max_size=20), st.integers(1, 400))
def test_two_stage_budget_keeps_to_the_budget(files_, budget):
    rows = [(k, str(i), c) for i, (k, c) in enumerate(files_)]
    got = allocate.admit(rows, budget, allocate.SHARES, 10)
    assert len(got) <= 10 and sum(sum(rows[i][2][:n]) for i, n in got.items()) <= budget


@given(st.dictionaries(st.text(min_size=1, max_size=3), st.integers(0, 30), max_size=6), st.integers(0, 100))
def test_balanced_quotas(sizes, budget):
    got = allocate.balanced_quotas(sizes, budget)
    assert sum(got.values()) == min(budget, sum(sizes.values()))
    assert all(got[k] <= sizes[k] for k in sizes)


@given(st.lists(st.tuples(st.floats(0, 300), st.integers(1, 50)), max_size=40))
def test_limits_hold_in_every_window(requests):
    requests.sort()
    at = allocate.limiter([t for t, _ in requests], [c for _, c in requests], 1.0, 5, 100)
    assert all(a >= t for a, (t, _) in zip(at, requests))
    assert all(b - a >= 1.0 - 1e-9 for a, b in zip(at, at[1:]))


def test_evidence_is_packed_like_the_plain_fold(spark):
    items = [(1, 9000), (2, 5000), (3, 4000), (4, 100), (5, 20_000)]
    rows = [("k", i, t) for i, t in items] + [("one", 1, 99_000), (None, 1, 5)]
    df = spark.createDataFrame(rows, "key string, id int, tokens bigint")
    spent, ids = 0, []
    for i, t in items:
        if spent + t + 50 <= 14_000 or len(ids) < 2:
            spent, ids = spent + t + 50, [*ids, i]
    got = sorted(tuple(r)[:2] for r in allocate.pack_in_order(df, ["key"], [F.col("id")], F.lit(14_000)).where("key is not null").collect())
    assert got == [("k", i) for i in ids] + [("one", 1)]
    assert allocate.pack_in_order(df, ["key"], [F.col("id")], F.lit(14_000)).where("key is null").count() == 1


def test_a_package_is_reduced_from_its_end(spark):
    df = spark.createDataFrame([("r", False, 1, 500, 1), ("r", False, 2, 400, 2), ("r", False, 3, 300, 3), ("r", True, 4, 900, 1)], "key string, test boolean, id int, tokens bigint, pos int")
    left = lambda budget: sorted(r.id for r in allocate.reduced(df, ["key"], budget).collect())
    assert left(2100) == [1, 2, 3, 4] and left(1800) == [1, 2, 4] and left(10) == [1, 4]


def test_groups_are_held_out_whole(spark):
    df = spark.createDataFrame([(i, f"g{i % 17}", "L" if i % 3 else None) for i in range(300)], "id int, g string, l string")
    out = allocate.holdout_split(df, "g", "l", {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()
    assert len(out) == 300 and len({(r.g, r.l) for r in out}) == len({(r.g, r.l, r.split) for r in out})


# ------------------------------------------------------------------ sources and sinks


def test_json_lines_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"repo": "A/b", "n": 1, "v": 1}\n\nnot json\n{"repo": "a/B", "n": 1, "v": 2}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "repo string, n int, v int", [F.lower("repo"), F.col("n")], "v").collect()
    assert [(r.repo, r.v) for r in rows] == [("a/B", 2)]


def test_golden_set_and_writers(spark, tmp_path):
    (tmp_path / "g.csv").write_text('issue_id,ground_truth_files\n1,"a.py, b.py,"\n2,\n')
    g = files.read_golden(spark, str(tmp_path / "g.csv"))
    assert {r.issue_id: r.ground_truth_files for r in g.collect()} == {"1": ["a.py", "b.py"], "2": []}
    files.write_csv(g.withColumn("title", F.lit("one\ntwo three")), str(tmp_path / "out"), {"title": 7})
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r.ground_truth_files, r.title) for r in back} == {("a.py; b.py", "one two"), (None, "one two")}
    files.write_jsonl(g.withColumn("split", F.lit("train")), str(tmp_path / "j"), ["split"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    files.write_snapshot(g, str(tmp_path / "s"), "s1")
    assert spark.read.parquet(str(tmp_path / "s")).select("snapshot_id").distinct().first()[0] == "s1"


def test_trees_and_archives(spark, tmp_path):
    tree = tmp_path / "tree" / "sub"
    tree.mkdir(parents=True)
    (tree / "a.py").write_text("x\ny")
    (tree / "b.bin").write_bytes(b"a\x00b")
    (tree / "c.py").write_text("")
    got = {r.relative_path.split("/")[-1]: (r.loc, r.is_binary) for r in files.read_tree(spark, str(tmp_path / "tree")).collect()}
    assert got == {"a.py": (2, False), "b.bin": (None, True)}
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, data in (("top/src/a.py", b"1\n2\n"), ("top/../../evil", b"x"), ("/abs", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("top/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        tar.addfile(link)
    (tmp_path / "r.tar.gz").write_bytes(buffer.getvalue())
    rows = files.read_archives(spark, str(tmp_path / "r.tar.gz")).collect()
    # lines are line feeds and one
    assert [(r.relative_path, r.loc, r.error) for r in rows] == [("src/a.py", 3, None)]
    (tmp_path / "s.tar.gz").write_bytes(b"no archive")
    rows = files.read_archives(spark, str(tmp_path / "*.tar.gz")).collect()
    assert {(r.archive[-8:], r.relative_path, r.error is None) for r in rows} == {("r.tar.gz", "src/a.py", True), ("s.tar.gz", None, False)}


def test_settings_and_reports(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("""# budget
languages:
  - python   # first
  - "c#"
limits: {}
budget:
  total: 40
  share: 0.5
  strict: true
  note: 'a: b'
  sizes: [1, 2, x]
queries:
  - name: one
    stars: ">100"
  - name: two
    stars:
empty:
""".replace("limits: {}\n", ""))
    assert files.read_settings(str(tmp_path / "c.yaml")) == {
        "languages": ["python", "c#"], "budget": {"total": 40, "share": 0.5, "strict": True, "note": "a: b", "sizes": [1, 2, "x"]}, "queries": [{"name": "one", "stars": ">100"}, {"name": "two", "stars": None}], "empty": None,
    }
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string")
    assert files.write_manifest(df, str(tmp_path / "m.json"), {"run": "r1"}) == {"rows": 2, "columns": {"n": "int", "t": "string"}, "run": "r1"} == json.loads((tmp_path / "m.json").read_text())
    files.write_markdown(df.orderBy("n"), str(tmp_path / "t.md"), "Rows")
    assert (tmp_path / "t.md").read_text() == "# Rows\n\n| n | t |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |\n"
    with pytest.raises(ValueError):
        files.write_markdown(df, str(tmp_path / "t.md"), "Rows", 1)
    traces = spark.sql("select 1 as id, named_struct('decision', 'PASS', 'n', 2) as s union all select 2, null")
    files.write_traces(traces, str(tmp_path / "traces"))
    assert json.loads((tmp_path / "traces" / "summary.json").read_text()) == [{"stage": "s", "decision": "PASS", "n": 1}, {"stage": "s", "decision": "SKIPPED", "n": 1}]
    assert spark.read.json(str(tmp_path / "traces" / "trace.jsonl")).count() == spark.read.option("header", True).csv(str(tmp_path / "traces" / "trace.csv")).count() == 2
    files.append_results(df, str(tmp_path / "e"), "r1")
    files.append_results(df, str(tmp_path / "e"), "r2")
    assert spark.read.parquet(str(tmp_path / "e")).groupBy("run_id").count().count() == 2


def test_paged_source_stops_at_a_short_page(spark, tmp_path):
    folder = tmp_path / "o__r"
    folder.mkdir()
    item = lambda n, pull=False: {"number": n, "title": "t", "state": "open", "html_url": f"x/{'pull' if pull else 'issues'}/{n}"}
    (folder / "1.json").write_text(json.dumps([item(1), item(2, True)]))
    (folder / "2.json").write_text(json.dumps([item(3)]))
    (folder / "3.json").write_text(json.dumps([item(4)]))
    spark.dataSource.register(PagedIssues)
    df = spark.read.format("paged_issues").options(path=str(tmp_path), repos="o/r,o/none", per_page=2).load()
    assert {(r.number, r.is_pull_request) for r in df.collect()} == {(1, False), (2, True), (3, False)}


# ------------------------------------------------------------------ streams


def run_stream(spark, df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name)


def test_streams_give_what_batches_give(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
    counts = run_stream(spark, feeds.windowed_counts(feeds.read_stream(spark, str(tmp_path / "in"), schema)), "complete", "w1").select("start", "event_type", "n")
    batch = e.groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, batch.collect()))
    assert run_stream(spark, feeds.session_counts(feeds.read_stream(spark, str(tmp_path / "in"), schema)), "append", "w2").count() >= 0
    timed = feeds.read_stream(spark, str(tmp_path / "in"), schema).withColumn("t", F.unix_micros("ts") / 1e6).withColumn("c", F.col("value").cast("bigint"))
    waits = run_stream(spark, feeds.limited(timed), "append", "w3")
    plain = allocate.quota_simulation(e.withColumn("t", F.unix_micros("ts") / 1e6).withColumn("c", F.col("value").cast("bigint")), "user_id", "t", "c")
    assert sorted(map(tuple, waits.collect())) == sorted(map(tuple, plain.collect()))


def test_uuids_and_line_ranges(spark):
    import uuid

    df = spark.createDataFrame([("https://forge.example/a/b/issues/1",), ("é",), ("",)], "n string")
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in df.select("n", tx.uuid5(F.col("n")).alias("u")).collect())
    ranges = spark.createDataFrame([("3-9",), ("7",), ("x",), (None,), (" 2 - 4 ",)], "t string").select(tx.line_range(F.col("t")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in ranges] == [(3, 9), (7, 7), (1, 30), (1, 30), (2, 4)]


def test_ties_beyond_any_margin_keep_the_least_ids_and_lengths_do_not_matter(spark):
    base = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(1, 41)] + [(50, [1.0, 2.0, 3.0]), (51, [0.0, 0.0]), (52, None), (53, [])], "vec_id bigint, embedding array<float>")
    out = retrieval.nearest_each(base, base.where("vec_id in (40, 50)"), 3).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in out) == [(40, 1, 1), (40, 2, 2), (40, 3, 3)]


def test_neighbours_within_groups(spark):
    base = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 1.0]), ("c", "y", [1.0, 0.0])], "id string, g string, v array<double>")
    asked = spark.createDataFrame([(1, "x", [1.0, 0.1]), (2, "z", [1.0, 0.0]), (3, "y", [0.0, 1.0])], "id bigint, g string, v array<double>")
    out = retrieval.nearest_each(base, asked, 5, "id", "v", "g").collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in out) == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")]


def test_a_group_near_to_nothing_keeps_the_kinds_of_its_ids(spark, monkeypatch):
    base = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "y", [1.0, 1.0])], "id string, g string, v array<double>")
    asked = spark.createDataFrame([("p", "x", [0.0, 0.0]), ("q", "y", [1.0, 0.0])], "id string, g string, v array<double>")
    assert [(r.query_id, r.id, r["rank"]) for r in retrieval.nearest_each(base, asked, 5, "id", "v", "g").collect()] == [("q", "b", 1)]
    # two blocks, of which one is empty
    monkeypatch.setattr(retrieval, "BASE_BLOCK", 1)
    twice = base.where("id = 'b'")
    assert sorted((r.query_id, r.id, r["rank"]) for r in retrieval.nearest_each(twice.union(twice), asked, 5, "id", "v", "g").collect()) == [("q", "b", 1), ("q", "b", 2)]


@pytest.fixture(scope="module")
def cancelled(spark, tmp_path_factory):
    """Two repositories; the words of the first one's only question share a dimension and differ in sign, so that its vector is zero."""
    d = str(tmp_path_factory.mktemp("cancelled"))
    chunks = [
        ("000000aa", "s1", "r/one", "src/a.py", "bindShard", "function", "bindShard function of a"), ("000001bb", "s1", "r/one", "src/b.py", None, None, "nothing"),
        ("000014cc", "s2", "r/two", "src/c.py", "load_page", "function", "load_page function"), ("000015dd", "s2", "r/two", "tests/c.py", None, None, "load_page and other words"),
    ]
    c = spark.createDataFrame(chunks, "chunk_id string, snapshot_id string, repo_name string, file_path string, symbol_name string, symbol_type string, raw_content string")
    c.selectExpr("*", "cast(null as string) info_class", "1 start_line", "9 end_line", "cast(null as string) contextual_header").write.parquet(f"{d}/code_chunk.parquet")
    spark.createDataFrame([("s1", "r/one", "ACTIVE", "k1"), ("s2", "r/two", "ACTIVE", "k2")], "snapshot_id string, repo_name string, status string, commit_sha string").write.parquet(f"{d}/repo_snapshot.parquet")
    return d


CANCELLED = {
    "exact_metrics": [("000000aa", 0.0, 0.0, 0.0, 0.0, 0.0), ("000014cc", 1.0, 1.0, 1.0, 1.0, 1.0)],
    "graded_relevance": [("000014cc", 1, "src/c.py", 1.0), ("000014cc", 2, "tests/c.py", 0.5)],
    "isolation_violations": [(2, 0, 1)],
    "mrr": [(2, 0.5)],
    "recall_at_k": [(1, 0.5, 0.5, 0.5), (3, 0.5, 0.25, 0.5), (5, 0.5, 0.25, 0.5), (10, 0.5, 0.25, 0.5)],
    "rolling_evaluation": [(2, 1, 0.5, 0.5, 0.5, 0.5, 0.5)],
}


@pytest.mark.parametrize("name", sorted(CANCELLED))
def test_a_repository_whose_questions_have_no_vector(spark, cancelled, name):
    con = duckdb.connect()
    for t in ("code_chunk", "repo_snapshot"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{cancelled}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES[name](spark, cancelled).collect())) == sorted(con.execute(ORACLES[name]).fetchall()) == CANCELLED[name]


def test_every_symbol_counts_in_the_mean_reciprocal_rank(spark, tmp_path):
    # of these ids, only the first is of those whose leading digits are divisible by 20; 00000b and 00000c ask the same, which is found first in the file of 00000b
    chunks = [
        ("000000aa", "s1", "r/one", "src/a.py", "alpha", "function", "alpha function"), ("000001bb", "s1", "r/one", "src/b.py", "beta", "method", "gamma method"), ("000002cc", "s1", "r/one", "src/c.py", "gamma", "method", "beta method"),
        ("00000b00", "s1", "r/one", "lib/d.py", "delta", "class", "delta class"), ("00000c00", "s1", "r/one", "lib/e.py", "Delta", "class", "delta class"), ("00000d00", "s1", "r/one", "lib/f.py", None, "class", "nothing"),
        # in another repository, of none, and in two snapshots, of which the least one counts
        ("00000e00", "s2", "r/two", "lib/g.py", "delta", "class", "other"), ("00000f00", "s3", None, "lib/h.py", "alpha", None, "alpha"), ("00001000", "s4", "r/two", "lib/x.py", None, None, "delta class"), ("00001000", "s2", "r/two", "lib/i.py", "iota", None, "iota"),
        ("00001100", "s5", "r/one", "lib/j.py", "alpha", "function", "alpha function"),
    ]
    c = spark.createDataFrame(chunks, "chunk_id string, snapshot_id string, repo_name string, file_path string, symbol_name string, symbol_type string, raw_content string")
    c.selectExpr("*", "cast(null as string) info_class", "1 start_line", "9 end_line", "cast(null as string) contextual_header").write.parquet(f"{tmp_path}/code_chunk.parquet")
    spark.createDataFrame([(f"s{i}", "r", "ACTIVE" if i < 5 else "RETIRED", "k") for i in range(1, 6)], "snapshot_id string, repo_name string, status string, commit_sha string").write.parquet(f"{tmp_path}/repo_snapshot.parquet")
    con = duckdb.connect()
    for t in ("code_chunk", "repo_snapshot"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    # by ids the ranks are 1, 2, 2, 1, 2, 1, none without a repository, and 1
    got = list(map(tuple, QUERIES["mrr"](spark, str(tmp_path)).collect()))
    assert got == con.execute(ORACLES["mrr"]).fetchall() == [(8, 0.6875)]


def test_paths_join_by_whole_suffixes_within_a_repository(spark):
    mentioned = spark.createDataFrame([("r", "src/a/index.js"), ("r", "index.js"), ("q", "a/index.js"), ("r", None)], "repo string, path string")
    files = spark.createDataFrame([("r", "a/index.js"), ("r", "lib/src/a/index.js"), ("r", "xindex.js"), ("q", "b/index.js")] + [("r", f"d{i}/index.js") for i in range(300)], "repo string, p string")
    got = {(r.path, r.p) for r in rel.suffix_join(mentioned, files, F.col("path"), F.col("p"), ["repo"]).collect()}
    assert got == {("src/a/index.js", "a/index.js"), ("src/a/index.js", "lib/src/a/index.js")} | {("index.js", p) for p in ["a/index.js", "lib/src/a/index.js", *[f"d{i}/index.js" for i in range(300)]]}


def test_a_search_needs_a_repository_and_keeps_to_it(spark):
    chunks = spark.createDataFrame(
        [("c1", "s1", "o/a", "f.py", "SOURCE_CODE", "f", 1, 2, None, "alpha beta"), ("c1", "s1", "o/a", "f.py", "SOURCE_CODE", "f", 1, 2, None, "alpha beta"), ("c2", "s2", "o/b", "f.py", None, "f", 1, 2, "", "alpha beta"), ("c3", "s3", "o/a", "g.py", "TESTS", "", 1, 2, "H", "alpha")],
        "chunk_id string, snapshot_id string, repo_name string, file_path string, info_class string, symbol_name string, start_line int, end_line int, contextual_header string, raw_content string",
    )
    snapshots = spark.createDataFrame([("s1", "o/a", "ACTIVE", "1"), ("s2", "o/b", "ACTIVE", "2"), ("s3", "o/a", "RETIRED", "0")], "snapshot_id string, repo_name string, status string, commit_sha string")
    for repo in (None, " "):
        with pytest.raises(ValueError):
            search.isolated(chunks, snapshots, repo)
    r = search.Retriever(chunks, snapshots)
    for mode in search.MODES:
        assert [x.chunk_id for x in r.chunks_for("o/a", "alpha", None, mode=mode).collect()] == ["c1"]
    assert [x.chunk_id for x in r.chunks_for("o/a", "alpha", None, commit="no such").collect()] == ["c1"]
    assert r.context_for("o/a", "alpha", "").first() == ("--- SOURCE FILE: f.py (Lines 1-2) in f ---\nalpha beta\n", ["c1"], 1)
    assert r.context_for("o/a", " ", None).first() == ("", [], 0)
    with pytest.raises(ValueError):
        r.chunks_for("o/a", "alpha", None, mode="other")


def test_ignore_files():
    import re

    def left_out(path, lines):
        out = False
        for leave, pattern in sourcefiles.gitignore(lines):
            out = leave if re.search(pattern, path) else out
        return out

    lines = ["# c", "", "*.log", "/web/", "a/**/b.txt", "!keep.log", "x[0-9].py", "tmp"]
    assert [left_out(p, lines) for p in ("d/e.log", "web/i.js", "src/web/i.js", "a/b.txt", "a/c/d/b.txt", "keep.log", "x1.py", "xa.py", "tmp/f", "atmp/f")] == [True, True, False, True, True, False, True, False, True, False]


def test_flat_rows_and_fallbacks(spark):
    df = spark.sql("select 1 as id, named_struct('decision', 'PASS', 'n', 2, 'xs', array('a', 'b'), 'ok', true) as s union all select 2, null")
    assert sorted(map(tuple, records.flat_rows(df).collect())) == [(1, "PASS", 2, "a; b", True), (2, "SKIPPED", 0, "", False)]
    some, none = spark.range(2), spark.range(0)
    assert records.or_else(some, spark.range(5, 9)).count() == 2 and records.or_else(none, spark.range(5, 9)).count() == 4


def test_sql_functions(spark):
    assert sql.register(spark) == [f[0] for f in sql.FUNCTIONS]
    row = spark.sql("select token_estimate('abcdefghi'), words_of('A b_1, c'), round(cosine_similarity(array(1d, 0d), array(1d, 1d)), 6), cosine_similarity(array(1d), array(1d, 1d)), round(rrf(array(1, null, 3), 60), 6)").first()
    assert tuple(row) == (2, ["a", "b_1", "c"], 0.707107, None, round(1 / 61 + 1 / 63, 6))


def test_postings_give_what_the_scan_gives(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    index.write_postings(docs, "doc_id", F.col("text"), str(tmp_path / "p"), 8)
    for terms in (["cache", "panel"], ["the"], ["no_such_word", "the"]):
        want = retrieval.matching_all(docs, terms, "doc_id", F.col("text"), 20).collect()
        assert [tuple(r) for r in index.matching_indexed(spark, str(tmp_path / "p"), terms, 20, 8).collect()] == [tuple(r) for r in want]


def test_the_vector_index_holds_every_row_and_recalls_enough(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0")
    pairs = lambda df: {(r.query_id, r.id) for r in df.collect()}
    exact = pairs(retrieval.nearest_each(e, asked, 10))
    assert pairs(index.nearest_indexed(e, asked, 10, centres=16, probes=16)) == exact
    recall = len(pairs(index.nearest_indexed(e, asked, 10)) & exact) / len(exact)
    assert recall >= 0.9, recall
    assert index.nearest_indexed(e.limit(0), asked, 10).count() == 0


def test_pools_are_served_by_their_quotas_nulls_too(spark):
    rows = [(f"a{i:03}", "x") for i in range(200)] + [("b1", "y"), ("c1", None), ("c2", None), ("c3", None)]
    df = spark.createDataFrame(rows, "name string, pool string")
    got = sorted(r.name for r in allocate.balanced_select(df, "pool", [F.col("name")], 8).collect())
    # two each at first, then what is left over goes round
    assert got == ["a000", "a001", "a002", "a003", "b1", "c1", "c2", "c3"]
    assert allocate.balanced_select(df.limit(0), "pool", [F.col("name")], 8).count() == 0
