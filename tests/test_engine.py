import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.engine import Engine, collection_name, identity
from corvane.operators import catalog, chunking, evaluation, incremental, ranking, retrieval, trace
from corvane.sources.files import append_jsonl, directory, preview, read_config, read_dataset, read_jsonl, read_lines, read_tree, select_files, write_report
from corvane.sources.index_store import IndexStore, WriterConflict
from corvane.streaming import tracker

FILES = [
    ("src/shape.ts", "// A shape.\nexport class Shape {\n  area() {\n    return 1;\n  }\n}\n\nexport const unit = 1;\n"), ("src/use.ts", 'import { Shape } from "./shape"\n\nexport function make() {\n  const s = new Shape();\n  return s.area();\n}\n'),
    ("src/tests/shape.test.ts", 'import { Shape } from "../shape"\n\ntest("area", () => {\n  expect(new Shape().area()).toBe(1)\n})\n'), ("docs/guide.md", "Intro\n\n# Shape guide\n\nUse Shape.\n\n## More\n\ntext\n"), ("pkg/mod.py", "import os\n\n\ndef helper(x):\n    return x\n\n\nclass Tool:\n    def run(self):\n        return helper(1)\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "relative_path string, content string")


def test_index_search_reindex_clear(spark, files, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.index("c", files)["generation"] == 1
    top = e.search("c", "Shape class", 5).orderBy("rank").collect()
    assert top and top[0].relative_path in ("src/shape.ts", "src/use.ts") and [r.rank for r in top] == list(range(1, len(top) + 1))
    assert {r.relative_path for r in e.search("c", "Shape", 5, extensions=[".md"], target="all").collect()} == {"docs/guide.md"}
    changed = spark.createDataFrame([(p, c + "\nexport function extra() {\n  return 2\n}\n") if p == "src/use.ts" else (p, c) for p, c in FILES if p != "pkg/mod.py"], files.schema)
    out = e.reindex("c", changed)
    assert (out["modified"], out["removed"], out["added"]) == (1, 1, 0) and out["growth"] == 3
    rebuilt = {r.id for r in e.rows(changed).select("id").collect()}
    assert {r.id for r in e.store.read("c").select("id").collect()} == rebuilt
    big = changed.union(spark.createDataFrame([("big.py", "\n".join(f"x{i} = {i}" for i in range(6000)))], files.schema))
    assert e.reindex("c", big, automatic=True)["status"] == "refused" and e.status("c")["manifest"]["generation"] == 2
    part = spark.createDataFrame([("pkg/mod.py", FILES[4][1])], files.schema)
    out = e.reindex_paths("c", ["./pkg/mod.py", "docs/guide.md", "../out.py"], part)
    assert (out["added"], out["removed"], out["modified"]) == (1, 1, 0) and {r.relative_path for r in e.states.read("c").collect()} == {"src/shape.ts", "src/use.ts", "src/tests/shape.test.ts", "pkg/mod.py"}
    posted = e.posted.read("c")
    assert {r.relative_path for r in posted.select("relative_path").distinct().collect()} == {r.relative_path for r in e.store.read("c").select("relative_path").distinct().collect()}
    tests = e.search("c", "tests of Shape", 5).orderBy("rank").collect()
    assert [r.is_primary for r in tests if r.file_role == "test"] == [True] and e.search("c", "Shape", 5, threshold=2.0, weights=(0.5, 0.5), include_related=False).filter("file_role <> 'implementation'").count() == 0
    shown = e.context(e.store.read("c").filter("relative_path = 'src/shape.ts'"), changed).first()
    assert "class Shape" in shown.context
    e.clear("c")
    assert not e.has("c")


def test_reindex_tree_reuses_hashes(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "src" / f"{name}.py").write_text(f"def {name}():\n    return 1\n")
    e = Engine(spark, str(tmp_path / "index"))
    e.index_tree("t", str(tmp_path / "src"), extensions=[".py"])
    (tmp_path / "src" / "b.py").write_text("def b():\n    return 2\n\n\ndef more():\n    pass\n")
    (tmp_path / "src" / "c.py").unlink()
    out = e.reindex_tree("t", str(tmp_path / "src"), extensions=[".py"])
    assert (out["added"], out["removed"], out["modified"], out["growth"]) == (0, 1, 1, 2)
    assert {(r.relative_path, r.primary_symbol) for r in e.store.read("t").collect()} == {("a.py", "a"), ("b.py", "b"), ("b.py", "more")}


def test_capped_index(spark, files, tmp_path):
    e = Engine(spark, str(tmp_path))
    assert e.index("c", files, cap=3)["status"] == "limit_reached" and e.store.row_count("c") == 3 and e.posted.read("c").select("id").distinct().count() <= 3


def test_only_chunks_within_the_cap_are_embedded(spark, files, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def embed(texts):
        import os
        import uuid

        with open(os.path.join(str(seen), uuid.uuid4().hex), "w") as out:
            out.write("x" * len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    embedded = lambda: sum(p.stat().st_size for p in seen.iterdir())
    whole, part = Engine(spark, str(tmp_path / "whole"), embed), Engine(spark, str(tmp_path / "part"), embed)
    assert whole.index("c", files)["status"] == "completed"
    n, before = whole.store.row_count("c"), embedded()
    m = part.index("c", files, cap=n - 2)
    assert (m["status"], m["generation"]) == ("limit_reached", 1) and embedded() - before == n - 2  # as no two contents are equal
    rows = [tuple(r) for r in whole.store.read("c").orderBy("relative_path", "chunk_index").collect()]
    assert [tuple(r) for r in part.store.read("c").orderBy("relative_path", "chunk_index").collect()] == rows[:-2]
    assert whole.index("c", files, cap=n)["status"] == "completed"  # exactly the cap is no excess
    assert not list(tmp_path.glob("*/index/c/staged-*"))


def test_cap_in_path_order(spark):
    rows = [(None if i == 0 else f"d{i * 7919 % 101}/\u00e9{i}", j) for i in range(120) for j in range(i % 4 + 1)]
    df = spark.createDataFrame(rows, "relative_path string, chunk_index int")
    rows.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    for cap in (0, 1, 2, 57, 150, len(rows) - 1):
        got = sorted(((r.relative_path, r.chunk_index) for r in chunking.capped(df, cap).collect()), key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
        assert got == rows[:cap]
        assert chunking.cut(df, cap, gathered=1) == chunking.cut(df, cap)
    assert chunking.cut(df, len(rows)) is None and chunking.capped(df, len(rows)).filter("status = 'completed'").count() == len(rows)


def test_no_table_of_vectors_is_sent_to_all_tasks(spark, tmp_path):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.range(200).selectExpr("cast(id as string) id", "array(cast(id as float), 1f) vector", "'c' || id content", "'h' || id normalized_content_hash").write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "query_id string, query_vector array<float>")
    found = plan(retrieval.dense_topk(index, asked, 5))
    assert "BuildRight" in found and "BuildLeft" not in found  # the queries go to the index, not the index to the queries
    assert "Broadcast" not in plan(incremental.embed_once(index.drop("vector"), F.array(F.lit(1.0))))


def test_barrels_and_sinks(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "i"))
    rows = spark.createDataFrame([("pkg/index.ts", 'export * from "./a"\n'), ("lib/index.ts", "export function f() {\n  return 1\n}\n")], "relative_path string, content string")
    assert {r.relative_path: r.file_role for r in e.chunks(rows).collect()} == {"pkg/index.ts": "barrel", "lib/index.ts": "implementation"}
    append_jsonl(spark.createDataFrame([("a", 1), ("b", None)], "k string, v int"), str(tmp_path / "log"))
    append_jsonl(spark.createDataFrame([("a", 2)], "k string, v int"), str(tmp_path / "log"))
    (tmp_path / "log" / "z.json").write_text('{"k": "b"\n')
    assert sorted((r.k, r.v is None) for r in read_jsonl(spark, str(tmp_path / "log"), ["k"], "k string, v int").collect()) == [("a", False), ("b", True)]
    write_report(spark.range(2), str(tmp_path / "report"))
    write_report(spark.range(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    (tmp_path / "g.conf").write_text("# all\nhybridMode = true\ncustomExtensions = .x\ncustomExtensions = .y\nsearchTimeoutMs=5\n")
    (tmp_path / "p.conf").write_text("searchTimeoutMs = 9\ncustomExtensions = .z\n")
    assert read_config(spark, str(tmp_path / "g.conf"), str(tmp_path / "none.conf"), str(tmp_path / "p.conf")) == {"hybridMode": "true", "customExtensions": [".z"], "searchTimeoutMs": "9"}
    (tmp_path / "one.json").write_text('[{"instance_id": "a", "patch": "--- a/x.py"}]')
    (tmp_path / "two.jsonl").write_text('{"instance_id": "b", "patch": "--- a/y.py\\n--- a/z.py"}\n')
    data = read_dataset(spark, [str(tmp_path / "one.json"), str(tmp_path / "two.jsonl")], "instance_id string, patch string").withColumn("difficulty", F.lit("easy"))
    assert data.count() == 2 and [r.instance_id for r in evaluation.subset(data, "easy").collect()] == ["b"]
    assert read_lines(rows, 1, 1).filter("relative_path like 'lib%'").first().content == "  return 1"
    assert spark.range(1).select(evaluation.reduction_percent(F.lit(25), F.lit(100))).first()[0] == 75.0


def test_periodic_sync(spark, tmp_path):
    import time

    seen = []
    q = tracker.periodic_sync(spark, lambda name: seen.append(name), lambda: ["a", "b", "a"], str(tmp_path / "ck"), "1 second")
    until = time.time() + 60
    while len(seen) < 4 and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert seen.count("a") >= 2 and abs(seen.count("a") - seen.count("b")) <= 1


def test_names():
    assert identity("git", "git@host.org:a/b.git") == identity("git", "https://host.org/a/b") == "host.org/a/b"
    assert collection_name("x").startswith("hybrid_code_chunks_") and len(collection_name("x", "y" * 400)) == 255


def test_chunks(spark, files):
    got = {(r.relative_path, r.start_line, r.end_line, r.node_type) for r in chunking.code_chunks(files.filter("relative_path not like '%.md'")).collect()}
    assert ("src/shape.ts", 1, 6, "class_declaration") in got and ("src/shape.ts", 8, 8, "lexical_declaration") in got
    assert ("pkg/mod.py", 4, 5, "function_definition") in got and ("pkg/mod.py", 8, 10, "class_definition") in got and ("pkg/mod.py", 9, 10, "function_definition") in got
    md = chunking.markdown_sections(files.filter("relative_path like '%.md'")).orderBy("section").collect()
    assert [(r.chunk_kind, r.symbol_name, r.start_line, r.end_line) for r in md] == [("markdown_preamble", None, 1, 2), ("markdown_section", "Shape guide", 3, 6), ("markdown_section", "More", 7, 10)]
    bad = chunking.code_chunks(spark.createDataFrame([("x.ipynb", "{}"), ("y.ipynb", '{"cells":[{"cell_type":"code","source":["a","b"]}]}')], files.schema)).orderBy("relative_path").collect()
    assert bad[0].error.startswith("ValueError") and bad[1].content == "ab"


def test_large_chunks_overlap():
    pieces = list(chunking._split_large("\n".join("x" * 30 for _ in range(20)), 1, 100, 10))
    assert len(pieces) > 5 and all(len(p[2]) <= 111 for p in pieces) and pieces[1][2].startswith("x" * 10 + "\n")
    assert all(len(p) <= 50 for p in chunking.split_text("word " * 100, 50, 10))


def test_line_windows(spark, files):
    rows = chunking.line_windows(files.filter("relative_path = 'src/shape.ts'"), size=40, overlap=5).orderBy("piece").collect()
    assert rows[0].start_line == 1 and len(rows) > 2 and rows[1].content.split("\n")[0] == rows[0].content[-5:].split("\n")[0]


def test_trace(spark, files):
    got = {(r.kind, r.relative_path, r.line): r for r in trace.trace_symbol(files, "Shape").collect()}
    assert ("definition", "src/shape.ts", 2) in got and got["import", "src/use.ts", 1].resolved_path == "src/shape.ts"
    assert got["reference", "src/use.ts", 4].enclosing_symbol == "make" and ("related_test", "src/tests/shape.test.ts", 4) in got
    with pytest.raises(ValueError):
        trace.symbol_lines(files, "no good")
    rows = spark.createDataFrame([("b.ts", "Shape;\nfunction f() {\n  Shape;\n}\n"), ("a.ts", "Shape;\n"), ("c.ts", "new Shape()\nShape;\nShape;\n"), ("d.ts", "Shape()\n")], files.schema)
    order = lambda **o: [(r.relative_path, r.line) for r in sorted(trace.trace_symbol(rows, "Shape", **o).filter("kind = 'reference'").collect(), key=lambda r: r.rank)]
    assert order() == [("c.ts", 1), ("b.ts", 3), ("a.ts", 1), ("b.ts", 1), ("c.ts", 2), ("c.ts", 3)] and order(start="c.ts", span=(3, 3))[:3] == [("c.ts", 3), ("c.ts", 1), ("c.ts", 2)]


def test_trace_deals_out_no_lines(spark):
    """Callers come with their lines, also where a path comes twice, and no line is shuffled by its path."""
    one = 'import { Base } from "./base"\nclass A {\n  go() {\n    new Base()\n  }\n}\n'
    files = spark.createDataFrame([("src/a.ts", one), ("src/a.ts", one.replace("class A", "class B")), ("src/base.ts", "export class Base {}\r\n"), ("src/none.ts", None)], "relative_path string, content string")
    df = trace.trace_symbol(files, "Base")
    got = sorted((r.kind, r.relative_path, r.line, r.enclosing_symbol, r.resolved_path) for r in df.collect() if r.kind in ("import", "reference"))
    assert [g[:3] + g[4:] for g in got] == [("import", "src/a.ts", 1, "src/base.ts")] * 2 + [("reference", "src/a.ts", 4, None)] * 2
    assert [g[3] for g in got] == [None, None, "A.go", "B.go"]
    assert not re.search(r"hashpartitioning\(relative_path#\d+, line#\d+, \d", df._jdf.queryExecution().executedPlan().toString())


def test_dedupe_prefers_auditable(spark):
    body = "\n".join(f"  line number {i} of the body" for i in range(8))
    rows = [("q", 1, "a.ts", body, 2, 9, 5.0, 1, []), ("q", 2, "a.ts", "function f() {\n" + body + "\n}", 1, 10, 5.0, 2, []), ("q", 3, "b.ts", body, 2, 9, 1.0, 3, []), ("q", 4, "a.ts", "other text", 100, 101, 1.0, 4, [])]
    df = spark.createDataFrame(rows, "query_id string, id int, relative_path string, content string, start_line int, end_line int, score double, rank int, reasons array<string>")
    assert sorted(r.id for r in ranking.deduplicate(df).collect()) == [2, 3, 4]


def test_diversify_caps_files(spark):
    rows = [("q", i, f"f{i % 2}.ts", f"function g{i}() {{\n}}", 10 * i + 1, 10 * i + 5, 10.0 - i, i + 1, ["path_match"], "definition") for i in range(10)]
    df = spark.createDataFrame(rows, "query_id string, id int, relative_path string, content string, start_line int, end_line int, score double, rank int, reasons array<string>, chunk_role string")
    got = ranking.diversify(df, 8).orderBy("pick").collect()
    assert len(got) == 6 and got[0].relative_path != got[1].relative_path and max(pd.Series([r.relative_path for r in got]).value_counts()) == 3


def test_limits():
    assert retrieval.limits(None) == (5, 80) and retrieval.limits(30) == (30, 120) and retrieval.limits(500) == (500, 200) and retrieval.limits(float("nan")) == (5, 80)


def test_catalog(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    rows = lambda *r: spark.createDataFrame(r, "path string, last_updated string").withColumn("last_updated", F.col("last_updated").cast("timestamp"))
    dead = spark.createDataFrame([("a", "2024-01-09"), ("b", "2024-01-01")], "path string, removed_at string").withColumn("removed_at", F.col("removed_at").cast("timestamp"))
    got = catalog.merge_snapshots(rows(("a", "2024-01-08"), ("b", "2023-12-30")), rows(("b", "2023-12-31"), ("c", "2024-01-01")), dead, now)
    assert {(r.path, r.last_updated.day) for r in got.collect()} == {("b", 31), ("c", 1)}
    cat = spark.createDataFrame([("p1", "k1", 0, 0), ("p2", "k2", 0, 0), ("p3", "k3", 0, 0), ("p4", "k4", 0, 0)], "path string, collection_name string, files int, chunks int")
    col = spark.createDataFrame([("k2", None), ("k3", 0), ("k4", 5)], "collection_name string, row_count int")
    man = spark.createDataFrame([("k4", 1, 5)], "collection_name string, files int, chunks int")
    assert {r.path: r.action for r in catalog.heal(cat, col, man).collect()} == {"p1": "remove", "p2": "skip", "p3": "remove", "p4": "overwrite"}
    assert {r.path: r.warnings for r in catalog.diagnose(cat, col, man).collect()}["p1"] == ["collection is missing", "no manifest"]
    t = spark.createDataFrame([("k4",), ("p1",)], "target string")
    assert {r.target: r.collection_name for r in catalog.resolve_target(t, cat.withColumn("derived_name", F.lit("z"))).collect()} == {"k4": "k4", "p1": "k1"}


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", ["x"], ["y"], ["Foo.barBaz"]), ("b", ["x"], [], ["Foo"]), ("c", ["x"], [], [])], "case_id string, primary array<string>, acceptable array<string>, symbols array<string>")
    res = spark.createDataFrame([("a", "z", 1, ""), ("a", "x", 2, "call barBaz()"), ("b", "q", 1, "Foo")], "case_id string, path string, rank int, content string")
    assert {r.case_id: r.score for r in evaluation.case_scores(res, cases).collect()} == {"a": 5, "b": 1, "c": 0}
    have = spark.createDataFrame([("x",), ("z",)], "relative_path string")
    assert {r.case_id: (r.missing, r.stale, r.scorable) for r in evaluation.freshness(cases, res, have).collect()} == {"a": (1, 0, True), "b": (0, 1, True), "c": (0, 0, True)}
    assert spark.range(1).select(evaluation.patch_paths(F.lit("--- a/x.py\n+++ b/x.py\n--- a/x.py\n--- a/y.py"))).first()[0] == ["x.py", "y.py"]
    anchors = spark.createDataFrame([("a", "BARBAZ"), ("a", "nope")], "case_id string, anchor string")
    assert tuple(evaluation.anchor_coverage(anchors, res).first()) == ("a", 2, 1, ["nope"])


def test_incremental_pieces(spark):
    s = lambda *r: spark.createDataFrame(r, "relative_path string, hash string, effective_lines int")
    old, new = s(("a", "1", 5), ("b", "1", 5), ("c", "1", None)), s(("a", "2", 9), ("b", "1", 5), ("d", "1", 3), ("c", "2", 4))
    assert {tuple(r) for r in incremental.snapshot_diff(old, new).collect()} == {("a", "modified"), ("c", "modified"), ("d", "added")}
    assert incremental.effective_growth(old, new).first().growth == 7


def test_tree_source(spark, tmp_path):
    for name, text in {"pkg/__init__.py": "x", "pkg/deep/er/a.py": "y", "node_modules/z.js": "n", "b.log": "l", ".hidden/q.py": "h", "Makefile": "all:", ".gitignore": "skip.py\n", "skip.py": "s"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    df = read_tree(spark, str(tmp_path))
    assert preview(df, 2) == (3, ["Makefile", "pkg/__init__.py"])
    assert read_tree(spark, str(tmp_path), max_depth=1).count() == 2
    assert {r.folder: r.files for r in directory(df).collect()}["pkg"] == 2
    assert select_files(df, patterns=["pkg/**"]).count() == 1


def test_store_versions(spark, tmp_path):
    s = IndexStore(spark, str(tmp_path))
    s.commit("k", spark.range(5).withColumn("relative_path", F.lit("p")))
    assert s.delete_ids("k", spark.range(2))["generation"] == 2 and s.row_count("k") == 3 and s.collections() == ["k"] and s.row_count("none") is None
    s.drop("k")
    assert s.collections() == []


def test_store_survives_crashes_and_other_writers(spark, tmp_path):
    rows = lambda *paths: spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "relative_path string, n int")
    paths = lambda df: sorted(r.relative_path for r in df.collect())
    s = IndexStore(spark, str(tmp_path))
    s.commit("k", rows("a", "b", "c"))
    held = s.read("k")  # a reader that started before the next commits
    s._write("k", rows("lost"))  # a writer that dies before its manifest
    assert paths(s.read("k")) == ["a", "b", "c"]
    (tmp_path / "k" / "manifest-000000000002.json").write_text('{"gen')  # one that dies within it
    assert paths(s.read("k")) == ["a", "b", "c"]
    with pytest.raises(WriterConflict):
        s.commit("k", rows("x"))
    (tmp_path / "k" / "manifest-000000000002.json").unlink()
    first = s.manifest("k")["parts"]
    new = s.update("k", rows("b"), rows("d"), note="n")
    assert paths(s.read("k")) == ["a", "c", "d"] and new["generation"] == 2 and new["note"] == "n" and paths(held) == ["a", "b", "c"]
    assert [b for b in first if new["parts"].get(b) == first[b]]  # untouched buckets are the old folders
    for p in "efg":
        s.update("k", rows(), rows(p)) if p != "e" else s.update("k", rows("none"), rows(p))
    assert paths(s.read("k")) == ["a", "c", "d", "e", "f", "g"] and len([f for f in (tmp_path / "k").iterdir() if f.name.startswith("manifest")]) == 2
    assert s.update("k", rows("a", "c", "d", "e", "f", "g"), rows())["parts"] == {} and s.row_count("k") == 0 and s.read("k").columns == ["relative_path", "n"]


def test_tracking_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    ev = spark.createDataFrame([("c", "a", "change", 1), ("c", "a", "change", 2), ("c", "b", "change", 3), ("d", None, "overflow", 4)], "codebase string, path string, kind string, version long")
    ev.coalesce(1).write.parquet(src)
    seen = []
    q = tracker.track(spark.readStream.schema(ev.schema).parquet(src), lambda df, n: seen.extend((r.path, r.version) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(seen, key=str) == [("a", 2), ("b", 3), (None, 4)]
    state = {r.codebase: (r.status, r.dirty_paths, r.version) for r in tracker.dirty_state(ev).collect()}
    assert state == {"c": ("dirty", 2, 3), "d": ("unknown", 0, 4)}
