import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages_keep_columns_and_rows(spark):
    import corpus_pipeline
    from corvane.llm import quality
    from corvane.llm.decontaminate import contaminated
    from tests.llm.test_ngram_join import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).withColumn("text", F.concat(F.lit('api_key = "q8Zk2Lm9Xw4"\n'), F.col("text"))).withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = docs.unionByName(extra)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)
    one = stages[names[0]](spark, docs, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert one.columns == columns and {i for i, _ in rows} == want

    two = stages[names[1]](spark, one, SF)
    groups = brute(rows)
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(set(groups.values()))

    three = stages[names[2]](spark, two, SF)
    bad = {r.doc_id for r in contaminated(two, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - bad

    four = stages[names[3]](spark, three, SF)
    assert four.columns == columns and four.count() == three.count() and four.filter("text like '%q8Zk2Lm9Xw4%'").count() == 0
    five = stages[names[4]](spark, four, SF).collect()
    assert len(five) == four.count() and all(r.n_tokens == len(r.ids) for r in five)


def odd_documents(spark):
    """Documents of the smallest table with null and repeated ids, copies, odd texts and columns that clash with internal names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40")
    words = docs.filter("doc_id = 3")
    more = (words.withColumn("doc_id", F.lit(None).cast("long")).unionByName(words).unionByName(words.withColumn("text", F.lit(None).cast("string")))
            .unionByName(words.withColumn("text", F.lit(""))).unionByName(docs.filter("doc_id = 5").withColumn("doc_id", F.lit(3).cast("long"))))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 60").orderBy("item_id").limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("so it went: "), "text").alias("text"))
    more = more.unionByName(item.unionByName(item.withColumn("doc_id", F.lit(9).cast("long"))), allowMissingColumns=True)
    clash = {"score": "mine", "predicted": "own", "row_0": "r", "text_key_0": "k", "__row": "x", "id": "i", "item": "it", "spans": "s", "ids": "n"}
    return docs.unionByName(more).select("*", *[F.lit(v).alias(c) for c, v in clash.items()]), clash


def test_stages_on_odd_documents(spark):
    import corpus_pipeline
    from corvane.llm import quality
    from corvane.llm.decontaminate import contaminated
    from tests.llm.test_ngram_join import brute

    docs, clash = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    every = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.text for r in quality.score(docs, model).filter("predicted = 1").collect()}
    groups = brute([(i, t) for i, (_, t) in enumerate(rows)])
    first = {}
    for i, (doc_id, text) in enumerate(rows):
        first.setdefault(groups[i], []).append((doc_id is None, doc_id or 0, text))
    held = {r.doc_id for r in contaminated(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {i for i, r in enumerate(rows) if (r[1] or "").startswith("so it went")} <= held
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        assert f(spark, docs.limit(0), SF).count() == 0, name
        if f is corpus_pipeline.encode:
            assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == len(rows) and out.filter("doc_id is null").count() == sum(r[0] is None for r in rows)
            continue
        assert out.columns == docs.columns and all(r[c] == v for r in out.select(*clash).collect() for c, v in clash.items()), name
        if f is corpus_pipeline.keep_quality:
            assert every(out) == sorted((r for r in rows if r[1] in good), key=str)
        elif f is corpus_pipeline.drop_near_copies:
            got = [(r.doc_id is None, r.doc_id or 0) for r in out.collect()]
            assert sorted(got) == sorted(min(g)[:2] if len(g) > 1 else g[0][:2] for g in first.values())
        elif f is corpus_pipeline.drop_benchmark:
            assert every(out) == sorted((r for i, r in enumerate(rows) if i not in held), key=str)
        else:
            assert out.count() == len(rows) and f(spark, docs.drop("n_chars"), SF).count() == len(rows)


def test_run_leaves_no_table_but_the_last(spark):
    import corpus_pipeline
    from corvane.llm.shared import standing

    before = set(standing())
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and len(set(standing()) - before) == 1


def test_registered_queries_run(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert "pipeline" in known and sum(n.startswith("op") for n in known) == 10
    assert entry.entry(spark).count() > 0
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert known["op1_quality_classifier"](spark, SF).count() == n and known["op10_secrets"](spark, SF).count() == n


def test_sql_oracles(spark):
    import duckdb

    from corvane.llm import queries

    c = duckdb.connect()
    for t in ("conversations", "documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        want = sorted(map(repr, c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()))
        assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want, name
