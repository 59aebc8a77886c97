"""Scores of ranked results against expected paths, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = 2**30


def file_ranks(results: DataFrame) -> DataFrame:
    """(case_id, path, rank, content): each path once, ranked by its first appearance."""
    first = results.groupBy("case_id", "path").agg(F.min("rank").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda s: s["content"]), "\n").alias("content"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("first", "path"))).drop("first")


def symbol_hit(content: Column, symbols: Column) -> Column:
    """Any alias occurs: a qualified name as text or, from four characters, its last part; a plain name as a word."""
    def one(s):
        tail = F.substring_index(F.regexp_replace(s, "::|#", "."), ".", -1)
        word = lambda w: F.regexp(content, F.concat(F.lit(r"\b"), F.regexp_replace(w, r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\b")))
        return F.when(s.rlike(r"[.#]|::"), F.contains(content, s) | ((F.char_length(tail) >= 4) & word(tail))).otherwise(word(s))
    return F.exists(symbols, one)


def case_scores(results: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, score 0-5, best ranks). cases: case_id, primary array, acceptable array, symbols array; results: case_id, path, rank, content.

    One join of ranked files with the cases' expected paths; best ranks by conditional minima.
    """
    ranked = file_ranks(results)
    j = ranked.join(cases, "case_id")
    main, fine, sym = F.array_contains("primary", F.col("path")), F.array_contains("acceptable", F.col("path")), symbol_hit(F.col("content"), F.col("symbols"))
    best = lambda cond: F.coalesce(F.min(F.when(cond, F.col("rank"))), F.lit(NEVER))
    b = j.groupBy("case_id").agg(best(main).alias("p"), best(fine).alias("a"), best(main & sym).alias("ps"), best(fine & sym).alias("as"))
    b = cases.select("case_id").join(b, "case_id", "left")
    p, a, ps, s = (F.col(c) for c in ("p", "a", "ps", "as"))
    score = (F.when(p.isNull(), 0).when(ps <= 5, 5).when((ps <= 8) | (p <= 5) | (s <= 5), 4).when((ps <= 10) | (s <= 8) | (p <= 8) | (a <= 5), 3)
             .when((a <= 10) | (s <= 10) | (p <= 20), 2).otherwise(1))
    known = lambda c: F.when(F.col(c) < NEVER, F.col(c))
    return b.select("case_id", score.alias("score"), known("p").alias("primary_rank"), known("a").alias("acceptable_rank"))


def taxonomy(score: Column, results: Column, valid: Column) -> Column:
    return F.when(~valid, "invalid_fixture").when(results == 0, "empty_result").when(score < 3, "search_miss").otherwise("expected_hit")


def project_report(scores: DataFrame, total: bool = False) -> DataFrame:
    """Cases, points, hit counts and percent by project; with total, one more row over all (rollup)."""
    group = scores.rollup("project") if total else scores.groupBy("project")
    hits = [F.count_if(F.col("primary_rank") <= k).alias(f"top{k}") for k in (5, 8)] + [F.count_if(F.least("primary_rank", "acceptable_rank") <= k).alias(f"any{k}") for k in (10, 20)]
    return group.agg(F.count("*").alias("cases"), F.sum("score").alias("points"), *hits, (F.round(1000 * F.sum("score") / (5 * F.count("*"))) / 10).alias("percent"))


def nearest_rank(df: DataFrame, value: str, ps: list[float], by: list[str]) -> DataFrame:
    """Nearest-rank percentiles, least and largest, by group; percentile_disc sorts counts of distinct values, not rows."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{int(p * 100)}") for p in ps], F.min(value).alias("least"), F.max(value).alias("largest"))


def precision_recall(hits: DataFrame, oracle: DataFrame) -> DataFrame:
    """(instance_id, precision, recall, f1) of (instance_id, path) sets after path normalisation: a full outer join and counts."""
    clean = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^(\./|/)+", "")
    h = hits.select("instance_id", clean.alias("path")).distinct().withColumn("h", F.lit(1))
    o = oracle.select("instance_id", clean.alias("path")).distinct().withColumn("o", F.lit(1))
    c = h.join(o, ["instance_id", "path"], "full").groupBy("instance_id").agg(F.count("h").alias("n_hits"), F.count("o").alias("n_oracle"), F.count(F.col("h") + F.col("o")).alias("n_both"))
    p, r = F.coalesce(F.col("n_both") / F.nullif("n_hits", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("n_both") / F.nullif("n_oracle", F.lit(0)), F.lit(0.0))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))


def method_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of F1 and tokens by method."""
    return scores.groupBy("method").agg(F.avg("f1").alias("f1_mean"), F.stddev_pop("f1").alias("f1_std"), F.avg("tokens").alias("tokens_mean"), F.stddev_pop("tokens").alias("tokens_std"), F.max("tokens").alias("tokens_max"), F.sum("tokens").alias("tokens_sum"))


def patch_paths(patch: Column) -> Column:
    """Distinct files of a unified diff, from its '--- a/' lines."""
    return F.array_distinct(F.regexp_extract_all(patch, F.lit(r"(?m)^--- a/(.+)$"), F.lit(1)))


def freshness(cases: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """(case_id, missing expected paths, stale result paths, scorable): two anti joins against the files that exist."""
    have = files.select(F.col("relative_path").alias("path")).distinct()
    expected = cases.select("case_id", F.explode(F.array_union("primary", "acceptable")).alias("path"))
    missing = expected.join(have, "path", "left_anti").groupBy("case_id").agg(F.count_distinct("path").alias("missing"))
    stale = results.select("case_id", "path").distinct().join(have, "path", "left_anti").groupBy("case_id").agg(F.count("*").alias("stale"))
    there = expected.join(have, "path", "left_semi").select("case_id").distinct().withColumn("scorable", F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cases.select("case_id").join(missing, "case_id", "left").join(stale, "case_id", "left").join(there, "case_id", "left").select("case_id", zero("missing"), zero("stale"), F.coalesce("scorable", F.lit(False)).alias("scorable"))


def anchor_coverage(anchors: DataFrame, results: DataFrame) -> DataFrame:
    """(case_id, extracted, recalled, missing) of (case_id, anchor) against result contents and paths."""
    text = results.groupBy("case_id").agg(F.lower(F.array_join(F.collect_list(F.concat_ws("\n", "path", "content")), "\n")).alias("hay"))
    a = anchors.distinct().join(text, "case_id", "left").withColumn("hit", F.coalesce(F.contains("hay", F.lower("anchor")), F.lit(False)))
    return a.groupBy("case_id").agg(F.count("*").alias("extracted"), F.count_if("hit").alias("recalled"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("anchor")))).alias("missing"))


def saturation(results: DataFrame) -> DataFrame:
    """(case_id, saturated): two paths or fewer among the first five rows, or three or fewer among the first ten."""
    n = lambda k: F.count_distinct(F.when(F.col("rank") <= k, F.col("path")))
    return results.groupBy("case_id").agg(((n(5) <= 2) | (n(10) <= 3)).alias("saturated"))


def quality_summary(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count_if(F.col("rank") <= 3).alias("top3"), F.count_if(F.col("rank") <= 5).alias("top5"), F.avg(F.col("test_first").cast("double")).alias("test_first"), F.avg(F.col("barrel_first").cast("double")).alias("barrel_first"))


def covered_by_trace(evidence: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, path): expected paths that a trace's evidence names, by a definition there or an import or export resolved to it.

    Only where the symbol's letters and digits are those of the file's name, or within them.
    evidence: (case_id, symbol, kind, relative_path, resolved_path); cases: (case_id, primary, acceptable).
    """
    plain = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    found = evidence.select("case_id", "symbol", F.when(F.col("kind") == "definition", F.col("relative_path")).when(F.col("kind").isin("import", "export"), F.col("resolved_path")).alias("path"))
    wanted = cases.select("case_id", F.explode(F.array_union("primary", "acceptable")).alias("path"))
    base = plain(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    return found.join(wanted, ["case_id", "path"]).filter((plain(F.col("symbol")) != "") & F.contains(base, plain(F.col("symbol")))).select("case_id", "path").distinct()


def reduction_percent(ours: Column, theirs: Column) -> Column:
    """How many per cent less ours is than theirs; null if theirs is 0."""
    return F.round(100 * (theirs - ours) / F.nullif(theirs, F.lit(0)), 2)


def subset(instances: DataFrame, difficulty: str, files: int = 2) -> DataFrame:
    return instances.filter((F.col("difficulty") == difficulty) & (F.size(patch_paths(F.col("patch"))) == files))


def resume(instances: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """Instances not processed yet, by id, so that no more than `most` get processed overall."""
    return instances.join(done.select("instance_id").distinct(), "instance_id", "left_anti").orderBy("instance_id").limit(max(0, most - done.select("instance_id").distinct().count()))
