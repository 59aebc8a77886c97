"""Ranked retrieval: exact dense top-k, BM25, reciprocal-rank fusion, and their merge with lexical hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.vectors import dot, norm

RRF_K = 100
QUERY_BLOCK = 64  # query vectors that one row meets at a time
SENT = 4096  # query vectors that may be sent to every task
TOKEN = r"[\p{L}\p{N}]+"


def limits(top_k: float | None) -> tuple[int, int]:
    """(output limit, candidate limit): 5 by default; four candidates an output, between 80 and 200."""
    ok = top_k is not None and top_k == top_k and 0 < top_k < float("inf") and int(top_k) > 0
    out = int(top_k) if ok else 5
    return out, min(max(4 * out, 80), 200)


def ranked(df: DataFrame, score: str, tie: str, k: int | None = None, by: str = "query_id") -> DataFrame:
    """Rank within each query; k rows a query if given (Spark then prunes within tasks before it shuffles)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.filter(F.col("rank") <= k)


def dense_topk(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vector", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) by exact cosine. queries: (query_id, query_vector), a stated set of bounded size.

    The query side is sent to every task only after a count says that it is small; a larger set meets the
    index in blocks of query ids. The norm of an index row is computed once, not once a query.
    """
    rows = index.filter(where) if where is not None else index
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).withColumn("n", norm(F.col("v")))
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("q")).withColumn("qn", norm(F.col("q")))
    # the queries of a block ride along with each row as one array: a map-side product, no join of all with all
    n = asked.count()
    n_blocks = max(1, -(-n // QUERY_BLOCK))
    blocks = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("query_id", "q", "qn")).alias("qs"))
    spread = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    # said outright: by the size of its files a compressed index passes for the smaller side, and all its vectors for one block of queries met in one task
    pairs = spread.join(F.broadcast(blocks) if n <= SENT else blocks, "block").select("id", "v", "n", F.explode("qs").alias("q"))
    scored = pairs.select("q.query_id", "id", (dot(F.col("v"), F.col("q.q")) / F.nullif(F.col("n") * F.col("q.qn"), F.lit(0.0))).alias("score"))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return ranked(scored.filter("score is not null"), "score", "id", k)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str, keep: list[str] = []) -> DataFrame:
    """(id, term, tf, len, keep...): term counts with the document's length, counted per document before anything is shuffled."""
    words = docs.select(F.col(id_col).alias("id"), *keep, tokens(F.col(text_col)).alias("ws")).withColumn("len", F.size("ws"))
    return words.select("id", *keep, "len", F.explode("ws").alias("term")).groupBy("id", *keep, "len", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> list[tuple[str, str]]:
    """(query_id, term) of the queries, a stated set of bounded size."""
    return [(r.query_id, r.term) for r in queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")).collect()]


def bm25_scores(tf: DataFrame, asked: list[tuple[str, str]], n_docs: int, avg_len: float, held: dict[str, int], k: int, id_type: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) from the counts (id, term, tf, len) of the asked terms and the number of documents that hold each."""
    spark = tf.sparkSession
    kind = f"query_id {id_type}, term string, df long"
    wanted = F.broadcast(spark.createDataFrame([(q, t, held[t]) for q, t in asked if t in held], kind))  # as many rows as the queries have terms
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg_len or 1.0)))
    scored = tf.join(wanted, "term").groupBy("query_id", "id").agg(F.sum(F.round(part, 9)).alias("score"))
    return ranked(scored.withColumn("score", F.round("score", 6)), "score", "id", k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank). queries: (query_id, query text), a stated set of bounded size.

    Texts are tokenised twice: once for statistics, of which a row a term reaches the driver, once for
    the counts, which are scored within the scan before anything is shuffled. Where an index exists, see bm25_indexed.
    """
    asked = query_terms(queries)
    terms = sorted({t for _, t in asked})
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ws"))
    hits = words.select("id", F.size("ws").alias("len"), (F.filter("ws", lambda w: w.isin(terms)) if terms else F.array().cast("array<string>")).alias("hits"))
    stats = hits.select("len", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("hits"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("len").alias("words")).collect()
    held = {r.term: r.n for r in stats if r.term is not None}
    n_docs, n_words = next(((r.n, r.words) for r in stats if r.term is None), (0, 0))
    tf = hits.select("id", "len", "hits", F.explode(F.array_distinct("hits")).alias("term")).select("id", "len", "term", F.size(F.filter("hits", lambda w: w == F.col("term"))).cast("long").alias("tf"))
    return bm25_scores(tf, asked, n_docs, n_words / n_docs if n_docs else 1.0, held, k, dict(queries.dtypes)["query_id"], k1, b)


def bm25_indexed(index: DataFrame, posted: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) over the postings of an index whose rows carry n_terms; only the postings of the asked terms are read."""
    asked = query_terms(queries)
    terms = sorted({t for _, t in asked})
    rows = posted.filter(F.col("term").isin(terms)) if terms else posted.limit(0)
    tf = rows.join(index.select("id"), "id", "left_semi").select("id", "term", "tf", "len")
    held = {r.term: r.n for r in tf.groupBy("term").agg(F.count("*").alias("n")).collect()}
    n_docs, avg_len = index.agg(F.count("*"), F.avg("n_terms")).first()
    return bm25_scores(tf, asked, n_docs, avg_len or 1.0, held, k, dict(queries.dtypes)["query_id"])


def fuse(left: DataFrame, right: DataFrame, k: int, rrf_k: int = RRF_K, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Reciprocal-rank fusion of two (query_id, id, rank) lists: a full outer join on (query, id)."""
    a, b = left.select("query_id", "id", F.col("rank").alias("r1")), right.select("query_id", "id", F.col("rank").alias("r2"))
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(float(rrf_k)) + F.col(r)), F.lit(0.0))
    both = a.join(b, ["query_id", "id"], "full").withColumn("score", part("r1", weights[0]) + part("r2", weights[1]))
    return ranked(both, "score", "id", k)


def weighted(left: DataFrame, right: DataFrame, k: int, weights: tuple[float, float]) -> DataFrame:
    """Weighted sum of two (query_id, id, score) lists after scaling each query's scores to 0..1."""
    def scaled(df, name):
        w = Window.partitionBy("query_id")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return df.select("query_id", "id", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0)).alias(name))
    both = scaled(left, "s1").join(scaled(right, "s2"), ["query_id", "id"], "full")
    return ranked(both.withColumn("score", F.coalesce("s1", F.lit(0.0)) * weights[0] + F.coalesce("s2", F.lit(0.0)) * weights[1]), "score", "id", k)


REASON_PRIORITY = {"exact_filename": 300, "exact_symbol_definition": 300, "path_match": 200, "reference_match": 100, "semantic_match": 0}


def order_reasons(reasons: Column) -> Column:
    """Distinct reasons, the weightiest first; equal weights keep their order."""
    weight = lambda r: F.try_element_at(F.create_map(*[F.lit(x) for kv in REASON_PRIORITY.items() for x in kv]), r)
    keyed = F.transform(F.array_distinct(reasons), lambda r, i: F.struct((-F.coalesce(weight(r), F.lit(0))).alias("w"), i.alias("i"), r.alias("r")))
    return F.transform(F.array_sort(keyed), lambda s: s["r"])


def result_key(path: Column, start: Column, end: Column, content: Column, available: Column) -> Column:
    return F.when(available, F.concat_ws(":", path, start.cast("string"), end.cast("string"))).otherwise(F.concat(path, F.lit(":unknown:"), F.sha1(content)))


def merge_lexical(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer join of two result lists on (query_id, result_key).

    Both carry score, lexical_score, owner_tier, reasons; the vector side also rank. A row found by
    both takes the larger of each number and the union of reasons; lexical-only rows have vector
    score 0 and follow. The order is owner tier, lexical score, vector score, original rank.
    """
    v = vector.select("query_id", "result_key", F.col("score").alias("vs"), F.col("lexical_score").alias("vl"), F.col("owner_tier").alias("vt"), F.col("reasons").alias("vr"), F.col("rank").alias("vrank"))
    x = lexical.select("query_id", "result_key", F.col("score").alias("ls"), F.col("lexical_score").alias("ll"), F.col("owner_tier").alias("lt"), F.col("reasons").alias("lr"))
    empty = F.array().cast("array<string>")
    out = v.join(x, ["query_id", "result_key"], "full").select(
        "query_id", "result_key", F.coalesce("vs", F.lit(0.0)).alias("vector_score"), F.greatest("vs", "ls").alias("score"),
        F.coalesce(F.greatest("vl", "ll"), F.lit(0)).alias("lexical_score"), F.coalesce(F.greatest("vt", "lt"), F.lit(0)).alias("owner_tier"),
        order_reasons(F.array_union(F.coalesce("vr", empty), F.coalesce("lr", empty))).alias("reasons"), F.coalesce("vrank", F.lit(2**31 - 1)).alias("original_rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("owner_tier"), F.desc("lexical_score"), F.desc("vector_score"), "original_rank", "result_key")
    return out.withColumn("rank", F.row_number().over(w))
