"""All queries of the library by name, with the SQL they are compared against.

The test tables hold no source tree, so documents stand in for files: a document's path is
source/lang/doc_<id>.md and its text the content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.operators import catalog, chunking, evaluation, incremental, ranking, retrieval, trace
from corvane.operators.filters import parse_filter
from corvane.operators.lexical import analyse, lexical_score
from corvane.sources.files import grep
from corvane.streaming import tracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vfiles(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    return d.select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.col("text").alias("content"), "doc_id", "source", "lang")


VFILES = "SELECT source || '/' || lang || '/doc_' || doc_id || '.md' AS relative_path, text AS content, doc_id, source, lang FROM documents"
# Paths with more shape than the stand-ins: the role and token rules need extensions, folders and camel case.
SHAPED_SPARK = """concat(case doc_id % 7 when 0 then 'src/tests/' when 1 then 'app/docs/' when 2 then 'pkg/core/' when 3 then 'web/dist/' when 4 then 'lib/config/' else 'src/' end,
 source, '/', case doc_id % 5 when 0 then 'index' when 1 then 'main' when 2 then 'fileRoleHelper' when 3 then 'test_runner' else 'HTTPServer_spec' end,
 case doc_id % 6 when 0 then '.ts' when 1 then '.py' when 2 then '.css' when 3 then '.json' when 4 then '.go' else '.md' end)"""
SHAPED_DUCK = SHAPED_SPARK


@query("""
SELECT vec_id AS id, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY round(s, 6) DESC, vec_id) AS INTEGER) AS rank FROM (
  SELECT c.vec_id, list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s
  FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY rank LIMIT 10""")
def dense_topk(spark, sf):
    """Exact cosine top 10 of one query vector."""
    e = t(spark, sf, "embeddings")
    asked = e.filter("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = retrieval.dense_topk(e, asked, 200, "vec_id", "embedding").withColumn("score", F.round("score", 6))
    return retrieval.ranked(got.drop("rank"), "score", "id", 10).select("id", "score", "rank")


@query("""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings c ON c.label <> 3 WHERE q.vec_id < 10),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def dense_topk_batch(spark, sf):
    """Ten queries at once, filtered."""
    e = t(spark, sf, "embeddings")
    asked = e.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = retrieval.dense_topk(e, asked, 200, "vec_id", "embedding", where=F.col("label") != 3).withColumn("score", F.round("score", 6))
    return retrieval.ranked(got.drop("rank"), "score", "id", 5).select("query_id", "id", "score", "rank")


BM25_QUERIES = [("q1", "thonre anerst"), ("q2", "the and of"), ("q3", "ciónes que")]
BM25_SQL = """
WITH q AS (SELECT * FROM (VALUES ('q1', 'thonre anerst'), ('q2', 'the and of'), ('q3', 'ciónes que')) AS v(query_id, query)),
terms AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+'))) AS term FROM q),
d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
st AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM d),
w AS (SELECT id, len(ws) AS l, unnest(ws) AS term FROM d),
tf AS (SELECT id, l, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, id, round(sum(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / al)), 9)), 6) AS score
  FROM tf JOIN df USING (term) JOIN terms USING (term), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
"""


def _bm25(spark, sf, k):
    asked = spark.createDataFrame(BM25_QUERIES, "query_id string, query string")
    return retrieval.bm25_topk(t(spark, sf, "documents"), asked, k, "doc_id", "text").select("query_id", "id", "score", "rank")


@query(BM25_SQL + "SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf):
    """Exact BM25."""
    return _bm25(spark, sf, 10)


PHRASE_SQL = """, p AS (SELECT 'q2' AS query_id, doc_id AS id, CAST((length(text) - length(replace(text, 'the ', ''))) / 4 AS BIGINT) AS score FROM documents),
pr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p),
a AS (SELECT * FROM r WHERE rank <= 80), b AS (SELECT * FROM pr WHERE rank <= 80),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id,
  round(coalesce(1.0 / (100 + a.rank), 0) + coalesce(1.0 / (100 + b.rank), 0), 9) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.id = b.id),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f)
"""


@query(BM25_SQL + PHRASE_SQL + "SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 20")
def rrf_hybrid(spark, sf):
    """BM25 ranks and phrase-count ranks fused."""
    d = t(spark, sf, "documents")
    hits = (F.char_length("text") - F.char_length(F.replace("text", F.lit("the "), F.lit("")))) / 4
    phrase = d.select(F.lit("q2").alias("query_id"), F.col("doc_id").alias("id"), hits.cast("long").alias("score"))
    fused = retrieval.fuse(_bm25(spark, sf, 80), retrieval.ranked(phrase, "score", "id", 80), 200).withColumn("score", F.round("score", 9))
    return retrieval.ranked(fused.drop("rank"), "score", "id", 20).select("query_id", "id", "score", "rank")


MD_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE WHEN length(line) < 60 THEN '# ' || line ELSE line END AS line FROM l),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s{0,3}#{1,6}\\s+(.+?)\\s*#*\\s*$') THEN trim(regexp_extract(line, '^\\s{0,3}#{1,6}\\s+(.+?)\\s*#*\\s*$', 1)) ELSE '' END AS title FROM m),
s AS (SELECT *, sum(CASE WHEN title <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM h),
p AS (SELECT doc_id, section, min(pos) AS start_line, max(pos) AS end_line, string_agg(line, chr(10) ORDER BY pos) AS content, arg_min(title, pos) AS title FROM s GROUP BY ALL),
k AS (SELECT *, max(section) OVER (PARTITION BY doc_id) AS top FROM p)
SELECT 'doc_' || doc_id AS relative_path, CAST(section AS BIGINT) AS section, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(content) AS content_md5,
 CASE WHEN section > 0 THEN 'markdown_section' WHEN top > 0 THEN 'markdown_preamble' ELSE 'markdown' END AS chunk_kind, CASE WHEN section > 0 THEN title END AS symbol_name
FROM k WHERE trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''"""


@query(MD_SQL)
def chunk_markdown_sections(spark, sf):
    """Sections by header lines (short lines of the documents become headers)."""
    d = t(spark, sf, "documents")
    body = F.array_join(F.transform(F.split("text", "\n"), lambda s: F.when(F.char_length(s) < 60, F.concat(F.lit("# "), s)).otherwise(s)), "\n")
    parts = chunking.markdown_sections(d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("relative_path"), body.alias("content")))
    return parts.select("relative_path", "section", "start_line", "end_line", F.md5("content").alias("content_md5"), "chunk_kind", "symbol_name")


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, piece, held FROM (SELECT doc_id, pos, 0 AS piece, length(line) AS held FROM l WHERE pos = 1)
 UNION ALL SELECT l.doc_id, l.pos, CASE WHEN held + 1 + length(line) > 400 THEN piece + 1 ELSE piece END, CASE WHEN held + 1 + length(line) > 400 THEN length(line) ELSE held + 1 + length(line) END
 FROM k JOIN l ON l.doc_id = k.doc_id AND l.pos = k.pos + 1),
p AS (SELECT doc_id, piece, min(pos) AS start_line, string_agg(line, chr(10) ORDER BY pos) AS own FROM k JOIN l USING (doc_id, pos) GROUP BY ALL),
w AS (SELECT *, right(lag(own) OVER (PARTITION BY doc_id ORDER BY piece), 40) AS tail FROM p)
SELECT doc_id, piece, CAST(CASE WHEN tail IS NULL THEN start_line ELSE greatest(1, start_line - len(string_split(tail, chr(10)))) END AS INTEGER) AS start_line,
 md5(CASE WHEN tail IS NULL THEN own ELSE tail || chr(10) || own END) AS content_md5 FROM w""")
def line_windows_overlap(spark, sf):
    """Pieces of at most 400 characters on line boundaries, each with the last 40 characters of the piece before."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("relative_path"), F.col("text").alias("content"))
    return chunking.line_windows(d, 400, 40).select(F.col("relative_path").alias("doc_id"), "piece", "start_line", F.md5("content").alias("content_md5"))


@query(f"""SELECT 'chunk_' || substr(sha256(relative_path || ':1:' || len(string_split(content, chr(10))) || ':' || content), 1, 16) AS id, sha1(content) AS content_hash,
 sha1(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS normalized_content_hash, doc_id FROM ({VFILES})""")
def chunk_ids(spark, sf):
    """Ids and hashes."""
    v = vfiles(spark, sf)
    c = F.col("content")
    return v.select(T.chunk_id(F.col("relative_path"), F.lit(1), F.size(F.split(c, "\n")), c).alias("id"), T.content_hash(c).alias("content_hash"), T.normalised_hash(c).alias("normalized_content_hash"), "doc_id")


@query("""SELECT doc_id, h AS normalized_content_hash FROM (SELECT doc_id, sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h, source FROM documents)
QUALIFY row_number() OVER (PARTITION BY source, h ORDER BY doc_id) = 1""")
def exact_dedupe(spark, sf):
    """The first chunk of each normalised content within a file (a source stands for a file)."""
    d = t(spark, sf, "documents").select("doc_id", F.col("source").alias("relative_path"), T.normalised_hash(F.col("text")).alias("normalized_content_hash"))
    return chunking.distinct_in_file(d, F.col("doc_id")).select("doc_id", "normalized_content_hash")


LINES_SQL = """WITH l AS (SELECT lang AS relative_path, doc_id AS id, list_sort(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 8))) AS ls FROM documents),
m AS (SELECT *, min(id) OVER (PARTITION BY relative_path, ls) AS class_id FROM l WHERE len(ls) >= 4), c AS (SELECT * FROM m WHERE id = class_id)
"""


@query(LINES_SQL + """SELECT relative_path, a, b, round(s, 6) AS similarity FROM (SELECT x.relative_path, x.id AS a, y.id AS b, len(list_intersect(x.ls, y.ls)) / (len(x.ls) + len(y.ls) - len(list_intersect(x.ls, y.ls))) AS s
 FROM c x JOIN c y ON x.relative_path = y.relative_path AND x.id < y.id) WHERE s >= 0.25""")
def near_dup_pairs(spark, sf):
    """Classes of equal line sets of one path that are alike to 0.25 or more, over the whole table (a language stands for a path)."""
    _, pairs = ranking.similar_files_lines(t(spark, sf, "documents").select(F.col("lang").alias("relative_path"), F.col("doc_id").alias("id"), F.col("text").alias("content")), 0.25, f"{_scratch(spark)}/line-sets")
    return pairs.select("relative_path", "a", "b", F.round("similarity", 6).alias("similarity"))


@query(LINES_SQL + "SELECT relative_path, id, class_id FROM m")
def near_dup_classes(spark, sf):
    """The class of every row that has meaningful lines enough; with near_dup_pairs it tells every pair."""
    return ranking.line_classes(t(spark, sf, "documents").select(F.col("lang").alias("relative_path"), F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query("""WITH r AS (SELECT lang AS query_id, doc_id AS id, source AS relative_path, text, doc_id % 400 + 1 AS s, doc_id % 400 + 12 AS e, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 997 DESC, doc_id) AS rank FROM documents),
l AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 8)) AS ls FROM r WHERE rank <= 200),
j AS (SELECT x.query_id, x.relative_path, x.id AS a, y.id AS b, least(x.e, y.e) - greatest(x.s, y.s) + 1 AS common, greatest(x.s, y.s) - least(x.e, y.e) - 1 AS apart,
 CASE WHEN least(len(x.ls), len(y.ls)) < 4 THEN 0 ELSE len(list_intersect(x.ls, y.ls)) / (len(x.ls) + len(y.ls) - len(list_intersect(x.ls, y.ls))) END AS alike,
 CASE WHEN length(x.flat) <= length(y.flat) THEN x.flat ELSE y.flat END AS short, CASE WHEN length(x.flat) <= length(y.flat) THEN y.flat ELSE x.flat END AS long
 FROM l x JOIN l y ON x.query_id = y.query_id AND x.relative_path = y.relative_path AND x.id < y.id)
SELECT query_id, relative_path, a, b FROM j WHERE (common > 0 AND (common / 12 > 0.5 OR common / 12 >= 0.6)) OR (common <= 0 AND apart <= 2 AND alike >= 0.6)
 OR (short <> '' AND ((length(short) >= 80 AND contains(long, short)) OR (short <> long AND alike >= 0.82)))""")
def duplicate_pairs(spark, sf):
    """Pairs of near duplicates among the results of each query, which the search limits to 200 candidates: by ranges, contained texts and line sets (no text here declares anything)."""
    return ranking.duplicate_pairs(_results(spark, sf), ["query_id"])


@query(f"""WITH p AS (SELECT doc_id, {SHAPED_DUCK} AS path FROM documents)
SELECT doc_id, list_extract(string_split(path, '/'), 1) AS path_segment_0, coalesce(list_extract(string_split(path, '/'), 2), '') AS path_segment_1, coalesce(list_extract(string_split(path, '/'), 3), '') AS path_segment_2,
 coalesce(list_extract(string_split(path, '/'), 4), '') AS path_segment_3, coalesce(list_extract(string_split(path, '/'), 5), '') AS path_segment_4, len(string_split(path, '/')) - 1 AS depth FROM p""")
def path_segments(spark, sf):
    """C17, A02."""
    p = t(spark, sf, "documents").select("doc_id", F.expr(SHAPED_SPARK).alias("path"))
    return p.select("doc_id", *[P.segment(F.col("path"), i).alias(f"path_segment_{i}") for i in range(5)], P.depth(F.col("path")).cast("long").alias("depth"))


@query(f"""WITH p AS (SELECT doc_id, {SHAPED_DUCK} AS path FROM documents),
r AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(path, '[\\\\/._-]+'), lambda s: length(s) >= 2)) AS raw, generate_subscripts(list_filter(regexp_split_to_array(path, '[\\\\/._-]+'), lambda s: length(s) >= 2), 1) AS i FROM p),
s AS (SELECT doc_id, i, raw, list_filter(string_split(regexp_replace(raw, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), ' '), lambda x: length(x) >= 2) AS parts FROM r)
SELECT doc_id, list_sort(list_distinct(flatten(list(list_prepend(raw, parts))))) AS tokens FROM s GROUP BY doc_id""")
def path_tokens(spark, sf):
    """C15, C16 (sorted for the comparison, which ignores order)."""
    p = t(spark, sf, "documents").select("doc_id", F.expr(SHAPED_SPARK).alias("path"))
    return p.select("doc_id", F.array_sort(P.path_tokens(F.col("path"))).alias("tokens"))


@query(f"""WITH p AS (SELECT doc_id, lower({SHAPED_DUCK}) AS path FROM documents)
SELECT doc_id, CASE
 WHEN regexp_matches(path, '/(dist|build|generated|__generated__)/') THEN 'generated'
 WHEN regexp_matches(path, '/(__tests__|test|tests|spec|specs)/') OR regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR regexp_matches(path, '_(spec|test)(\\.[^./]*)?$') THEN 'test'
 WHEN regexp_matches(path, '/configs?/') OR regexp_matches(path, '\\.json$') THEN 'config'
 WHEN regexp_matches(path, '/docs?/') OR regexp_matches(path, '\\.md$') THEN 'docs'
 WHEN regexp_matches(path, '\\.css$') THEN 'style'
 WHEN regexp_matches(path, '/main\\.(ts|py|go)$') THEN 'entrypoint' ELSE 'implementation' END AS file_role FROM p""")
def file_role(spark, sf):
    """C18 by path."""
    p = t(spark, sf, "documents").select("doc_id", F.expr(SHAPED_SPARK).alias("path"))
    return p.select("doc_id", P.file_role(F.col("path")).alias("file_role"))


@query(f"""WITH p AS (SELECT doc_id, {SHAPED_DUCK} AS path FROM documents)
SELECT doc_id, regexp_extract(path, '(\\.[^./]*)$', 1) AS ext, CASE regexp_extract(path, '(\\.[^./]*)$', 1) WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.json' THEN 'json' WHEN '.go' THEN 'go' WHEN '.md' THEN 'markdown' ELSE 'text' END AS language,
 regexp_extract(path, '(\\.[^./]*)$', 1) <> '.css' AS supported FROM p""")
def file_language(spark, sf):
    """A03, A09, N02."""
    p = t(spark, sf, "documents").select("doc_id", F.expr(SHAPED_SPARK).alias("path"))
    return p.select("doc_id", P.extension(F.col("path")).alias("ext"), P.language(F.col("path")).alias("language"), P.supported(F.col("path")).alias("supported"))


@query(f"""SELECT doc_id, source FROM ({VFILES}) WHERE (lang = 'de' OR lang = 'fr') AND source IN ('src1', 'src2', 'src3')""")
def ext_filter_scan(spark, sf):
    """A parsed filter, pushed into the scan."""
    d = t(spark, sf, "documents")
    return d.filter(parse_filter("(lang == \"de\" or lang == 'fr') and source in ['src1', 'src2', \"src3\"]", d.columns)).select("doc_id", "source")


@query(f"""SELECT count(DISTINCT relative_path) FILTER (source = 'src1' OR source = 'src2') AS files, count(*) FILTER (source = 'src1' OR source = 'src2') AS chunks FROM ({VFILES})""")
def collection_stats(spark, sf):
    """files and chunks of a codebase; rows that name none count too."""
    v = vfiles(spark, sf).withColumn("codebase_path", F.when(F.col("source") != "src2", F.col("source")))
    return catalog.collection_stats(v, F.lit("src1"))


@query("""SELECT DISTINCT source AS codebase_path FROM documents WHERE source <> 'src2'""")
def codebases(spark, sf):
    """the codebases of a shared collection."""
    return catalog.codebases_of(t(spark, sf, "documents").select(F.when(F.col("source") != "src2", F.col("source")).alias("codebase_path")))


def _states(spark, sf):
    v = vfiles(spark, sf)
    old = v.filter("doc_id % 7 <> 1").select("relative_path", F.sha2("content", 256).alias("hash"), T.effective_lines(F.col("content")).alias("effective_lines"))
    content = F.when(F.col("doc_id") % 7 == 3, F.concat("content", F.lit("\nmore\n\n// note\nrest"))).otherwise(F.col("content"))
    new = v.filter("doc_id % 7 <> 2").select("relative_path", F.sha2(content, 256).alias("hash"), T.effective_lines(content).alias("effective_lines"))
    return old, new


STATE_SQL = f"""WITH v AS ({VFILES}), o AS (SELECT relative_path, sha256(content) AS hash FROM v WHERE doc_id % 7 <> 1),
n AS (SELECT relative_path, sha256(CASE WHEN doc_id % 7 = 3 THEN content || chr(10) || 'more' || chr(10) || chr(10) || '// note' || chr(10) || 'rest' ELSE content END) AS hash FROM v WHERE doc_id % 7 <> 2)
"""


@query(STATE_SQL + """SELECT * FROM (SELECT coalesce(o.relative_path, n.relative_path) AS relative_path,
 CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' END AS change FROM o FULL JOIN n USING (relative_path)) WHERE change IS NOT NULL""")
def snapshot_diff(spark, sf):
    """E03."""
    return incremental.snapshot_diff(*_states(spark, sf))


@query(STATE_SQL + "SELECT sha256('root:' || string_agg(hash, '' ORDER BY relative_path)) AS root FROM n")
def root_digest(spark, sf):
    """F15."""
    return incremental.root_digest(_states(spark, sf)[1])


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '' AND NOT regexp_matches(trim(s), '^(//|#|--|/\\*|<!--)')) AS code FROM documents)
SELECT CAST(sum(CASE WHEN doc_id % 7 = 1 THEN len(code) WHEN doc_id % 7 = 3 THEN 2 ELSE 0 END) AS BIGINT) AS growth FROM l WHERE doc_id % 7 <> 2""")
def effective_line_growth(spark, sf):
    """Added files count whole, files with five more lines gain two."""
    return incremental.effective_growth(*_states(spark, sf))


@query("""SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 5 < 3)""")
def delete_by_path(spark, sf):
    """Rows of changed keys go by a left anti join."""
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("relative_path"), "l_orderkey", "l_linenumber")
    gone = t(spark, sf, "orders").filter("o_orderkey % 5 < 3").select(F.col("o_orderkey").alias("relative_path"))
    return incremental.without_paths(rows, gone).select("l_orderkey", "l_linenumber")


@query("""WITH d AS (SELECT doc_id, text, sha1(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents), e AS (SELECT h, arg_min(text, doc_id) AS t FROM d GROUP BY h)
SELECT doc_id, length(t) AS embedded_chars FROM d JOIN e USING (h)""")
def embed_cache_join(spark, sf):
    """Each distinct content is embedded once (its length stands for the vector)."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), T.normalised_hash(F.col("text")).alias("normalized_content_hash"))
    return incremental.embed_once(d, F.char_length("content").cast("long")).select(F.col("id").alias("doc_id"), F.col("vector").alias("embedded_chars"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM p
 UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE page_id % 3 = 0 AND path LIKE '%/%/%')
SELECT p.page_id, arg_max(root, length(root)) AS root FROM p JOIN r ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY p.page_id""")
def longest_prefix_match(spark, sf):
    """The longest ancestor."""
    p = t(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    host = F.substring_index("path", "/", 1)
    roots = p.select(host.alias("root")).union(p.filter("page_id % 3 = 0 and path like '%/%/%'").select(F.substring_index("path", "/", 2).alias("root")))
    best = catalog.longest_prefix(p.select("path").distinct(), roots)
    return p.join(best, "path").select("page_id", "root")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_wins_merge(spark, sf):
    """The last record of each key."""
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return catalog.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT user_id, max(ts) AS removed_at FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id""")
def tombstone_expiry(spark, sf):
    """K15."""
    e = t(spark, sf, "events")
    kind, now = e.agg(F.min("event_type"), F.max("ts")).first()
    dead = e.filter(F.col("event_type") == kind).select(F.col("user_id").alias("path"), F.col("ts").alias("removed_at"))
    return catalog.live_tombstones(dead, F.lit(now).cast(dict(e.dtypes)["ts"])).groupBy(F.col("path").alias("user_id")).agg(F.max("removed_at").alias("removed_at"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM i GROUP BY user_id, n""")
def debounce_sessions(spark, sf):
    """K01 in batch form."""
    return tracker.debounce(t(spark, sf, "events"), "user_id", "ts", "1 hour")


def _file_events(spark, sf):
    e = t(spark, sf, "events")
    kind = F.when(F.col("event_id") % 97 == 0, "overflow").otherwise("change")
    return e.select((F.col("user_id") % 50).alias("codebase"), F.when(kind == "change", F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string"))).alias("path"), kind.alias("kind"), F.col("event_id").alias("version"))


@query("""WITH e AS (SELECT user_id % 50 AS codebase, CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'f' || (event_id % 40) END AS path, event_id % 97 = 0 AS unknown, event_id AS version FROM events)
SELECT codebase, CASE WHEN bool_or(unknown) THEN 'unknown' ELSE 'dirty' END AS status, CASE WHEN bool_or(unknown) THEN 0 ELSE count(DISTINCT path) END AS dirty_paths, max(version) AS version FROM e GROUP BY codebase""")
def dirty_state(spark, sf):
    """K02, K04 in batch form."""
    return tracker.dirty_state(_file_events(spark, sf))


@query("""WITH e AS (SELECT user_id % 50 AS codebase, event_id AS version FROM events), o AS (SELECT codebase, max(version) - 20 AS seen FROM e GROUP BY codebase)
SELECT e.codebase, e.version FROM e JOIN o USING (codebase) WHERE version > seen""")
def acknowledged_events(spark, sf):
    """What came after the observed version."""
    e = _file_events(spark, sf)
    return tracker.acknowledge(e, e.groupBy("codebase").agg((F.max("version") - 20).alias("version"))).select("codebase", "version")


@query("""WITH r AS (SELECT lang AS query_id, doc_id AS id, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS n, min(rank) OVER (PARTITION BY query_id, source) AS best FROM r WHERE rank <= 200),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n > 1, best, n) AS pick FROM c WHERE n <= 3) SELECT query_id, id, CAST(pick AS INTEGER) AS pick FROM o WHERE pick <= 20""")
def file_diversify(spark, sf):
    """The best row of each file first, then more of each, three a file at most; no row here is strong evidence."""
    d = t(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("source").alias("relative_path"), F.col("source").alias("content"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"),
                                         F.col("n_chars").cast("double").alias("score"), F.array().cast("array<string>").alias("reasons"), F.lit("reference").alias("chunk_role"))
    return ranking.diversify(retrieval.ranked(d, "score", "id", 200), 20).select("query_id", "id", "pick")


RELATED_SQL = """WITH d AS (SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank,
 CASE doc_id % 6 WHEN 0 THEN 'test' WHEN 1 THEN 'docs' WHEN 2 THEN 'style' WHEN 3 THEN 'barrel' ELSE 'implementation' END AS role FROM documents),
g AS (SELECT *, role = 'implementation' AS is_primary, CASE role WHEN 'implementation' THEN 0 WHEN 'barrel' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS grp FROM d WHERE rank <= 80),
c AS (SELECT *, count(*) FILTER (is_primary) OVER (PARTITION BY query_id) AS p, count(*) FILTER (NOT is_primary) OVER (PARTITION BY query_id) AS r, row_number() OVER (PARTITION BY query_id, is_primary, grp ORDER BY rank) AS ing FROM g),
s AS (SELECT *, CASE WHEN r = 0 THEN 0 WHEN p < 10 THEN least(r, 10 - p) ELSE least(r, 2, 9) END AS reserve, row_number() OVER (PARTITION BY query_id, is_primary ORDER BY CASE WHEN is_primary THEN 0 WHEN ing = 1 THEN grp ELSE 6 END, rank) AS place FROM c)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY is_primary DESC, place) AS INTEGER) AS pick FROM s WHERE CASE WHEN is_primary THEN place <= 10 - reserve ELSE place <= reserve END"""


@query(RELATED_SQL)
def related_pick(spark, sf):
    """Primaries, then the first related row of each group."""
    role = F.expr("case doc_id % 6 when 0 then 'test' when 1 then 'docs' when 2 then 'style' when 3 then 'barrel' else 'implementation' end")
    d = t(spark, sf, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), role.alias("file_role"))
    return ranking.group_and_pick(retrieval.ranked(d, "score", "id", 80), 10).select("query_id", "id", "pick")


@query("""WITH f AS (SELECT source, doc_id FROM documents), e AS (SELECT 'src/' || source || '/unit' || doc_id || '.ts' AS relative_path, doc_id % 9 = 3 AS holds FROM f)
SELECT relative_path, line, is_definition, call_target FROM (SELECT relative_path, unnest([6, 10]) AS line, unnest([false, true]) AS is_definition, unnest([NULL, 'make3']) AS call_target FROM e WHERE holds)
 WHERE is_definition""")
def symbol_refs(spark, sf):
    """Trace: the lines of generated sources that name a symbol as a word."""
    return trace.symbol_lines(code_files(spark, sf), "make3").select("relative_path", "line", "is_definition", "call_target")


@query(f"""WITH v AS ({VFILES}), l AS (SELECT relative_path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM v)
SELECT relative_path, CAST(line AS INTEGER) AS line FROM l WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')""")
def symbol_words(spark, sf):
    """Whole words of the texts."""
    return trace.symbol_lines(vfiles(spark, sf), "the").filter(F.col("matched") == "the").select("relative_path", "line")


@query(f"""WITH v AS ({VFILES}), l AS (SELECT relative_path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM v)
SELECT relative_path, CAST(line AS INTEGER) AS line, md5(text) AS text_md5 FROM l WHERE regexp_matches(text, '[Ll]icen[sc]e|rights reserved')""")
def grep_lines(spark, sf):
    """A17."""
    return grep(vfiles(spark, sf), "[Ll]icen[sc]e|rights reserved").select("relative_path", "line", F.md5("text").alias("text_md5"))


LEX_SQL = f"""WITH v AS ({VFILES}), s AS (SELECT doc_id,
 (CASE WHEN contains(lower(relative_path), 'src1/de') THEN 90 ELSE 0 END) + (CASE WHEN contains(lower(relative_path), 'src1') THEN 90 ELSE 0 END)
 + (CASE WHEN contains(content, 'src1/de') THEN 100 WHEN contains(lower(content), 'src1/de') THEN 50 ELSE 0 END) + (CASE WHEN contains(content, 'src1') THEN 100 WHEN contains(lower(content), 'src1') THEN 50 ELSE 0 END) AS base,
 (CASE WHEN contains(lower(relative_path || chr(10) || content), 'thonre') THEN 15 ELSE 0 END) + (CASE WHEN contains(lower(relative_path || chr(10) || content), 'anerst') THEN 15 ELSE 0 END) AS weak,
 contains(lower(relative_path), 'src1') AS in_path, contains(lower(content), 'src1') AS in_text FROM v)
 SELECT doc_id, CAST(base + least(weak, 45) - 70 AS INTEGER) AS lexical_score, CASE WHEN in_path THEN 400 WHEN in_text THEN 300 ELSE 0 END AS owner_tier FROM s WHERE base > 0"""


@query(LEX_SQL)
def lexical_score_rows(spark, sf):
    """terms of a query scored over path and content; documents are docs, hence -70."""
    none = F.array().cast("array<string>")
    v = vfiles(spark, sf)
    for c in ("symbols", "definition_identifiers", "content_definitions", "path_tokens"):
        v = v.withColumn(c, none)
    v = v.withColumn("file_role", P.file_role(F.col("relative_path")))
    score, _, tier = lexical_score(analyse("src1/de thonre anerst"))
    return v.select("doc_id", score.cast("int").alias("lexical_score"), tier.cast("int").alias("owner_tier")).filter("lexical_score <> 0")


@query("""WITH b AS (SELECT item_id AS case_id, 'doc_' || (item_id * 3 % 40) AS prim, 'doc_' || (item_id * 5 % 40) AS acc FROM benchmark),
r AS (SELECT conv_id % 40 AS case_id, 'doc_' || ((conv_id * 7 + turn * 11) % 40) AS path, row_number() OVER (PARTITION BY conv_id % 40 ORDER BY conv_id, turn) AS rank FROM conversations),
f AS (SELECT case_id, path, row_number() OVER (PARTITION BY case_id ORDER BY min(rank), path) AS rank FROM r GROUP BY case_id, path),
m AS (SELECT b.case_id, count(f.path) AS n, min(CASE WHEN path = prim THEN f.rank END) AS p, min(CASE WHEN path = acc THEN f.rank END) AS a FROM b LEFT JOIN f USING (case_id) GROUP BY b.case_id)
SELECT case_id, CASE WHEN n = 0 THEN 0 WHEN p <= 5 THEN 4 WHEN p <= 8 OR a <= 5 THEN 3 WHEN a <= 10 OR p <= 20 THEN 2 ELSE 1 END AS score, CAST(p AS INTEGER) AS primary_rank, CAST(a AS INTEGER) AS acceptable_rank FROM m""")
def benchmark_score(spark, sf):
    """Graded scores from first ranks (no symbols asked for)."""
    b = t(spark, sf, "benchmark")
    doc = lambda n: F.concat(F.lit("doc_"), n.cast("string"))
    cases = b.select(F.col("item_id").alias("case_id"), F.array(doc(F.col("item_id") * 3 % 40)).alias("primary"), F.array(doc(F.col("item_id") * 5 % 40)).alias("acceptable"), F.array().cast("array<string>").alias("symbols"))
    r = t(spark, sf, "conversations").select((F.col("conv_id") % 40).alias("case_id"), doc((F.col("conv_id") * 7 + F.col("turn") * 11) % 40).alias("path"), "conv_id", "turn", F.lit("").alias("content"))
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy("conv_id", "turn")))
    return evaluation.case_scores(r, cases)


@query("""WITH h AS (SELECT DISTINCT d.source AS i, d.doc_id AS p FROM documents d WHERE d.n_chars > 1500), o AS (SELECT DISTINCT d.source AS i, d.doc_id AS p FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1),
c AS (SELECT coalesce(h.i, o.i) AS instance_id, count(h.p) AS n_hits, count(o.p) AS n_oracle, count(CASE WHEN h.p IS NOT NULL AND o.p IS NOT NULL THEN 1 END) AS n_both FROM h FULL JOIN o ON h.i = o.i AND h.p = o.p GROUP BY 1)
SELECT instance_id, round(coalesce(n_both / nullif(n_hits, 0), 0), 9) AS precision, round(coalesce(n_both / nullif(n_oracle, 0), 0), 9) AS recall,
 round(coalesce(2 * (n_both / nullif(n_hits, 0)) * (n_both / nullif(n_oracle, 0)) / nullif(n_both / nullif(n_hits, 0) + n_both / nullif(n_oracle, 0), 0), 0), 9) AS f1 FROM c""")
def prf1(spark, sf):
    """Precision, recall and F1 of a length rule against the quality labels, by source."""
    d = t(spark, sf, "documents")
    path = F.concat(F.lit("./"), F.col("doc_id").cast("string"))
    hits = d.filter("n_chars > 1500").select(F.col("source").alias("instance_id"), path.alias("path"))
    oracle = d.join(t(spark, sf, "labels").filter("quality = 1"), "doc_id").select(F.col("source").alias("instance_id"), F.col("doc_id").cast("string").alias("path"))
    s = evaluation.precision_recall(hits, oracle)
    return s.select("instance_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) FILTER (i = greatest(1, ceil(0.5 * n))) AS p50, min(value) FILTER (i = greatest(1, ceil(0.95 * n))) AS p95, min(value) AS least, max(value) AS largest FROM r GROUP BY event_type""")
def percentiles(spark, sf):
    """Nearest-rank percentiles."""
    return evaluation.nearest_rank(t(spark, sf, "events"), "value", [0.5, 0.95], ["event_type"])


@query("""WITH s AS (SELECT o_orderpriority AS project, o_orderkey % 6 AS score, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 25 + 1 END AS p, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 30 + 1 END AS a FROM orders)
SELECT project, count(*) AS cases, CAST(sum(score) AS BIGINT) AS points, count(*) FILTER (p <= 5) AS top5, count(*) FILTER (p <= 8) AS top8, count(*) FILTER (coalesce(least(p, a), p, a) <= 10) AS any10,
 count(*) FILTER (coalesce(least(p, a), p, a) <= 20) AS any20, round(1000 * sum(score) / (5 * count(*))) / 10 AS percent FROM s GROUP BY ROLLUP (project)""")
def project_report(spark, sf):
    """The report with a total row."""
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    s = o.select(F.col("o_orderpriority").alias("project"), (k % 6).alias("score"), F.when(k % 4 > 0, k % 25 + 1).alias("primary_rank"), F.when(k % 3 > 0, k % 30 + 1).alias("acceptable_rank"))
    return evaluation.project_report(s, total=True)


@query("""WITH s AS (SELECT event_type AS method, (event_id % 100) / 100.0 AS f1, user_id AS tokens FROM events)
SELECT method, round(avg(f1), 9) AS f1_mean, round(stddev_pop(f1), 9) AS f1_std, round(avg(tokens), 6) AS tokens_mean, round(stddev_pop(tokens), 6) AS tokens_std, max(tokens) AS tokens_max, CAST(sum(tokens) AS BIGINT) AS tokens_sum FROM s GROUP BY method""")
def method_summary(spark, sf):
    """F11, F12."""
    s = t(spark, sf, "events").select(F.col("event_type").alias("method"), ((F.col("event_id") % 100) / 100.0).alias("f1"), F.col("user_id").alias("tokens"))
    m = evaluation.method_summary(s)
    return m.select("method", F.round("f1_mean", 9).alias("f1_mean"), F.round("f1_std", 9).alias("f1_std"), F.round("tokens_mean", 6).alias("tokens_mean"), F.round("tokens_std", 6).alias("tokens_std"), "tokens_max", "tokens_sum")


@query("""SELECT i.conv_id AS instance_id FROM (SELECT DISTINCT conv_id FROM conversations) i WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 4 = 0) ORDER BY conv_id LIMIT 20""")
def resume_instances(spark, sf):
    """Unprocessed instances by anti join, then the first few."""
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("instance_id")).distinct()
    done = c.filter("instance_id % 4 = 0")
    return evaluation.resume(c, done, 20 + done.count())


@query("""WITH c AS (SELECT 'p' || c_custkey AS path, 'k' || (c_custkey % 40) AS collection_name FROM customer WHERE c_custkey % 3 <> 0), k AS (SELECT DISTINCT 'k' || s_suppkey AS collection_name FROM supplier WHERE s_suppkey % 2 = 0),
m AS (SELECT 'p' || c_custkey AS path, 'k' || (c_custkey % 40) AS collection_name FROM customer WHERE c_custkey % 5 <> 0), j AS (
SELECT coalesce(c.path, m.path) AS path, c.path IS NOT NULL AS listed, coalesce(c.collection_name, m.collection_name) AS cn FROM c FULL JOIN m ON c.path = m.path)
SELECT path, CASE WHEN k.collection_name IS NULL THEN 'drop' WHEN NOT listed THEN 'add' ELSE 'keep' END AS action FROM j LEFT JOIN k ON k.collection_name = cn WHERE listed OR k.collection_name IS NOT NULL""")
def catalog_reconcile(spark, sf):
    """Catalog against collections and manifests."""
    c = t(spark, sf, "customer")
    key = F.col("c_custkey")
    name, path = F.concat(F.lit("k"), (key % 40).cast("string")), F.concat(F.lit("p"), key.cast("string"))
    cat = c.filter(key % 3 != 0).select(path.alias("path"), name.alias("collection_name"))
    man = c.filter(key % 5 != 0).select(path.alias("codebase_path"), name.alias("collection_name"))
    col = t(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("collection_name")).distinct()
    return catalog.reconcile(cat, col, man)


@query("""WITH o AS (SELECT c_custkey AS k, 1 AS g, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0)
SELECT k, CAST(g AS BIGINT) AS generation, v FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT n.k, CAST(coalesce(o.g, 0) + 1 AS BIGINT), n.v FROM n LEFT JOIN o USING (k)""")
def manifest_upsert(spark, sf):
    """Delete key, insert, generation + 1."""
    c = t(spark, sf, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.lit(1).cast("long").alias("generation"), F.col("c_acctbal").alias("v"))
    new = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("generation"), (-F.col("c_acctbal")).alias("v"))
    return catalog.upsert(old, new, ["k"])


@query("""SELECT relative_path, change FROM (""" + STATE_SQL + """SELECT coalesce(o.relative_path, n.relative_path) AS relative_path,
 CASE WHEN o.hash IS NULL THEN 'added' WHEN n.hash IS NULL THEN 'removed' WHEN o.hash <> n.hash THEN 'modified' END AS change FROM o FULL JOIN n USING (relative_path)) WHERE change IS NOT NULL AND starts_with(relative_path, 'src1/')""")
def targeted_diff(spark, sf):
    """The difference for listed paths, which need cleaning first."""
    old, new = _states(spark, sf)
    p = vfiles(spark, sf).filter("source = 'src1'").select(F.concat(F.lit("./"), F.replace("relative_path", F.lit("/"), F.lit("//"))).alias("relative_path"))
    return incremental.targeted_diff(p.union(p).union(p.select(F.concat(F.lit("../"), "relative_path").alias("relative_path"))), old, new)


# Generated sources, and queries that SQL cannot express: greedy loops, parsers, and the engine end to end.
CODE = """concat('import {{ Base }} from "./base"\\n\\n// doc ', doc_id, '\\nexport class Shape', doc_id, ' extends Base {{\\n  area() {{\\n    return new Box', doc_id % 9, '(1)\\n  }}\\n}}\\n\\nexport function make', doc_id % 9, '(x) {{\\n  return Shape', doc_id, '(x)\\n}}\\n')""".replace("{{", "{").replace("}}", "}")


def code_files(spark, sf):
    return t(spark, sf, "documents").select(F.concat(F.lit("src/"), F.col("source"), F.lit("/unit"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("relative_path"), F.expr(CODE).alias("content"))


@query("""SELECT 'src/' || source || '/unit' || doc_id || '.ts' AS relative_path, CAST(unnest([0, 1]) AS INTEGER) AS chunk_index, CAST(unnest([3, 10]) AS BIGINT) AS start_line, CAST(unnest([8, 12]) AS BIGINT) AS end_line,
 unnest(['class_declaration', 'function_declaration']) AS node_type, unnest(['class', 'function']) AS symbol_kind, unnest(['Shape' || doc_id, 'make' || (doc_id % 9)]) AS symbol_name, 'definition' AS chunk_role FROM documents""")
def code_split_regex(spark, sf):
    """Declaration chunks with symbol, kind and role."""
    c = chunking.code_chunks(code_files(spark, sf))
    sym = T.symbol(F.col("content"))
    return c.select("relative_path", "chunk_index", "start_line", "end_line", "node_type", sym["kind"].alias("symbol_kind"), sym["name"].alias("symbol_name"),
                    T.chunk_role(F.col("node_type"), F.col("content"), F.lit("typescript"), F.col("relative_path"), sym).alias("chunk_role"))


@query()
def recursive_split(spark, sf):
    """Texts without declarations, split by size."""
    d = t(spark, sf, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("relative_path"), F.col("text").alias("content"))
    return chunking.code_chunks(d).select("relative_path", "chunk_index", "start_line", "end_line", F.char_length("content").alias("chars"))


def _results(spark, sf):
    """Search-like rows: every language is a query, every source a file."""
    d = t(spark, sf, "documents")
    return retrieval.ranked(d.select(
        F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("source").alias("relative_path"), F.col("text").alias("content"), (F.col("doc_id") % 400 + 1).alias("start_line"),
        (F.col("doc_id") % 400 + 12).alias("end_line"), (F.col("n_chars") % 997).cast("double").alias("score"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("path_match"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(F.col("doc_id") % 2 == 0, "definition").otherwise("reference").alias("chunk_role")), "score", "id", 200)


@query()
def greedy_dedupe(spark, sf):
    """Near-duplicate elimination in rank order."""
    return ranking.deduplicate(_results(spark, sf)).select("query_id", "id", "rank")


@query()
def diversify_full(spark, sf):
    """Files by evidence, three rows a file at most."""
    return ranking.diversify(_results(spark, sf), 50).select("query_id", "id", "relative_path", "pick")


@query()
def trace_end_to_end(spark, sf):
    """Symbol trace with imports resolved and enclosing symbols."""
    f = code_files(spark, sf).union(spark.createDataFrame([("src/src0/base.ts", "export class Base {}\n")], "relative_path string, content string"))
    return trace.trace_symbol(f, "Base", 200)


@query()
def search_end_to_end(spark, sf):
    """The whole search over an index that lives in the session only."""
    from corvane.engine import Engine

    root = f"{_scratch(spark)}/engine"
    e = Engine(spark, root)
    name = "code"
    e.index(name, code_files(spark, sf).filter("length(relative_path) > 0"))
    return e.search(name, "Shape7 make3 area", 10).select("rank", "id", "relative_path", "start_line", "score", "lexical_score", "owner_tier", "result_group")


def _scratch(spark: SparkSession) -> str:
    """A new folder where checkpoints go; only a local session that names none gets a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or f'file://{tempfile.gettempdir()}').rstrip('/')}/corvane-{uuid.uuid4().hex}"


@query(ORACLES["debounce_sessions"])
def streaming_incremental(spark, sf):
    """K01 as a stream: session windows over the events, with a watermark; equal to the batch form, open sessions included."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return tracker.run_debounce(spark, stream, "user_id", "ts", "1 hour", _scratch(spark))


@query("""WITH e AS (SELECT user_id % 50 AS codebase, CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'f' || (event_id % 40) END AS path, event_id AS version FROM events),
c AS (SELECT codebase, max(version) AS version, max(version) - 200 AS seen FROM e GROUP BY codebase), a AS (SELECT e.codebase, path FROM e JOIN c USING (codebase) WHERE e.version > seen)
SELECT c.codebase, CASE WHEN bool_or(path IS NULL) THEN 'unknown' ELSE 'dirty' END AS status, CASE WHEN bool_or(path IS NULL) THEN 0 ELSE count(DISTINCT path) END AS dirty_paths, c.version FROM c JOIN a USING (codebase) GROUP BY c.codebase, c.version""")
def streaming_dirty_state(spark, sf):
    """K02-K04 as a stream with state: file events and a sync that has seen all but the last 200 versions of each codebase, in two micro-batches."""
    root = _scratch(spark)
    e = _file_events(spark, sf)
    e.write.parquet(f"{root}/events")
    stream = lambda: spark.readStream.schema(e.schema).parquet(f"{root}/events")

    def run():
        q = tracker.dirty_stream(stream()).writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{root}/states"))
        q.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    e.groupBy("codebase").agg((F.max("version") - 200).alias("version")).select("codebase", F.lit(None).cast("string").alias("path"), F.lit(tracker.CLEAN).alias("kind"), "version").write.mode("append").parquet(f"{root}/events")
    run()
    return catalog.latest(spark.read.parquet(f"{root}/states"), ["codebase"], ["batch"]).drop("batch")


@query("""SELECT 'src/' || source || '/unit' || doc_id || '.ts' AS relative_path, ['Shape' || doc_id, 'make' || (doc_id % 9)] AS names FROM documents""")
def definition_identifiers(spark, sf):
    """Names that files define."""
    from corvane.functions.definitions import definition_identifiers as names

    f = code_files(spark, sf)
    return f.select("relative_path", names(F.col("content"), P.language(F.col("relative_path"))).alias("names"))


@query("""WITH e AS (SELECT user_id % 50 AS codebase, CASE WHEN event_id % 97 = 0 THEN NULL ELSE 'f' || (event_id % 40) END AS path, event_id % 97 = 0 AS unknown FROM events),
s AS (SELECT codebase, CASE WHEN bool_or(unknown) THEN 'unknown' ELSE 'dirty' END AS status FROM e GROUP BY codebase)
SELECT codebase, minutes, CASE WHEN codebase % 2 = 0 AND status <> 'clean' THEN 'sync' WHEN status = 'unknown' THEN 'serve_and_queue' WHEN status = 'dirty' THEN 'targeted_sync' WHEN minutes >= 10 THEN 'serve_and_queue' ELSE 'serve' END AS action
FROM (SELECT codebase, CASE WHEN codebase % 3 = 0 THEN 'clean' ELSE status END AS status FROM s), (SELECT unnest([3, 9, 10, 25]) AS minutes)""")
def sync_policy(spark, sf):
    """What a search does first, strong for even codebases, every third codebase clean, at several ages of the last full scan."""
    e = _file_events(spark, sf)
    done = e.filter("codebase % 3 = 0").groupBy("codebase").agg(F.max("version").alias("version")).select("codebase", F.lit(None).cast("string").alias("path"), F.lit(tracker.CLEAN).alias("kind"), "version")
    s = tracker.dirty_state(e.unionByName(done)).withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in (3, 9, 10, 25)])))
    return s.select("codebase", "minutes", tracker.decide(F.col("status"), F.col("codebase") % 2 == 0, F.col("minutes")).alias("action"))


@query("""WITH o AS (SELECT relative_path, row_number() OVER (ORDER BY relative_path, chunk_index) AS place FROM (SELECT source AS relative_path, doc_id AS chunk_index FROM documents))
SELECT relative_path, count(*) AS chunks, CASE WHEN (SELECT count(*) FROM documents) > 150 THEN 'limit_reached' ELSE 'completed' END AS status FROM o WHERE place <= 150 GROUP BY relative_path""")
def chunk_cap(spark, sf):
    """The first 150 chunks in path order, with the run's status."""
    d = t(spark, sf, "documents").select(F.col("source").alias("relative_path"), F.col("doc_id").alias("chunk_index"))
    return chunking.capped(d, 150).groupBy("relative_path", "status").agg(F.count("*").alias("chunks"))


@query(f"""WITH p AS (SELECT string_split({SHAPED_DUCK}, '/') AS parts, n_chars FROM documents),
f AS (SELECT unnest(list_transform(range(0, len(parts)), lambda i: array_to_string(parts[1:i], '/'))) AS folder, n_chars FROM p)
SELECT folder, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM f GROUP BY folder""")
def directory_tree(spark, sf):
    """Files and bytes of every folder."""
    from corvane.sources.files import directory

    return directory(t(spark, sf, "documents").select(F.expr(SHAPED_SPARK).alias("relative_path"), F.col("n_chars").alias("size")))


@query("""WITH r AS (SELECT lang AS case_id, source AS path, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT case_id, count(DISTINCT CASE WHEN rank <= 5 THEN path END) <= 2 OR count(DISTINCT CASE WHEN rank <= 10 THEN path END) <= 3 AS saturated FROM r GROUP BY case_id""")
def same_file_saturation(spark, sf):
    """F19."""
    d = t(spark, sf, "documents").select(F.col("lang").alias("case_id"), F.col("source").alias("path"), "n_chars", "doc_id")
    return evaluation.saturation(d.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n_chars"), "doc_id"))))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'removed' ELSE 'added' END AS change FROM orders WHERE o_orderkey % 3 <> 1""")
def merkle_compare(spark, sf):
    """Set differences of node ids."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return incremental.merkle_changes(o.filter("id % 3 <> 2"), o.filter("id % 3 <> 0"))


# Catalog and evaluation over small tables of the test data.
@query("""WITH s AS (SELECT o_orderkey % 6 AS score, o_orderkey % 4 AS n, o_orderkey % 7 <> 0 AS valid FROM orders)
SELECT CASE WHEN NOT valid THEN 'invalid_fixture' WHEN n = 0 THEN 'empty_result' WHEN score < 3 THEN 'search_miss' ELSE 'expected_hit' END AS kind, count(*) AS cases FROM s GROUP BY 1""")
def failure_taxonomy(spark, sf):
    """Cases by kind of failure."""
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").groupBy(evaluation.taxonomy(k % 6, k % 4, k % 7 != 0).alias("kind")).agg(F.count("*").alias("cases"))


@query("""WITH c AS (SELECT o_orderkey % 9 AS rank, o_orderkey % 2 = 0 AS test_first, o_orderkey % 5 = 0 AS barrel_first FROM orders)
SELECT count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 5) AS top5, round(avg(CAST(test_first AS DOUBLE)), 9) AS test_first, round(avg(CAST(barrel_first AS DOUBLE)), 9) AS barrel_first FROM c""")
def quality_summary(spark, sf):
    """F13, M06."""
    k = F.col("o_orderkey")
    s = evaluation.quality_summary(t(spark, sf, "orders").select((k % 9).alias("rank"), (k % 2 == 0).alias("test_first"), (k % 5 == 0).alias("barrel_first")))
    return s.select("top3", "top5", F.round("test_first", 9).alias("test_first"), F.round("barrel_first", 9).alias("barrel_first"))


@query("""SELECT CAST(sum(o_orderkey % 5) AS BIGINT) AS added, CAST(sum(o_orderkey % 3) AS BIGINT) AS removed, CAST(sum(o_orderkey % 2) AS BIGINT) AS modified, count(*) FILTER (o_orderkey % 11 = 0) AS warnings FROM orders""")
def sync_totals(spark, sf):
    """F08."""
    k = F.col("o_orderkey")
    return catalog.sync_totals(t(spark, sf, "orders").select((k % 5).alias("added"), (k % 3).alias("removed"), (k % 2).alias("modified"), F.when(k % 11 == 0, F.lit("w")).alias("warning")))


def _catalog(spark, sf):
    """(catalog, collections, manifests) from customers and suppliers: some collections missing, empty or of unknown size."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = F.concat(F.lit("k"), (k % 20).cast("string"))
    cat = t(spark, sf, "customer").select(F.concat(F.lit("p"), k.cast("string")).alias("path"), name.alias("collection_name"), F.concat(F.lit("d"), k.cast("string")).alias("derived_name"), (k % 3).alias("files"), (k % 3 * 2).alias("chunks"))
    numbers = spark.range(20).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("collection_name"), F.col("id"))
    col = numbers.filter("id % 4 <> 1").select("collection_name", F.when(F.col("id") % 5 != 2, F.col("id") % 3).alias("row_count"))
    man = numbers.filter("id % 3 <> 0").select("collection_name", (F.col("id") % 2).alias("files"), (F.col("id") % 2 * 2).alias("chunks"))
    return cat, col, man


CATALOG_SQL = """WITH cat AS (SELECT 'p' || c_custkey AS path, 'k' || (c_custkey % 20) AS collection_name, 'd' || c_custkey AS derived_name, c_custkey % 3 AS files, c_custkey % 3 * 2 AS chunks FROM customer),
n AS (SELECT 'k' || i AS collection_name, i FROM (SELECT unnest(range(20)) AS i)), col AS (SELECT collection_name, CASE WHEN i % 5 <> 2 THEN i % 3 END AS row_count FROM n WHERE i % 4 <> 1),
man AS (SELECT collection_name, i % 2 AS m_files, i % 2 * 2 AS m_chunks FROM n WHERE i % 3 <> 0),
j AS (SELECT cat.*, col.collection_name IS NOT NULL AS there, row_count, man.collection_name IS NOT NULL AS listed, m_files, m_chunks FROM cat LEFT JOIN col USING (collection_name) LEFT JOIN man USING (collection_name))
"""


@query(CATALOG_SQL + """SELECT path, CASE WHEN NOT there THEN 'remove' WHEN row_count IS NULL THEN 'skip' WHEN row_count = 0 THEN 'remove' WHEN listed THEN 'overwrite' ELSE 'skip' END AS action FROM j WHERE files = 0 AND chunks = 0""")
def heal_catalog(spark, sf):
    """E19."""
    return catalog.heal(*_catalog(spark, sf))


@query(CATALOG_SQL + """SELECT path, list_filter([CASE WHEN NOT there THEN 'collection is missing' END, CASE WHEN there AND row_count IS NULL THEN 'row count unknown' END, CASE WHEN row_count = 0 THEN 'collection is empty' END,
 CASE WHEN NOT listed THEN 'no manifest' END, CASE WHEN m_chunks <> chunks THEN 'chunks differ from the manifest' END, CASE WHEN m_files <> files THEN 'files differ from the manifest' END], lambda w: w IS NOT NULL) AS warnings FROM j""")
def status_diagnostics(spark, sf):
    """E16."""
    return catalog.diagnose(*_catalog(spark, sf))


@query(CATALOG_SQL + """, t AS (SELECT 'k' || i AS target FROM (SELECT unnest(range(25)) AS i) UNION ALL SELECT 'p' || c_custkey FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT 'd' || c_custkey FROM customer WHERE c_custkey % 9 = 0)
SELECT DISTINCT target, collection_name FROM t JOIN cat ON target = collection_name OR target = path OR target = derived_name""")
def resolve_targets(spark, sf):
    """By collection, path or derived name."""
    cat = _catalog(spark, sf)[0]
    c = t(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    asked = spark.range(25).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("target")).union(c.filter("c_custkey % 7 = 0").select(F.concat(F.lit("p"), k))).union(c.filter("c_custkey % 9 = 0").select(F.concat(F.lit("d"), k)))
    return catalog.resolve_target(asked, cat)


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderkey % 10 AS size, o_orderkey % 4 AS age, CASE WHEN o_orderkey % 6 <> 0 THEN 1 END AS lines FROM orders)
SELECT 'f' || k AS relative_path, k % 5 <> 0 AND age <> 3 AND lines IS NOT NULL AND k % 8 <> 1 AS reuse FROM s""")
def hash_reuse(spark, sf):
    """Files with the size and time of the last state need no new hash."""
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("f"), k.cast("string")).alias("relative_path")
    before = o.filter(k % 8 != 1).select(path, (k % 10).alias("size"), (k % 4).alias("mtime"), F.when(k % 6 != 0, 1).alias("effective_lines"))
    now = o.select(path, F.when(k % 5 == 0, k % 10 + 1).otherwise(k % 10).alias("size"), F.when(k % 4 == 3, 9).otherwise(k % 4).alias("mtime"))
    return incremental.changed_states(before, now)


@query("""WITH a AS (SELECT conv_id AS id, min(turn) AS s FROM conversations GROUP BY conv_id), b AS (SELECT conv_id AS id, CAST(max(length(text)) AS BIGINT) AS s FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id),
x AS (SELECT id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1.0 END AS s1 FROM a),
y AS (SELECT id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE 1.0 END AS s2 FROM b),
f AS (SELECT coalesce(x.id, y.id) AS id, round(0.3 * coalesce(s1, 0) + 0.7 * coalesce(s2, 0), 9) AS score FROM x FULL JOIN y ON x.id = y.id)
SELECT id, score FROM f ORDER BY score DESC, id LIMIT 20""")
def weighted_fusion(spark, sf):
    """Two lists by their scaled scores."""
    c = t(spark, sf, "conversations")
    one = lambda df, s: df.groupBy(F.col("conv_id").alias("id")).agg(s.cast("double").alias("score")).withColumn("query_id", F.lit("q"))
    both = retrieval.weighted(one(c, F.min("turn")), one(c.filter("conv_id % 3 <> 0"), F.max(F.char_length("text"))), 10**6, (0.3, 0.7))
    return both.select("id", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(f"""WITH v AS ({VFILES}), q AS (SELECT unnest(['doc_7.md', 'src1/de', 'de/DOC_12.md', './en/doc_3.md', 'nothing.md']) AS name), w AS (SELECT name, lower(regexp_replace(name, '^([.]/)+', '')) AS wanted FROM q)
SELECT name, relative_path FROM v JOIN w ON lower(relative_path) = wanted OR ends_with(lower(relative_path), '/' || wanted)""")
def exact_files(spark, sf):
    """Files that a name or path asks for exactly."""
    from corvane.sources.files import exact_file

    return exact_file(vfiles(spark, sf), spark.createDataFrame([(n,) for n in ("doc_7.md", "src1/de", "de/DOC_12.md", "./en/doc_3.md", "nothing.md")], "name string"))


@query("""WITH e AS (SELECT conv_id % 7 AS case_id, 'Unit' || (conv_id % 30) AS symbol, CASE turn % 3 WHEN 0 THEN 'definition' WHEN 1 THEN 'import' ELSE 'reference' END AS kind, 'a/unit_' || (conv_id % 30) || '.ts' AS own, 'a/other' || (conv_id % 30) || '.ts' AS other FROM conversations),
f AS (SELECT case_id, symbol, CASE WHEN kind = 'definition' THEN own WHEN kind = 'import' THEN other END AS path FROM e), w AS (SELECT i AS case_id, unnest(['a/unit_' || (i * 3) || '.ts', 'a/other' || (i * 2) || '.ts', 'a/unit_' || i || '.ts']) AS path FROM (SELECT unnest(range(7)) AS i))
SELECT DISTINCT case_id, path FROM f JOIN w USING (case_id, path) WHERE contains(regexp_replace(regexp_extract(path, '([^/]*)[.]ts$', 1), '[^A-Za-z0-9]', '', 'g'), lower(symbol))""")
def trace_coverage(spark, sf):
    """Expected paths that trace evidence names."""
    c, k = t(spark, sf, "conversations"), (F.col("conv_id") % 30).cast("string")
    own, other = F.concat(F.lit("a/unit_"), k, F.lit(".ts")), F.concat(F.lit("a/other"), k, F.lit(".ts"))
    kind = F.when(F.col("turn") % 3 == 0, "definition").when(F.col("turn") % 3 == 1, "import").otherwise("reference")
    evidence = c.select((F.col("conv_id") % 7).alias("case_id"), F.concat(F.lit("Unit"), k).alias("symbol"), kind.alias("kind"), own.alias("relative_path"), other.alias("resolved_path"))
    cases = spark.createDataFrame([(i, [f"a/unit_{i * 3}.ts", f"a/other{i * 2}.ts"], [f"a/unit_{i}.ts"]) for i in range(7)], "case_id long, primary array<string>, acceptable array<string>")
    return evaluation.covered_by_trace(evidence, cases)
