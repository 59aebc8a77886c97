"""Registered queries of the training-data operators: thin wrappers that read whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window

from pyspark.sql import functions as F

from corvane.llm import quality
from corvane.llm.bpe import bpe_digests
from corvane.llm.chat_format import SCHEMA_COLUMNS, format_chat, holds_calls
from corvane.llm.decontaminate import contaminated
from corvane.llm.html_extract import extract_text
from corvane.llm.ngram_join import ngram_jaccard
from corvane.llm.secrets import KINDS, scan_secrets, span_text
from corvane.llm.shared import prepare
from corvane.llm.substring_dedup import remove_repeats
from corvane.llm.topk import exact_topk
from corvane.llm.warc import capture_index, read_records, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", "predicted")


def as_tool_messages(rows: DataFrame) -> DataFrame:
    """Messages for format_chat: user turns as calls, and the assistant turns after them as their results; all other rows as they are.

    A call from turn 2 on refers to the call two turns before. Rows that repeat (conv_id, turn,
    role) get ids of their own, in the order of their texts; the first has the id without a number.
    Rows without conv_id or turn, and assistant texts that hold real calls, stay as they are.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    own = F.coalesce(F.col("role").isin("user", "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & ~((F.col("role") == "assistant") & holds_calls("text")), F.lit(False))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn", "role").orderBy("text"))
    mine = rows.filter(own).withColumn("place", F.when(place > 1, F.concat(F.lit("-"), place)).otherwise(F.lit("")))
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - back)
    arguments = F.struct("turn", F.col("text").alias("prompt"), F.when(F.col("turn") >= 2, F.concat(F.lit("$"), name(2))).alias("after"))
    call = F.struct(F.concat(name(0), "place").alias("id"), F.when(F.col("turn") >= 2, F.lit("reply")).otherwise(F.lit("open")).alias("name"), arguments.alias("arguments"))
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    given = F.to_json(F.struct(F.concat(name(1), "place").alias("tool_call_id"), F.struct("text").alias("content")))
    user = F.col("role") == "user"
    return mine.select("conv_id", "turn", F.when(user, F.lit("assistant")).otherwise(F.lit("tool")).alias("role"), F.when(user, asked).otherwise(given).alias("text")).unionByName(rows.filter(~own))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of conversations: calls with levels and results as of as_tool_messages, the rest as messages."""
    asks = [("prompt", "string", True), ("turn", "integer", True)]
    schemas = spark.createDataFrame([("open", asks), ("reply", [*asks, ("after", "string", True)])], SCHEMA_COLUMNS)
    return format_chat(as_tool_messages(table(spark, sf_dir, "conversations")), schemas)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, folder = write_archives(table(spark, sf_dir, "pages"))
    return read_records(capture_index(entries), folder).drop("payload", "url", "place")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"), count("guess"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op3_tool_call_linking": op3_tool_call_linking,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_html_text": op8_html_text,
    "op9_exact_topk": op9_exact_topk,
    "op10_secrets": op10_secrets,
}
ORACLES: dict[str, str] = {
    "op3_tool_call_linking": """
        WITH r AS (
            SELECT conv_id, turn, role, text, role IN ('user', 'assistant') AND conv_id IS NOT NULL AND turn IS NOT NULL AS own,
                   row_number() OVER (PARTITION BY conv_id, turn, role ORDER BY text NULLS FIRST) AS place FROM conversations
        ), n AS (
            SELECT *, CASE WHEN place > 1 THEN '-' || place ELSE '' END AS tail FROM r WHERE own
        ), steps AS (
            SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
            FROM (SELECT DISTINCT conv_id, turn FROM n WHERE role = 'user')
        ), levels AS (
            SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS INTEGER) AS level FROM steps
        ), calls AS (
            SELECT conv_id, turn, level, text, 'c' || conv_id || '-' || turn || tail AS call_id, CASE WHEN turn >= 2 THEN 'reply' ELSE 'open' END AS name,
                   CASE WHEN turn >= 2 THEN '"after":"$c' || conv_id || '-' || (turn - 2) || '",' ELSE '' END AS after
            FROM n JOIN levels USING (conv_id, turn) WHERE role = 'user'
        ), results AS (
            SELECT conv_id, turn, text, 'c' || conv_id || '-' || (turn - 1) || tail AS call_id FROM n WHERE role = 'assistant'
        )
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn,
               CASE WHEN c.call_id IS NOT NULL THEN 'call' ELSE 'result' END AS kind, level,
               c.call_id IS NOT NULL AND r.call_id IS NOT NULL AS linked,
               CASE WHEN c.call_id IS NULL THEN 'no call' WHEN c.text IS NULL THEN 'missing:prompt' ELSE '' END AS complaint,
               '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '{' || c.after || coalesce('"prompt":' || CAST(to_json(c.text) AS VARCHAR) || ',', '') || '"turn":' || c.turn || '}' END
               || ',"id":"' || coalesce(c.call_id, r.call_id) || '","name":' || coalesce('"' || c.name || '"', 'null')
               || ',"result":' || CASE WHEN r.call_id IS NULL THEN 'null' WHEN r.text IS NULL THEN '{}'
                                       ELSE '{"text":' || CAST(to_json(r.text) AS VARCHAR) || '}' END || '}' AS json
        FROM calls c FULL JOIN results r USING (conv_id, call_id)
        UNION ALL
        SELECT conv_id, NULL, turn, 'message', NULL, FALSE, '',
               '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
        FROM r WHERE own IS NOT TRUE""",
    "op2_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                                    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS shingle FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)
        ), reach AS (
            SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.root AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) r ON r.node = d.doc_id""",
    "op4_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), p AS (
            SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w
        ), v AS (
            SELECT doc_id, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS win,
                   generate_subscripts(range(1, len(ws) - 18), 1) AS pos FROM w WHERE len(ws) >= 20
        ), again AS (
            SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM v) WHERE n > 1
        ), c AS (
            SELECT p.doc_id, p.pos, word, max(CASE WHEN again.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
            FROM p LEFT JOIN again ON p.doc_id = again.doc_id AND p.pos = again.pos
        ), g AS (
            SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)""",
    "op7_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
        ), g AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p
        )
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN payload_bytes >= 1000 AND last IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND last IS DISTINCT FROM page_id THEN last END AS refers_to
        FROM g""",
    "op9_exact_topk": """
        WITH x AS (
            SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
        ), s AS (
            SELECT q.place, q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM x q JOIN x c ON q.place <> c.place
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
