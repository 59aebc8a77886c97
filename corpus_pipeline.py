"""Corpus pipeline: raw documents to token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents. run() applies them in turn, each written as
Parquet in the shared folder and read again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import quality
from corvane.llm.bpe import bpe_encode
from corvane.llm.decontaminate import without_benchmark
from corvane.llm.ngram_join import one_of_each_group
from corvane.llm.queries import table, tokenizer_path
from corvane.llm.secrets import mask_secrets
from corvane.llm.shared import discard, materialise, prepare, standing


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject. It learns from the labels of documents that are not held out.

    Every row is judged by its text alone, whatever its id; null and empty texts score 0 and go. All
    columns stay as they were, also those named like the classifier's. Without labels the model is
    blank and keeps every text that is not empty; an empty table stays empty.
    """
    prepare(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id; see one_of_each_group for null and repeated ids and empty texts."""
    prepare(spark)
    return one_of_each_group(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item. Null and empty texts hold none; ids, null or repeated, decide nothing. An empty benchmark drops nothing."""
    prepare(spark)
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secret values masked in the text; n_chars, where there is such a column, counted anew. Null and empty texts stay as they are."""
    prepare(spark)
    masked = mask_secrets(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; null and empty texts have no tokens, null and repeated ids stay as they are."""
    prepare(spark)
    return bpe_encode(docs, tokenizer_path()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scan", hide_secrets),
    ("BPE encoding", encode),
]
ORACLE_SQL = None  # a trained network and similarity groups are beyond SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage has written goes once the next stage's rows stand."""
    docs = table(spark, sf_dir, "documents")
    earlier = set(standing())
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = materialise(docs, name.replace(" ", "-"))
            for old in set(standing()) - earlier - {path}:
                discard(spark, old)
    return docs
