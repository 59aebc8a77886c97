"""The engine's own API: index a tree or a table of files, search it, keep it current, trace symbols."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths as P
from corvane.functions import text as T
from corvane.functions.definitions import definition_identifiers
from corvane.functions.embedding import EmbedBatch, embedding_column, hashed
from corvane.operators import chunking, incremental, lexical, ranking, retrieval, trace
from corvane.operators.filters import anchor_filter, extension_filter, filename_filter, parse_filter
from corvane.sources import files as sources
from corvane.sources.index_store import IndexStore

LEXICAL_ROWS = 200
REPOSITORY = re.compile(r"^(?:[a-z+]+://)?(?:[^@/]+@)?([^/:]+)[/:](.+?)(?:\.git)?/?$")


def identity(kind: str, value: str) -> str:
    """path: as it is; git: host/owner/name whatever the protocol; global and custom: the given value."""
    if kind == "git" and (m := REPOSITORY.match(value.strip())):
        return f"{m[1].lower()}/{m[2].strip('/')}"
    return value.replace("\\", "/").rstrip("/") if kind == "path" else value


def collection_name(value: str, readable: str | None = None, hybrid: bool = True) -> str:
    """Prefix, eight hex digits of the identity's md5, and an optional readable part; 255 characters at most."""
    name = ("hybrid_code_chunks_" if hybrid else "code_chunks_") + hashlib.md5(value.encode()).hexdigest()[:8]
    if readable:
        name += "_" + re.sub(r"[^A-Za-z0-9_]+", "_", readable).strip("_")
    return name[:255]


@dataclass
class Engine:
    """root: where collections live. embed: texts to vectors."""

    spark: SparkSession
    root: str
    embed: EmbedBatch | None = None

    def __post_init__(self):
        self.embed = self.embed or hashed()
        self.store, self.states, self.posted = (IndexStore(self.spark, f"{self.root}/{kind}") for kind in ("index", "state", "postings"))

    @staticmethod
    def pieces(files: DataFrame) -> DataFrame:
        """Chunks as they come out of the splitters, with the hash that tells repeats."""
        lang = P.language(F.col("relative_path"))
        md = chunking.markdown_sections(files.filter(lang == "markdown")).select(
            "relative_path", F.col("section").cast("int").alias("chunk_index"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content",
            F.col("chunk_kind").alias("node_type"), "symbol_name")
        code = chunking.code_chunks(files.filter(lang != "markdown")).filter("error is null").select("relative_path", "chunk_index", "start_line", "end_line", "content", "node_type", F.lit(None).cast("string").alias("symbol_name"))
        return md.unionByName(code).withColumn("normalized_content_hash", T.normalised_hash(F.col("content")))

    @staticmethod
    def described(pieces: DataFrame) -> DataFrame:
        """Chunk rows with all structured columns, without vectors."""
        rows = pieces.withColumn("language", P.language(F.col("relative_path")))
        c, path = F.col("content"), F.col("relative_path")
        rows = rows.withColumn("sym", F.when(F.col("language") != "markdown", T.symbol(c)).when(F.col("symbol_name").isNotNull(), F.struct(F.lit("section").alias("kind"), F.col("symbol_name").alias("name"))))
        defined = definition_identifiers(c, F.col("language"))
        return rows.select(
            T.chunk_id(path, F.col("start_line"), F.col("end_line"), c).alias("id"), "content", "relative_path", "start_line", "end_line", P.extension(path).alias("file_extension"),
            F.coalesce("sym.name", F.lit("")).alias("primary_symbol"), F.coalesce("sym.kind", F.lit("")).alias("symbol_kind"),
            F.when(F.col("language") == "markdown", F.col("node_type")).otherwise(T.chunk_kind(F.col("node_type"), F.col("sym.kind"))).alias("chunk_kind"), F.col("sym").isNotNull().alias("is_definition"),
            P.file_role(path, c).alias("file_role"), P.stem(path).alias("basename"), *[P.segment(path, i).alias(f"path_segment_{i}") for i in range(5)], P.file_name(path).alias("file_name"),
            P.path_tokens(path).alias("path_tokens"), F.array_union(defined, F.array_compact(F.array("sym.name"))).alias("symbols"), defined.alias("definition_identifiers"),
            T.content_hash(c).alias("content_hash"), "normalized_content_hash", T.chunk_role(F.col("node_type"), c, F.col("language"), path, F.col("sym")).alias("chunk_role"), "language", "chunk_index", F.size(retrieval.tokens(c)).alias("n_terms"))

    def chunks(self, files: DataFrame) -> DataFrame:
        return self.described(self.pieces(files))

    def rows(self, files: DataFrame) -> DataFrame:
        """Chunk rows with vectors."""
        return self._embedded(chunking.distinct_in_file(self.pieces(files), F.col("start_line")))

    def _embedded(self, pieces: DataFrame) -> DataFrame:
        """Equal contents are embedded once."""
        chunks = self.described(pieces)
        return incremental.embed_once(chunks, embedding_column(self.embed)(F.col("content")))

    @staticmethod
    def state(files: DataFrame) -> DataFrame:
        """What the next run compares with; mtime where the files have one."""
        mtime = F.col("mtime") if "mtime" in files.columns else F.lit(None)
        return files.select("relative_path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"), T.effective_lines(F.col("content")).alias("effective_lines"),
                            mtime.cast("timestamp").alias("mtime"))

    def _postings(self, rows: DataFrame) -> DataFrame:
        """Term counts of index rows, sorted within a task so that a term's rows lie together in the files."""
        return retrieval.postings(rows, "id", "content", ["relative_path"]).sortWithinPartitions("term")

    def index(self, name: str, files: DataFrame, cap: int = chunking.CHUNK_CAP) -> dict:
        """Build a collection from (relative_path, content[, mtime]) rows, of at most `cap` chunks in path order. Rows first, then postings, the state last.

        All files are split once and their chunks counted; only chunks within the cap are described, embedded and written.
        """
        with self.store.staged(name, chunking.distinct_in_file(self.pieces(files), F.col("start_line"))) as pieces:
            end = chunking.cut(pieces, cap)
            rows = self._embedded(pieces if end is None else chunking.until(pieces, *end))
            manifest = self.store.commit(name, rows, status="completed" if end is None else "limit_reached")
        self.posted.commit(name, self._postings(self.store.read(name)))
        self.states.commit(name, self.state(files))
        return manifest

    def index_tree(self, name: str, path: str, **options) -> dict:
        files = sources.read_tree(self.spark, path, **options).filter("error is null")
        return self.index(name, files.select("relative_path", "content", "mtime"))

    def reindex(self, name: str, files: DataFrame, automatic: bool = False) -> dict:
        """Apply what changed since the last state. An automatic run refuses growth beyond the guard and changes nothing."""
        return self._apply(name, self.states.read(name), files, incremental.snapshot_diff, automatic)

    def reindex_paths(self, name: str, paths: list[str], files: DataFrame, automatic: bool = False) -> dict:
        """The same for some paths only. files: their rows where they exist; all other files stay unread."""
        asked = self.spark.createDataFrame([(p,) for p in paths], "relative_path string")
        return self._apply(name, self.states.read(name), files, lambda old, new: incremental.targeted_diff(asked, old, new), automatic)

    def reindex_tree(self, name: str, path: str, automatic: bool = False, **options) -> dict:
        """Apply what changed in a folder: files whose size and time are those of the state are not hashed again."""
        old = self.states.read(name)
        listed = sources.read_tree(self.spark, path, **options).filter("error is null")
        reuse = incremental.changed_states(old, listed).filter("reuse").select("relative_path")
        fresh = self.state(listed.join(reuse, "relative_path", "left_anti"))
        new = fresh.unionByName(old.join(reuse, "relative_path", "left_semi").select(*fresh.columns))
        return self._apply(name, old, listed.select("relative_path", "content", "mtime"), incremental.snapshot_diff, automatic, new)

    def _apply(self, name: str, old: DataFrame, files: DataFrame, diff, automatic: bool, new: DataFrame | None = None) -> dict:
        new = self.state(files) if new is None else new
        changes = diff(old, new).cache()
        touched = new.join(changes.select("relative_path"), "relative_path", "left_semi")
        growth = incremental.effective_growth(old.join(changes.select("relative_path"), "relative_path", "left_semi"), touched).first().growth
        if not incremental.may_apply(growth, automatic):
            changes.unpersist()
            return {"status": "refused", "growth": growth}
        counts = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
        if counts:
            gone = changes.filter("change <> 'added'").select("relative_path")
            come = self.rows(files.join(changes.filter("change <> 'removed'").select("relative_path"), "relative_path", "left_semi"))
            self.store.update(name, gone, come, status="completed")
            written = self.store.read(name).join(changes.select("relative_path"), "relative_path", "left_semi")
            self.posted.update(name, gone, self._postings(written))
            self.states.update(name, gone, touched)
        changes.unpersist()
        return {"status": "completed", "growth": growth, **{k: counts.get(k, 0) for k in ("added", "removed", "modified")}}

    def search(self, name: str, query: str, limit: int | None = None, target: str = "implementation", include_related: bool = True, where: str | None = None, extensions: list[str] = (),
               threshold: float | None = None, weights: tuple[float, float] | None = None) -> DataFrame:
        """Ranked rows: dense and BM25 ranks fused, lexical candidates merged, near duplicates removed, roles grouped, files diversified.

        threshold: least cosine of a dense hit. weights: fuse scaled scores by these weights of (dense, BM25), not ranks.
        """
        out, candidates = retrieval.limits(limit)
        index = self.store.read(name)
        if where:
            index = index.filter(parse_filter(where, index.columns))
        index = index.filter(extension_filter(list(extensions)))
        q = self.spark.createDataFrame([("q", query, self.embed([query])[0])], "query_id string, query string, query_vector array<float>")
        dense = retrieval.dense_topk(index, q, candidates, threshold=threshold)
        sparse = retrieval.bm25_indexed(index, self.posted.read(name), q, candidates)
        fused = retrieval.weighted(dense, sparse, candidates, weights) if weights else retrieval.fuse(dense, sparse, candidates)
        terms = lexical.analyse(query)
        score, reasons, tier = lexical.lexical_score(terms, role_scoring=target != "all")
        scored = lambda rows: (rows.withColumn("content_definitions", F.col("definition_identifiers")).withColumn("lexical_score", score.cast("int"))
                               .withColumn("reasons", reasons).withColumn("owner_tier", tier))
        lean = index.drop("vector")
        known = ["lexical_score", "owner_tier", "reasons"]
        # `candidates` and LEXICAL_ROWS bound what comes to the driver; all that follows works on local tables of that size
        first = self._local(fused.select("query_id", "id", "score", "rank"))
        rows = scored(lean.filter(F.col("id").isin([r.id for r in first.collect()])))
        if terms.anchors or terms.filename:
            exact = filename_filter(terms.filename) if terms.filename else anchor_filter(terms.anchors)
            found = self._local(scored(lean.filter(exact)).filter("lexical_score > 0").orderBy(F.desc("owner_tier"), F.desc("lexical_score"), "relative_path", "start_line", "id").limit(LEXICAL_ROWS))
            rows = self._local(rows).unionByName(found).dropDuplicates(["id"])
            hits = first.join(rows.select("id", *known), "id").withColumnRenamed("id", "result_key")
            said = found.select(F.lit("q").alias("query_id"), F.col("id").alias("result_key"), F.col("lexical_score").cast("double").alias("score"), *known)
            merged = retrieval.merge_lexical(hits, said).withColumnRenamed("result_key", "id")
            full = merged.select("query_id", "id", "score", "rank", *known).join(rows.drop(*known), "id")
        else:
            full = first.join(rows, "id")
        full = self._local(ranking.with_features(full.drop("content_definitions")))
        ordered = ranking.in_group_order(ranking.deduplicate(full), terms, target)
        if target == "all":
            out_rows = ordered.filter(F.col("rank") <= out)
        elif not include_related:
            out_rows = ranking.diversify(ordered.filter("is_primary"), out).drop("rank").withColumnRenamed("pick", "rank")
        else:
            out_rows = ranking.place_related(ranking.diversify(ordered, candidates + LEXICAL_ROWS, by=["query_id", "is_primary"]).drop("rank"), out)
        return out_rows.drop(*ranking.FEATURES)

    def _local(self, rows: DataFrame) -> DataFrame:
        """A table of a few hundred rows at most, computed once."""
        return self.spark.createDataFrame(rows.collect(), rows.schema)

    def context(self, results: DataFrame, files: DataFrame, around: int = 4, cap: int = 5000) -> DataFrame:
        """Results with the file's current lines around each hit; the stored chunk where the file or the range is gone."""
        f = files.select("relative_path", F.split("content", "\n").alias("ls"))
        start, end = F.greatest(F.lit(1), F.col("start_line") - around).cast("int"), (F.col("end_line") + around).cast("int")
        fresh = F.when((F.col("start_line") > 0) & (F.size("ls") >= F.col("end_line")), F.array_join(F.slice("ls", start, end - start + 1), "\n"))
        return results.join(f, "relative_path", "left").withColumn("context", T.truncated(F.coalesce(fresh, F.col("content")), cap)).withColumn("stale", fresh.isNull()).drop("ls")

    def trace(self, files: DataFrame, symbol: str, **options) -> DataFrame:
        return trace.trace_symbol(files, symbol, **options)

    def preview(self, files: DataFrame, n: int = 50) -> tuple[int, list[str]]:
        return sources.preview(files, n)

    def has(self, name: str) -> bool:
        return self.store.exists(name)

    def status(self, name: str) -> dict:
        return {"manifest": self.store.manifest(name), "rows": self.store.row_count(name) if self.has(name) else None}

    def clear(self, name: str) -> None:
        """State first, then postings and rows."""
        for store in (self.states, self.posted, self.store):
            store.drop(name)
