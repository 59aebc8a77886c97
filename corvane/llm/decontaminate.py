"""Benchmark decontamination by greedy string tiling.

Seeds are the hashes of `min_match` consecutive words (lower case, without ASCII punctuation).
Documents that hold a seed of the benchmark pass a filter of fixed size, and a join on the seed
names the items each may hold. Every such pair is tiled: running Karp-Rabin windows find the
maximal matches among unmarked words, the longest is marked on both sides, and so on until no match
of min_match words is left. The share of an item's words that got marked, its coverage, does not
depend on their order in the document, so reordered passages count as well.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.hashing import slices, text_buffers, window_hashes, word_hashes
from corvane.llm.shared import materialise, unused_name

FILTER_BITS = 22


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in doc, start in item, length), longest first; ties go to the smaller starts."""
    k = min(min_match, len(item))
    if not k or len(doc) < k:
        return []
    bounds = lambda x: np.array([0, len(x)])
    d_win, d_ok = window_hashes(doc, bounds(doc), k)
    i_win, i_ok = window_hashes(item, bounds(item), k)
    by_hash: dict[int, list[int]] = {}
    for j in np.flatnonzero(i_ok).tolist():
        by_hash.setdefault(int(i_win[j]), []).append(j)
    hits = np.flatnonzero(np.isin(d_win, np.array(list(by_hash), np.uint64)) & d_ok)
    # seeds as diagonals: on diagonal p - j, runs of consecutive p are matches; runs split as words get marked
    starts, ends = [], []
    by_diagonal: dict[int, list[int]] = {}
    for p in hits.tolist():
        for j in by_hash[int(d_win[p])]:
            by_diagonal.setdefault(p - j, []).append(p)
    for diagonal, ps in by_diagonal.items():
        at = np.array(ps)
        cuts = np.flatnonzero(np.diff(at) != 1) + 1
        starts += [(int(x[0]), diagonal) for x in np.split(at, cuts)]
        ends += [int(x[-1]) + k for x in np.split(at, cuts)]
    d_free, i_free = np.ones(len(doc), bool), np.ones(len(item), bool)
    queue = [(-(e - p), p, p - diagonal) for (p, diagonal), e in zip(starts, ends, strict=True)]
    heapq.heapify(queue)
    tiles = []
    while queue:
        n, p, j = heapq.heappop(queue)
        free = d_free[p : p - n] & i_free[j : j - n]
        if free.all():
            d_free[p : p - n] = i_free[j : j - n] = False
            tiles.append((p, j, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False]))))  # what is left of a match goes back
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= k:
                heapq.heappush(queue, (-(b - a), p + a, j + a))
    return tiles


def _sequences(batch: pa.RecordBatch):
    """Word hashes of each text, with its index."""
    data, offs = text_buffers(batch.column("text"))
    for a, b in slices(offs):
        words, _, _, bounds = word_hashes(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], lower=True, bare=True)
        yield a, b, words, bounds


def _items(min_match: int):
    """(item, words, seeds) of each benchmark row with words."""

    def run(batches):
        for batch in batches:
            out = {"item": [], "words": [], "seeds": []}
            ids = batch.column("id").to_pylist()
            for a, b, words, bounds in _sequences(batch):
                for i in range(a, b):
                    own = words[bounds[i - a] : bounds[i - a + 1]]
                    if len(own):
                        k = min(min_match, len(own))
                        win, ok = window_hashes(own, np.array([0, len(own)]), k)
                        out["item"].append(ids[i])
                        out["words"].append(own.tobytes())
                        out["seeds"].append(np.unique(win[ok]).view(np.int64).tolist())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item", pa.int64()), ("words", pa.binary()), ("seeds", pa.list_(pa.int64()))]))

    return run


def _holders(lengths: list[int], filter_bits: np.ndarray):
    """(id, words, seeds) of each document with a window in the filter; ids keep their type."""
    packed = np.packbits(filter_bits)
    mask, shift = np.uint64((1 << FILTER_BITS) - 1), np.uint64(FILTER_BITS)

    def run(batches):
        low, high = np.unpackbits(packed).astype(bool).reshape(2, -1)
        for batch in batches:
            ids = batch.column("id")
            rows, seqs, found = [], [], []
            for a, _b, words, bounds in _sequences(batch):
                hits = []
                for k in lengths:
                    win, ok = window_hashes(words, bounds, k)
                    at = np.flatnonzero(ok)
                    at = at[low[(win[at] & mask).astype(np.int64)]]
                    at = at[high[((win[at] >> shift) & mask).astype(np.int64)]]
                    hits.append((at, win[at]))
                at, win = (np.concatenate(x) for x in zip(*hits, strict=True))
                doc = np.searchsorted(bounds, at, "right") - 1
                for i in np.unique(doc).tolist():
                    rows.append(a + i)
                    seqs.append(words[bounds[i] : bounds[i + 1]].tobytes())
                    found.append(np.unique(win[doc == i]).view(np.int64).tolist())
            if rows:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(seqs, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["id", "words", "seeds"])

    return run


def _tiles(min_match: int, coverage: float):
    fields = [("item", pa.int64()), ("n_words", pa.int64()), ("n_covered", pa.int64()), ("n_tiles", pa.int64()), ("longest", pa.int64())]

    def run(batches):
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field("id").type), *fields])
            out = {f.name: [] for f in schema}
            for i, item, d, x in zip(*(batch.column(c).to_pylist() for c in ("id", "item", "words", "item_words")), strict=True):
                own = np.frombuffer(x, np.uint64)
                tiles = tile(np.frombuffer(d, np.uint64), own, min_match)
                got = sum(t[2] for t in tiles)
                if got >= coverage * len(own):
                    for name, v in zip(out, (i, item, len(own), got, len(tiles), max(t[2] for t in tiles)), strict=True):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 min_match: int = 5, coverage: float = 0.6) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, n_tiles, longest) of each document and item it holds to at least `coverage`.

    Null and empty texts hold nothing; items without words are held by nothing, items shorter than
    min_match must be held whole. Rows that repeat give one result row. Other columns are ignored.
    An empty benchmark or table gives an empty result. The words of a document that passes the
    filter travel once for each item that shares a seed with them.
    """
    return _held(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), benchmark, item_col, item_text, min_match, coverage).withColumnsRenamed({"id": id_col, "item": item_col})


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = 5, coverage: float = 0.6) -> DataFrame:
    """The rows of docs whose text holds no benchmark item to at least `coverage`, all columns as they were.

    A row is judged by its text alone: rows without an id go like others, and rows that repeat an id
    are judged one by one. Rows without a text stay.
    """
    key = unused_name(docs, "text_key")
    digest = F.sha2(F.col(text_col), 256)
    held = _held(docs.select(digest.alias("id"), F.col(text_col).alias("text")), benchmark, item_col, item_text, min_match, coverage).select(F.col("id").alias(key)).distinct()
    return docs.withColumn(key, digest).join(held, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _held(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, min_match: int, coverage: float) -> DataFrame:
    """(id, item, n_words, n_covered, n_tiles, longest) of (id, text) rows; ids of any type."""
    kind = docs.schema["id"].dataType.simpleString()
    items, _ = materialise(benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text"))
                           .mapInArrow(_items(min_match), "item long, words binary, seeds array<long>"), "decon-items")
    mask = (1 << FILTER_BITS) - 1
    hold = np.zeros((2, 1 << FILTER_BITS), bool)  # of fixed size: a larger benchmark only lets more documents through
    seeds = items.select("item", F.explode("seeds").alias("seed"))
    bits = seeds.select(F.posexplode(F.array(F.col("seed"), F.shiftrightunsigned("seed", FILTER_BITS))).alias("half", "x")).withColumn("x", F.col("x").bitwiseAND(F.lit(mask)))
    cells = bits.select("half", F.shiftright("x", 12).cast("int").alias("cell"), F.col("x").bitwiseAND(F.lit(4095)).cast("int").alias("bit"))
    for r in cells.groupBy("half", "cell").agg(F.collect_set("bit").alias("bits")).toLocalIterator():  # at most 2048 rows of at most 4096
        hold[r.half, r.cell * 4096 + np.array(r.bits)] = True
    lengths = sorted(r.k for r in items.select(F.least(F.lit(min_match), (F.octet_length("words") / 8).cast("int")).alias("k")).distinct().collect()) or [min_match]
    holders, _ = materialise(docs.mapInArrow(_holders(lengths, hold), f"id {kind}, words binary, seeds array<long>")
                             .withColumn("key", F.sha2("words", 256)).dropDuplicates(["id", "key"]), "decon-docs")
    pairs = (holders.select("id", "key", F.explode("seeds").alias("seed")).join(seeds, "seed").select("id", "key", "item").distinct())
    null_safe = [F.col("p.id").eqNullSafe(F.col("h.id")), F.col("p.key") == F.col("h.key")]
    texts = pairs.alias("p").join(holders.alias("h"), null_safe).select("p.id", "p.item", "h.words")
    return (texts.join(items.select(F.col("item"), F.col("words").alias("item_words")), "item")
            .select("id", "item", "words", "item_words")
            .mapInArrow(_tiles(min_match, coverage), f"id {kind}, item long, n_words long, n_covered long, n_tiles long, longest long").distinct())
