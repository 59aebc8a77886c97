"""Exact top-k inner products by columnar branch and bound.

Candidates lie in blocks with a vertical layout, one row a dimension, dimensions in one fixed
order. A query accumulates its products over a block of dimensions at a time. What the remaining
dimensions can still add is bounded by the product of the remaining lengths of query and
candidate (Cauchy-Schwarz); candidates whose bound falls below the k-th best score so far leave,
and the survivors are compacted before the next block of dimensions. The k-th best score carries
over from one block of candidates to the next within a task.

Vectors whose squared length stays under WIDE multiply in 64-bit integers without overflow; the
few others meet in Python integers, so that every score is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP = 8  # dimensions a block
WIDE = 2.0**61  # by Cauchy-Schwarz the products of vectors below it stay below 2**61 as well
LONG = 2**63 - 1
SLOT_BLOCKS = 4  # blocks of candidates that one task holds, where there are many

_BLOCK = pa.schema([("dim", pa.int32()), ("wide", pa.bool_()), ("ids", pa.binary()), ("names", pa.list_(pa.string())), ("x", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("query", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary()), ("twin", pa.bool_())])


def usable_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x array<double>) of each vector without null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    usable = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    return rows.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def whole(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * component) in Python integers, however large."""
    return [math.floor(v * scale) if abs(v) < 1e15 else int(v) * scale for v in x.tolist()]


def beyond(score: int) -> bytes | None:
    """Null for a score of 64 bits, else bytes that sort as the scores do."""
    if -LONG < score < LONG:
        return None
    n = (abs(score).bit_length() + 7) // 8
    raw = b"\x01" + n.to_bytes(4, "big") + abs(score).to_bytes(n, "big")
    return raw if score > 0 else bytes(255 - b for b in raw)


def _pack(block: int, scale: int):
    """Vectors -> blocks of one width, wide vectors apart: (dim, wide, ids, names, dimension-major doubles)."""

    def run(batches):
        held: dict[tuple[int, bool], list] = {}

        def out(key):
            ids, names, rows = zip(*held.pop(key), strict=True)
            x = np.array(rows, np.float64).reshape(len(ids), key[0]).T
            return pa.RecordBatch.from_pydict({"dim": [key[0]], "wide": [key[1]], "ids": [np.array(ids, np.int64).tobytes()], "names": [[n for n in names if n]], "x": [np.ascontiguousarray(x).tobytes()]}, _BLOCK)

        for batch in batches:
            for i, name, x in zip(batch.column("id").to_pylist(), batch.column("name").to_pylist(), batch.column("x"), strict=True):
                x = x.values.to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    key = len(x), not float(((np.abs(x) * scale + 1) ** 2).sum()) < WIDE
                held.setdefault(key, []).append((i, name, x))
                if len(held[key]) >= block:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return run


class Block:
    """Candidates of one block, ready for any number of queries."""

    def __init__(self, dim: int, ids: bytes, raw: bytes, scale: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.raw = np.frombuffer(raw, np.float64).reshape(dim, len(self.ids))
        self.x = np.floor(self.raw * scale).astype(np.int64)
        self.order = np.argsort(-np.abs(self.x).sum(axis=1), kind="stable") if dim else np.zeros(0, np.int64)
        mass = self.x[self.order].astype(np.float64) ** 2
        self.tails = [mass[j:].sum(axis=0) for j in range(0, dim, STEP)] + [np.zeros(len(self.ids))]

    def best(self, q: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best k for one query; candidates below `least` may be missing."""
        order, alive = self.order, np.arange(len(self.ids))
        q = q[order]
        q_tail = np.concatenate((np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1], [0.0]))
        score = np.zeros(len(alive), np.int64)
        for j, at in enumerate(range(0, len(order), STEP)):
            dims = order[at : at + STEP]
            score += q[at : at + STEP] @ (self.x[dims] if len(alive) == self.x.shape[1] else self.x[np.ix_(dims, alive)])
            if at + STEP < len(order):
                reach = np.sqrt(q_tail[at + STEP] * self.tails[j + 1][alive]) * (1 + 1e-9) + 1e-6
                floor = least
                if len(alive) > k:  # k candidates reach at least this
                    floor = max(floor, np.partition(score - reach, len(score) - k)[len(score) - k])
                slack = 1e-9 * (np.abs(score) + reach) + 1  # scores above 2**53 are rounded here
                keep = score + reach + slack >= floor - abs(floor) * 1e-9
                if keep.sum() < len(alive):
                    alive, score = alive[keep], score[keep]
                if not len(alive):
                    break
        top = np.lexsort((self.ids[alive], -score))[:k]
        return alive[top], score[top]


def _search(k: int, scale: int):
    """Pairs of a block of queries and one of candidates -> each query's best, held over all pairs that follow one another."""

    def rows_of(state):
        out = {f.name: [] for f in _FOUND}
        for (query_id, query), found in state.items():
            for score, vec_id, far, twin in found:
                for name, v in zip(out, (query_id, query, vec_id, score, far, twin), strict=True):
                    out[name].append(v)
        return pa.RecordBatch.from_pydict(out, _FOUND)

    def run(batches):
        asked, state, blocks = None, {}, {}
        for batch in batches:
            for dim, q_wide, q_ids, q_x, names, wide, c_ids, c_x in zip(*(batch.column(c).to_pylist() for c in ("dim", "q_wide", "q_ids", "q_x", "names", "wide", "ids", "x")), strict=True):
                if asked != (q_ids, q_x):
                    if state:
                        yield rows_of(state)
                    asked, state = (q_ids, q_x), {}
                queries = np.frombuffer(q_ids, np.int64)
                raw = np.frombuffer(q_x, np.float64).reshape(dim, len(queries))
                if q_wide or wide:
                    ids = np.frombuffer(c_ids, np.int64)
                    cand = np.frombuffer(c_x, np.float64).reshape(dim, len(ids))
                    ints = [whole(cand[:, j], scale) for j in range(len(ids))]
                else:
                    if (c_ids, c_x) not in blocks:
                        if len(blocks) > SLOT_BLOCKS:
                            blocks.clear()
                        blocks[c_ids, c_x] = Block(dim, c_ids, c_x, scale)
                    b = blocks[c_ids, c_x]
                    cand, ids = b.raw, b.ids
                    q_int = np.floor(raw * scale).astype(np.int64)
                for c, name in enumerate(names):
                    before = state.get((int(queries[c]), name), [])
                    if q_wide or wide:
                        own = whole(raw[:, c], scale)
                        exact = [sum(p * x for p, x in zip(own, v, strict=True)) for v in ints]
                        places = sorted(range(len(ids)), key=lambda j: (-exact[j], int(ids[j])))[:k]
                        scores = [exact[j] for j in places]
                    else:
                        least = before[k - 1][0] if len(before) >= k else -math.inf
                        places, scores = b.best(q_int[:, c], k, least)
                    same = [int(ids[j]) == int(queries[c]) and bool((cand[:, j] == raw[:, c]).all()) for j in places]
                    fresh = [(max(-LONG, min(LONG, int(s))), int(ids[j]), beyond(int(s)), t) for j, s, t in zip(places, scores, same, strict=True)]
                    # best score first; beyond 64 bits the exact bytes decide
                    state[int(queries[c]), name] = sorted(before + fresh, key=lambda r: (-r[0], bytes(255 - b for b in r[2]) if r[2] else b"", r[1]))[:k]
        if state:
            yield rows_of(state)

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024,
               block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors by integer inner product, ties to the smaller id.

    Components x become floor(scale * x). Vectors that are null or hold a null or non-finite
    component, and rows without an id, take no part; vectors of another width than the query are no
    candidates. A query that is one of `vectors` (same id, same components) is not its own
    candidate: one such row is left out, and further rows that repeat it, or its id, are candidates
    as any other. Query rows that repeat id and components have one ranking each. Scores are
    exact; those beyond 64 bits rank by their true value and are shown as +-(2**63 - 1). Queries
    and candidates meet as blocks, and k + 1 rows a query leave a task.
    """
    spark = vectors.sparkSession
    xs = usable_vectors(vectors, id_col, vec_col)
    name = F.sha1(F.array_join(F.transform("x", lambda v: v.cast("string")), " "))  # tells queries of one id apart
    qs = usable_vectors(queries, id_col, vec_col).groupBy("id", "x").agg(F.count("*").alias("times")).withColumn("name", name)
    schema = "dim int, wide boolean, ids binary, names array<string>, x binary"
    n_blocks = max(1, -(-xs.count() // block))
    slots = n_blocks if n_blocks <= 4 * spark.sparkContext.defaultParallelism else -(-n_blocks // SLOT_BLOCKS)
    cand = xs.withColumn("name", F.lit("")).mapInArrow(_pack(block, scale), schema).drop("names").withColumn("slot", F.pmod(F.xxhash64("ids", "x"), F.lit(slots))).repartition(slots, "dim", "slot")
    asked = (qs.mapInArrow(_pack(query_block, scale), schema).withColumnsRenamed({"wide": "q_wide", "ids": "q_ids", "x": "q_x"})
             .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long")))).repartition(slots, "dim", "slot"))
    found = asked.join(cand, ["dim", "slot"]).mapInArrow(_search(k + 1, scale), "query_id long, query string, vec_id long, score long, beyond binary, twin boolean")
    best = [F.desc("score"), F.desc("beyond"), "vec_id"]
    w = Window.partitionBy("query_id", "query")
    # the query itself: one of the rows that equal it
    top = found.withColumn("place", F.row_number().over(w.orderBy(*best))).filter(F.col("place") <= k + 1)
    own = F.min(F.when(F.col("twin"), F.col("place"))).over(w)
    top = top.withColumn("own", own).filter("own is null or place <> own")
    ranked = top.withColumn("rank", F.row_number().over(w.orderBy("place"))).filter(F.col("rank") <= k)
    repeats = qs.filter("times > 1").select(F.col("id").alias("query_id"), F.col("name").alias("query"), "times")
    return (ranked.join(repeats, ["query_id", "query"], "left")
            .select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long")))).alias("copy"))
            .select("query_id", "rank", "vec_id", "score"))
