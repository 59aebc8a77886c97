"""N-gram Jaccard join with signature trees.

Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of at
least `percent` per cent. The search is exact:

1. One pass hashes every text to its shingle set. Equal sets share a digest, the node of the graph,
   so copies never meet each other. The pass also sums a fixed-size count sketch of all shingles.
2. Every node lists its prefix: the |x| - ceil(t |x|) + SHARED shingles that are rarest by the sketch
   (ties by hash). The order is the same for all documents, hence linked nodes share at least
   SHARED shingles of their prefixes, whatever the sketch's errors. Each shingle's position bounds
   the sizes of partners for which it can be one of the first shared ones.
3. Shingles of few documents give pairs; pairs that may share SHARED shingles form blocks. Shingles
   of many documents are blocks themselves, merged where they have the same smallest member, and
   without documents that have too few such shingles.
4. Blocks that hold several components are cut into parts of bounded size: first each part is
   searched by itself, then some members of each component found so far, at last all pairs of parts
   that may still join components. So a large group of near copies is linked in linear work, and
   only what stands outside it is compared with all of it. A search builds signature trees: a leaf is a document's token bitmap and size, an inner node the OR of
   its children's bitmaps with their size range. A dual traversal drops pairs of tree nodes whose
   largest possible overlap is too small. The leaf pairs left are verified on whole shingle sets,
   unless they are connected by then.
5. Components come from star rounds over the verified links; what a later search finds is added between components.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.components import components, joined
from corvane.llm.hashing import shingle_sets, slices, text_buffers
from corvane.llm.shared import discard, materialise, unused_name

SKETCH_BITS = 17  # 2**17 counters, whatever the size of the input
BLOCK_ROWS = 4096  # counters of one sketch row
HOT = 16384  # documents in a counter from which its shingles are dealt by salted keys
BRIDGE = 16  # members of a component that look for links between parts
PART = 512  # members of a block handled together
SHARED = 8  # prefix shingles that linked documents must share, if they have as many
LARGE = 16  # documents from which a shingle's block is searched as a whole, not by pairs
FANOUT = 8
MAX_BITMAP = 1 << 16


def need_overlap(n: int, m: int, percent: int) -> int:
    """Smallest i with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def node_of(s: np.ndarray) -> int:
    """Digest of a shingle set (signed 64 bit); sets of different size never share one by the size kept beside it."""
    v = (int(np.bitwise_xor.reduce(s)) * 0x9E3779B97F4A7C15 + int(s.sum(dtype=np.uint64)) * 0xD1B54A32D192ED03 + len(s)) & (2**64 - 1)
    v ^= v >> 29
    return v - 2**64 if v >= 2**63 else v


def bitmap_of(s: np.ndarray) -> bytes:
    """Token bitmap of at least two bits a token, a power of two wide."""
    width = min(MAX_BITMAP, max(64, 1 << int(2 * len(s) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray, bytes]]:
    data, offs = text_buffers(batch.column("text"))
    for a, b in slices(offs):
        part = data[offs[a] : offs[b]]
        rel = offs[a : b + 1] - offs[a]
        for i, s in enumerate(shingle_sets(part, rel, k)):
            yield a + i, s, part[rel[i] : rel[i + 1]]


def _scan(k: int):
    """Rows of documents (id, node, n, and the compressed text at the node's first row here) and of the sketch (cell, bits)."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        seen: set[int] = set()
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column("id").to_pylist()
            out = {x: [] for x in ("cell", "id", "node", "n", "bits", "z")}
            for i, s, text in _sets(batch, k):
                node, fresh = None, False
                if len(s):
                    node = node_of(s)
                    fresh = node not in seen
                    if fresh:
                        seen.add(node)
                        np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                for x, v in zip(out, (None, ids[i], node, len(s), None, zip_.compress(text.tobytes()) if fresh else None), strict=True):
                    out[x].append(v)
            yield pa.RecordBatch.from_pydict(out, _SCAN_SCHEMA)
        rows = counts.reshape(-1, BLOCK_ROWS)
        used = [i for i in range(len(rows)) if rows[i].any()]
        yield pa.RecordBatch.from_pydict({"cell": used, "id": [None] * len(used), "node": [None] * len(used), "n": [0] * len(used), "bits": [rows[i].tobytes() for i in used], "z": [None] * len(used)}, _SCAN_SCHEMA)

    return run


_SCAN_SCHEMA = pa.schema([("cell", pa.int32()), ("id", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("z", pa.binary())])


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, bits in zip(batch.column("cell").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            v = np.frombuffer(bits, np.int64)
            sums[cell] = sums[cell] + v if cell in sums else v
    if sums:
        yield pa.RecordBatch.from_pydict({"cell": list(sums), "bits": [v.tobytes() for v in sums.values()]}, pa.schema([("cell", pa.int32()), ("bits", pa.binary())]))


def _sketch(rows: DataFrame) -> np.ndarray:
    """Add up the sketch rows; 32 rows of fixed size reach the driver, whatever the input."""
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    summed = rows.filter("cell is not null").select("cell", "bits").repartition(8, "cell").mapInArrow(_add_up, "cell int, bits binary")
    for r in summed.collect():
        total[r.cell * BLOCK_ROWS : (r.cell + 1) * BLOCK_ROWS] += np.frombuffer(bytes(r.bits), np.int64)
    return total


def _prefixes(k: int, percent: int, sketch: np.ndarray):
    """(token, salt, node, nc) rows of each node's prefix. Very frequent tokens get a salt from 1 on, others 0.

    nc holds the size n and, in the low half, the largest partner size for which this token can be
    one of the first SHARED common ones: from position i on at most n - i tokens are left to share.
    """
    hot = max(HOT, int(4 * sketch.mean()))
    order = sketch.astype(np.int64)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            toks, salts, nodes, sizes = [], [], [], []
            for _, s, _text in _sets(batch, k):
                n = len(s)
                if not n or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                seen_in = order[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                least = -(-percent * n // 100)
                slack = min(SHARED, least) - 1
                p = n - least + slack + 1
                o = np.argsort(seen_in, kind="stable")[:p]  # s is sorted, so ties go by hash
                parts = seen_in[o] // hot
                toks.append(s[o].view(np.int64))
                salts.append(np.where(parts > 1, 1 + (node & 0x7FFFFFFF) % np.maximum(parts, 1), 0).astype(np.int32))
                nodes.append(np.full(p, node, np.int64))
                cap = (100 + percent) * (n - np.arange(p, dtype=np.int64) + SHARED - 1) // percent - n
                sizes.append((n << 32) + np.maximum(cap, 0))
            if toks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (toks, salts, nodes, sizes)], ["token", "salt", "node", "nc"])

    return run


class Tree:
    """Signature tree over (node, component, size, bitmap) members. A tree node is
    (OR bitmap, least size, largest size, largest count of tokens beyond the bitmap's bits, component or None, children or member)."""

    def __init__(self, members: list[tuple[int, int, int, bytes]], width: int):
        level, often = [], Counter(m[1] for m in members)
        for m in sorted(members, key=lambda m: (m[1] if often[m[1]] > 1 else 0, m[2], m[0])):
            bits = fold(m[3], width)
            level.append((bits, m[2], m[2], m[2] - bits.bit_count(), m[1], m))
        while len(level) > 1:
            level = [self._over(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0]

    @staticmethod
    def _over(kids):
        bits, comps = 0, {x[4] for x in kids}
        for x in kids:
            bits |= x[0]
        return (bits, min(x[1] for x in kids), max(x[2] for x in kids), max(x[3] for x in kids), comps.pop() if len(comps) == 1 else None, kids)


def fold(bits: bytes, width: int) -> int:
    """A bitmap as an integer of `width` bits: wider bitmaps OR their halves (the same tokens modulo a smaller power of two)."""
    v, w = int.from_bytes(bits, "little"), 8 * len(bits)
    while w > width:
        w //= 2
        v = (v >> w) | (v & ((1 << w) - 1))
    return v


def joinable(x, y, percent: int) -> bool:
    """Can any member below x and any below y reach the overlap they need?"""
    if x[4] is not None and x[4] == y[4]:
        return False
    if 100 * x[2] < percent * y[1] or 100 * y[2] < percent * x[1]:
        return False
    common = (x[0] & y[0]).bit_count()
    most = min(x[2], y[2], common + min(x[3], y[3]))
    if most < need_overlap(x[1], y[1], percent):
        return False
    for one, two in ((x, y), (y, x)):  # a leaf's bits outside the other side's OR are tokens it cannot share
        if isinstance(one[5], tuple) and one[1] - (one[0].bit_count() - common) < need_overlap(one[1], two[1], percent):
            return False
    return True


def dual(x, y, percent: int) -> Iterator[tuple[int, int]]:
    """Leaf pairs below x and y that may link; x is y stands for the pairs inside one tree."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if x is y:
            if not isinstance(x[5], tuple) and x[4] is None:
                kids = x[5]
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids))]
        elif joinable(x, y, percent):
            if isinstance(x[5], tuple) and isinstance(y[5], tuple):
                a, b = x[5][0], y[5][0]
                yield (a, b) if a < b else (b, a)
            elif isinstance(y[5], tuple) or (not isinstance(x[5], tuple) and x[2] - x[1] >= y[2] - y[1]):
                stack += [(c, y) for c in x[5]]
            else:
                stack += [(x, c) for c in y[5]]


def _part_pairs(batches) -> Iterator[tuple[list, list | None]]:
    """Rows sorted by (block, i, j) -> members of part i and of part j (None: the same part)."""
    key, rows = None, []

    def parts():
        left = [r[1:] for r in rows if r[0] == key[1]]
        right = [r[1:] for r in rows if r[0] == key[2]] if key[1] != key[2] else None
        if left and (right or (right is None and len(left) > 1)):
            yield left, right

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("block", "i", "j", "part", "node", "comp", "n", "z")]
        for block, i, j, *row in zip(*cols, strict=True):
            if (block, i, j) != key:
                if len(rows) > 1:
                    yield from parts()
                key, rows = (block, i, j), []
            rows.append(tuple(row))
    if len(rows) > 1:
        yield from parts()


def _candidates(left, right, percent: int) -> Iterator[tuple[int, int]]:
    width = 8 * min(len(r[3]) for r in [*left, *(right or ())])
    a = Tree(left, width)
    return dual(a.root, a.root if right is None else Tree(right, width).root, percent)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Do two sorted shingle sets reach the similarity?"""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    i = int((y[at] == x).sum())
    return 100 * i >= percent * (len(x) + len(y) - i)


def _span(k: int, percent: int):
    """Verified links between components of each block: whoever is connected already is not compared."""

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for left, right in _part_pairs(batches):
            sets, up, found = {}, {}, []

            def member(row):
                node, comp, n, z = row
                raw = np.frombuffer(unzip.decompress(z), np.uint8)
                sets[node] = shingle_sets(raw, np.array([0, len(raw)]), k)[0]
                up[node] = comp
                return node, comp, n, bitmap_of(sets[node])

            def root(x):
                while up.setdefault(x, x) != x:
                    up[x] = up.setdefault(up[x], up[x])
                    x = up[x]
                return x

            for a, b in _candidates([member(r) for r in left], right and [member(r) for r in right], percent):
                ra, rb = root(a), root(b)
                if ra != rb and linked(sets[a], sets[b], percent):
                    up[ra] = rb
                    found.append((a, b))
            yield from _pair_batch(found)

    return run


def _pair_batch(pairs):
    if pairs:
        a, b = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_pydict({"a": a, "b": b}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _bloom(nodes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over node digests; only saves shuffle, the joins after it decide."""

    def collect(batches):
        bits = np.zeros(1 << 23, bool)
        for b in batches:
            bits[b.column("node").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << 23) - 1)] = True
        rows = np.packbits(bits).reshape(64, -1)
        used = [i for i in range(64) if rows[i].any()]
        if used:
            yield pa.RecordBatch.from_pydict({"cell": used, "bits": [rows[i].tobytes() for i in used]}, pa.schema([("cell", pa.int32()), ("bits", pa.binary())]))

    def either(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, raw in zip(batch.column("cell").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                v = np.frombuffer(raw, np.uint8)
                sums[cell] = sums[cell] | v if cell in sums else v
        if sums:
            yield pa.RecordBatch.from_pydict({"cell": list(sums), "bits": [v.tobytes() for v in sums.values()]}, pa.schema([("cell", pa.int32()), ("bits", pa.binary())]))

    total = np.zeros((64, (1 << 23) // 512), np.uint8)
    for r in nodes.mapInArrow(collect, "cell int, bits binary").repartition(8, "cell").mapInArrow(either, "cell int, bits binary").collect():
        total[r.cell] |= np.frombuffer(bytes(r.bits), np.uint8)
    return np.unpackbits(total.reshape(-1)).astype(bool)


def _through(bloom: np.ndarray):
    packed = np.packbits(bloom)

    def run(batches):
        bits = np.unpackbits(packed).astype(bool)
        for b in batches:
            keep = bits[(b.column("node").to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64((1 << 23) - 1)).astype(np.int64)]
            if keep.any():
                yield b.filter(pa.array(keep))

    return run


def _part_rows(rows: DataFrame, comp: DataFrame, percent: int, mode: str) -> DataFrame:
    """(block, node) rows -> members of the blocks that hold several components, for each pair (i, j) of parts to search.

    own: every part by itself, so each member comes once; blocks of one part are done then. few: BRIDGE members of each component, to
    join what lies in different parts. all: every pair of parts. There, a component with more than
    PART members in a block has parts of its own, and two parts of one component are never paired:
    what is connected by then costs nothing more, however large it is.
    """
    near, whole, own = Window.partitionBy("block").orderBy("n", "node"), Window.partitionBy("block"), Window.partitionBy("block", "comp")
    member = (rows.filter(F.col("parts") > (0 if mode == "own" else 1)).join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node"))
              .withColumn("lo", F.min("comp").over(whole)).withColumn("hi", F.max("comp").over(whole)).filter("lo < hi")
              .withColumn("before", F.lag("n").over(near)).withColumn("after", F.lead("n").over(near))
              .filter(f"100 * before >= {percent} * n or 100 * n >= {percent} * after"))
    if mode == "few":
        member = member.withColumn("pick", F.row_number().over(own.orderBy(F.xxhash64("node")))).filter(F.col("pick") <= BRIDGE)
    if mode != "all":
        part = F.pmod(F.xxhash64("node"), F.col("parts") if mode == "own" else F.ceil(F.count("*").over(whole) / PART)).cast("string")
        return member.withColumn("part", part).select("block", F.col("part").alias("i"), F.col("part").alias("j"), "part", "node", "comp", "n")
    member = (member.withColumn("own", F.count("*").over(own)).withColumn("mixed", F.count_if(F.col("own") < PART).over(whole))
              .withColumn("home", F.when(F.col("own") >= PART, F.col("comp")))
              .withColumn("part", F.concat_ws("/", F.coalesce(F.col("home").cast("string"), F.lit("-")),
                                              F.pmod(F.xxhash64("node"), F.ceil(F.when(F.col("home").isNull(), F.col("mixed")).otherwise(F.col("own")) / PART))))
              .select("block", "node", "n", "comp", "home", "part"))
    parts = member.select("block", "part", "home").distinct()
    other = parts.select("block", F.col("part").alias("j"), F.col("home").alias("other"))
    pairs = (parts.withColumnRenamed("part", "i").join(other, "block").filter("i <= j and not coalesce(home = other, false)")
             .select("block", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part")))
    return member.join(pairs, ["block", "part"]).select("block", "i", "j", "part", "node", "comp", "n")


def _texts(nodes: DataFrame, scan: DataFrame) -> DataFrame:
    """(node, z) of these nodes, once each."""
    return (scan.filter("z is not null").select("node", "z").mapInArrow(_through(_bloom(nodes)), "node long, z binary")
            .groupBy("node").agg(F.first("z").alias("z")))


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs.

    Words are runs of bytes other than space and 0x09-0x0D, A-Z in lower case. component_id is the
    smallest doc_id reachable over links. Null or empty texts have n_shingles 0 and link with
    nothing. Rows that repeat a doc_id are one document whose links are pooled; a null doc_id
    stays null and takes part through its text only. Other columns are ignored. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan, scan_path = materialise(docs.mapInArrow(_scan(k), "cell int, id long, node long, n int, bits binary, z binary"), "ngram-scan")
    members = scan.filter("cell is null").select("id", "node", "n")
    sketch = _sketch(scan)

    rows = docs.select("text").mapInArrow(_prefixes(k, percent, sketch), "token long, salt int, node long, nc long")
    w = Window.partitionBy("token", "salt")
    following = w.orderBy("nc").rowsBetween(1, LARGE)
    n, cap = (lambda nc: F.shiftright(nc, 32)), (lambda nc: nc.bitwiseAND(F.lit((1 << 32) - 1)))

    def fits(nc):  # sizes that may link, and each within the other's bound
        return lambda x: (100 * n(nc) >= percent * n(x["nc"])) & (n(x["nc"]) <= cap(nc)) & (n(nc) <= cap(x["nc"])) & (x["node"] != F.col("node"))

    few = (F.col("size") < LARGE) & (F.col("salt") == 0)
    shared, shared_path = materialise(
        rows.withColumn("size", F.count("*").over(w)).withColumn("lo", F.min("node").over(w)).withColumn("hi", F.max("node").over(w)).filter("lo < hi or salt > 0")
        .withColumn("next", F.collect_list(F.struct("node", "nc")).over(following))
        .withColumn("next", F.when(few, F.filter("next", fits(F.col("nc")))))
        .filter("next is null or size(next) > 0")
        .select(F.when(F.col("next").isNull(), F.col("token")).alias("token"), "node", n(F.col("nc")).cast("int").alias("n"),
                F.transform("next", lambda x: F.struct(x["node"].alias("node"), n(x["nc"]).cast("int").alias("n"))).alias("next")), "ngram-shared")

    # linked documents share `least_shared` prefix shingles: those of few documents count exactly,
    # of those of many documents no more than the smaller number that either document has
    many = shared.filter("token is not null").drop("next")
    n_many = many.groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    least_shared = lambda size: F.least(F.lit(SHARED), F.ceil(F.lit(percent) * size / 100))
    pairs = (shared.filter("token is null").select("node", "n", F.explode("next").alias("x"))
             .select(F.least(F.struct("node", "n"), F.struct("x.node", "x.n")).alias("a"), F.greatest(F.struct("node", "n"), F.struct("x.node", "x.n")).alias("b"))
             .groupBy("a", "b").agg(F.count("*").alias("c")))
    of_many = lambda side: n_many.select(F.col("node").alias(f"{side}_node"), F.col("k").alias(f"{side}_k"))
    pairs = (pairs.withColumn("a_node", F.col("a.node")).withColumn("b_node", F.col("b.node")).join(of_many("a"), "a_node", "left").join(of_many("b"), "b_node", "left")
             .filter(F.col("c") + F.least(F.coalesce("a_k", F.lit(0)), F.coalesce("b_k", F.lit(0))) >= least_shared(F.least("a.n", "b.n"))))
    paired = pairs.select(F.col("a.node").alias("block"), F.explode(F.array("a", "b")).alias("x")).select("block", "x.node", "x.n")
    enough = n_many.filter(F.col("k") >= least_shared(F.ceil(F.lit(percent) * F.col("n") / 100))).select("node")
    large = many.join(enough, "node", "left_semi")
    merged = large.join(large.groupBy("token").agg(F.min("node").alias("block")), "token")
    same_id = (members.filter("node is not null and id is not null").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("hi"))
               .filter("b < hi").drop("hi").join(members, "id").filter("node <> b").select(F.col("node").alias("a"), "b"))
    blocks, blocks_path = materialise(paired.union(merged.select("block", "node", "n")).distinct()
                                      .withColumn("parts", F.ceil(F.count("*").over(Window.partitionBy("block")) / PART)), "ngram-blocks")
    comp, comp_path = materialise(components(same_id), "ngram-comp")
    paths = [scan_path, shared_path, blocks_path, comp_path]
    for mode in ("own", "few", "all"):
        parts, parts_path = materialise(_part_rows(blocks, comp, percent, mode), "ngram-parts")
        spans = (parts.join(_texts(parts.select("node").distinct(), scan), "node").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
                 .mapInArrow(_span(k, percent), "a long, b long"))
        links, links_path = materialise(spans, "ngram-links")
        comp, comp_path = materialise(joined(comp, links), "ngram-comp")
        paths += [parts_path, links_path, comp_path]

    # component labels are digests: the answer is each component's smallest document
    named = (members.join(comp, "node", "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("c")))
    named, _ = materialise(named, "ngram-named")
    least = named.filter("c is not null and id is not null").groupBy("c").agg(F.min("id").alias("least"))
    for path in paths:
        discard(spark, path)
    return named.join(least, "c", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("least", "id").alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row of each group of linked texts, all columns as they were: that with the smallest id, null ids last.

    Rows are judged one by one: rows that repeat an id with unlike texts all stay, and rows without an
    id go where another row is a copy. Of rows that share the smallest id one stays. Texts without words
    link with nothing, so their rows stay. An empty table gives an empty result.
    """
    row = unused_name(docs, "row")
    rows, _ = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "ngram-rows")  # numbers that stay the same from here on
    groups = ngram_jaccard(rows, row, text_col, k, percent).select(F.col(row).alias("row"), F.col("component_id").alias("group"))
    named = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id")).join(groups, "row")
    first = named.groupBy("group").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias(row)).select(row)
    return rows.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
