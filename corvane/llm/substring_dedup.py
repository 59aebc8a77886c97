"""Substring deduplication by Rabin-Karp window hashes.

Every run of `window` consecutive words is hashed with a rolling polynomial. A window whose words
also start earlier in the corpus (smaller doc_id, or earlier in the same document) is repeated;
overlapping repeated windows merge into maximal intervals, and the words inside them go.

Plan: documents are dealt once, by ranges of doc_id ("chunks"), so chunk order is document order.
The ranges are cut at quantiles of the text's bytes over doc_id, so a chunk holds about chunk_bytes
however the ids lie. Each chunk finds its own repeats and sends its distinct hashes, sorted and delta-coded, to hash
buckets. A bucket answers each chunk with one bit a hash: does an earlier chunk hold it? The chunks
then read the same exchange again and apply the answers. So a hash travels once per chunk, never
once per occurrence: a passage in a third of all documents costs a bucket one entry a chunk.
chunk_bytes and bucket_windows bound the memory of a task; both can grow with the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.hashing import slices, text_buffers, window_hashes, word_hashes

_U = np.uint64
UNIT = 4096  # bytes that count as one when chunks are cut


def pack(hashes: np.ndarray) -> tuple[int, bytes]:
    """(bytes an entry, delta-coded little-endian entries) of a sorted array."""
    deltas = np.diff(hashes, prepend=_U(0))
    width = max(1, (int(deltas[1:].max()).bit_length() + 7) // 8) if len(deltas) > 1 else 1
    first = deltas[:1].tobytes()  # whole first hash, then deltas of `width` bytes
    return width, first + deltas[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(width: int, raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, np.uint8, offset=8).reshape(-1, width)
    deltas = np.zeros((len(body) + 1, 8), np.uint8)
    deltas[0] = np.frombuffer(raw, np.uint8, 8)
    deltas[1:, :width] = body
    return np.cumsum(deltas.reshape(-1).view(_U), dtype=_U)


def chunk_windows(text: pa.Array, window: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, tuple]]:
    """Slices of a chunk: (first document, end, window hashes, valid starts, (data, starts, ends, bounds))."""
    data, offs = text_buffers(text)
    for a, b in slices(offs):
        part, rel = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        words, starts, ends, bounds = word_hashes(part, rel, lower=False)
        wins, valid = window_hashes(words, bounds, window)
        yield a, b, wins, valid, (part, starts, ends, bounds)


def _in_order(batches) -> Iterator[tuple[int, pa.Table]]:
    """Batches sorted by chunk -> one table for each chunk."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunks = batch.column("chunk").to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunks)) + 1, [len(chunks)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if int(chunks[a]) != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = int(chunks[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("width", pa.int32()), ("hashes", pa.binary())])


def _send(window: int, bucket_bits: int):
    def run(batches):
        for chunk, rows in _in_order(batches):
            own = [w[v] for _, _, w, v, _ in chunk_windows(rows.column("text"), window)]
            hashes = np.unique(np.concatenate(own)) if own else np.zeros(0, _U)
            if not len(hashes):
                continue
            bucket = (hashes >> _U(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(hashes), np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(hashes)]))
            out = {"bucket": [], "chunk": [], "width": [], "hashes": []}
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                width, raw = pack(hashes[a:b])
                for name, v in zip(out, (int(bucket[a]), chunk, width, raw), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, _SENT)

    return run


def _answer(batches):
    """Rows sorted by (bucket, chunk) -> (chunk, bucket, a bit for each hash that an earlier chunk holds)."""

    def bucket_rows(bucket, rows):
        parts = [unpack(w, raw) for _, w, raw in rows]
        order = np.argsort(np.concatenate(parts), kind="stable")  # ties keep the order of the chunks
        hashes = np.concatenate(parts)[order]
        again = np.zeros(len(hashes), bool)
        again[order[1:]] = hashes[1:] == hashes[:-1]
        at, out = 0, {"chunk": [], "bucket": [], "n": [], "bits": []}
        for (chunk, _, _), p in zip(rows, parts, strict=True):
            own = again[at : at + len(p)]
            at += len(p)
            if own.any():
                for name, v in zip(out, (chunk, bucket, len(p), np.packbits(own).tobytes()), strict=True):
                    out[name].append(v)
        if out["chunk"]:
            yield pa.RecordBatch.from_pydict(out, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())]))

    key, rows = None, []
    for batch in batches:
        for bucket, chunk, width, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "width", "hashes")), strict=True):
            if bucket != key:
                if rows:
                    yield from bucket_rows(key, rows)
                key, rows = bucket, []
            rows.append((chunk, width, raw))
    if rows:
        yield from bucket_rows(key, rows)


def _apply(window: int, bucket_bits: int, keep_text: bool):
    def run(docs: pa.Table, answers: pa.Table):
        docs = docs.sort_by([("id", "ascending"), ("tie", "ascending")])
        docs = docs.take(pa.array(np.argsort(docs.column("id").is_valid().to_numpy(), kind="stable"))) if docs.column("id").null_count else docs
        pieces = list(chunk_windows(docs.column("text"), window))
        every = np.concatenate([w[v] for _, _, w, v, _ in pieces]) if pieces else np.zeros(0, _U)
        hashes, first, back = np.unique(every, return_index=True, return_inverse=True)
        earlier = np.zeros(len(hashes), bool)
        if answers.num_rows:
            for bucket, n, bits in zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "bits")), strict=True):
                at = int(np.searchsorted(hashes, _U(bucket << (64 - bucket_bits)) if bucket_bits else _U(0)))
                earlier[at : at + n] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
        gone = earlier[back]
        gone |= first[back] != np.arange(len(every))  # an earlier start inside this chunk
        at, out = 0, {"id": docs.column("id"), "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for a, b, _, valid, (data, starts, ends, bounds) in pieces:
            hit = np.flatnonzero(valid)
            hit = hit[gone[at : at + len(hit)]]
            at += int(valid.sum())
            cover = np.zeros(len(starts) + window + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            covered = np.cumsum(cover)[: len(starts)] > 0
            raw = data.tobytes()
            for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                keep = np.flatnonzero(~covered[x:y]) + x
                text = b" ".join([raw[s:e] for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                out["n_words"].append(y - x)
                out["n_removed"].append(y - x - len(keep))
                out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                out["kept"].append(text.decode("utf-8", "surrogatepass") if keep_text else None)
        return pa.table({"id": out["id"].combine_chunks().cast(pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.string())})

    return run


def _chunks(docs: DataFrame, chunk_bytes: int) -> tuple[Column, int]:
    """(chunk of a row by id and tie, bytes in all). Chunks follow the order (null ids first, id, tie).

    Cut points are approximate quantiles over ids, each id counted about once for every UNIT bytes of
    its texts, by a sketch of bounded size. An id (or null) that would fill several chunks is spread
    over them by the tie; rows equal in id and text, and repeated ids beyond 2**53, stay in one.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    nameless, named = docs.agg(F.sum(F.when(F.col("id").isNull(), size)), F.sum(F.when(F.col("id").isNotNull(), size))).first()
    nameless, named = nameless or 0, named or 0
    before, n = -(-nameless // chunk_bytes), max(1, -(-named // chunk_bytes))
    cuts: list[int] = []
    if n > 1:
        units = F.floor((size + F.rand(7) * UNIT) / UNIT)  # rounded up or down by chance, so small texts count in proportion
        marks = docs.filter("id is not null").select("id", units.alias("units")).filter("units > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), "units")))
        cuts = marks.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] or []
    ladder = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))])
    marks = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")

    def below(holds):  # binary search: how many cuts hold
        return F.aggregate(ladder, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & holds(F.try_element_at(marks, at + step)), at + step).otherwise(at))

    place = F.conv(F.substring("tie", 1, 8), 16, 10).cast("long")
    spread = lambda parts: F.shiftright(F.coalesce(place, F.lit(0).cast("long")) * parts, 32)
    low, high = below(lambda c: c < F.col("id")), below(lambda c: c <= F.col("id"))
    own = F.when(high - low <= 1, high).otherwise(low + 1 + spread(high - low))
    return F.when(F.col("id").isNull(), spread(F.lit(before).cast("long"))).otherwise(own + before).cast("long"), nameless + named


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, keep_text: bool = True,
                   chunk_bytes: int = 16 << 20, bucket_windows: int = 1 << 21) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for every row: `kept` is the text left, words joined by one space.

    Words are runs of bytes other than space and 0x09-0x0D. Null or empty texts have no words, and
    the hash of the empty string. Rows that repeat a doc_id are ordered by their text; a null
    doc_id counts as the smallest. Other columns are ignored. Equality of windows is equality of
    64-bit hashes: among N distinct windows about N*N/2**65 pairs agree by chance (one for 6e9).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunk, size = _chunks(docs, chunk_bytes)
    bucket_bits = max(0, (size // 6 // bucket_windows).bit_length())
    chunks = max(1, -(-size // chunk_bytes))
    tie = F.sha1("text")  # only orders rows of one doc_id
    dealt = docs.withColumn("tie", F.when(F.col("text").isNotNull(), tie)).withColumn("chunk", chunk).repartition(chunks, "chunk")
    sent = dealt.sortWithinPartitions("chunk").mapInArrow(_send(window, bucket_bits), "bucket long, chunk long, width int, hashes binary")
    answers = (sent.repartition(1 << bucket_bits, "bucket").sortWithinPartitions("bucket", "chunk")
               .mapInArrow(_answer, "chunk long, bucket long, n long, bits binary"))
    return (dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(_apply(window, bucket_bits, keep_text), "id long, n_words long, n_removed long, kept_sha256 string, kept string")
            .withColumnRenamed("id", id_col))
