"""Quality classifier: a byte-level convolutional network in numpy.

A document is cut into overlapping chunks that cover all of it. Learned filters over runs of bytes
slide along each chunk; each filter's largest response in the chunk passes a rectifier, and a
linear layer over these gives the chunk's logit. The document's probability is the logistic of the
mean logit of its chunks. A byte is one of 512 symbols: a byte that starts a run which comes again
a short lag later differs from the same byte elsewhere, and the filters learn what either means.
Training runs on the driver over whole texts of a bounded, documented sample of labelled documents
(`sample` of each class, `sample_bytes` of text in all); everything else covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.hashing import slices, text_buffers

CHUNK, STEP = 512, 448
WIDTH, STRIDE, FILTERS = 6, 2, 16
LAGS, RUN = range(2, 25), 10
SHORTENED = 0.25  # share of chunks that training cuts to 16-160 bytes
PAD = 36  # zero bytes after each document, so that neighbours in a batch never meet


@dataclass
class Model:
    table: np.ndarray  # (WIDTH, 512, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # FILTERS weights
    base: float


def repeats(buf: np.ndarray) -> np.ndarray:
    """1 where the RUN bytes from here equal those a short lag later."""
    found = np.zeros(len(buf), bool)
    for d in LAGS:
        run = buf[:-d] == buf[d:] if len(buf) > d else np.zeros(0, bool)
        have = 1
        while have < RUN and len(run):
            add = min(have, RUN - have)
            run = run[:-add] & run[add:] if len(run) > add else run[:0]
            have += add
        found[: len(run)] |= run
    return found & (buf != 0)


def symbols(buf: np.ndarray) -> np.ndarray:
    """The bytes, 256 higher where a run starts that comes again."""
    return buf + 256 * repeats(buf).astype(np.uint16)


def responses(model: Model, buf: np.ndarray) -> np.ndarray:
    """Filter responses at every STRIDE-th symbol of a padded buffer."""
    n = max(0, (len(buf) - WIDTH) // STRIDE + 1)
    out = np.repeat(model.bias[None, :], n, axis=0)
    for k in range(WIDTH):
        out += model.table[k][buf[k : k + n * STRIDE : STRIDE][:n]]
    return out


def layout(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded buffer, chunk starts, chunk ends, document of each chunk)."""
    lens = np.diff(offs)
    room = lens + PAD + (lens + PAD) % STRIDE
    at = np.concatenate(([0], np.cumsum(room)))
    buf = np.zeros(int(at[-1]), np.uint8)
    starts, ends, owner = [], [], []
    for i, n in enumerate(lens.tolist()):
        if n:
            a = int(at[i])
            buf[a : a + n] = data[offs[i] : offs[i + 1]]
            s = np.arange(0, max(1, n - (CHUNK - STEP)), STEP)
            starts.append(a + s)
            ends.append(a + np.minimum(s + CHUNK, n))
            owner.append(np.full(len(s), i))
    if not starts:
        return buf, *(np.zeros(0, np.int64),) * 3
    return buf, np.concatenate(starts), np.concatenate(ends), np.concatenate(owner)


def logits(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean chunk logit of each document; nan without bytes."""
    buf, starts, ends, owner = layout(data, offs)
    out = np.full(len(offs) - 1, np.nan)
    if not len(starts):
        return out
    r = responses(model, symbols(buf))
    first = starts // STRIDE
    last = np.maximum(first + 1, (ends - WIDTH) // STRIDE + 1)
    pairs = np.stack([first, last], axis=1).ravel()
    pooled = np.maximum.reduceat(np.concatenate([r, r[-1:]]), pairs, axis=0)[::2]
    z = np.maximum(pooled, 0) @ model.out + model.base
    n = np.bincount(owner, minlength=len(out))
    return np.where(n > 0, np.bincount(owner, z, minlength=len(out)) / np.maximum(n, 1), np.nan)


def train(chunks: np.ndarray, sizes: np.ndarray, owner: np.ndarray, label: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit on chunks (rows of CHUNK symbols, zero after `sizes`) that belong to documents with 0/1 labels."""
    rng = np.random.default_rng(seed)
    m = Model(np.tile(rng.standard_normal((WIDTH, 256, FILTERS)) * 0.1, (1, 2, 1)).astype(np.float32), np.zeros(FILTERS, np.float32), (rng.standard_normal(FILTERS) * 0.1).astype(np.float32), 0.0)
    if not len(chunks):
        return m
    slots = (CHUNK - WIDTH) // STRIDE + 1
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(label) + 1))
    params = [m.table, m.bias, m.out, np.zeros(1, np.float32)]
    mean, var, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        docs = rng.permutation(len(label))
        for at in range(0, len(docs), batch):
            own = docs[at : at + batch]
            rows = np.concatenate([order[bounds[d] : bounds[d + 1]] for d in own])
            doc = np.repeat(np.arange(len(own)), [bounds[d + 1] - bounds[d] for d in own])
            if not len(rows):
                continue
            x, size = chunks[rows], sizes[rows].copy()
            short = np.flatnonzero(rng.random(len(rows)) < SHORTENED)  # short texts are rare among the labels
            size[short] = np.minimum(size[short], rng.integers(16, 160, len(short)))
            x[np.arange(CHUNK)[None, :] >= size[:, None]] = 0
            r = np.zeros((len(rows), slots, FILTERS), np.float32) + m.bias
            for k in range(WIDTH):
                r += m.table[k][x[:, k : k + slots * STRIDE : STRIDE]]
            last = np.maximum(1, (size - WIDTH) // STRIDE + 1)
            r[np.arange(slots)[None, :] >= last[:, None]] = -np.inf
            where = r.argmax(axis=1)
            top = np.take_along_axis(r, where[:, None, :], axis=1)[:, 0]
            h = np.maximum(top, 0)
            share = 1 / np.bincount(doc, minlength=len(own))[doc]
            z = h @ m.out + params[3][0]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, z * share, minlength=len(own)), -30, 30)))
            g = ((p - label[own])[doc] * share / len(own)).astype(np.float32)
            gh = g[:, None] * m.out * (top > 0)
            grads = [np.zeros_like(m.table), gh.sum(axis=0), g @ h + 1e-4 * m.out, np.array([g.sum()], np.float32)]
            f = np.arange(FILTERS)
            for k in range(WIDTH):
                np.add.at(grads[0][k], (x[np.arange(len(rows))[:, None], where * STRIDE + k], f[None, :]), gh)
            t += 1
            for i, grad in enumerate(grads):  # Adam
                mean[i] += 0.1 * (grad - mean[i])
                var[i] += 0.001 * (grad * grad - var[i])
                params[i] -= (rate * (mean[i] / (1 - 0.9**t)) / (np.sqrt(var[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    m.base = float(params[3][0])
    return m


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def whole_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all chunks, their sizes, the text of each)."""
    buf, starts, ends, owner = layout(*text_buffers(texts))
    buf, sizes = np.append(symbols(buf), np.zeros(CHUNK, np.uint16)), (ends - starts).astype(np.int64)
    chunks = np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[starts]
    chunks[np.arange(CHUNK)[None, :] >= sizes[:, None]] = 0
    return chunks, sizes, owner


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 1500, sample_bytes: int = 32 << 20) -> Model:
    """Train on at most `sample` documents of each class, none of them held out, picked by a hash of the id.

    Of these, in the order of the hash, as many count as have `sample_bytes` of text together (a few
    times as much memory on the driver); their texts are read whole. An id with several labels has
    the larger, one with several rows the smallest text. Null ids, labels other than 0 and 1, and empty
    texts teach nothing. Without labels the model is blank.
    """
    ids = F.col(id_col).cast("long").alias("id")
    usable = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(ids, F.col(label_col).cast("int").alias("label"))
    usable = usable.filter("id is not null").groupBy("id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        part = usable.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    found = (docs.select(ids, F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # 2 * sample rows at most
             .groupBy("id", "label").agg(F.min("text").alias("text")).filter("octet_length(text) > 0"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))  # over 2 * sample rows
    rows = found.withColumn("so_far", so_far).filter(F.col("so_far") <= sample_bytes).select("id", "label", "text").collect()
    rows.sort(key=lambda r: r.id)
    chunks, sizes, owner = whole_chunks(pa.array([r.text for r in rows], pa.string()))
    return train(chunks, sizes, owner, np.array([r.label for r in rows], np.float32))


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    data, offs = text_buffers(texts)
    z = [logits(model, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(offs, 1 << 18)]
    z = np.concatenate(z) if z else np.zeros(0)
    return np.where(np.isnan(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns as they were, whatever their names."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(probabilities(model, batch.column(text_col)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with `score` and `predicted` (1 if score >= threshold) added.

    A null or empty text scores 0. Rows never influence each other, so repeated texts score alike.
    Columns of docs named score or predicted are replaced; all others stay, as do all rows.
    """
    docs = docs.drop("score", "predicted")

    def run(batches):
        for batch in batches:
            p = probabilities(model, batch.column(text_col))
            cols = [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
