import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from corvane.llm.substring_dedup import _chunks, pack, remove_repeats, unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha1((r[1] or "").encode()).hexdigest() if r[1] is not None else "")):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            if k in seen:
                gone[j : j + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in df.collect()), key=str)


def test_matches_brute_force(docs_of):
    rng = random.Random(2)
    passages = [" ".join(f"p{k}x{i}" for i in range(rng.choice([19, 20, 21, 55]))) for k in range(6)]
    rows = []
    for i in range(150):
        parts = [" ".join(rng.choice(["a", "b", "c", "d"]) + str(rng.randrange(400)) for _ in range(rng.randrange(40)))]
        parts += rng.choices(passages, k=rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i * 7 - 300, "\n".join(parts)))
    rows.append((5000, rows[3][1]))
    rows.append((5001, passages[3] + " " + passages[3]))
    for size in (1 << 20, 2000):  # one chunk, and many
        assert rows_of(remove_repeats(docs_of(rows), chunk_bytes=size, bucket_windows=256)) == brute(rows)


def test_extreme_and_skewed_ids(docs_of):
    rng = random.Random(5)
    said = lambda: " ".join(rng.choice("abcdef") + str(rng.randrange(40)) for _ in range(60))
    passage = " ".join(f"same{i}" for i in range(30))
    ends = [(-(2**63), f"{said()} {passage}"), (2**63 - 1, f"{passage} {said()}"), (0, said()), (None, passage), (2**53 + 1, f"x {passage}"), (2**53 + 2, passage)]
    skewed = [(i, f"{said()} {passage if i % 3 == 0 else ''}") for i in range(199)] + [(4_000_000_000_000, passage)]
    nameless = [(None if i % 3 else 5, f"{said()} {passage if i % 5 == 0 else ''}") for i in range(200)]
    for rows in (ends, skewed, nameless, ends + skewed + nameless):
        assert rows_of(remove_repeats(docs_of(rows), chunk_bytes=2500, bucket_windows=256)) == brute(rows)


def test_chunks_hold_like_bytes_in_order(docs_of):
    text = "word " * 100
    rows = [(i if i % 2 else -(10**15) + i**5, text) for i in range(2000)] + [(None, f"{text} {i}") for i in range(1000)] + [(77, f"{text} {i}") for i in range(1000)] + [(4 * 10**12, text * 3)]
    docs = docs_of(rows).select(F.col("doc_id").alias("id"), "text").withColumn("tie", F.sha1("text"))
    chunk, size = _chunks(docs, 40_000)
    got = docs.select("id", "tie", F.octet_length("text").alias("n"), chunk.alias("chunk")).collect()
    assert size == sum(r.n for r in got)
    total = {}
    for r in got:
        total[r.chunk] = total.get(r.chunk, 0) + r.n
    assert min(total) == 0 and len(total) > 40 and max(total.values()) < 100_000
    ordered = sorted(got, key=lambda r: (r.id is not None, r.id or 0, r.tie))
    assert [r.chunk for r in ordered] == sorted(r.chunk for r in ordered)


def test_odd_rows(odd, empty):
    from tests.llm.conftest import ODD_ROWS

    assert rows_of(remove_repeats(odd)) == brute(ODD_ROWS)
    assert remove_repeats(empty).count() == 0


def test_pack_round_trip():
    for n in (1, 2, 1000):
        h = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
        assert (unpack(*pack(h)) == h).all()
    h = np.array([5, 2**64 - 1], np.uint64)
    assert (unpack(*pack(h)) == h).all()
