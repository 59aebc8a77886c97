import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corvane.llm.hashing import shingle_sets, text_buffers
from corvane.llm.ngram_join import PART, Tree, bitmap_of, dual, fold, linked, need_overlap, ngram_jaccard, one_of_each_group

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, up, holders = {}, {}, defaultdict(list)
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for n, (i, s) in enumerate(flat):
        shared = Counter(m for x in s for m in holders[x])
        for m, c in shared.items():
            j, o = flat[m]
            if 100 * c >= 75 * (len(s) + len(o) - c):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in s:
            holders[x].append(n)
    return {i: root(i) for i in up}


def near_copies(seed, n, group):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 7, 12, 40, 120]))]
        for _ in range(rng.randint(1, group)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((k, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
            k += 1
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(docs_of):
    rows = near_copies(1, 60, 8)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard(docs_of(rows)).collect()}
    want = brute(rows)
    assert got == {i: (len(shingles(t)), want[i]) for i, t in rows}


def test_one_large_group(docs_of, monkeypatch):
    import corvane.llm.ngram_join as m

    monkeypatch.setattr(m, "PART", 16)  # several parts, so that bridges and pairs of parts are used
    monkeypatch.setattr(m, "LARGE", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for k in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"e{rng.randrange(1000)}"
        rows.append((k, " ".join(w)))
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in m.ngram_jaccard(docs_of(rows)).collect()} == want and PART == 512
    monkeypatch.setattr(m, "HOT", 10)  # frequent shingles get salts
    assert {r.doc_id: r.component_id for r in m.ngram_jaccard(docs_of(rows)).collect()} == want


def test_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard(odd).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 3, None), (4, 1, 4), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 7)], key=str)
    assert ngram_jaccard(empty).count() == 0


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(25):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        for _ in range(3):
            s = base.copy()
            s[rng.integers(0, 60, 4)] = rng.integers(0, 2**63, 4).astype(np.uint64)
            sets.append(np.unique(s))
    members = [(i, i, len(s), bitmap_of(s)) for i, s in enumerate(sets)]
    tree = Tree(members, 128)
    found = set(dual(tree.root, tree.root, 75))
    truth = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if linked(sets[i], sets[j], 75)}
    assert truth and truth <= found and len(found) < len(sets) * (len(sets) - 1) // 2
    assert need_overlap(4, 4, 75) == 4 and fold(b"\x01\x80", 8) == 0x81


def test_shingles_match_words():
    import pyarrow as pa

    texts = ["A b\tC d e f", "a b c d e F ", "x y", "", "é à ü ö ß é"]
    data, offs = text_buffers(pa.array(texts))
    s = shingle_sets(data, offs)
    assert [len(x) for x in s] == [len(shingles(t)) for t in texts] and (s[0] == s[1]).all()


def test_one_of_each_group(docs_of, odd, empty):
    same = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(7, same), (3, same + " thirteen"), (None, same), (None, "alone without any id here"), (5, "quite another text of six words"), (5, same.upper()), (5, "and a third one under this id"), (8, None), (9, ""), (None, None), (3, same + " thirteen")]
    docs = docs_of(rows).withColumn("row_0", F.lit("mine"))
    got = one_of_each_group(docs)
    assert got.columns == docs.columns
    want = [(3, same + " thirteen"), (None, "alone without any id here"), (5, "quite another text of six words"), (5, "and a third one under this id"), (8, None), (9, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str) and {r.row_0 for r in got.collect()} == {"mine"}
    assert one_of_each_group(odd).count() == 7 and one_of_each_group(empty).count() == 0
