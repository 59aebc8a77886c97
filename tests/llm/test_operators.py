"""Smaller operators against brute force, libraries or known answers, with odd and empty tables."""

import fractions
import gzip
import hashlib
import itertools
import json
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import chat_format, decontaminate, html_extract, quality, queries, secrets, topk, warc
from corvane.llm.bpe import bpe_decode, bpe_digests, bpe_encode, load
from corvane.llm.queries import tokenizer_path

ODD_TEXTS = ["It's DON'T can't 'so'll x'sy  İstanbul ΣΑΣ ǅ ½ ² Ⅷ 你好123 café café <|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> \x1c\x85​﻿ emoji😀😀👍🏽 zzzz　q",
             "a" * 500, "the" * 300, "!!!???...---===", "", " ", "\x1c", "a\x1db c", None, "x\u0085y z", "aaaa aaa aa a bbbb abababab"]


# ---- BPE -------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(docs_of, library):
    rng = random.Random(1)
    texts = ODD_TEXTS + ["".join(rng.choice("abcdefghijklmnop éöñß.,'0123 -_\n") for _ in range(200)) for _ in range(60)]
    df = docs_of(list(enumerate(texts)))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {r.doc_id: r.ids for r in bpe_encode(df, tokenizer_path()).collect()}
    assert ids == want
    text = {r.doc_id: r.text for r in bpe_decode(bpe_encode(df, tokenizer_path()), tokenizer_path()).collect()}
    assert text == {i: library.decode(x, skip_special_tokens=False) for i, x in want.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_digests(df, tokenizer_path()).collect()}
    assert got == {i: (len(x), sha(" ".join(map(str, x))), sha(text[i])) for i, x in want.items()}


def test_bpe_table_shapes(odd, empty):
    assert bpe_digests(odd, tokenizer_path()).count() == 9 and bpe_encode(empty, tokenizer_path()).count() == 0


def test_bpe_states_equal_plain_merges():
    bpe, rng = load(tokenizer_path()), random.Random(4)

    def plain(word):
        parts = bpe.symbols("".join(bpe.letters[b] for b in word.encode()) + "</w>")
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: bpe.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in bpe.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return " ".join(parts)

    words = {"".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(3000)}
    bpe.learn(list(words))
    assert all(bpe.learnt[w][1] == plain(w) for w in words)


# ---- exact top-k -----------------------------------------------------------------------------------------
def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 24)).astype(np.float32)
    x[7] = x[3]
    rows = [(i, [float(v) for v in r], i) for i, r in enumerate(x)]
    rows += [(900, None, 0), (901, [float("nan")] * 24, 0), (902, [None] + [0.0] * 23, 0), (903, [float("inf")] * 24, 0), (None, [0.0] * 24, 0), (905, [1.0] * 3, 0), (906, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int")
    q = df.filter("vec_id % 20 = 0")
    fl = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 400, 20):
        s = fl @ fl[i]
        best = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:10]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate(best)]
    for block in (64, 4096):
        got = [tuple(r) for r in topk.exact_topk(df, q, 10, block=block, query_block=7).collect()]
        assert sorted(got) == sorted(want)
    few = topk.exact_topk(df.filter("vec_id < 4"), df.filter("vec_id = 0"), 10).collect()
    assert [(r.query_id, r.vec_id) for r in topk.exact_topk(df.filter("size(embedding) = 0"), df.filter("size(embedding) = 0")).collect()] == []
    assert len(few) == 3 and topk.exact_topk(df.limit(0), q, 10).count() == 0 and topk.exact_topk(df, q.limit(0), 10).count() == 0


def test_topk_repeated_ids_and_large_values(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1e30, 1.0]), (3, [0.5, 2.0]), (4, [-1e30, 5.0]), (5, [1.6e308, -1.6e308]), (6, [3e15, 1.0]), (7, [3e15, 2.0]), (8, [3e15, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [[math.floor(fractions.Fraction(v) * 1024) for v in x] for _, x in rows]
    for only in ("vec_id = 0", "vec_id = 2", "vec_id >= 4"):
        want = []
        for a, (i, _) in enumerate(rows):
            if eval(only.replace(" = ", " == "), {"vec_id": i}):
                s = [sum(p * q for p, q in zip(ints[a], ints[b], strict=True)) for b in range(len(rows))]
                best = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-s[b], rows[b][0]))[:4]
                want += [(i, r + 1, rows[b][0], max(-(2**63 - 1), min(2**63 - 1, s[b]))) for r, b in enumerate(best)]
        for block in (2, 100):
            got = [tuple(r) for r in topk.exact_topk(df, df.filter(only), 4, block=block).collect()]
            assert sorted(got) == sorted(want), only


# ---- secrets ---------------------------------------------------------------------------------------------
def brute_spans(text):
    out = []
    for kind, p, least, group in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2), ("access", r"AKIA[A-Z0-9]+", 16, 0), ("hex", r"[0-9a-f]+", 32, 0)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(p, text, (re.I if kind == "assign" else 0) | re.A) if len(m[group]) >= least]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_base_spans(docs_of, odd, empty):
    rng = random.Random(9)
    bits = ["password", "TOKEN", "api_key", "apiKey", "secret", '"', "'", " ", ":", "=", "AKIA", "abcdef0123456789" * 2, "ABCDEFGH1234", "x" * 9, "é", "😀", "ſecret", "toKen", "short"]
    texts = ["".join(rng.choice(bits) for _ in range(30)) for _ in range(300)] + ["token=secret=abcdefgh12", "token: abc secret: longvalue1", None, ""]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind != "guess"] for r in secrets.scan_secrets(docs_of(list(enumerate(texts)))).collect()}
    assert got == {i: brute_spans(t or "") for i, t in enumerate(texts)}
    assert secrets.scan_secrets(odd).count() == 9 and secrets.scan_secrets(empty).count() == 0


def test_guess_cost():
    cost = secrets.guess_cost
    assert cost("") == 0 and cost("password1") < 4 < 8 < cost("x7#Kq9!vLm2$") and cost("qwertyuiop") < 5 and cost("19900412") < 6 and cost("aaaaaaaaaaaa") < 4
    assert cost("abcabcabcabc") < 8 and cost("P4ssw0rd") < cost("Zq8vK2mX") and cost("z" * 20_000) < 8
    found = secrets.find_secrets("pwd: hunterX9$kkQz2! and passphrase is password1 and password = 'abcdefgh'", 8.0)
    assert [s[0] for s in found] == ["guess", "assign"]
    assert secrets.redact("a token=abcdefgh1 b", secrets.find_secrets("a token=abcdefgh1 b", 8.0), "[S]") == "a token=[S] b"


def test_guess_contexts():
    for text, value in [("password: x7#Kq9!vLm2$", "x7#Kq9!vLm2$"), ("secret = Tr!ub4&dor%3X", "Tr!ub4&dor%3X"), ("password is x7#Kq9!vLm2$ ok", "x7#Kq9!vLm2$"), ("DB_PASS=x7#Kq9!vLm2$", "x7#Kq9!vLm2$"),
                        ("APP_DB_PWD='x7#Kq9!vLm2$'", "x7#Kq9!vLm2$"), ("login is password: x7#Kq9!vLm2$", "x7#Kq9!vLm2$"), ("pwd: x7#Kq,9!vL;m2$, next", "x7#Kq,9!vL;m2$"), ("<b>api_key: x7#Kq9<!vLm2$</b>", "x7#Kq9<!vLm2$")]:
        assert [(s[0], text[s[3] : s[2]]) for s in secrets.find_secrets(text, 8.0)] == [("guess", value)]
    text = "token: abcdefgh12#$tail99 (token=abcdefgh1)"
    assert [(s[0], text[s[3] : s[2]]) for s in secrets.find_secrets(text, 8.0)] == [("assign", "abcdefgh12"), ("guess", "#$tail99"), ("assign", "abcdefgh1")]
    assert secrets.redact(text, secrets.find_secrets(text, 8.0), "[S]") == "token: [S][S] (token=[S])"
    key = "AKIA" + "Q" * 16
    text = f"pwd=x7#{key}vLm2$9!"
    assert [(s[0], text[s[3] : s[2]]) for s in secrets.find_secrets(text, 8.0)] == [("guess", "x7#"), ("access", key), ("guess", "vLm2$9!")]


def test_guess_spares_prose(docs_of, tmp_path):
    prose = ["login is required", "auth: disabled", "Login is required.", "password is incorrect, try again", "the secret is everything", "credentials: available on request", "token is necessary", "api_key is deprecated"]
    for text in prose:
        assert secrets.find_secrets(text, 8.0) == []
    assert [r.text for r in secrets.mask_secrets(docs_of([(1, prose[0]), (2, "pwd: x7#Kq9!vLm2$")])).orderBy("doc_id").collect()] == [prose[0], "pwd: [SECRET]"]
    assert secrets.guess_cost("quizzaciously") > 8
    own = tmp_path / "words.txt"
    own.write_text("the\nquizzaciously\n")
    assert secrets.guess_cost("quizzaciously", str(own)) < 2


def test_mask_keeps_columns(odd):
    out = secrets.mask_secrets(odd)
    assert out.columns == odd.columns and out.count() == 9


# ---- decontamination -------------------------------------------------------------------------------------
def brute_tiles(doc, item, k):
    k = min(k, len(item))
    free_d, free_i, total = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while p + n < len(doc) and j + n < len(item) and doc[p + n] == item[j + n] and free_d[p + n] and free_i[j + n]:
                    n += 1
                if n >= k:
                    best = min(best, (-n, p, j))
        if not best[0]:
            return total
        for x in range(-best[0]):
            free_d[best[1] + x] = free_i[best[2] + x] = False
        total -= best[0]


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(60):
        item = rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64)
        doc = rng.integers(0, 6, rng.integers(0, 60)).astype(np.uint64)
        if len(doc) > 30:
            doc[3 : 3 + len(item) // 2] = item[len(item) - len(item) // 2 :]
        assert sum(t[2] for t in decontaminate.tile(doc, item, 3)) == brute_tiles(doc.tolist(), item.tolist(), 3)
    same = np.zeros(1500, np.uint64)
    assert decontaminate.tile(same, same[:700], 5) == [(0, 0, 700)]


def test_contaminated_equals_brute_force(spark, docs_of):
    """The whole query on a fixture: seeds, filter, joins and coverage against tiling of every document with every item."""
    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghijklmnopqrst") + str(rng.randrange(30)) for _ in range(n)]
    items = [(i, words(rng.choice([1, 3, 5, 8, 20, 40]))) for i in range(25)] + [(25, []), (26, ["a1"] * 12)]
    rows = []
    for i in range(150):
        doc = words(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1]
            cut = rng.randrange(len(item) + 1)
            doc[rng.randrange(len(doc) + 1) : 0] = item[cut:] + rng.choice([[], words(4)]) + item[:cut]  # whole, or as two parts the other way round
        rows.append((i if i % 10 else None if i % 20 else 5, " ".join(w.upper() if rng.random() < 0.2 else w + rng.choice(["", "", "!"]) for w in doc)))
    code = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws], np.uint64)
    want = set()
    for i, t in rows:
        doc = number([w.lower().rstrip("!") for w in t.split()])
        for j, ws in items:
            if ws and (got := brute_tiles(doc.tolist(), number(ws).tolist(), 5)) >= 0.6 * len(ws) and got:
                want.add((i, j, len(ws), got, t))
    bench = spark.createDataFrame([(j, " ".join(ws)) for j, ws in items], "item_id long, text string")
    docs = docs_of(rows)
    got = {(r.doc_id, r.item_id, r.n_words, r.n_covered) for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want) > 30 and got == {w[:4] for w in want}
    kept = decontaminate.without_benchmark(docs, bench)
    bad = {w[4] for w in want}
    assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in rows if t not in bad)


def test_contaminated(spark, docs_of, odd, empty):
    items = [(1, "One two three four five six seven eight nine ten eleven twelve."), (2, "tiny item"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(10, "noise seven EIGHT nine, ten eleven twelve!! more noise one two three four five six end"), (11, "one two three four five and then nothing"), (12, "a tiny, item here"), (13, None), (14, "tiny other item")])
    got = sorted((r.doc_id, r.item_id, r.n_covered, r.n_tiles) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(10, 1, 12, 2), (12, 2, 2, 1)]
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


# ---- WARC ------------------------------------------------------------------------------------------------
def test_loser_tree_merges():
    rng = random.Random(3)
    for k in range(0, 9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(7))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_warc_round_trip(spark):
    big, big2 = "<p>" + "x é" * 500, "<p>" + "y" * 999
    rows = [(1, "http://www.B.org/a?q", big), (2, "http://a.com/", big), (9, "http://a.com/z", big), (3, None, None), (4, "bad url\r\nx", ""), (5, "http://a.com/", "small"), (6, "http://a.com/", "small"), (7, "u", big2), (8, "u", big2), (9, "http://a.com/z", big), (-4, "n", big2)]
    pages = spark.createDataFrame([(*r, "f", 1) for r in rows], "page_id long, url string, html string, file string, offset int")
    entries, folder = warc.write_archives(pages)
    index = warc.capture_index(entries)
    keys = [(r.urlkey, r.seconds, r.page) for r in index.collect()]
    assert keys == sorted(keys) and [(r.urlkey, r.seconds, r.page) for r in index.orderBy("place").collect()] == keys and len(keys) == len(rows)
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect())
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        last = max(j for j, _, g in rows if g == h)
        visit = len(raw) >= 1000 and last != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if visit else "response", last if visit else None))
    assert [tuple(x) for x in got] == sorted(want)
    raw = warc.record_bytes(7, "u", 0, b"abc", hashlib.sha1(b"abc").digest(), None)
    fields, payload = warc.parse_record(gzip.decompress(gzip.compress(raw)))
    assert payload == b"abc" and warc.page_of(fields["warc-record-id"]) == 7 and warc.page_of(warc.record_id(-4)) == -4
    e, f = warc.write_archives(pages.limit(0))
    assert warc.read_records(warc.capture_index(e), f).count() == 0


def test_warc_odd_ids(spark):
    big, other = "<p>" + "z" * 1200, "<p>" + "o" * 1200
    rows = [(None, "http://a.com/", big), (None, "http://a.com/", big), (0, "http://a.com/", big), (None, "http://b.com/", other), (None, "http://b.com/", other), (None, None, None),
            (300_000_000_000, "u", "x"), (2**63 - 1, "u", "x"), (-(2**63), "u", "x"), (-5, "v", big)]
    entries, folder = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_records(warc.capture_index(entries), folder).collect()), key=repr)
    want = [(None, "http://a.com/", "revisit", 0)] * 2 + [(0, "http://a.com/", "response", None)] + [(None, "http://b.com/", "response", None)] * 2 + [(None, "", "response", None)]
    want += [(i, "u", "response", None) for i in (300_000_000_000, 2**63 - 1, -(2**63))] + [(-5, "v", "revisit", 0)]
    assert got == sorted(want, key=repr)
    assert warc._stamp(-(10**15)) == "0001-01-01T00:00:00Z" and warc._stamp(10**15) == "9999-12-31T23:59:59Z" and warc._stamp(0) == "1970-01-01T00:00:00Z"


# ---- HTML ------------------------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T{i}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/x>m{i}</a></li></ul></nav><div class="ad">buy {i}</div>
<article><h1>Head {i}</h1><p>First&nbsp;&amp; <b>bold {i}<br><p>Second   {i} line</p><aside>side</aside><div id="comments"><p>reader {i}</p></div></article><footer>&copy; {i}</footer></body></html>"""
PLAIN = """<html><body><div class=menu><a href=/>home</a></div><div><div class="story"><h2>Title {i}</h2><p>Body text number {i} goes on and on.</p><p>More {i}.</p><p>Again {i}!</p></div><div class="cookie-notice">We use cookies {i}</div></div><form><input name=q>find</form></body></html>"""


def test_html_text(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(i=i)) for i in range(6)] + [(10 + i, f"http://p.org/{i}", PLAIN.format(i=i)) for i in range(6)]
    rows += [(20, "http://h.org/x", None), (21, None, ""), (22, "http://h.org/y", "just text &lt;b"), (23, "http://h.org/z", PAGE.format(i=9)[:330]), (24, None, "<p>lone <br> page")]
    df = spark.createDataFrame([(*r, "h", "t") for r in rows], "page_id long, url string, html string, host string, template string")
    got = {r.page_id: r for r in html_extract.extract_text(df).collect()}
    assert got[3].text == "Head 3\nFirst & bold 3\nSecond 3 line" and got[3].n_chars == len(got[3].text)
    assert got[12].text == "Title 2\nBody text number 2 goes on and on.\nMore 2.\nAgain 2!"
    assert got[20].text == got[21].text == "" and got[22].text == "just text <b" and got[23].text.startswith("Head 9") and got[24].text == "lone page"
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_deep_and_long_pages(spark):
    n = 50_000
    deep = "<div>" * n + "deep text" + "</div>" * n
    mixed = "<body>" + "<div><b>x " * 1200 + "<nav>gone<p>gone too</p></nav>kept<p>own line</p> tail" + "</b></div>" * 1200
    many = "<article>" + "".join(f"<p>a{i}</p><h2>b{i}</h2>" for i in range(3000)) + "</article>"
    more = "<article>" + "".join(f"<h3>c{i}</h3><p>d{i}</p>" for i in range(3000)) + "</article>"
    rows = [(0, "http://d.org/", deep), (1, "http://d.org/1", mixed), (2, "http://l.org/", many), (3, "http://l.org/2", more), (4, "http://o.org/", "</section>" * n + "<span>" * n + "end"), (5, "http://o.org/", "<p>x" * n)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep text" and got[4] == "end" and got[5] == "\n".join(["x"] * n)
    assert "gone" not in got[1] and got[1].split("\n")[-3:] == ["x kept", "own line", "tail"]
    assert got[2] == "\n".join(f"a{i}\nb{i}" for i in range(3000)) and got[3] == "\n".join(f"c{i}\nd{i}" for i in range(3000))


def plain_match(a, b):
    """Simple tree matching cell by cell: (matched nodes, positions)."""
    best, gain, pairs, i, j = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], {}, [], len(a), len(b)
    for x, y in itertools.product(range(len(a)), range(len(b))):
        if a[x][0] == b[y][0]:
            gain[x, y] = 1 + plain_match(a[x][6], b[y][6])[0]
        best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + gain.get((x, y), 0))
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1], pairs[::-1]


def test_one_match_at_every_size():
    rng = random.Random(5)
    tree = lambda names, depth, wide: [rng.choice(names), 0, 0, 0, 0, 0, [tree(names, depth - 1, wide) for _ in range(rng.randint(0, wide) if depth else 0)]]
    some = lambda n, names, depth, wide: [tree(names, depth, wide) for _ in range(n)]
    for _ in range(400):
        names = "abcdefgh"[: rng.randint(1, 8)]
        a, b = (some(rng.randint(0, 12), names, rng.randint(0, 2), 3) for _ in "ab")
        b = [x for x in a if rng.random() < 0.8] + b[:3] if rng.random() < 0.4 else b
        assert html_extract.align(a, b) == plain_match(a, b)
    for n, m, depth in ((190, 200, 1), (210, 200, 2), (450, 100, 1), (90, 600, 1)):
        a, b = some(n, "abc", depth, 2), some(m, "abc", depth, 2)
        assert html_extract.align(a, b) == plain_match(a, b)


def test_notices_go_from_pages_of_any_length(spark):
    said = lambda i, n: "".join(f"<p>{w}</p><h2>{w * 2}</h2>" for w in random.Random(i).sample(range(10**6), n))
    note = "<div class=info>Our terms apply</div>"
    for n in (8, 60, 100, 300):
        rows = [(i, "http://n.org/", f"<article><table><tr><td>t{i}</table>{note}{said(i, n + 3)}</article>" if i % 2 else f"<article>{note}{said(i, n + n // 2)}<table><tr><td>t{i}</table>{said(i + 50, n)}</article>") for i in range(6)]
        trees = [html_extract.parse(h) for _, _, h in rows]
        for order in ([0, 1, 2, 3, 4, 5], [5, 3, 1, 4, 2, 0], [1, 0, 2, 4, 3, 5]):
            t = html_extract.fold(trees[order[0]])
            for i in order[1:]:
                t = html_extract.merge(t, html_extract.fold(trees[i]))
            assert not [i for i in order if "terms" in html_extract.text_of(html_extract.parse(rows[i][2]), t)], (n, order)
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"t{i}" in got[i].split("\n") and "terms" not in got[i] for i in range(6))


def test_unique_ids_and_classes_do_not_grow_the_template():
    page = lambda i: html_extract.parse(f"<body><div id=menu-{i}>m</div><article id=a{i} class='post-{i}'>" + "".join(f"<p id=p{i}x{j}>{i}</p><h2 class=c{i}z{j}>h</h2>" for j in range(40)) + "</article></body>")
    t = html_extract.fold(page(0))
    sizes = []
    for i in range(1, 120):
        t = html_extract.merge(t, html_extract.fold(page(i)))
        sizes.append(len(json.dumps(t)))
    assert sizes[-1] < 2 * sizes[0] and "menu" in json.dumps(t)


def test_templates_lose_no_node(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    own = lambda i, n: "".join(f"<p class=own{letters(i * n + j)}>{i} says {j}</p>" for j in range(n))
    box = lambda said: f"<div class=box>{said}</div>"
    page = lambda i, middle: f"<body><article>{middle}{own(i, 40)}<h4>end {i}</h4></article></body>"
    pages = [page(0, box("Told once"))] + [page(i, "") for i in range(1, 60)] + [page(i, box("Our terms")) for i in range(60, 140)]
    t = html_extract.fold(html_extract.parse(pages[0]))
    for h in pages[1:]:
        t = html_extract.merge(t, html_extract.fold(html_extract.parse(h)))
    kids = t[6][0][6][0][6]
    assert len(kids) == 140 * 40 + 2 and [k[2] for k in kids if k[0] == "div.box"] == [81]
    said = html_extract.text_of(html_extract.parse(pages[70]), t).split("\n")  # the box differs on one page: it is no template
    assert said == ["Our terms", *(f"70 says {j}" for j in range(40)), "end 70"]
    two = "<body>" + "".join(f"<section><article><p>{{0}} {w}</p></article></section>" for w in ("one", "two", "three")) + "</body>"
    rows = [(i, "http://s.org/", two.format(i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "2 one\n2 two\n2 three"


def test_template_knows_constants():
    pages = [html_extract.parse(f"<body><div class=x><p>Same line here</p><h3>t{i}</h3><span>v{i}</span></div></body>") for i in range(4)]
    t = html_extract.fold(pages[0])
    for p in pages[1:]:
        t = html_extract.merge(t, html_extract.fold(p))
    assert html_extract.constants(t, []) and html_extract.text_of(pages[1], t) == "t1\nv1"
    assert html_extract.align(t[6], t[6])[0] > 0 and json.loads(json.dumps(t)) == t


def test_copies_are_not_template(spark):
    words = [f"w{i}" for i in range(600)]
    said = lambda i, n=60: " ".join(random.Random(i).sample(words, n))
    shape = "<html><body><article><h1>{0}</h1>{1}<p>{2}</p><p>{3}</p><div class=info><p>Our terms apply</p><p>All rights are ours</p></div><ul><li>One rule</li><li>Two rules</li></ul></article></body></html>"
    quote = "<blockquote>A quote of the one article</blockquote>"
    copy = shape.format("Copied", quote, said(1), said(2))
    mixed = [copy] * 3 + [copy.replace("w1 ", "w9 ")] + [shape.format(f"H{i}", "", said(10 + i), said(50 + i)) for i in range(8)]
    only = [f"<html><body><article><h1>Same</h1><p>{said(3)}</p><ul><li>a</li><li>b</li></ul><p>{said(4, 20)} {x}</p></article></body></html>" for x in ("one", "two", "three", "four")]
    rows = [(i, f"http://mixed.org/{i}", h) for i, h in enumerate(mixed)] + [(100 + i, f"http://only.org/{i}", h) for i, h in enumerate(only)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == got[1] == f"Copied\nA quote of the one article\n{said(1)}\n{said(2)}"  # the box and the list are template, the quote is not
    assert got[5] == f"H1\n{said(11)}\n{said(51)}"
    assert got[100] == f"Same\n{said(3)}\na\nb\n{said(4, 20)} one"


# ---- quality ---------------------------------------------------------------------------------------------
def test_quality_learns_and_scores_all(spark, docs_of, odd, empty):
    rng = random.Random(0)
    good = lambda: " ".join(rng.choice(["river", "stone", "over", "the", "green", "hill,", "and", "walks."]) for _ in range(rng.randint(20, 400)))
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!", "$$$", "CLICK!!"]) for _ in range(rng.randint(20, 400)))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    model = quality.fit(docs, labels, sample=100)
    out = quality.score(docs, model).withColumn("held", quality.held_out("doc_id")).collect()
    held = [r for r in out if r.held]
    assert len(held) > 40 and sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    again = {r.doc_id: r.score for r in quality.score(docs.repartition(7), model).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-4 for r in out)  # neighbours in a batch do not matter
    odd_scores = quality.score(odd, model).collect()
    assert len(odd_scores) == 9 and all(0 <= r.score <= 1 for r in odd_scores) and {r.score for r in odd_scores if not r.text} == {0.0}
    assert quality.score(empty, model).count() == 0 and quality.fit(docs, labels.limit(0)).base == 0.0
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in odd_scores if r.predicted)
    more = docs.unionByName(docs.withColumn("text", F.concat("text", F.lit("zz")))).unionByName(docs)  # of rows that repeat an id the smallest text counts
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0)], labels.schema))
    same = quality.fit(more, again, sample=100)
    assert np.array_equal(same.table, model.table) and np.array_equal(same.out, model.out)
    assert quality.fit(docs, labels, sample=100, sample_bytes=0).base == 0.0


def test_chunks_cover_the_document():
    for n in (1, 5, 511, 512, 513, 960, 961, 5000):
        data = np.ones(n, np.uint8)
        _, starts, ends, _ = quality.layout(data, np.array([0, n]))
        assert starts[0] == 0 and ends[-1] == n and all(b <= e for b, e in zip(starts[1:], ends[:-1], strict=True))
        chunks, sizes, owner = quality.whole_chunks(pa.array(["", "x" * n, None]))
        assert len(chunks) == len(starts) and set(owner) == {1} and sizes.tolist() == (ends - starts).tolist() and all((c[:k] & 255 == 120).all() and not c[k:].any() for c, k in zip(chunks, sizes, strict=True))
    assert quality.repeats(np.frombuffer(b"abcabcabcabcabcabc" + bytes(40), np.uint8)).any() and not quality.repeats(np.frombuffer(bytes(range(1, 120)), np.uint8)).any()


# ---- chat ------------------------------------------------------------------------------------------------
def test_tool_calls(spark):
    call = lambda i, n, a: {"id": i, "name": n, "arguments": a}
    said = lambda *calls: json.dumps({"content": "", "tool_calls": list(calls)})
    msgs = [
        (1, 0, "user", 'hi "there"\n'), (1, 1, "assistant", said(call("a", "f", {"y": 1, "x": "s"}), call("b", "f", {"x": "$a", "y": 2.5}))), (1, 2, "tool", '{"tool_call_id":"a","content":{"z":1,"b":[true,null]}}'),
        (1, 3, "tool", '{"tool_call_id":"zz","content":"lost"}'), (1, 4, "assistant", said(call("c", "g", {}), call("d", "f", {"x": "$b", "q": 1}), call("p", "f", {"x": "$q", "y": 1}), call("q", "f", {"x": "$p", "y": 1}))),
        (1, 5, "assistant", "not json {"), (2, 0, "assistant", said(call("a", "f", {"x": "t", "y": 1}), call("a", "f", {"x": "u", "y": 1}))), (2, 1, "tool", '{"tool_call_id":"a","content":null}'), (3, 0, None, None), (None, 0, "user", ""),
        (2, 2, "assistant", said(call(None, "f", {"x": "t", "y": 1})))]
    df = spark.createDataFrame([(*m, 1) for m in msgs], "conv_id long, turn long, role string, text string, level int")
    schemas = spark.createDataFrame([("f", [("x", "string", True), ("y", "integer", True)])], chat_format.SCHEMA_COLUMNS)
    out = chat_format.format_chat(df, schemas)
    got = {(r.conv_id, r.call_id): r for r in out.filter("kind <> 'message'").collect() if r.call_id}
    assert (got[1, "a"].level, got[1, "b"].level, got[1, "d"].level, got[1, "p"].level) == (0, 1, 2, None)
    assert got[1, "a"].linked and not got[1, "b"].linked and got[1, "zz"].kind == "result" and got[1, "zz"].complaint == "no call"
    assert (got[1, "a"].complaint, got[1, "b"].complaint, got[1, "c"].complaint, got[1, "d"].complaint) == ("", "type:y", "unknown tool", "missing:y")
    assert got[1, "a"].json == '{"arguments":{"x":"s","y":1},"id":"a","name":"f","result":{"b":[true,null],"z":1}}'
    assert got[2, "a"].json.startswith('{"arguments":{"x":"t"') and out.filter("complaint = 'no id'").count() == 1
    plain = sorted(r.json for r in out.filter("kind = 'message'").collect())
    assert '{"content":"hi \\"there\\"\\n","role":"user"}' in plain and '{"content":null,"role":null}' in plain and len(plain) == 4
    assert chat_format.format_chat(df.limit(0), schemas).count() == 0


def test_format_chat_query_reads_every_row(spark, tmp_path):
    real = json.dumps({"tool_calls": [{"id": "r", "name": "open", "arguments": {"turn": "x", "prompt": "p"}}]})
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", None), (1, 4, "assistant", None), (1, 5, "user", "c"), (2, 0, "user", "one"), (2, 0, "user", "two"), (2, 1, "assistant", "three"),
            (2, 1, "assistant", "four"), (2, 1, "assistant", "five"), (3, 0, None, "x"), (3, 1, "tool", "not json"), (3, 2, "assistant", real), (None, 1, "user", "lost"), (4, None, "assistant", "lost"), (4, 3, "user", "late")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op3_tool_call_linking"](spark, str(tmp_path)).collect()
    assert sum(1 + r.linked for r in got) == len(rows)
    calls = {r.call_id: (r.level, r.linked, r.complaint) for r in got if r.kind == "call"}
    assert calls == {"c1-1": (0, True, ""), "c1-3": (1, True, "missing:prompt"), "c1-5": (2, False, ""), "c2-0": (0, True, ""), "c2-0-2": (0, True, ""), "r": (0, False, "type:turn"), "c4-3": (0, False, "")}
    assert [r.call_id for r in got if r.kind == "result"] == ["c2-0-3"]
    assert sorted(json.loads(r.json)["content"] for r in got if r.kind == "message") == ["be kind", "lost", "lost", "not json", "x"]
    assert not re.search("Python|Pandas|Arrow", queries.QUERIES["op3_tool_call_linking"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString())


def test_levels_of_chains_branches_and_cycles(spark):
    needs = {f"n{i}": [f"n{i - 1}"] if i else [] for i in range(40)}
    needs |= {"only a key": [], "m": ["n7", "n39"], "k": ["m"], "x": ["y"], "y": ["z"], "z": ["x"], "u": ["x"], "v": ["u", "n0"], "w": ["m", "k", "gone"], "s": ["s"]}
    calls = spark.createDataFrame([(1, i, json.dumps({"a": ["$" + n for n in ns], "$n5": {"$n6": 1}, "t": 'say "$n7"'})) for i, ns in needs.items()], "conv_id long, call_id string, arguments string")
    got = {r.call_id: r.level for r in chat_format.levels(calls).collect()}
    assert got == {f"n{i}": i for i in range(40)} | {"only a key": 0, "m": 40, "k": 41, "w": 42} | dict.fromkeys("xyzuvs")


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.format_chat(df, spark.createDataFrame([], chat_format.SCHEMA_COLUMNS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and F is not None
