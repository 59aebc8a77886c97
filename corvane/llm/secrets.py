"""Secret scan: fixed patterns, and password guess-cost dynamic programming on credential values.

The base patterns find assignments, access keys and long hex runs. Beyond them, values that stand
in a credential context (password, DB_PASS, token, auth, ... with ":", "=" or "is") are priced: the
cheapest segmentation of the value into words, dates, repeats, keyboard walks and brute-force
characters gives the guesses an attacker needs. Values that cost at least 10**threshold guesses are
added as spans of kind `guess`; cheap ones (placeholders, plain words, 12345678) are not. Where a
base span covers a part of such a value, the rest of it is the `guess` span.
"""

from __future__ import annotations

import base64
import bisect
import functools
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run of 32 or more: the same as dropping shorter runs
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ["assign", "access", "hex", "guess"]

# Names of the base patterns count inside longer names, as there; the others at the start of a name or after "_".
_NAME = r"""(?:(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|credentials?|auth|bearer|login|private_key|access_key|client_key)|password|passwd|secret|token|api_?key)["']?"""
# The value goes up to white space, a quote or a markup tag; the name of another credential is no value.
CONTEXT = re.compile(
    rf"""{_NAME}(?:\x20*[:=]\x20*|\x20is\x20)["']?(?!{_NAME}[:=]?(?:\s|$))((?:[^\s"'<]|<(?!/?[a-z][a-z0-9]*/?>)){{8,}})""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = (*KEYWORDS, "pwd", "pass", "credential", "auth", "bearer", "login", "private_key", "access_key", "client_key")
CLOSERS = {")": "(", "]": "[", "}": "{"}

# Common password words, most frequent first; a word's place is its guess number, or its place in the ranked word list if that is lower.
WORDS = {w: i for i, w in enumerate(
    "password admin welcome letmein monkey dragon master login secret hello test user root guest love "
    "sunshine princess football baseball shadow superman batman summer winter spring autumn flower "
    "computer internet server database default changeme example sample company office home house "
    "the and you for that with have this from they will your what when make like time just know "
    "orange banana apple cherry pepper cookie coffee tiger eagle falcon mustang ginger buster "
    "michael jennifer jordan daniel thomas andrew charlie".split(), 1)}
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
LEET = str.maketrans("@4310$5!7", "aaeiossit")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
LONGEST_WORD = 24  # of a ranked word list
SEGMENT = math.log10(2)  # each further segment doubles the arrangements to try


def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33)


def word_lists() -> list[str]:
    """The default ranked word lists: vocabularies of public tokenizers, in English and in several languages."""
    import public_tokenizers

    return [public_tokenizers.path(name) for name in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]


def _listed(path: str) -> list[str]:
    """The lower-case words of a list, most frequent first.

    A text file has one word a line. Of a tokenizer's .json or .tiktoken file the entries count that
    are a whole word, which such files mark by a leading space or a closing mark, by id.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        return [t.removesuffix("</w>") for t in sorted(vocab, key=vocab.get) if t.endswith("</w>")]
    with open(path, encoding="utf-8") as f:
        if path.endswith(".tiktoken"):
            tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f if line.strip()]
            return [t[1:].lower() for t in tokens if t.startswith(" ")]
        return [line.strip().lower() for line in f]


@functools.lru_cache(4)
def ranks(words: str | None = None) -> dict[str, int]:
    """Word -> guess number: the least place in WORDS and in the ranked list at the path `words` (None: word_lists())."""
    out = dict(WORDS)
    for path in [words] if words else word_lists():
        for i, w in enumerate(dict.fromkeys(w for w in _listed(path) if w.isalpha() and 3 <= len(w) <= LONGEST_WORD), 1):
            out[w] = min(i, out.get(w, i))
    return out


def guess_cost(value: str, words: str | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation, by the words of ranks(words); 0 for an empty value. Linear in its length."""
    known = ranks(words)
    n, low = len(value), value.lower()
    if len(low) != n:
        low = value
    plain = low.translate(LEET)
    dates = {}
    for m in DATE.finditer(value):
        dates.setdefault(m.end(), []).append(m.start())
    best = [0.0] * (n + 1)
    same = walk = 0
    for end in range(1, n + 1):
        best[end] = best[end - 1] + _char_cost(value[end - 1])
        same = same + 1 if end > 1 and low[end - 1] == low[end - 2] else 1
        walk = walk + 1 if end > 1 and low[end - 2 : end] in NEXT else 1
        options = []
        if same >= 3:  # one character again and again
            options.append((end - same, _char_cost(value[end - 1]) + math.log10(same)))
        if walk >= 3:  # neighbours on the keyboard or in the alphabet: a start, then turns
            options.append((end - walk, math.log10(47) + math.log10(walk) + 0.3))
        for size in range(3, min(LONGEST_WORD, end) + 1):
            start = end - size
            rank = known.get(low[start:end])
            leet = rank is None
            if leet:
                rank = known.get(plain[start:end])
            if rank is not None:
                options.append((start, math.log10(rank + 1) + 0.3 * leet + (0.3 if value[start:end] != low[start:end] else 0)))
        for start in dates.get(end, ()):
            options.append((start, math.log10(365 * 130) if end - start > 4 else math.log10(130)))
        for size in range(2, min(16, end // 2) + 1):  # the block before, once more
            if low[end - size : end] == low[end - 2 * size : end - size]:
                options.append((end - size, SEGMENT))
        for start, cost in options:
            best[end] = min(best[end], best[start] + cost + SEGMENT)
    return best[n]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _uncovered(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of [start, end) that none of the disjoint sorted spans covers."""
    out = []
    for i in range(max(0, bisect.bisect_left(spans, (start,)) - 1), len(spans)):
        s, e = spans[i]
        if s >= end:
            break
        if e > start:
            if s > start:
                out.append((start, s))
            start = e
    return [*out, (start, end)] if start < end else out


def find_secrets(text: str, threshold: float, words: str | None = None) -> list[tuple[str, int, int, int, float]]:
    """(kind, start, end, start of the value, log10 guesses) by start, then kind; offsets in code points."""
    found = []
    low = text.lower()
    if any(w in low for w in KEYWORDS):
        found += [("assign", m.start(), m.end(), m.start(2), guess_cost(m[2], words)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), guess_cost(m[0], words)) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end(), m.start(), guess_cost(m[0], words)) for m in HEX.finditer(text)]
    if any(w in low for w in CONTEXT_WORDS):
        base = _union([(s, e) for _, s, e, _, _ in found])
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(",;>")
            pieces = _uncovered(m.start(1), m.start(1) + len(value), base)
            if pieces and (cost := guess_cost(value, words)) >= threshold:
                for s, e in pieces:
                    if e - s == len(value):
                        found.append(("guess", m.start(), e, s, cost))
                    elif any(c not in CLOSERS or CLOSERS[c] in value for c in text[s:e]):  # not just the end of a bracket around it all
                        found.append(("guess", s, e, s, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int, int, float]], mask: str) -> str:
    """The text with every value masked; overlapping values are masked as one."""
    out, at = [], 0
    for _, _, end, value, _ in sorted(spans, key=lambda x: x[3]):
        if end > at:
            if value >= at:
                out += [text[at:value], mask]
            at = end
    return "".join(out) + text[at:]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("guesses_log10", pa.float64())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 8.0, mask: str | None = None, words: str | None = None) -> DataFrame:
    """(doc_id, spans[, text]) for every row; with `mask`, the text with each value replaced by it.

    `words` is the path of the ranked word list, the same on every executor (see ranks). A null or
    empty text has no spans, and stays as it is. Repeated rows give repeated rows. Other
    columns are ignored. Each text is scanned whole, in one task; no rows move.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = batch.column("text").to_pylist()
                spans = [find_secrets(t, threshold, words) if t else [] for t in texts]
                cols = [batch.column("id"), pa.array([[dict(zip(("kind", "start", "end", "value_start", "guesses_log10"), s, strict=True)) for s in row] for row in spans], pa.list_(_SPAN))]
                if mask is not None:
                    cols.append(pa.array([redact(t, s, mask) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["id", "spans", "text"][: len(cols)])

    schema = "id long, spans array<struct<kind:string,start:int,end:int,value_start:int,guesses_log10:double>>" + (", text string" if mask is not None else "")
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def mask_secrets(docs: DataFrame, text_col: str = "text", threshold: float = 8.0, mask: str = "[SECRET]", words: str | None = None) -> DataFrame:
    """docs with every secret value in the text replaced by the mask; all other columns and rows as they were."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                texts = [redact(t, s, mask) if t and (s := find_secrets(t, threshold, words)) else t for t in batch.column(text_col).to_pylist()]
                place = batch.schema.get_field_index(text_col)
                yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def span_text(spans) -> object:
    """kind:start:end joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
