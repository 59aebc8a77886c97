"""BPE encoding by prefix-sharing trie traversal, and decoding.

For byte pair encoding every prefix of a word has one last token, and the encoding of a prefix is
the encoding of the prefix before that token followed by it. A candidate last token is right
exactly if it and the token before it stay apart when the pair is encoded by itself. So each trie
node keeps one state, the length of its last token, and a node's state follows from those of its
ancestors. The distinct words of a batch, sorted, are the trie in depth-first order: the common
prefix with the word before is the shared path, whose states are kept and computed once.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
KEPT_WORDS = 300_000  # words whose encoding a task remembers; then it starts anew
KEPT_PAIRS = 2_000_000  # pairs of tokens, likewise


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def _class(starts: str) -> str:
    """Ranges of all characters whose general category starts with this letter."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(starts)
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


_SPACES = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


_CONTROLS = frozenset("\x1c\x1d\x1e\x1f")  # white space to str.split, not to the file's pattern


@lru_cache(maxsize=1)
def _words_pattern() -> re.Pattern:
    letters, numbers = _class("L"), _class("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACES}{letters}{numbers}]+")


class WordBpe:
    """A vocabulary with merges, word ends and special tokens, read from a tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.backward: dict = {"": {}, END: {}}  # tokens spelled from their last letter; key 0 holds the token itself
        for t in self.ids:
            end = END if t.endswith(END) and len(t) > len(END) else ""
            node = self.backward[end]
            for c in reversed(t.removesuffix(end)):
                node = node.setdefault(c, {})
            node[0] = t
        self.id_of = {t: str(i) for t, i in self.ids.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[str, dict[str, bool]] = {}  # does the second token stay apart from the first?
        self.split: dict[str, tuple[str, str] | None] = {}  # last merge of a token; absent: not looked at yet
        self.reset()

    def reset(self) -> None:
        self.id_text: dict[str, str] = {}  # of words without white space, as they stand in the text
        self.token_text: dict[str, str] = {}
        self.learnt: dict[str, tuple[str, str]] = {}  # ids and tokens of normalised words
        self.blank: set[str] = set()  # pieces that have no token

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            return [*token[: -len(END) - 1], token[-len(END) - 1 :]]
        return list(token)

    def alone(self, token: str) -> bool:
        """Does the text of this token encode as just this token? Notes its last merge."""
        if token not in self.split:
            parts = self.symbols(token)
            last = (token, "") if len(parts) == 1 and token in self.ids else None
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
                pair = (parts[best], parts[best + 1])
                if pair not in self.rank:
                    last = None
                    break
                parts[best : best + 2] = ["".join(pair)]
                last = pair
            self.split[token] = last
        return self.split[token] is not None

    def spine(self, token: str, side: int) -> tuple[list[str], list[int]]:
        """The pieces of a token at its left (0) or right (1) edge, smallest first, and the rank of the merge that ends each."""
        pieces, ends = [token], [1 << 60]
        while self.alone(pieces[-1]) and self.split[pieces[-1]][1]:
            pair = self.split[pieces[-1]]
            pieces.append(pair[side])
            ends.append(self.rank[pair])
        return pieces[::-1], ends[::-1]

    def apart(self, left: str, right: str) -> bool:
        """Do these two tokens stay apart where they meet?

        Each side grows by its own merges in order of rank. The pieces that face each other at some
        time merge if the rank of that merge comes before the next one of either side; of equal
        ranks the leftmost is first.
        """
        (a, a_ends), (b, b_ends) = self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        while True:
            cross = self.rank.get((a[i], b[j]))
            if cross is not None and cross < a_ends[i] and cross <= b_ends[j]:
                return False
            if i == len(a) - 1 and j == len(b) - 1:
                return True
            if a_ends[i] <= b_ends[j]:
                i += 1
            else:
                j += 1

    def learn(self, words: list[str]) -> None:
        """Encode distinct words in one depth-first walk over their trie."""
        letters, middle, final, pairs, id_of = self.letters, self.backward[""], self.backward[END], self.pairs, self.id_of
        spelled = sorted(("".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]), w) for w in words)
        before, last = "", [""]
        for word, plain in spelled:
            shared, size = 0, len(word)
            most = min(len(before), size - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, size + 1):
                node, start, tokens = final if depth == size else middle, depth, []
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    token = node.get(0)
                    if token is not None:
                        tokens.append((start, token))
                for start, token in reversed(tokens):  # the longest candidate first
                    left = last[start]
                    known = pairs.get(left)
                    if known is None:
                        known = pairs[left] = {}
                    fits = known.get(token)
                    if fits is None:
                        fits = known[token] = self.alone(token) and (not left or self.apart(left, token))
                    if fits:
                        break
                else:
                    raise ValueError(f"no token ends {word[:depth]!r}")
                last.append(token)
            found, depth = [last[size]], size - (len(last[size]) - len(END))
            while depth:
                found.append(last[depth])
                depth -= len(last[depth])
            found.reverse()
            before = word[:-1]
            del last[size:]
            self.learnt[plain] = " ".join([id_of[t] for t in found]), " ".join(found)

    def normalised(self, word: str) -> list[str]:
        """The words that the file's normaliser and splitter make of a text without white space."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("\u03a3", "\u03c3")  # lower() would write a final sigma
        return _words_pattern().findall(word.lower())

    def pieces(self, text: str) -> list[str]:
        """White-space separated words of a text, and the special tokens in it."""
        if self.cut and any(t in text for t in self.special):
            return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self.pieces(part))]
        return text.split() if not any(c in text for c in _CONTROLS) else re.split(f"[{_SPACES}]+", text)

    def decoded(self, ids: str) -> str:
        """The text of decimal ids joined by one space: token texts joined likewise, as the file names no decoder. Unknown ids have none."""
        return " ".join([self.tokens[i] for i in map(int, ids.split()) if i in self.tokens])

    def encode_batch(self, texts: list[str]) -> Iterator[list[str]]:
        """The pieces of each text; id_text then holds the encoding of every piece, and token_text what its ids decode to."""
        if len(self.id_text) > KEPT_WORDS:
            self.reset()
        if sum(map(len, self.pairs.values())) > KEPT_PAIRS:
            self.pairs.clear()
        split = [self.pieces(t) for t in texts]
        new = set().union(*split).difference(self.id_text)
        parts = {w: self.normalised(w) for w in new if w not in self.special}
        self.learn([w for w in set().union(*parts.values()) if w not in self.learnt])
        for w in new:
            words = parts.get(w)
            if words is None:
                self.id_text[w] = str(self.special[w])
                self.token_text[w] = self.decoded(self.id_text[w])
            elif len(words) == 1:
                self.id_text[w] = self.learnt[words[0]][0]
                self.token_text[w] = self.decoded(self.id_text[w])
            elif words:
                self.id_text[w] = " ".join([self.learnt[x][0] for x in words])
                self.token_text[w] = self.decoded(self.id_text[w])
            else:
                self.id_text[w] = self.token_text[w] = ""
                self.blank.add(w)
        gc.freeze()  # what was just learnt stays: the collector need not walk it again
        for ws in split:
            yield [w for w in ws if w not in self.blank] if self.blank else ws


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _some(batches, size: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part, [t or "" for t in part.column("text").to_pylist()]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row; a null or empty text has an empty array. Other columns are ignored."""

    def run(batches):
        bpe = load(path)
        for part, texts in _some(batches):
            ids = [[int(i) for w in ws for i in bpe.id_text[w].split(" ")] for ws in bpe.encode_batch(texts)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): token texts joined by one space, as the file names no decoder. A null array decodes to ''."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            text = [bpe.decoded(" ".join(map(str, ids or ()))) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(text, pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, and digest both, without moving the arrays.

    Null and empty texts give 0 tokens and digests of ''. Every input row gives one row.
    """

    def run(batches):
        bpe = load(path)
        for part, texts in _some(batches):
            n, ids_sha, text_sha = [], [], []
            for ws in bpe.encode_batch(texts):
                ids = " ".join(map(bpe.id_text.__getitem__, ws))
                n.append(ids.count(" ") + 1 if ws else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(" ".join(map(bpe.token_text.__getitem__, ws)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col))
