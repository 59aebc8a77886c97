"""Text to vectors through a batch function; offline, hashed bags of tokens."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EmbedBatch = Callable[[list[str]], list[list[float]]]
MAX_TOKENS, BATCH, WAIT, BUDGET = 8192, 64, 3.0, 60.0


def hashed(dim: int = 128) -> EmbedBatch:
    """A deterministic embedder: signed token hashes, then unit length. It needs no model and no network."""
    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out[size[:, 0] == 0, 0] = 1
        return (out / np.where(size == 0, 1, size)).tolist()

    return embed


def prepared(text: str | None, max_tokens: int = MAX_TOKENS) -> str:
    """An empty text becomes one space; long texts are cut to what a model of max_tokens takes."""
    return (text or " ")[: max_tokens * 4]


def with_retries(embed: EmbedBatch, texts: list[str], wait: float = WAIT, budget: float = BUDGET) -> list[list[float]]:
    """Only rate limits (an error that mentions 429) are tried again, until the budget is spent."""
    end = time.monotonic() + budget
    while True:
        try:
            return embed(texts)
        except Exception as e:
            if "429" not in str(e) or time.monotonic() + wait > end:
                raise
            time.sleep(wait)


def checked(vectors: list[list[float]], n: int) -> list[list[float]]:
    if len(vectors) != n or len({len(v) for v in vectors}) > 1 or (vectors and not vectors[0]):
        raise ValueError("the embedder must return one non-empty vector of one size for each text")
    return vectors


def embedding_column(embed: EmbedBatch, batch: int = BATCH):
    """A pandas UDF over text columns; batches keep their order."""
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            ready = [prepared(x) for x in texts]
            out = []
            for at in range(0, len(ready), batch):
                some = ready[at : at + batch]
                out += checked(with_retries(embed, some), len(some))
            yield pd.Series(out)

    return run


def one_size(index: DataFrame) -> bool:
    """Do all vectors of an index have the same positive size?"""
    lo, hi = index.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    return lo == hi and (lo is None or lo > 0)
