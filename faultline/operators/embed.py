"""Embedding text columns with a pluggable function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A batch of texts to an array of shape (texts, dims).
Embedder = Callable[[list[str]], np.ndarray]

DIMS = 1536
# What stands between words: anything but letters and digits.
NO_WORD = r"[^\p{L}\p{N}]+"
# Numbers that one counting pass may hold.
COUNTS = 1 << 22


def hashing_embedder(dims: int = DIMS) -> Embedder:
    """Deterministic feature hashing of words: signed counts, not normalised.

    A word adds +1 or -1 to one position. Position and sign come from the first
    33 bits of its MD5. Counts are whole numbers, so any two runs agree exactly.
    Each distinct word of a batch is hashed once; counting runs over all its words at once.
    """

    def embed_texts(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        # Word counts of some rows at a time, so that the counting array stays small.
        step = max(1, COUNTS // dims)
        lists = pc.split_pattern_regex(pc.utf8_lower(pa.array(texts, pa.large_string())), NO_WORD)
        for at in range(0, len(texts), step):
            part = lists.slice(at, step)
            words = part.flatten().dictionary_encode()
            rows = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy())
            digests = [hashlib.md5(w).digest() for w in words.dictionary.cast(pa.large_binary()).to_pylist()]
            heads = np.frombuffer(b"".join(d[:5] for d in digests), np.uint8).reshape(-1, 5).astype(np.int64)
            place = (heads[:, :4] @ (1 << np.array([24, 16, 8, 0]))) % dims
            # Splitting leaves an empty text where no word stands before a mark.
            sign = np.where(heads[:, 4] < 128, 1, -1) * (pc.binary_length(words.dictionary).to_numpy() > 0)
            codes = words.indices.to_numpy()
            counts = np.bincount(rows * dims + place[codes], sign[codes], len(part) * dims)
            out[at:at + len(part)] = counts.reshape(len(part), dims)
        return out

    return embed_texts


def embed(df: DataFrame, fn: Embedder | None = None, dims: int = DIMS, text: str = "content",
          into: str = "embedding") -> DataFrame:
    """Add an embedding of ``text``; NULL text, or no function, gives the zero vector.

    ``fn`` runs on Arrow batches in the tasks. A failing call fails the task and
    is retried by Spark rather than stored as zeros.
    """
    zero = F.array_repeat(F.lit(0.0).cast("float"), dims)
    if fn is None:
        return df.withColumn(into, zero)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.notna()
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            if known.any():
                made = np.asarray(fn(texts[known].tolist()), dtype=np.float32)
                out[known] = pd.Series(list(made), index=texts.index[known])
            yield out

    return df.withColumn(into, F.coalesce(vectors(F.col(text)), zero))
