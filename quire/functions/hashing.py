"""Hashes of texts and books (SC10, AG10, PR19, PR20)."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import vectorised


@lru_cache(200_000)
def _bits(word: str) -> np.ndarray:
    h = hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return np.unpackbits(np.frombuffer(h, dtype=np.uint8), bitorder="little").astype(np.int64) * 2 - 1


def simhash(text: str) -> int:
    """PR19: 64 bits, words weighted by frequency, as a signed long; 0 for a text without words."""
    counts = Counter(text.split())
    if not counts:
        return 0
    total = sum(_bits(w) * c for w, c in counts.items())
    return int.from_bytes(np.packbits(total >= 0, bitorder="little").tobytes(), "little", signed=True)


def simhash64(text: Column) -> Column:
    """PR19 of a column; NULL gives NULL."""
    return vectorised(simhash, "bigint")(text)


def hamming(a: Column, b: Column) -> Column:
    """PR20."""
    return F.bit_count(a.bitwiseXOR(b))


def book_fingerprints(chapters: DataFrame, key: str, text: str) -> DataFrame:
    """AG10: MD5 over a book's sorted chapter MD5s, whatever their order. Only hashes are shuffled; no chapter, no row."""
    h = chapters.where(F.col(text).isNotNull()).select(key, F.md5(text).alias("h"))
    return h.groupBy(key).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "|")).alias("fingerprint"))
