"""Shared text rules: words, hashes, and the document columns of the pipeline."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def word_count(text: Column) -> Column:
    """Words of ``text``; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased.  ``bytes.split()`` and
    ``bytes.lower()`` know ASCII only, which is just the rule wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words per worker."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public 64-bit avalanche finaliser."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(word_hash: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; a shorter text is
    one shingle, a text without words has none."""
    n = len(word_hash)
    if n == 0:
        return word_hash
    width = min(width, n)
    acc = np.full(n - width + 1, np.uint64(width))
    with np.errstate(over="ignore"):
        for j in range(width):
            acc = mix64(acc * _STEP + word_hash[j : n - width + 1 + j])
    return np.unique(acc)
