"""Packing by concatenating and cutting.

Pass one tokenises the documents where they lie: every task writes its
documents' ids together with the stretch they belong to (a file and the first
row read from it, so that a stretch lies in one task) and the running token
total inside the stretch.  The totals of the stretches, summed in the order of
files and rows, give each its global offset; the stream therefore has the order
in which the documents were written, such as a mix, however the files are dealt
to tasks.  Pass two adds the offset and cuts the stream at multiples of
``length``; a document that crosses a boundary leaves one boundary record per
window.  Only the last sequence can be short, so padding is below one sequence
for the whole corpus.  No text is shuffled and no global sort is made; written
tables make the order stable when an executor is lost.

The cutting, the digests and the prefix sums are DataFrame expressions; only
the tokenizer runs in Python, with a word cache in front of it.

Defined results: null and empty texts are their end id alone; rows that repeat
a doc_id are packed each; documents that were not read from Parquet files have
the order of their partitions; an empty table gives no sequence; extra columns
are not read.  A last sequence whose token count is a power of two is not padded.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.store import read, write_table

LENGTH = 4096
#: The offsets of so many stretches, about 100 bytes each, are sent to all
#: executors; those of more are joined by shuffle.
MOST_BROADCAST = 100_000
END_ID = 2
VOCABULARY = "word_bpe_49k.json"

#: Fixed values of this vocabulary: its splitting pattern, here for lower-case
#: text of the characters in ``LATIN`` only.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^ \t\n\x0b\x0c\ra-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
#: ASCII and composed Latin letters: in normal form, one to one in lower case.
LATIN = re.compile(r"[\x00-\x7F¡-¬®-ÿ–-„…€]*").fullmatch
WORD_END = "</w>"


class CachedTokenizer:
    """Ids of the word vocabulary.  Its pre-tokeniser splits into pieces that
    are encoded one by one, so a piece's ids are kept and looked up; unknown
    pieces of a text are encoded together, parted by spaces.  Texts with a
    special token's string or with characters beyond ``LATIN`` go to the
    tokenizer whole."""

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.find = re.compile(PIECES).findall
        self.last = np.zeros(self.plain.get_vocab_size(), bool)
        self.last[[i for token, i in self.plain.get_vocab().items() if token.endswith(WORD_END)]] = True
        self.cache: dict[str, bytes] = {}
        self.limit = limit

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, pieces: list[str]) -> None:
        if len(self.cache) > self.limit:
            self.cache.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.cache]
        ids = self.whole(" ".join(new))
        ends = np.flatnonzero(self.last[ids]) + 1
        data = ids.tobytes()
        if len(ends) == len(new):
            begin = 0
            for piece, end in zip(new, (4 * ends).tolist()):
                self.cache[piece] = data[begin:end]
                begin = end
        else:
            for piece in new:
                self.cache[piece] = self.whole(piece).tobytes()

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or not (text.isascii() or LATIN(text)):
            return self.whole(text)
        pieces = self.find(text.lower())
        try:
            parts = list(map(self.cache.__getitem__, pieces))
        except KeyError:
            self.learn(pieces)
            parts = list(map(self.cache.__getitem__, pieces))
        return np.frombuffer(b"".join(parts), dtype="<u4")


_loaded: dict[str, CachedTokenizer] = {}


def tokenizer_of(path: str) -> CachedTokenizer:
    """One tokenizer and cache per worker process."""
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]


def vocabulary_path(package: str = "public_tokenizers", name: str = VOCABULARY) -> str:
    return importlib.import_module(package).path(name)


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = tokenizer_of(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        file, stretch, start, read = None, 0, 0, 0
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.iloc[k : k + 500]
                ids = [tokenizer.ids(t).tobytes() + end if t else end for t in part["text"]]
                n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                rows = np.arange(read, read + len(part)) if part["row"].iloc[0] < 0 else part["row"].to_numpy()
                # a stretch ends where the file changes or rows do not follow on
                names = part["file"].to_numpy()
                fresh = np.r_[file is None or names[0] != file or rows[0] != read, (names[1:] != names[:-1]) | (np.diff(rows) != 1)]
                for at in np.split(np.arange(len(part)), np.flatnonzero(fresh)):
                    if not len(at):
                        continue
                    if fresh[at[0]]:
                        stretch, start = int(rows[at[0]]), 0
                    own = n[at]
                    yield pd.DataFrame({"doc_id": part["doc_id"].iloc[at], "file": names[at], "stretch": stretch, "begin": start + np.cumsum(own) - own, "n": own, "ids": [ids[i] for i in at]})
                    start += int(own.sum())
                file, read = names[-1], int(rows[-1]) + 1

    return run


def in_order(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and row each was read from, or else the partition
    and row -1."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.withColumn("file", F.format_string("%010d", F.spark_partition_id())).withColumn("row", F.lit(-1).cast("long"))


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Written table doc_id, file, stretch, begin, n, ids (little-endian 32-bit)."""
    plain = in_order(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return write_table(plain.mapInPandas(_tokenise(path or vocabulary_path(), end_id), "doc_id long, file string, stretch long, begin long, n long, ids binary"), "tokens", 1000)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary), doc_tokens,
    sequence_id, offset, padded_length (of its sequence)."""
    rows = tokenised(docs, path, end_id)
    place = ["file", "stretch"]
    totals = write_table(rows.groupBy(*place).agg(F.sum("n").alias("total")), "stretches")  # one row per file and task
    bases = totals.select(*place, (F.sum("total").over(W.orderBy(*place)) - F.col("total")).alias("base"), F.sum("total").over(W.partitionBy()).alias("all_tokens"))
    if totals.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    placed = rows.join(bases, place).withColumn("first", F.col("base") + F.col("begin"))
    windows = F.sequence(F.floor(F.col("first") / length), F.floor((F.col("first") + F.col("n") - 1) / length))
    cut = placed.withColumn("sequence_id", F.explode(windows))
    left = F.greatest(F.col("first"), F.col("sequence_id") * length)
    right = F.least(F.col("first") + F.col("n"), (F.col("sequence_id") + 1) * length)
    fill = F.least(F.lit(length).cast("long"), F.col("all_tokens") - F.col("sequence_id") * length)
    power = F.bit_count(fill) == 1
    return cut.select(
        "doc_id",
        (left - F.col("first")).alias("start"),
        (right - left).alias("length"),
        F.substring("ids", ((left - F.col("first")) * 4 + 1).cast("int"), ((right - left) * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"),
        "sequence_id",
        (left - F.col("sequence_id") * length).alias("offset"),
        F.when(power, fill).otherwise(F.lit(length)).cast("long").alias("padded_length"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(read(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of the packed sequences."""
    return pack(docs)
