"""Exact dedup by a tree merge of sorted digest runs.

Every task sorts its rows by digest into runs and cuts them into digest ranges;
an entry of a run is a digest with its best row and the number of its rows.
Runs are dealt to ``LANES`` lanes, which merge theirs; then in every round
``FAN_IN`` neighbouring lanes exchange their runs of a range and one of them
merges them, until a range has one run.  A digest that a third of all rows
share is one entry a run, so it never meets as raw rows in one task, and a
range holds about ``PER_RANGE`` entries.

Two entries are one only if all 256 bits of SHA-256 and the lengths of the
normalised texts agree, which is checked at every level; the best row has the
most code points in its original text, then the smallest doc_id, then the
smallest row key.

Rows meet their group by digest; hot groups are broadcast behind a proven bound
(``store.join_groups``).

Defined results: null text counts as empty, all such rows form one group;
repeated rows count as rows of their own, of which one stays; null doc_id sorts
last; columns other than doc_id and text are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import join_groups, join_ids, numbered, read, write_table
from helixframe.llm.text import DOCUMENT_COLUMNS, SPACE

LANES, FAN_IN = 64, 8
#: Rows that a task sorts into one run; entries of a digest range at the end.
PER_RUN, PER_RANGE = 200_000, 200_000

#: Columns of an entry beside its digest, all 64-bit.
ENTRY = ("plain_len", "less", "void", "doc_id", "row_key", "n")
_KEY = ["digest", "plain_len"]
_RUN = "lane long, part long, digests binary, entries binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, chars, digest, plain_len: one narrow row per document of
    ``docs(row_key, doc_id, text)``."""
    text = normalised(F.col("text"))
    plain = docs.select("row_key", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), text.alias("plain"))
    return plain.select("row_key", "doc_id", "chars", F.unhex(F.sha2(F.col("plain").cast("binary"), 256)).alias("digest"), F.length("plain").alias("plain_len"))


def merged(digest: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of entries whose digests are distinct, from runs that lie
    end to end: ``digest`` (n, 4) unsigned, ``entry`` (n, 6).  The stable sort
    finds the sorted runs as they lie and merges them."""
    order = np.argsort(digest[:, 0], kind="stable")
    same = _same(digest[order], entry[order])
    if ((np.diff(digest[order, 0]) == 0) & ~same).any():
        order = np.lexsort((entry[:, 0], *digest.T[::-1]))
        same = _same(digest[order], entry[order])
    digest, entry = digest[order], entry[order]
    start = np.flatnonzero(np.r_[True, ~same])
    if len(start) == len(entry):
        return digest, entry
    group = np.cumsum(np.r_[True, ~same])
    best = np.lexsort((entry[:, 4], entry[:, 3], entry[:, 2], entry[:, 1], group))[start]
    kept = entry[best]
    kept[:, 5] = np.add.reduceat(entry[:, 5], start)
    return digest[start], kept


def _same(digest: np.ndarray, entry: np.ndarray) -> np.ndarray:
    return (digest[1:] == digest[:-1]).all(axis=1) & (entry[1:, 0] == entry[:-1, 0])


def packed(digest: np.ndarray, entry: np.ndarray) -> tuple[bytes, bytes]:
    return digest.astype(">u8").tobytes(), entry.astype("<i8").tobytes()


def unpacked(digests: list[bytes], entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 4), np.frombuffer(b"".join(entries), "<i8").reshape(-1, len(ENTRY))


def _runs(ranges: int):
    """Sorted runs of a task's rows, cut into digest ranges."""
    edges = (np.arange(1, ranges, dtype=np.float64) / ranges * 2.0**64).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, held, rows = TaskContext.get().partitionId(), [], 0

        def flush() -> pd.DataFrame:
            nonlocal lane, rows
            digest, entry = merged(*(np.concatenate(x) for x in zip(*held)))
            cuts = np.r_[0, np.searchsorted(digest[:, 0], edges), len(digest)]
            used = np.flatnonzero(np.diff(cuts))
            cut = [packed(digest[cuts[r] : cuts[r + 1]], entry[cuts[r] : cuts[r + 1]]) for r in used]
            out = pd.DataFrame({"lane": lane, "part": used, "digests": [d for d, _ in cut], "entries": [e for _, e in cut]})
            lane, rows = lane + 1, 0
            held.clear()
            return out

        for batch in batches:
            digest, _ = unpacked(list(batch["digest"]), [])
            held.append((digest, batch[list(ENTRY)].to_numpy(np.int64)))
            rows += len(batch)
            if rows >= PER_RUN:
                yield flush()
        if rows:
            yield flush()

    return run


def _merge(key: tuple[Any, ...], group: pd.DataFrame) -> pd.DataFrame:
    digest, entry = packed(*merged(*unpacked(list(group["digests"]), list(group["entries"]))))
    return pd.DataFrame({"lane": [key[1]], "part": [key[0]], "digests": [digest], "entries": [entry]})


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for digests_, entries in zip(batch["digests"], batch["entries"]):
            _, entry = unpacked([], [entries])
            out = pd.DataFrame(entry, columns=list(ENTRY))
            yield out.assign(digest=[digests_[k : k + 32] for k in range(0, len(digests_), 32)])


def merge_tree(rows: DataFrame, total: int, lanes: int = LANES, fan_in: int = FAN_IN, per_range: int = PER_RANGE) -> DataFrame:
    """``rows`` as of ``digests`` -> one row per group: digest, plain_len,
    keep_id, keep_row, group_size."""
    void = F.col("doc_id").isNull()
    entry = (F.col("plain_len").cast("long"), -F.col("chars").cast("long"), void.cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("row_key"), F.lit(1).cast("long"))
    runs = rows.select("digest", *[c.alias(name) for c, name in zip(entry, ENTRY)]).mapInPandas(_runs(max(1, -(-total // per_range))), _RUN)
    runs = write_table(runs, "digest-runs").withColumn("lane", F.col("lane") % lanes)
    while True:
        runs = runs.groupBy("part", "lane").applyInPandas(_merge, _RUN)
        if lanes == 1:
            break
        lanes = -(-lanes // fan_in)
        runs = runs.withColumn("lane", F.floor(F.col("lane") / fan_in))
    best = runs.mapInPandas(_rows, "digest binary, " + ", ".join(f"{name} long" for name in ENTRY))
    return best.select("digest", F.col("plain_len").cast("int").alias("plain_len"), F.when(F.col("void") == 0, F.col("doc_id")).alias("keep_id"), F.col("row_key").alias("keep_row"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(row_key, doc_id, text)`` with its group's
    survivor: row_key, doc_id, keep_id, group_size, kept, text_sha256."""
    rows = write_table(digests(docs), "digests")
    total = rows.count()
    groups = write_table(merge_tree(rows, total), "digest-groups", 4)
    met = join_groups(rows, groups, _KEY, "group_size", total)
    return met.select("row_key", "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(numbered(read(spark, sf_dir, "documents"))).drop("row_key")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays."""
    rows = numbered(docs.select(*DOCUMENT_COLUMNS))
    gone = exact_groups(rows).where("not kept").select("row_key")
    return join_ids(rows, gone, "row_key", "left_anti").select(*DOCUMENT_COLUMNS)


OP7_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept, text_sha256
FROM n
"""
