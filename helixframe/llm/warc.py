"""WARC archives and a Merkle fixity audit of two replicas.

Pages are written as WARC/1.1 response records into gzipped archive files of at
most ``RECORDS`` records, by the tasks that hold them and without a shuffle.
An archive is read back by parsing its bytes: every record gives its byte range
in the archive, its identifier and the SHA-256 of the whole range.

A replica's tree stands on one line of addresses: part, chunk and byte offset.
Leaves are stretches of ``LEAF_BYTES``; a leaf's digest covers the offsets,
lengths and digests of the records that begin there, in the order of offsets,
and ``FAN_OUT`` neighbours are hashed into a parent up to one root.  Addresses
belong to one record each, so no identifier, null or repeated, can make a node
hot, and a node's children are bounded.

The audit compares the roots, ends there if they agree, and else goes down only
below nodes that differ, one join a level over one table of both replicas, so
that joins grow with the height of the tree and nothing else.

Defined results: null html counts as empty, a null url gives no URI header, a
null page_id an empty identifier (null again when read); line breaks in a url
are percent-encoded; repeated rows and identifiers are records of their own; a
range that holds a record in one replica only is missing or surplus; a record
whose length field is damaged ends before the next record; a file is held whole
by the task that parses it; extra columns are not read; equal replicas and empty
tables give no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import read, shared_dir, write_table

RECORDS = 1024
LEAF_BITS = 16
FAN_BITS = 4
LEAF_BYTES, FAN_OUT = 1 << LEAF_BITS, 1 << FAN_BITS
#: The tables carry no crawl time, so records carry this one.
DATE = "1970-01-01T00:00:00Z"

_MAGIC = b"WARC/1."
_SIZE = re.compile(rb"\r\nContent-Length: *(\d+)(?=\r\n)", re.I)
_ID = re.compile(rb"\r\nWARC-Record-ID: *<urn:page:(-?\d+)>", re.I)
_SUM = re.compile(rb"\r\nWARC-Block-Digest: *sha256:([0-9a-f]{64})", re.I)


def records(pages: DataFrame) -> DataFrame:
    """page_id, head, body: the two halves of each page's record."""
    body = F.coalesce(F.col("html"), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"), F.lit("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(body.cast("binary"), 256)), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return pages.select("page_id", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).alias("head"), body.alias("body"))


def write_archives(made: DataFrame, per_file: int = RECORDS) -> str:
    """Write (head, body) as archive files in the shared folder -> their folder.
    The writer ends every row with the record's last line feed."""
    path = f"{shared_dir(made.sparkSession)}/helixframe-warc-{uuid.uuid4().hex}"
    whole = made.select(F.concat("head", "body", F.lit("\r\n\r")).alias("value"))
    whole.write.option("maxRecordsPerFile", per_file).option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


def parse(data: bytes) -> Iterator[tuple[int, int, int | None, str, bool]]:
    """(offset, length, page_id, SHA-256, sound) of every record; ``sound`` tells
    whether the record agrees with the digest in its own header."""
    at = 0 if data.startswith(_MAGIC) else _next(data, 0)
    while at >= 0:
        head = data.find(b"\r\n\r\n", at) + 4
        size = _SIZE.search(data, at, head) if head > 3 else None
        end = head + int(size[1]) + 4 if size else 0
        whole = bool(size) and data[end - 4 : end] == b"\r\n\r\n"
        if not whole:
            after = _next(data, at + 1)
            end = after if after >= 0 else len(data)
        name, said = _ID.search(data, at, max(head, at)), _SUM.search(data, at, max(head, at))
        sound = whole and said is not None and hashlib.sha256(data[head : end - 4]).hexdigest() == said[1].decode()
        yield at, end - at, int(name[1]) if name else None, hashlib.sha256(data[at:end]).hexdigest(), sound
        at = end if data.startswith(_MAGIC, end) else _next(data, end - 4)


def _next(data: bytes, at: int) -> int:
    """Where the next record begins behind the end of another, else -1."""
    found = data.find(b"\r\n\r\n" + _MAGIC, max(at, 0))
    return found + 4 if found >= 0 else -1


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, chunk, content in zip(batch["part"], batch["chunk"], batch["content"]):
            rows = list(parse(gzip.decompress(content))) if content else []
            yield pd.DataFrame([(part, chunk, *r) for r in rows], columns=["part", "chunk", "record_offset", "record_bytes", "page_id", "digest", "sound"]).astype({"page_id": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Written table of the records of all archive files in ``path``: part,
    chunk, record_offset, record_bytes, page_id, digest, sound."""
    name = r"part-(\d+)-.*-c(\d+)\.[^/]*$"
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", name, 1).cast("long").alias("part"), F.regexp_extract("path", name, 2).cast("long").alias("chunk"), "content")
    return write_table(files.mapInPandas(_index, "part long, chunk long, record_offset long, record_bytes long, page_id long, digest string, sound boolean"), "warc-index", 4)


def addressed(one: DataFrame, two: DataFrame) -> tuple[DataFrame, int]:
    """Both replicas' records with ``side`` and ``address``, and the bits of an
    address."""
    both = one.withColumn("side", F.lit(1)).unionByName(two.withColumn("side", F.lit(2)))
    top = both.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("part", "chunk", "record_offset")]).first()
    chunk, offset = top["chunk"].bit_length(), top["record_offset"].bit_length()
    place = F.shiftleft(F.shiftleft(F.col("part"), chunk).bitwiseOR(F.col("chunk")), offset).bitwiseOR(F.col("record_offset"))
    return both.withColumn("address", place), top["part"].bit_length() + chunk + offset


def _digest(*fields: str) -> Column:
    """SHA-256 over a node's children in order: their fields, a line each."""
    line = lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*fields))), line), "\n").cast("binary"), 256)


def levels(rows: DataFrame, bits: int) -> list[DataFrame]:
    """Written tables (side, node, digest) from the leaves up to the roots."""
    level = rows.groupBy("side", F.shiftright("address", LEAF_BITS).alias("node")).agg(_digest("address", "record_bytes", "digest").alias("digest"))
    tree = [write_table(level, "merkle-0")]
    for k in range(1, max(0, -(-(bits - LEAF_BITS) // FAN_BITS)) + 1):
        up = tree[-1].groupBy("side", F.shiftright("node", FAN_BITS).alias("parent")).agg(_digest("node", "digest").alias("digest"))
        tree.append(write_table(up.withColumnRenamed("parent", "node"), f"merkle-{k}"))
    return tree


def differing(level: DataFrame) -> DataFrame:
    """Nodes that one side lacks or whose digests differ."""
    sides = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high"))
    return sides.where("n < 2 or low <> high").select(F.col("node").alias("suspect"))


def suspect_leaves(tree: list[DataFrame]) -> DataFrame:
    """Leaves that differ, found from the roots down, one join a level."""
    suspects = differing(tree[-1])
    for level in reversed(tree[:-1]):
        suspects = differing(level.join(suspects, F.shiftright("node", FAN_BITS) == F.col("suspect"), "left_semi"))
    return suspects


def audit(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row per byte range that differs between two indexes of archives:
    page_id, part, chunk, record_offset, record_bytes (of the first replica where
    it has the record), status, and both sides' digest and soundness."""
    rows, bits = addressed(one, two)
    tree = levels(rows, bits)
    if not differing(tree[-1]).limit(1).count():
        rows = rows.limit(0)
    suspects = write_table(suspect_leaves(tree), "merkle-suspects")
    found = rows.join(suspects, F.shiftright("address", LEAF_BITS) == F.col("suspect"), "left_semi")
    # an address belongs to one record a side, so every group has two rows at most
    side = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    kept = ("page_id", "record_bytes", "digest", "sound")
    met = found.groupBy("part", "chunk", "record_offset").agg(*[side(n, c).alias(f"{c}_{n}") for n in (1, 2) for c in kept])
    status = F.when(F.col("digest_2").isNull(), "missing").when(F.col("digest_1").isNull(), "surplus").when(F.col("digest_1") != F.col("digest_2"), "corrupt")
    first = lambda c: F.when(F.col("digest_1").isNull(), F.col(f"{c}_2")).otherwise(F.col(f"{c}_1")).alias(c)
    return met.withColumn("status", status).where("status is not null").select(first("page_id"), "part", "chunk", "record_offset", first("record_bytes"), "status", "digest_1", "digest_2", "sound_1", "sound_2")


def damaged(made: DataFrame) -> DataFrame:
    """The stated second replica of the query, damaged in place: of pages whose
    crc32(page_id as text) leaves 7 by 151 the record is blank, of those that
    leave 5 by 17 the body's last character is another or, where that is not an
    ASCII letter, digit or mark, the date is."""
    crc = F.crc32(F.col("page_id").cast("string").cast("binary"))
    lost, bad = crc % 151 == 7, crc % 17 == 5
    ends = F.col("body").rlike("[!-~]$")
    flipped = F.concat(F.expr("left(body, length(body) - 1)"), F.when(F.col("body").endswith("?"), "!").otherwise("?"))
    blank = lambda c: F.repeat(F.lit(" "), F.octet_length(c))
    return made.select(
        "page_id",
        F.when(lost, blank("head")).when(bad & ~ends, F.regexp_replace("head", "WARC-Date: 1", "WARC-Date: 2")).otherwise(F.col("head")).alias("head"),
        F.when(lost, blank("body")).when(bad & ends, flipped).otherwise(F.col("body")).alias("body"),
    )


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = records(read(spark, sf_dir, "pages"))
    return audit(*[read_archives(spark, write_archives(x)) for x in (made, damaged(made))])
