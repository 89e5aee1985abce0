"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds the magic bytes of all known formats in one
pass; a validator per format then confirms structure and length at each hit, so
that a declared type can be corrected and media embedded in other bytes carved
out.  Encoders and decoders for four lossless 8-bit containers let text be
stored as media and read back.

Defined results: null bytes and null text count as empty; bytes without a valid
signature have type ``application/octet-stream`` and length of all bytes; equal
bytes give equal rows; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import read

BLOCK = 576
PAD = b"\xff"
UNKNOWN = "application/octet-stream"

#: Magic bytes and their offset in the file.
MAGIC = (
    (b"RIFF", "audio/wav", 0),
    (b"BM", "image/bmp", 0),
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"P5", "image/x-portable-graymap", 0),
    (b"GIF89a", "image/gif", 0),
    (b"GIF87a", "image/gif", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b".snd", "audio/basic", 0),
)


def wav_length(data: bytes, at: int) -> int:
    """Length of the valid WAVE file at ``at``, else 0."""
    if data[at + 8 : at + 12] != b"WAVE" or len(data) < at + 44:
        return 0
    size = struct.unpack_from("<I", data, at + 4)[0] + 8
    if at + size > len(data):
        return 0
    spot, fmt = at + 12, False
    while spot + 8 <= at + size:
        kind, n = data[spot : spot + 4], struct.unpack_from("<I", data, spot + 4)[0]
        if kind == b"fmt ":
            fmt = n >= 16
        if kind == b"data":
            return size if fmt and spot + 8 + n <= at + size else 0
        spot += 8 + n + (n & 1)
    return 0


def bmp_length(data: bytes, at: int) -> int:
    """Uncompressed bitmaps of all header versions and depths."""
    if len(data) < at + 26:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", data, at + 2)
    if header == 12:
        width, height, planes, bits = struct.unpack_from("<HHHH", data, at + 18)
        packing = 0
    elif header in (40, 52, 56, 64, 108, 124) and len(data) >= at + 54:
        width, height, planes, bits, packing = struct.unpack_from("<iiHHI", data, at + 18)
    else:
        return 0
    row = (width * bits + 31) // 32 * 4
    sound = not reserved and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and packing in (0, 3) and width > 0 and start >= 14 + header
    return size if sound and start + row * abs(height) <= size and at + size <= len(data) else 0


def png_length(data: bytes, at: int) -> int:
    spot, first = at + 8, True
    while spot + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, spot)
        if first and kind != b"IHDR" or spot + 12 + n > len(data):
            return 0
        if zlib.crc32(data[spot + 4 : spot + 8 + n]) != struct.unpack_from(">I", data, spot + 8 + n)[0]:
            return 0
        first, spot = False, spot + 12 + n
        if kind == b"IEND":
            return spot - at
    return 0


_GAP = rb"(?:[ \t\r\n\v\f]|#[^\n]*\n)+"
_PGM = re.compile(rb"P5" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,5})[ \t\r\n\v\f]")


def pgm_length(data: bytes, at: int) -> int:
    """Grey maps of one or two bytes a sample, comments in the header allowed."""
    head = _PGM.match(data, at)
    if not head:
        return 0
    width, height, most = (int(x) for x in head.groups())
    n = head.end() - at + width * height * (2 if most > 255 else 1)
    return n if 0 < most < 65536 and width and height and at + n <= len(data) else 0


def gif_length(data: bytes, at: int) -> int:
    if len(data) < at + 14:
        return 0
    flags = data[at + 10]
    spot = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while spot < len(data):
        kind = data[spot]
        if kind == 0x3B:
            return spot + 1 - at
        if kind == 0x21:
            spot += 2
        elif kind == 0x2C and spot + 10 <= len(data):
            flags = data[spot + 9]
            spot += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return 0
        while spot < len(data) and data[spot]:
            spot += 1 + data[spot]
        spot += 1
    return 0


def jpeg_length(data: bytes, at: int) -> int:
    spot = at + 2
    while spot + 4 <= len(data) and data[spot] == 0xFF:
        kind, n = data[spot + 1], struct.unpack_from(">H", data, spot + 2)[0]
        if kind == 0xDA:
            end = data.find(b"\xff\xd9", spot + 2 + n)
            return end + 2 - at if end >= 0 else 0
        if n < 2:
            return 0
        spot += 2 + n
    return 0


def snd_length(data: bytes, at: int) -> int:
    if len(data) < at + 24:
        return 0
    start, n, coding, rate, channels = struct.unpack_from(">5I", data, at + 4)
    return start + n if start >= 24 and 0 < coding < 28 and 0 < channels < 65 and rate and at + start + n <= len(data) else 0


VALIDATORS = {"audio/wav": wav_length, "image/bmp": bmp_length, "image/png": png_length, "image/x-portable-graymap": pgm_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "audio/basic": snd_length}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, kind, before in MAGIC:
            self.automaton.add_word(magic.decode("latin-1"), (len(magic) + before, kind))
        self.automaton.make_automaton()

    def find(self, data: bytes) -> list[tuple[int, int, str]]:
        """(start, length, type) of every valid medium that no earlier one
        contains, in order."""
        found, beyond = [], 0
        for last, (size, kind) in self.automaton.iter(data.decode("latin-1")):
            start = last + 1 - size
            if start >= beyond and (n := VALIDATORS[kind](data, start)):
                found.append((start, n, kind))
                beyond = start + n
        return found


def to_wav(raw: bytes) -> bytes:
    odd = b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(raw) + len(odd)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(raw)) + raw + odd


def to_bmp(raw: bytes) -> bytes:
    height = len(raw) // BLOCK
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
    start = 54 + len(palette)
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", start + len(raw), 0, start, 40, BLOCK, -height, 1, 8, 0, len(raw), 2835, 2835, 256, 0) + palette + raw


def to_png(raw: bytes) -> bytes:
    rows = np.zeros((len(raw) // BLOCK, BLOCK + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, BLOCK)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def to_pgm(raw: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (BLOCK, len(raw) // BLOCK) + raw


def from_wav(data: bytes) -> bytes:
    return data[44 : 44 + struct.unpack_from("<I", data, 40)[0]]


def from_bmp(data: bytes) -> bytes:
    return data[struct.unpack_from("<I", data, 10)[0] :]


def from_png(data: bytes) -> bytes:
    spot, body = 8, []
    while spot < len(data):
        n, kind = struct.unpack_from(">I4s", data, spot)
        if kind == b"IDAT":
            body.append(data[spot + 8 : spot + 8 + n])
        spot += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, BLOCK + 1)[:, 1:].tobytes()


def from_pgm(data: bytes) -> bytes:
    return data[_PGM.match(data).end() :]


#: Container by the number of blocks, so that equal texts are stored alike.
CONTAINERS = (("image/png", to_png, from_png), ("audio/wav", to_wav, from_wav), ("image/bmp", to_bmp, from_bmp), ("image/x-portable-graymap", to_pgm, from_pgm))

DECODERS = {name: decode for name, _, decode in CONTAINERS}


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    total = max(1, -(-len(raw) // BLOCK)) * BLOCK
    return len(raw), raw + PAD * (total - len(raw))


class Sniffed(NamedTuple):
    kind: str  # confirmed type, or unknown
    size: int
    corrected: bool  # the declared type was wrong
    carved: list[tuple[int, int, str]]  # (start, length, type) of all media


def identify(sniffer: Sniffer, data: bytes, declared: str | None) -> Sniffed:
    """What bytes are, whatever they are declared to be."""
    found = sniffer.find(data)
    kind, size = (found[0][2], found[0][1]) if found and found[0][0] == 0 else (UNKNOWN, len(data))
    return Sniffed(kind, size, declared is not None and declared != kind, found)


def sniff(table: DataFrame, key: str, content: str, declared: str | None = None) -> DataFrame:
    """One row per row of ``table``: key, media_type (confirmed, or unknown),
    media_bytes, corrected (the declared type was wrong), and ``carved``, an
    array of (start, length, media_type) of all media found in the bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sniffer = Sniffer()
        for batch in batches:
            out = []
            for k, data, said in zip(batch["key"], batch["content"], batch["declared"]):
                own = identify(sniffer, data or b"", said)
                out.append((k, own.kind, own.size, own.corrected, [{"start": a, "length": n, "media_type": t} for a, n, t in own.carved]))
            yield pd.DataFrame(out, columns=["key", "media_type", "media_bytes", "corrected", "carved"])

    kind = table.schema[key].dataType.simpleString()
    said = F.col(declared) if declared else F.lit(None)
    plain = table.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"), said.cast("string").alias("declared"))
    return plain.mapInPandas(run, f"key {kind}, media_type string, media_bytes long, corrected boolean, carved array<struct<start: long, length: long, media_type: string>>").withColumnRenamed("key", key)


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sniffer = Sniffer()
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            n, raw = payload(text)
            declared, encode, _ = CONTAINERS[len(raw) // BLOCK % len(CONTAINERS)]
            stored = encode(raw)
            own = identify(sniffer, stored, declared)
            back = DECODERS[own.kind](stored[: own.size])
            levels = np.bincount(np.frombuffer(back, np.uint8), minlength=256)
            share = levels[levels > 0] / len(back)
            entropy = -(share * np.log2(share)).sum()
            feature = f"type={own.kind};declared={declared if own.corrected else 'ok'};media={len(own.carved)};rows={len(back) // BLOCK};mean={(levels * np.arange(256)).sum() / len(back):.3f};entropy={entropy:.4f};levels={len(share)}"
            out.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), own.size, hashlib.sha256(stored).hexdigest(), feature))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return docs.mapInPandas(_store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
