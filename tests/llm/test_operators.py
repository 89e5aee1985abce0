"""The ten operators against brute force, round trips, and odd inputs."""

import collections
import hashlib
import io
import math
import re
import struct
import time
import wave
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from helixframe.llm import exact_dedup, html_text, language, lm_scoring, media, mixing, near_dedup, packing, quality, registry, store, warc
from helixframe.llm.text import shingle_hashes

DATA = Path("/root/testdata/sf0.001")
#: Accuracy on held-out rows needs some dozens of them.
LABELLED = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, key long, label string, taken long, kept boolean"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, ties, repeated rows, a very long text, clashing names."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    texts = [base, base, base + " more", " ".join(base.split()), "", None, "word", "The Cat", "the cat", "\t \n", base.upper(), "x " * 30_000, "été naïve", base.replace("three", "3"), "a b c d e f", "a b c d e g"]
    rows = [(k, t, "en" if k % 3 else None, [None, "s0", "s1", "s2"][k % 4], None, 7, "d", 1, "l", 2, False) for k, t in enumerate(texts)]
    rows += [rows[0], (None, base, "en", "s1", 1, 7, None, None, None, None, None), (40, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) > width else ({tuple(w)} if w else set())


def brute_components(pairs, width):
    sets = {i: shingles(t, width) for i, t in pairs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_components_odd_rows(docs):
    rows = near_dedup.near_components(docs, 2, 80).collect()
    assert len(rows) == docs.count()
    want, sizes = brute_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None], 2)
    for r in rows:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["n_shingles"]) == (want[r["doc_id"]], sizes[r["doc_id"]]) and (not r["stays"] or r["doc_id"] == r["component_id"])
        else:
            assert r["component_id"] is None and r["stays"]
    stay = collections.Counter(r["component_id"] for r in rows if r["stays"] and r["n_shingles"])
    assert max(stay.values()) == 1 and set(stay) == {c for i, c in want.items() if sizes[i]} | {None}


def test_near_repeated_ids_are_one_document(spark):
    """Rows of one doc_id with different texts have the union of their links."""
    base, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, base), (5, other), (2, base + " x"), (3, other + " y"), (9, "alone in this"), (9, "alone in this"), (4, "of its own")]
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 2).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(5, 2), (2, 2), (3, 2), (9, 9), (4, 4)} and sum(r["stays"] for r in got) == 3
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in near_dedup.near_dedup_stage(spark, table, "").collect()) == [2, 4, 9]


def varied(rng, base, most, mark):
    own = list(base)
    for at in rng.choice(len(base), rng.integers(0, most), replace=False):
        own[at] = f"{mark}{rng.integers(1e6)}"
    return own


@pytest.mark.parametrize("tile, wide", [(256, 8), (3, 2), (2, 0)])
def test_near_components_groups(spark, monkeypatch, tile, wide):
    """Chains and a dense group whose members are not all linked directly, and
    boilerplate with pairs that share its buckets: compared tile against tile,
    and by prefixes."""
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    rows = [(1000 + k, " ".join(rng.choice(words, 60))) for k in range(60)]
    rows += [(k, " ".join(varied(rng, [f"b{k}" for k in range(80)], 9, "z"))) for k in range(120)]
    common = [f"c{k}" for k in range(100)]
    for k in range(40):
        own = [f"o{k}_{j}" for j in range(30)]
        rows += [(2000 + 2 * k, " ".join(common + own)), (2001 + 2 * k, " ".join(common + varied(rng, own, 6, "y")))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for width in (2, 5) if tile > 9 else (2,):
        want, _ = brute_components(rows, width)
        assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(table, width, wide=wide).collect()} == want


def test_near_recall_at_the_threshold(spark):
    """Of planted pairs whose similarity is just 0.8 or more, all are linked; of
    those just below, none."""
    rng = np.random.default_rng(11)
    rows, linked = [], set()
    for k in range(400):
        size = int(rng.integers(20, 200))
        shared, n = [f"s{k}_{j}" for j in range(size)], int(rng.integers(0, size // 4 + 2))
        rows += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join(shared[: size - n] + [f"t{k}_{j}" for j in range(n)]))]
        a, b = (shingles(t, 2) for _, t in rows[-2:])
        if 100 * len(a & b) >= 80 * len(a | b):
            linked.add(2 * k + 1)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"] for r in got if r["component_id"] != r["doc_id"]} == linked and 100 < len(linked) < 350


def test_prefixes_meet():
    """Sets that reach the threshold share a shingle of their prefixes, whatever
    the order."""
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 9, near_dedup.SLOTS)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        x = rng.integers(0, 2**62, n).astype(np.uint64)
        gone = int(rng.integers(0, n // 4 + 1))
        y = np.r_[x[gone:], rng.integers(0, 2**62, int(rng.integers(0, 4))).astype(np.uint64)]
        if len(y) and 100 * (n - gone) >= 80 * len(np.union1d(x, y)):
            assert set(near_dedup.prefix(x, counts, 80)) & set(near_dedup.prefix(y, counts, 80))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for n in (1, 7, 90, 3000):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            both = np.r_[x[: int(0.8 * len(x))], np.unique(rng.integers(0, 2**63, len(x) - int(0.8 * len(x))).astype(np.uint64))]
            a, b = near_dedup.sketch(x), near_dedup.sketch(np.unique(both))
            true = len(np.intersect1d(x, both)) / len(np.union1d(x, both))
            assert (a != near_dedup._EMPTY).all() and abs((a == b).mean() - true) < 0.15


def test_shared_counts():
    a = [np.array([1, 2, 3], np.uint64), np.array([9], np.uint64)]
    assert near_dedup.shared_counts(a, a).tolist() == [[3, 0], [0, 1]]


def test_shingles_short():
    h = np.array([5], np.uint64)
    assert len(shingle_hashes(h, 2)) == 1 and len(shingle_hashes(h[:0], 2)) == 0


def test_exact(docs):
    rows = exact_dedup.exact_groups(store.numbered(docs)).collect()
    assert len(rows) == docs.count()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        plain = (r["text"] or "").translate({c: None for c in (32, *range(9, 14))})
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"]))
    for r in rows:
        own = groups[r["text_sha256"]]
        keep = min(own, key=lambda x: (x[0], x[1], x[2] or 0))[2]
        assert (r["keep_id"], r["group_size"]) == (keep, len(own)) and (not r["kept"] or r["doc_id"] == keep)
    assert collections.Counter(r["text_sha256"] for r in rows if r["kept"]) == collections.Counter(groups.keys())


def test_exact_stage_keeps_one_row_a_group(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(2, "ab", "en", "s", 2), (2, "other", "en", "s", 5), (None, None, None, None, None), (None, "", None, None, None)]
    out = exact_dedup.exact_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2), "")
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, ""), (1, "a b"), (2, "other")]


def test_merged_runs():
    """Runs end to end become one; equal first words of different digests and
    equal digests of different lengths stay apart."""
    rng = np.random.default_rng(4)
    digest = rng.integers(0, 3, (400, 4)).astype(np.uint64)
    entry = np.column_stack([rng.integers(5, 7, 400), -rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.integers(0, 4, 400), np.arange(400), np.ones(400, int)])
    parts = [exact_dedup.merged(digest[k : k + 50], entry[k : k + 50]) for k in range(0, 400, 50)]
    d, e = exact_dedup.merged(*(np.concatenate(x) for x in zip(*parts)))
    want = {}
    for key, row in zip(map(tuple, digest), entry.tolist()):
        want.setdefault((key, row[0]), []).append(row)
    assert len(d) == len(want) and (np.diff(d[:, 0].astype(np.int64)) >= 0).all()
    for key, row in zip(map(tuple, d), e.tolist()):
        own = want[key, row[0]]
        assert row[:5] == min(own, key=lambda x: x[1:5])[:5] and row[5] == len(own)


def test_merge_tree_over_ranges_and_lanes(spark):
    rows = [(k, f"text {k % 37}") for k in range(500)]
    docs = store.numbered(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    made = exact_dedup.digests(docs).cache()
    for lanes, fan_in, per_range in ((64, 8, 10), (5, 2, 1000), (1, 2, 3)):
        got = exact_dedup.merge_tree(made, 500, lanes, fan_in, per_range).collect()
        assert {(r["keep_id"], r["group_size"]) for r in got} == {(k, len(range(k, 500, 37))) for k in range(37)} and len(got) == 37


def test_targets_hit_the_cap(spark):
    totals = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 500, 1), (None, 0, 1)], "source string, source_size long, n_rows long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals, (5, 2, 1), 3).collect()}
    left = 1510 - 30
    assert got["a"] == 30 and got[None] == 0 and abs(got["b"] - left * 2 / 3) < 1e-6 and abs(got["c"] - left / 3) < 1e-6


def test_mix(docs):
    rows = mixing.schedule(docs).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in rows:
        taken = sum(p["taken"] for p in r["passes"])
        assert 0 <= taken <= 3 * r["size"]
        by[r["source"]][0] += taken
        by[r["source"]][1] = r["target"]
    assert sum(t for t, _ in by.values()) == sum(r["size"] for r in rows)
    mixed = mixing.mix(docs)
    assert {"mix_pass", "mix_finish", "mix_taken", "taken"} <= set(mixed.columns)
    out = mixed.collect()
    assert sum(len(r["text"].split()) for r in out) == sum(t for t, _ in by.values())


def brute_mix(rows, weights=(5, 2, 1)):
    """(doc_id, pass) -> words taken, by sorting every offer by finish time."""
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    supply = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), float(sum(supply.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * supply[s] < share * weight[s]}
        if not full:
            target.update({s: share * weight[s] for s in open_})
            break
        for s in full:
            target[s] = 3.0 * supply[s]
            left -= target[s]
        open_ -= full
    offers, left = [], sum(supply.values())
    for k, s in enumerate(sources):
        own = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i, _, x in rows if x == s)
        served = 0
        for number in range(3):
            for _, i in own:
                served += size[i]
                if size[i]:
                    offers.append((served / target[s], k, i, number))
    taken = {}
    for end, _, i, number in sorted(offers):
        taken[i, number] = min(size[i], left)
        left -= taken[i, number]
    return taken, {s: (target[s], supply[s]) for s in sources}, [(i, n) for _, _, i, n in sorted(offers) if taken[i, n]]


@pytest.mark.parametrize("few, buckets", [(100_000, 1024), (2, 3)])
def test_mix_against_global_order(spark, monkeypatch, few, buckets):
    """The truncation of the global order of finish times, searched by stretches
    of virtual time, is that of sorting every offer."""
    monkeypatch.setattr(mixing, "FEW", few)
    monkeypatch.setattr(mixing, "BUCKETS", buckets)
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(rng.integers(0, 30)) if k % 7 else None, [None, "a", "b", "c", "a", "a"][int(rng.integers(6))]) for k in range(120)] + [(200, "long " * 4000, "b"), (201, "x", "tiny")]
    want, targets, _ = brute_mix(rows)
    got = mixing.schedule(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    for r in got:
        assert [p["taken"] for p in r["passes"]] == [want.get((r["doc_id"], k), 0) for k in range(3)]
        assert abs(r["target"] - targets[r["source"]][0]) < 1e-6
    assert len(got) == len(rows)


def test_mix_meets_targets_on_the_driver_tables(spark):
    """Sources miss their targets by less than their longest document."""
    if not DATA.exists():
        pytest.skip("no driver tables")
    rows = mixing.schedule(spark.read.parquet(f"{LABELLED}/documents.parquet")).collect()
    by, longest = collections.Counter(), max(r["size"] for r in rows)
    for r in rows:
        by[r["source"]] += sum(p["taken"] for p in r["passes"])
    assert all(abs(by[r["source"]] - r["target"]) <= longest for r in rows)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack(docs, length=64).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= 64
        pieces[r["doc_id"]].append(r)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        want = (own.encode(r["text"], add_special_tokens=False).ids if r["text"] else []) + [2]
        mine = sorted(pieces[r["doc_id"]], key=lambda x: x["start"])
        if r["doc_id"] not in (0, None):
            assert np.frombuffer(b"".join(bytes(x["ids"]) for x in mine), "<u4").tolist() == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for n, parts in by.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == 64 or n == max(by)


@pytest.mark.parametrize("text", ["It's 12 o'clock!!", "<|endoftext|> x", "İstanbul ẞ ﬁ é", "a\x1cb\x85c\xa0d", "日本語 ÀÉ ² ½ x_y", "''s 's"])
def test_tokenizer_cache_is_exact(text):
    own = packing.CachedTokenizer(packing.vocabulary_path())
    for _ in range(2):
        assert own.ids(text).tolist() == own.plain.encode(text, add_special_tokens=False).ids


def test_media_round_trip():
    sniffer = media.Sniffer()
    for text in ("", "héllo", "x" * 576, "BM RIFF\n" * 500):
        n, raw = media.payload(text)
        assert len(raw) % 576 == 0 and raw[:n] == text.encode() and set(raw[n:]) <= {255}
        for kind, encode, decode in media.CONTAINERS:
            stored = encode(raw)
            found = sniffer.find(b"junk" + stored + b"tail")
            assert (4, len(stored), kind) in found and decode(stored) == raw
            assert not [f for f in sniffer.find(stored[:-1]) if f[2] == kind and f[0] == 0 and f[1] > len(stored) - 1]


def read_by_hand(kind, data):
    """The samples of a container, by readers that share nothing with the module."""
    if kind == "audio/wav":
        with wave.open(io.BytesIO(data)) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1)
            return w.readframes(w.getnframes())
    if kind == "image/x-portable-graymap":
        head = re.match(rb"P5\n(\d+) (\d+)\n255\n", data)
        assert len(data) - head.end() == int(head[1]) * int(head[2])
        return data[head.end() :]
    if kind == "image/bmp":
        width, height = struct.unpack("<ii", data[18:26])
        assert height < 0 and struct.unpack("<I", data[2:6])[0] == len(data)
        return data[-width * -height :]
    body = zlib.decompress(b"".join(re.findall(rb"IDAT(.*?)....(?=....IEND)", data, re.S)))
    assert set(body[::577]) == {0}
    return b"".join(body[k + 1 : k + 577] for k in range(0, len(body), 577))


def test_media_query_against_brute_force(spark, docs):
    """Every row of the query, on odd rows and on texts that hold magic bytes."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + k, t) for k, t in enumerate(["BM" * 900, "P5\n2 2\n255\nabcdRIFF", "x" * 575, "x" * 576, "x" * 577, "é" * 2000, "GIF89a" * 300, "IEND IDAT"])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = table.mapInPandas(media._store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()
    want = collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        kind, encode, _ = media.CONTAINERS[len(padded) // 576 % 4]
        stored = encode(padded)
        assert read_by_hand(kind, stored) == padded
        want[i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"type={kind};declared=ok"] += 1
    assert collections.Counter((*tuple(r)[:7], ";".join(r["feature"].split(";")[:2])) for r in got) == want
    assert len({tuple(r)[1:] for r in got if r["n_bytes"] == 0}) == 1
    assert spark.createDataFrame([], table.schema).mapInPandas(media._store, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").count() == 0


def test_media_validators_take_other_legal_headers():
    bmp = b"BM" + struct.pack("<IIII", 54 + 8, 0, 54, 40) + struct.pack("<iiHHIIiiII", 1, 2, 1, 24, 0, 8, 0, 0, 0, 0) + b"abc\0def\0"
    core = b"BM" + struct.pack("<IIII", 26 + 4, 0, 26, 12) + struct.pack("<HHHH", 1, 1, 1, 24) + b"abc\0"
    pgm = b"P5 # made by hand\n2\t1\n65535\nabcd"
    sniffer = media.Sniffer()
    for data, kind in ((bmp, "image/bmp"), (core, "image/bmp"), (pgm, "image/x-portable-graymap")):
        assert media.identify(sniffer, data, "audio/wav") == (kind, len(data), True, [(0, len(data), kind)])
        assert media.identify(sniffer, data[:-1], kind).kind == media.UNKNOWN


def test_sniff_corrects_types(spark):
    wav = media.to_wav(media.payload("abc")[1])
    table = spark.createDataFrame([(1, wav, "image/png"), (2, b"nothing", "audio/wav"), (3, None, None), (4, b"zz" + wav, "audio/wav")], "k long, body binary, said string")
    got = {r["k"]: r for r in media.sniff(table, "k", "body", "said").collect()}
    assert got[1]["media_type"] == "audio/wav" and got[1]["corrected"] and got[1]["media_bytes"] == len(wav)
    assert got[2]["media_type"] == media.UNKNOWN and not got[3]["corrected"] and got[4]["carved"][0]["start"] == 2


PAGE_SCHEMA = "page_id long, url string, html string, digest string, side int, part long"


@pytest.fixture(scope="module")
def pages(spark):
    """Nulls, empties, repeated rows and identifiers, a long page, clashing names."""
    rows = [(k, f"u{k}", f"<p>page {k}</p>", "d", 3, 9) for k in range(2000)] + [(None, None, None, None, None, None)] * 30
    rows += [(7, "u7", "<p>page 7</p>", "d", 3, 9)] * 3 + [(7, "other", "<p>another 7</p>", "d", 3, 9), (-5, "a\r\nb", "", "", 1, 1), (2001, "é", "日本語", "", 1, 1)]
    rows += [(2002, "long", "word " * 200_000, "", 1, 1), (2003, "trap", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "", 1, 1)]
    return spark.createDataFrame(rows, PAGE_SCHEMA).repartition(3).cache()


def test_warc_round_trip(spark, pages):
    """Every record is found again, with the digest of its own bytes."""
    index = warc.read_archives(spark, warc.write_archives(warc.records(pages), 100)).collect()
    assert len(index) == pages.count() and all(r["sound"] for r in index)
    key = lambda x: (x is None, x or 0)
    assert sorted((r["page_id"] for r in index), key=key) == sorted((r["page_id"] for r in pages.collect()), key=key)
    by = collections.defaultdict(list)
    for r in index:
        by[r["part"], r["chunk"]].append((r["record_offset"], r["record_bytes"]))
    for ranges in by.values():
        assert len(ranges) <= 100
        end = 0
        for offset, size in sorted(ranges):
            assert offset == end
            end += size


def test_warc_parse_resumes():
    record = lambda body: b"WARC/1.1\r\nWARC-Record-ID: <urn:page:4>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    one, two = record(b"first"), record(b"second")
    assert [r[:3] for r in warc.parse(one + two)] == [(0, len(one), 4), (len(one), len(two), 4)]
    assert [r[:2] for r in warc.parse(one.replace(b": 5", b": 99") + two)] == [(0, len(one) + 1), (len(one) + 1, len(two))]
    assert [r[:2] for r in warc.parse(b" " * 40 + b"\r\n\r\n" + two)] == [(44, len(two))]
    assert [r[:2] for r in warc.parse(b" " * 40 + b"\r\n\r\n" + two)] == [(44, len(two))] and list(warc.parse(b"")) == list(warc.parse(b"junk")) == []


def test_warc_audit_finds_the_damage(spark, pages):
    made = warc.records(pages)
    one, two = (warc.read_archives(spark, warc.write_archives(x, 64)) for x in (made, warc.damaged(made)))
    want = collections.Counter()
    for r in pages.collect():
        crc = zlib.crc32(str(r["page_id"]).encode()) if r["page_id"] is not None else 0
        if crc % 151 == 7:
            want[r["page_id"], "missing"] += 1
        elif crc % 17 == 5:
            want[r["page_id"], "corrupt"] += 1
    got = warc.audit(one, two).collect()
    assert collections.Counter((r["page_id"], r["status"]) for r in got) == want and len(want) > 100
    assert all(r["sound_1"] for r in got) and collections.Counter((r["page_id"], "surplus") for r in warc.audit(two, one).collect() if r["status"] == "surplus") == {(k, "surplus"): n for (k, s), n in want.items() if s == "missing"}
    assert warc.audit(one, one).count() == 0


def test_warc_joins_grow_with_the_height(spark, pages):
    made = warc.records(pages)
    one, two = (warc.read_archives(spark, warc.write_archives(x, 64)) for x in (made, warc.damaged(made)))
    rows, bits = warc.addressed(one, two)
    tree = warc.levels(rows, bits)
    plan = warc.suspect_leaves(tree)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == len(tree) - 1 > 1


def test_warc_query(spark):
    if not DATA.exists():
        pytest.skip("no driver tables")
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id").collect()]
    crc = {i: zlib.crc32(str(i).encode()) for i in ids}
    want = {(i, "missing" if c % 151 == 7 else "corrupt") for i, c in crc.items() if c % 151 == 7 or c % 17 == 5}
    assert {(r["page_id"], r["status"]) for r in warc.op6_warc_fixity(spark, str(DATA)).collect()} == want


PAGE = """<html><head><title>t</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div id="cookie-banner">We use cookies, many of them, to do things. Agree?</div>
<article><h1>Head &amp; tail</h1><p>First   paragraph of the page,
with words enough to be one.<p>Second &lt;b&gt; one. It is short.<div class="ad">Buy now, it is very good and cheap, really.</div><form>Mail <input></form></article>
<section class="comments"><p>Nice article, thanks for writing all of it. I read it twice.</p></section><footer>&copy; us</footer><script>var x = "<p>no</p>";</script></body></html>"""


LONG = "This is a plain sentence of the article, and it goes on for a while without any link. " * 2


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><meta charset=utf-8><body><article><h1>Head line</h1><p>{LONG}</p></article></body></html>",
        f"<head><title>t</title><style>p{{}}</style><article><h1>Head line</h1><p>{LONG}</p></article>",
        f"<body class='no-sidebar sticky-header'><article><h1>Head line</h1><p>{LONG}</p></article></body>",
        f"<body><div class='main with-sidebar'><h1>Head line</h1><p>{LONG}</p><div class='sidebar'><p>{LONG}</p></div></div></body>",
        f"<body><div class='sidebar-layout'><aside>x</aside><article><h1>Head line</h1><p>{LONG}</p></article></div></body>",
        f"<body><div class='page-banner'><div role=main><h1>Head line</h1><p>{LONG}</p></div></div></body>",
        f"<body><article><div class='article-header'><h1>Head line</h1></div><p>{LONG}</p></article></body>",
        f"<body><header class='entry-header'><h1>Head line</h1></header><div class=content><p>{LONG}</p></div></body>",
        f"<body><article><h1>Head line</h1><svg/><p>{LONG}</p></article></body>",
        f"<body><article><h1>Head line</h1><p>{LONG}</p></article><div class=comments><article class=comment><p>{LONG}</p></article></div></body>",
    ],
)
def test_html_keeps_whole_article(page):
    assert html_text.main_text(page, html_text.trained()) == f"Head line\n\n{LONG.strip()}"


def test_html_keeps_inline_fallbacks():
    page = f"<body><article><p>{LONG}Here <math><mi>x</mi> is 3</math>, <object>a figure</object> <canvas>a plot</canvas> <svg><style>a{{}}</style><text>a label</text></svg> <noscript>and more</noscript>.</p></article>"
    assert html_text.main_text(page, html_text.trained()) == f"{LONG}Here x is 3, a figure a plot a label and more."


def test_html():
    tree = html_text.trained()
    assert html_text.main_text(PAGE, tree) == "Head & tail\n\nFirst paragraph of the page, with words enough to be one.\n\nSecond <b> one. It is short."
    assert html_text.main_text(None, tree) == html_text.main_text("", tree) == html_text.main_text("<nav>a</nav>", tree) == ""


BLOCKS = {
    "two heads": (f"<body><div><h3>Parts</h3><p><a href=1>One</a></p><p><a href=1>Two</a></p></div><div><h3>A head</h3><p>{LONG}</p><p>{LONG}</p></div>", ["A head", LONG.strip(), LONG.strip()]),
    "short lines": (f"<body><div><p>{LONG}</p><p>So it was.</p><p>{LONG}</p></div><div><p><a href=1>More</a></p><p>Of it</p><p><a href=1>Here</a></p></div>", [LONG.strip(), "So it was.", LONG.strip()]),
    "sources": (f"<body><article><p>{LONG}</p><h2>Sources</h2><ul><li><a href=1>A book</a></ul></article>", [LONG.strip(), "Sources", "A book"]),
    "topics": (f"<article class='post tag-feedback search-index'><p>{LONG}</p></article>", [LONG.strip()]),
    "body names": (f"<body class='single-post has-sidebar'><article><p>{LONG}</p></article>", [LONG.strip()]),
    "layout": (f"<div class='layout with-sidebar'><main><p>{LONG}</p></main><aside>x</aside></div>", [LONG.strip()]),
    "remark": (f"<main><p>{LONG}</p></main><article class='comment-body'><p>{LONG}</p></article>", [LONG.strip()]),
    "references": ("<article><p>a &amp;lt; b &#8212; c&nbsp;d &notanentity; &amp</p></article>", ["a &lt; b \u2014 c d &notanentity; &"]),
    "long": (f"<article><p>{'word ' * 300_000}</p><p>{LONG}</p></article>", [("word " * 300_000).strip(), LONG.strip()]),
}


@pytest.mark.parametrize("case", BLOCKS)
def test_html_blocks(case):
    """Neighbours decide in pages that name nothing; names do not cost articles."""
    page, want = BLOCKS[case]
    assert html_text.main_text(page, html_text.trained()) == "\n\n".join(want)


def test_html_tree_uses_neighbours():
    def used(node):
        return set() if isinstance(node, float) else {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3])

    assert used(html_text.trained().root) & {"before_words", "after_words"} and used(html_text.trained().root) & {"before_links", "after_links"}


@pytest.mark.parametrize("page", ["<div>" * 16_000 + "</ul>" * 16_000, "<script " * 20_000, "<a href='" * 20_000, "<div class='a b'>" * 9_000 + "</p>" * 9_000, "<!--" * 40_000])
def test_html_time_is_linear(page):
    began = time.process_time()
    html_text.main_text(page, html_text.trained())
    assert time.process_time() - began < 3


def flat_page(rng):
    """A page of bare blocks and its article by plain rules, for the brute force."""
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))
    article = [word(int(rng.integers(20, 60))) for _ in range(int(rng.integers(1, 5)))]
    inner = "".join(rng.choice([f"<p>{t}</p>", f"<p>{t.replace(' ', '  &#32; ', 1)}<p>", f"<div>{t}</div>"]) for t in article)
    menu = "".join(f"<li><a href=1>{word(2)}</a>" for _ in range(4))
    return f"<html><head><title>{word(3)}</title><body><nav><ul>{menu}</ul></nav><article>{inner}</article><footer>{word(9)}</footer><div class=comments><p>{word(30)}</p></div>", "\n\n".join(article)


def test_html_query_against_brute_force(spark):
    """Repeated rows, nulls, clashing names and generated pages whose article is
    known."""
    rng = np.random.default_rng(8)
    made = [flat_page(rng) for _ in range(40)]
    rows = [(k, f"u{k}", html, "text", 5) for k, (html, _) in enumerate(made)] + [(0, "u0", made[0][0], "text", 5), (None, None, None, None, None), (50, "e", "", "", 0), (51, "t", "no markup at all", "", 0)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    want = [(k, f"u{k}", t, len(t)) for k, (_, t) in enumerate(made)] + [(0, "u0", made[0][1], len(made[0][1])), (None, None, "", 0), (50, "e", "", 0)]
    assert collections.Counter(map(tuple, (r for r in got if r["page_id"] != 51))) == collections.Counter(want)


def test_language_held_out(spark):
    if not DATA.exists():
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.predict(docs, language.train(docs)).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95


def test_language_odd_rows(docs):
    got = {r["doc_id"]: r for r in language.predict(docs, language.train(docs)).collect()}
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[4]["score"] == 0 and 0 <= got[11]["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}


def trained_by_hand(texts):
    """Counts of n-grams as the operator takes them."""
    grams = collections.Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            x = language.EDGE + w + language.EDGE
            for i in range(2, len(x) + 1):
                grams[x[max(0, i - language.ORDER) : i]] += 1
    return grams


def log_probability(prob, back, context, letter):
    """Interpolated estimate of one letter, by going down to the order that has it."""
    total = 0.0
    while context and context + letter not in prob:
        total += back.get(context, 0.0)
        context = context[1:]
    return total + prob.get(context + letter, prob[""])


def test_kneser_ney_sums_to_one():
    """Over all letters seen and one unseen, after any context."""
    prob, back = language.kneser_ney(trained_by_hand(["abba baab aab bb", "bab cab abc"]))
    letters = {g for g in prob if len(g) == 1} | {"unseen"}
    for context in ("", "b", "ab", "aab", "zab", language.EDGE + "a", language.EDGE):
        assert abs(sum(math.exp(log_probability(prob, back, context, x)) for x in letters) - 1) < 1e-9


def test_language_against_brute_force(spark, docs):
    """Cross-entropy and language of every text, letter by letter."""
    texts = {"en": ["the cat sat on the mat and the dog", "one two three four five"], "de": ["der hund und die katze im haus", "ein zwei drei vier"], "fr": ["le chat est sur la table", "une deux trois été"]}
    models = {k: trained_by_hand(v) for k, v in texts.items()}
    own = language.Identifier(models)
    fitted = {k: language.kneser_ney(g) for k, g in models.items()}
    rows = [r["text"] for r in docs.collect()] + ["der kater", "été sur 12 tables", "日本語 the", "x" * 5000]
    entropy, size = language.WordScores(own).texts(rows)
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(table, own).collect()}
    for k, t in enumerate(rows):
        found = re.findall(r"[^\W\d_]+", (t or "").lower())[:3000]
        if not found:
            assert (got[k]["lang_pred"], got[k]["score"], size[k]) == ("und", 0.0, 0)
            continue
        if len(found) == 3000:
            continue
        want = []
        for lang in sorted(fitted):
            prob, back = fitted[lang]
            want.append(-sum(log_probability(prob, back, x[max(0, i - 3) : i], x[i]) for w in found for x in [language.EDGE + w + language.EDGE] for i in range(1, len(x))) / sum(len(w) + 1 for w in found))
        assert np.abs(entropy[k] - want).max() < 1e-4 and got[k]["lang_pred"] == sorted(fitted)[int(np.argmin(want))]
        odds = np.exp(-np.array(want) * size[k] - max(-np.array(want) * size[k]))
        assert abs(got[k]["score"] - odds.max() / odds.sum()) < 1e-2


def brute_deleted_interpolation(own, out, rounds=40):
    """score of each row by plain counting and EM over single tokens."""
    train = [[None, *ws] for i, ws in own if not out(i)]
    one = collections.Counter(w for ws in train for w in ws[1:])
    two = collections.Counter(p for ws in train for p in zip(["<s>", *ws[1:]], ws[1:]))
    n, v, ends = sum(one.values()), len(one), one[None]
    floor = 1 / (v + 1)
    count = lambda u: ends if u == "<s>" else one[u]
    place = lambda c: int(math.log2(c + 1))
    weights = collections.defaultdict(lambda: [0.4, 0.4, 0.2])
    cells = collections.Counter()
    for ws in train:
        for u, w in zip(["<s>", *ws[1:]], ws[1:]):
            c = count(u) - 1
            cells[place(c), (two[u, w] - 1) / c if c > 0 else 0.0, (one[w] - 1) / (n - 1)] += 1
    for _ in range(rounds):
        gained = collections.defaultdict(lambda: [0.05] * 3)
        for (b, p2, p1), k in cells.items():
            parts = [x * p for x, p in zip(weights[b], (p2, p1, floor))]
            gained[b] = [g + k * x / sum(parts) for g, x in zip(gained[b], parts)]
        weights.update({b: [x / sum(g) for x in g] for b, g in gained.items()})
    scores = []
    for i, ws in own:
        total = 0.0
        for u, w in zip(["<s>", *ws], ws):
            c = count(u)
            a, b, d = weights[place(c)]
            p = a * (two[u, w] / c if c else 0) + b * one[w] / n + d * floor
            total += math.log10(p if c else p / (1 - a))
        scores.append((i, total))
    return scores


def test_lm_score_against_brute_force(spark):
    """Counts over several blocks and ranges, the weights and the scores; the
    operator learns its weights from estimates in quarter octaves, so scores
    agree to one part in a hundred."""
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=np.arange(60, 0, -1) / 1830))) for k in range(300)]
    rows += [(300 + k, "a common line of words that comes again") for k in range(30)] + [(400, None), (400, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    own = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = collections.defaultdict(list)
    for i, s in brute_deleted_interpolation(own, out):
        want[i].append(s)
    got = lm_scoring.score(table).collect()
    assert len(got) == len(rows)
    for r in got:
        assert min(abs(r["score"] - s) / abs(s) for s in want[r["doc_id"]]) < 0.01


def test_lm_rows_are_bounded_by_ngrams(spark):
    """A block's request rows never exceed its n-grams, whatever the ranges."""
    table = spark.createDataFrame([(k, f"a b c{k}") for k in range(50)], "doc_id long, text string").coalesce(1)
    blocks, _ = lm_scoring.counted(table)
    for ranges in (1, 16, 10**5):
        asked = blocks.mapInPandas(lm_scoring._ask(ranges), "range int, block long, low binary, high binary, counts binary").collect()
        assert len(asked) <= min(ranges, 53 + 102)
        assert sum(len(lm_scoring.keys_of(r["low"], r["high"])) for r in asked) == 53 + 102


def test_numbers_round_trip():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.array([0, 127, 128, 2**63, 2**64 - 1], np.uint64), (rng.integers(0, 2**62, 500) >> rng.integers(0, 62, 500)).astype(np.uint64)])
    data, begin = lm_scoring.pack_numbers(x)
    assert (lm_scoring.unpack_numbers(data.tobytes()) == x).all() and (lm_scoring.unpack_numbers(data[begin[3] : begin[5]].tobytes()) == x[3:5]).all()
    assert len(lm_scoring.unpack_numbers(b"")) == 0


def test_squeeze():
    x = np.array([0, 5, 2**63], np.uint64)
    assert (lm_scoring.unsqueeze(lm_scoring.squeeze(x), "u8") == x).all() and len(lm_scoring.unsqueeze(lm_scoring.squeeze(x[:0]), "u8")) == 0


def test_quality(spark):
    if not DATA.exists():
        pytest.skip("no driver tables")
    docs, labels = (spark.read.parquet(f"{LABELLED}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9


def test_quality_odd_rows(spark, docs):
    rows = quality.score(docs, None).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(60)] + [(None, 1, 1), (3, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (4, 5, 40)}) == 1  # empty and null texts


def test_bradley_terry_against_gradient_descent():
    """The weights minimise the pairwise logistic loss, and the threshold parts
    the training strengths at the share of documents marked 0."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, len(quality.FEATURES))), np.r_[np.ones(220, int), np.zeros(80, int)]
    x[:220, 3] += 1
    x[:220, 7] -= 0.5
    model = quality.fit(x, y, pairs=4000)
    z, draw = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), np.random.default_rng(7)
    d = z[draw.choice(np.flatnonzero(y == 1), 4000)] - z[draw.choice(np.flatnonzero(y == 0), 4000)]
    w = np.zeros(x.shape[1])
    for _ in range(20_000):
        w -= 0.3 * (d.T @ (1 / (1 + np.exp(-(d @ w))) - 1) / len(d) + quality.RIDGE * w)
    assert np.abs(w - model.weights).max() < 1e-4
    assert (model.score(x) < 0.3).sum() == 80


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (mixing.schedule(none), mixing.mix(none), near_dedup.near_components(none), packing.pack(none), language.predict(none, language.train(none)), warc.audit(*[warc.read_archives(spark, warc.write_archives(warc.records(pages)))] * 2), exact_dedup.exact_groups(store.numbered(none)), html_text.extract(pages), lm_scoring.score(none), quality.score(none, quality.train(none, labels))):
        assert out.count() == 0


def test_pipeline_against_brute_force(spark, monkeypatch):
    """run() against plain Python: exact and near duplicates, the mix in its
    order, and the ids of every piece.  The quality model's decisions are those
    of its operator, which has tests of its own."""
    if not DATA.exists():
        pytest.skip("no driver tables")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).collect()}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if scored[r["doc_id"]]]
    assert 0 < len(rows) < len(scored)
    groups = collections.defaultdict(list)
    for i, t, s in rows:
        groups[(t or "").translate({c: None for c in (32, *range(9, 14))})].append((-len(t or ""), i))
    kept = {min(g)[1] for g in groups.values()}
    rows = [r for r in rows if r[0] in kept]
    components, _ = brute_components([r[:2] for r in rows], 5)
    rows = [r for r in rows if components[r[0]] == r[0]]
    taken, _, order = brute_mix(rows)
    own, texts, stream = Tokenizer.from_file(packing.vocabulary_path()), {i: t for i, t, _ in rows}, []
    for i, number in order:
        n, words = taken[i, number], texts[i].encode().split()
        text = texts[i] if n == len(words) else b" ".join(words[:n]).decode()
        stream += [(i, x) for x in [*own.encode(text, add_special_tokens=False).ids, 2]]
    # several files a stage, and splits that do not follow their order
    monkeypatch.setattr(corpus_pipeline, "write_table", lambda df, name: store.write_table(df, name))
    pieces = sorted(corpus_pipeline.run(spark, str(DATA)).collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    got = [(r["doc_id"], int(x)) for r in pieces for x in np.frombuffer(bytes(r["ids"]), "<u4")]
    assert got == stream and len(pieces) > len(order) > 50


def test_stages_keep_odd_rows_and_columns(spark, docs):
    """Every stage but the last returns the columns of documents, from tables
    with nulls, repeated rows and clashing columns, and from empty ones."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    folder = f"{store.shared_dir(spark)}/odd"
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, folder)
            assert (out.columns == names or name == "packing") and (out.count() > 0) == (table.count() > 0)


def test_packing_follows_files(spark, tmp_path):
    """Pieces have the order of files and rows, whatever the splits."""
    table = spark.createDataFrame([(k, "word " * (k % 9)) for k in range(2000)], "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id")
    table.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = packing.pack(spark.read.parquet(str(tmp_path / "t")), 64).orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids) and set(ids) == set(range(2000))


def test_registry():
    assert [int(k[2:].split("_")[0]) for k in registry.queries()] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
