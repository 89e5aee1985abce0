"""Near-duplicate components by fast similarity sketching.

Sketch (Dahlgaard, Knudsen, Thorup 2017): rounds of hashed bin placement.  In
round i < t every shingle is hashed to a bin and a value; a bin keeps the
smallest value of the first round that reaches it; rounds t..2t-1 put all
shingles into one bin each, so every coordinate is filled, and the share of
equal coordinates is concentrated around the Jaccard similarity.

1. Equal shingle sets collapse to their smallest row (map-side combined).
2. Banding: ``BANDS`` keys of ``ROWS`` coordinates.  A pair of similarity 0.8
   shares no band with probability (1 - 0.8^6)^48 < 5e-7.
3. Every bucket is a star around its smallest row: candidates are linear in the
   band rows however large a bucket is.
4. Candidates whose sketches agree in under ``FLOOR`` of the coordinates are
   more than six standard deviations from 0.8 and go; the others are confirmed
   on the full sets of their whole texts.
5. Components by label propagation over confirmed links.
6. Buckets that still hold several components are the rest that the star leaves
   open.  Buckets of the same members are one.  Members are dealt into tiles by
   size class, count and bytes; only tiles of the same or of neighbouring size
   classes can hold a link, and every two such tiles are compared as matrices,
   first of sketches and then of full sets.  Only links that join components are
   returned.
7. An open bucket of more than ``WIDE`` tiles, boilerplate say, is not compared
   tile against tile.  Its members are dealt anew by prefixes of their full sets:
   two sets of similarity t share one of the first (1 - t) n + 1 shingles of each
   in any one order of all shingles.  The order is from rare to common by counts
   over ``SLOTS`` hash slots, so shared boilerplate comes last and buckets of
   prefix shingles are small.  This is exact; they are compared as in step 6.
   No cap on bucket or partners anywhere.

Hot groups: leaders, equal sets and labels with many rows are salted or broadcast
behind a proven bound (``store.join_groups``); every pair of tiles is a key of its
own, and a tile bounds what a task holds.

Defined results: null and empty texts have an empty set, no link, and stay;
a text shorter than a shingle is one shingle; rows that repeat a doc_id are one
document, of the union of the rows' links; a null doc_id links with nothing and
stays its own class; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import MOST_HOT, few, join_groups, join_ids, numbered, read, write_table
from helixframe.llm.text import DOCUMENT_COLUMNS, WordHashes, mix64, shingle_hashes, words

BANDS, ROWS = 48, 6
SIZE = BANDS * ROWS
FLOOR = 0.65
#: Members and bytes of sets of a tile; tiles of a bucket that are compared as
#: they are; counters of the prefix order.
TILE, TILE_BYTES = 256, 8_000_000
WIDE = 8
SLOTS = 1 << 18
#: Links of one leader that are joined to one copy of its text.
PER_COPY = 4096

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)
_SEEDS = mix64(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BAND_SEED = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(items: np.ndarray) -> np.ndarray:
    """``SIZE`` coordinates of a non-empty array of distinct 64-bit hashes.
    Small sets take several rounds at a time; a coordinate's round stands above
    its hash, so the minimum is that of the first round that reached it."""
    out = np.full(SIZE, _EMPTY)
    i, many = 0, max(1, 6 * SIZE // len(items))
    while i < SIZE:
        rounds = np.arange(i, min(SIZE, i + many), dtype=np.uint64)
        h = mix64(items ^ _SEEDS[rounds][:, None])
        value = h & _LOW | (rounds << _32)[:, None]
        bins = ((h >> _32) * np.uint64(SIZE) >> _32).astype(np.int64).ravel()
        value = value.ravel()
        if i:
            open_ = empty[bins]
            bins, value = bins[open_], value[open_]
        np.minimum.at(out, bins, value)
        empty = out == _EMPTY
        if not empty.any():
            return out
        i += len(rounds)
    for k in np.flatnonzero(empty):
        out[k] = (mix64(items ^ _SEEDS[SIZE + k]) & _LOW).min() | np.uint64(SIZE + k) << _32
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = mix64(coordinates).reshape(BANDS, ROWS)
    key = _BAND_SEED.copy()
    for j in range(ROWS):
        key = mix64(key * np.uint64(31) + rows[:, j])
    return key.view(np.int64)


def _sketches(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                out = []
                for node, text in zip(batch["node"], batch["text"]):
                    items = shingle_hashes(table.array(words(text)), width)
                    if len(items):
                        found = sketch(items)
                        place = np.arange(1, len(items) + 1, dtype=np.uint64)
                        mark = np.array([np.bitwise_xor.reduce(mix64(items)), (mix64(items ^ np.uint64(77)) * place).sum()])
                        out.append((node, len(items), mark.tobytes(), band_keys(found), (mix64(found) & np.uint64(255)).astype(np.uint8).tobytes()))
                    else:
                        out.append((node, 0, None, None, None))
                found = pd.DataFrame(out, columns=["node", "n_shingles", "mark", "bands", "bytes"])
                yield found.assign(void=batch["void"].to_numpy(), doc_id=batch["doc_id"].to_numpy())

    return run


def sketch_table(docs: DataFrame, width: int) -> DataFrame:
    """Of ``docs(node, doc_id, text)``: node, doc_id, n_shingles, mark, bands,
    bytes."""
    schema = "node long, void boolean, doc_id long, n_shingles long, mark binary, bands array<long>, bytes binary"
    plain = docs.select("node", F.col("doc_id").isNull().alias("void"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    return plain.mapInPandas(_sketches(width), schema).withColumn("doc_id", F.when(~F.col("void"), F.col("doc_id"))).drop("void")


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        a = np.frombuffer(b"".join(batch["bytes_a"]), np.uint8).reshape(-1, SIZE)
        b = np.frombuffer(b"".join(batch["bytes_b"]), np.uint8).reshape(-1, SIZE)
        yield batch.loc[(a == b).mean(axis=1) >= FLOOR, ["a", "b"]]


def near_enough(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs (leader a, member b) whose sizes and sketches allow the
    similarity."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bytes").alias(f"bytes_{x}"))
    leaders = write_table(side("a").join(few(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("links"))), "a"), "leader-sketches")
    total = leaders.agg(F.sum("links")).first()[0] or 0
    joined = join_groups(pairs, leaders, ["a"], "links", total).drop("links").join(side("b"), "b")
    sized = joined.where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "bytes_a", "bytes_b").mapInPandas(_agree, "a long, b long")


def _confirm(width: int, threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = WordHashes(), {}

        def items(node, text):
            if node not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[node] = shingle_hashes(table.array(words(text)), width)
            return seen[node]

        with np.errstate(over="ignore"):
            for batch in batches:
                good = []
                for a, b, text_a, text_b in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"]):
                    x, y = items(a, text_a), items(b, text_b)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * both >= threshold * (len(x) + len(y) - both))
                yield batch.loc[good, ["a", "b"]]

    return run


def texts_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return write_table(join_ids(docs.select("node", "text"), ids, "node", "left_semi"), "near-texts")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity.  A leader's text is
    copied once per ``PER_COPY`` of its links; the leaders that need copies are
    those with more than one link in ``MOST_HOT``, so they are few."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))
    total = pairs.count()
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("links")).where((F.col("links") > PER_COPY) & (F.col("links") * MOST_HOT > total))
    large = F.broadcast(write_table(stars.select("a", F.ceil(F.col("links") / PER_COPY).alias("copies")), "large-stars"))
    salted = pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).alias("copy"))
    copied = side("a").join(large, "a", "left").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    joined = salted.join(side("b"), "b").join(copied, ["a", "copy"])
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(_confirm(width, threshold), "a long, b long")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """``edges(a, b)`` -> (node, label), the smallest node reachable.  Labels
    go over edges and then jump to the label of the label, so the number of
    rounds is about the logarithm of the diameter; each round is written."""
    both = write_table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), f"{name}-edges")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        step = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(step, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = own.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid", "left").select("node", "old", F.least("mid", "far").alias("label"))
        new = write_table(jump, name)
        if not new.where("label < old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of distinct-item arrays, as
    products of incidence matrices over slices of the items."""
    both = left + right
    items, at = np.unique(np.concatenate(both), return_inverse=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 8192
    for low in range(0, len(items), width):
        a, b = np.searchsorted(at, (low, low + width))
        grid = np.zeros((len(both), width), np.float32)
        grid[row[a:b], at[a:b] - low] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _tile_links(threshold: int):
    """Links between different components across two tiles, as few as join
    them: the full sets are compared, and a link that joins nothing new is not
    returned, so a tile gives fewer rows than it has members."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for left, right in zip(batch["left"], batch["right"]):
                same = right is None
                right = left if same else right
                get = lambda side, k: np.array([m[k] for m in side])
                rough = [np.frombuffer(b"".join(m["bytes"] for m in side), np.uint8).reshape(-1, SIZE) for side in (left, right)]
                label_a, label_b = get(left, "label"), get(right, "label")
                near = np.stack([(rough[1] == x).mean(axis=1) >= FLOOR for x in rough[0]]) & (label_a[:, None] != label_b[None, :])
                if same:
                    near = np.triu(near, 1)
                rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                if not len(rows):
                    continue
                sets_a, sets_b = ([np.frombuffer(side[i]["items"], np.uint64) for i in at] for side, at in ((left, rows), (right, columns)))
                both = shared_counts(sets_a, sets_b)
                size_a, size_b = (np.array([len(x) for x in sets], float) for sets in (sets_a, sets_b))
                linked = near[np.ix_(rows, columns)] & (100 * both >= threshold * (size_a[:, None] + size_b[None, :] - both))
                ids_a, ids_b = get(left, "node")[rows], get(right, "node")[columns]
                parent: dict[int, int] = {}

                def root(x: int) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                out = []
                for i, j in np.argwhere(linked):
                    x, y = root(label_a[rows[i]]), root(label_b[columns[j]])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out.append((min(ids_a[i], ids_b[j]), max(ids_a[i], ids_b[j])))
                yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordHashes()
        with np.errstate(over="ignore"):
            for batch in batches:
                yield pd.DataFrame({"node": batch["node"], "items": [shingle_hashes(table.array(words(t)), width).tobytes() for t in batch["text"]]})

    return run


def _rough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Members of two tiles whose text was not read yet and that some member
    of another component resembles."""
    for batch in batches:
        for left, right in zip(batch["left"], batch["right"]):
            sides = [left, left if right is None else right]
            rough = [np.frombuffer(b"".join(m["bytes"] for m in side), np.uint8).reshape(-1, SIZE) for side in sides]
            labels = [np.array([m["label"] for m in side]) for side in sides]
            ids = set()
            for k in (0, 1):
                for i, m in enumerate(sides[k]):
                    if not m["known"] and (((rough[1 - k] == rough[k][i]).mean(axis=1) >= FLOOR) & (labels[1 - k] != labels[k][i])).any():
                        ids.add(m["node"])
            yield pd.DataFrame({"node": pd.Series(sorted(ids), dtype="int64")})


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many of a task's sets have a shingle in each slot, counted per shingle."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        counts += np.bincount(_slot(np.frombuffer(b"".join(batch["items"]), np.uint64)), minlength=SLOTS)
    used = np.flatnonzero(counts)
    yield pd.DataFrame({"slot": used, "n": counts[used]})


def _slot(items: np.ndarray) -> np.ndarray:
    return (items & np.uint64(SLOTS - 1)).astype(np.int64)


def prefix(items: np.ndarray, counts: np.ndarray, threshold: int) -> np.ndarray:
    """The first shingles from rare to common, of which two sets that reach the
    threshold share one."""
    size = len(items) - -(-threshold * len(items) // 100) + 1
    return items[np.lexsort((items, counts[_slot(items)]))[:size]]


def _prefixes(counts: np.ndarray, threshold: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [prefix(np.frombuffer(x, np.uint64), counts, threshold) for x in batch["items"]]
            if found:
                yield pd.DataFrame({"node": np.repeat(batch["node"].to_numpy(), [len(x) for x in found]), "key": np.concatenate(found).view(np.int64)})

    return run


def prefix_buckets(sets: DataFrame, threshold: int) -> DataFrame:
    """(node, key) of the prefixes of all ``sets(node, items)``."""
    seen = write_table(sets.mapInPandas(_slots, "slot long, n long"), "slots", 500).groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[seen["slot"]] = seen["n"]
    return sets.mapInPandas(_prefixes(counts, threshold), "node long, key long")


def cells(members: DataFrame) -> DataFrame:
    """Tiles of each size class of each key of ``members(key, cls, node, bulk)``."""
    sums = members.groupBy("key", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("bulk").alias("bulk"))
    return sums.select("key", "cls", F.ceil(F.greatest(F.col("n") / TILE, F.col("bulk") / TILE_BYTES)).alias("tiles"))


def tile_pairs(members: DataFrame, tiled: DataFrame, fields: list[str]) -> DataFrame:
    """``members(key, cls, node, fields)`` dealt into the tiles of ``cells`` and
    every two tiles of the same or neighbouring classes side by side: left, and
    right or null where a tile is compared with itself."""
    beside = tiled.join(tiled.select("key", (F.col("cls") + 1).alias("cls"), F.col("tiles").alias("below")), ["key", "cls"], "left")
    beside = beside.join(tiled.select("key", (F.col("cls") - 1).alias("cls"), F.col("tiles").alias("above")), ["key", "cls"], "left").fillna(0, ["below", "above"])
    dealt = members.join(beside, ["key", "cls"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    held = write_table(dealt.groupBy("key", "cls", "tile").agg(*[F.first(c).alias(c) for c in ("tiles", "below", "above")], F.collect_list(F.struct("node", *fields)).alias("members")), "tiles")
    upto = lambda low, high: F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<long>"))
    zero, tile = F.lit(0).cast("long"), F.col("tile")
    place = lambda step: lambda j: F.struct((F.col("cls") + step).alias("cls"), j.alias("tile"))
    own = F.struct("cls", "tile")
    after = F.concat(F.transform(upto(tile + 1, F.col("tiles")), place(0)), F.transform(upto(zero, F.col("above")), place(1)))
    before = F.concat(F.transform(upto(zero, tile), place(0)), F.transform(upto(zero, F.col("below")), place(-1)))
    left = held.select("key", own.alias("x"), F.explode(after).alias("y"), F.col("members").alias("left"))
    right = held.select("key", F.explode(before).alias("x"), own.alias("y"), F.col("members").alias("right"))
    alone = held.select(F.col("members").alias("left"), F.lit(None).cast(held.schema["members"].dataType).alias("right")).where(F.size("left") > 1)
    return left.join(right, ["key", "x", "y"]).select("left", "right").unionByName(alone)


def several(members: DataFrame, least: int) -> DataFrame:
    """The keys of ``members(key, node, label)`` with ``least`` rows or more and
    more than one component, without those that have the members of another."""
    hashed = F.xxhash64("node")
    state = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.bit_xor(hashed).alias("mix"), F.sum(F.pmod(F.xxhash64("node", F.lit("sum")), F.lit(1 << 31))).alias("sum"),
    )
    return state.where(f"n >= {least} and low <> high").groupBy("n", "mix", "sum").agg(F.min("key").alias("key")).select("key", "n")


def open_links(bands: DataFrame, labels: DataFrame, sketches: DataFrame, docs: DataFrame, texts: DataFrame, width: int, threshold: int, total: int, wide: int = WIDE) -> DataFrame:
    """Links between different components inside buckets of three or more
    documents that the star left open.  ``texts`` has the texts of all documents
    that resembled a leader; a first pass over the sketches finds the few others
    that resemble somebody, a second one compares full sets."""
    marked = write_table(bands.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    still = write_table(several(marked, 3), "open-buckets")
    step = -np.log(min(threshold, 99.9) / 100) * (1 + 1e-9)
    sized = sketches.select("node", "bytes", F.floor(F.log("n_shingles") / F.lit(float(step))).alias("cls"), (F.col("n_shingles") * 8).alias("bulk"))
    known = texts.select("node").distinct().withColumn("known", F.lit(True))
    in_open = join_groups(marked, still, ["key"], "n", total * BANDS).drop("n").join(sized, "node").join(known, "node", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    in_open = write_table(in_open, "open-members")
    tiled = write_table(cells(in_open), "open-cells")
    large = write_table(tiled.groupBy("key").agg(F.sum("tiles").alias("tiles")).where(F.col("tiles") > wide).select("key"), "wide-buckets")
    narrow = in_open.join(large, "key", "left_anti")
    in_wide = write_table(in_open.join(large, "key", "left_semi").select("node", "label", "bytes", "cls", "bulk", "known").dropDuplicates(["node"]), "wide-members")
    rest = tile_pairs(narrow, tiled, ["label", "bytes", "known"]).mapInPandas(_rough, "node long")
    rest = write_table(rest.union(in_wide.where("not known").select("node")).distinct(), "open-unread", 16)
    more = join_ids(docs.select("node", "text"), rest, "node", "left_semi")
    here = texts.join(in_open.select("node").distinct(), "node", "left_semi")
    sets = write_table(here.union(more).mapInPandas(_sets(width), "node long, items binary"), "open-sets", 1000)
    fields = ["label", "bytes", "items"]
    links = tile_pairs(narrow.join(sets, "node"), tiled, fields).mapInPandas(_tile_links(threshold), "a long, b long")
    if in_wide.limit(1).count():
        dealt = prefix_buckets(sets.join(in_wide.select("node"), "node", "left_semi"), threshold).join(in_wide.drop("known"), "node")
        dealt = write_table(dealt.drop("bytes"), "prefixes", 500)
        shared = dealt.join(several(dealt, 2), "key", "left_semi")
        shared = write_table(shared.join(in_wide.select("node", "bytes"), "node"), "prefix-members")
        links = links.union(tile_pairs(shared.join(sets, "node"), write_table(cells(shared), "prefix-cells"), fields).mapInPandas(_tile_links(threshold), "a long, b long"))
    return links.distinct()


def noded(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``node``, and whether nodes stand for rows because doc_ids
    do not tell the rows apart; else a row's node is its doc_id."""
    alike = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if alike.limit(1).count():
        return numbered(docs).withColumnRenamed("row_key", "node"), True
    return docs.withColumn("node", F.col("doc_id").cast("long")), False


def same_ids(members: DataFrame, total: int) -> DataFrame:
    """Links (a, b) between the sets of rows that share a doc_id, from
    ``members(doc_id, head)``."""
    own = members.groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("rows"))
    firsts = own.groupBy("doc_id").agg(F.min("head").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_groups(own.select("doc_id", F.col("head").alias("b")), firsts, ["doc_id"], "n", total).where("a <> b").select("a", "b")


def near_components(docs: DataFrame, width: int = 5, threshold: int = 80, wide: int = WIDE) -> DataFrame:
    """One row per row of ``docs``: node, doc_id, n_shingles, component_id, and
    ``stays``, true for one row of each component."""
    return node_components(*noded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), width, threshold, wide)


def node_components(plain: DataFrame, repeated: bool, width: int = 5, threshold: int = 80, wide: int = WIDE) -> DataFrame:
    """The same for ``noded`` documents (node, doc_id, text)."""
    table = write_table(sketch_table(plain, width), "sketches", 1000)
    has_set = F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull()
    sets = table.where(has_set)
    total = sets.count()
    key = ["mark", "n_shingles"]
    heads = write_table(sets.groupBy(*key).agg(F.min("node").alias("head"), F.min(F.struct("doc_id", "node")).alias("first"), F.count(F.lit(1)).alias("size")), "set-heads")
    others = join_groups(sets.select("node", *key), heads.select(*key, "head", "size"), key, "size", total).where("node <> head").select("node")
    firsts = write_table(join_ids(sets, others, "node", "left_anti").select("node", "n_shingles", "bands", "bytes"), "set-firsts")
    bands = firsts.select("node", F.explode("bands").alias("key"))
    shared = write_table(bands.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leaders")
    in_shared = write_table(join_groups(bands, shared, ["key"], "n", total * BANDS).select("node", "key", "a"), "bucketed")
    stars = write_table(in_shared.where("a <> node").select("a", F.col("node").alias("b")).distinct(), "star-links")
    found = write_table(near_enough(stars, firsts, threshold), "candidates")
    texts = texts_of(found, plain)
    links = write_table(confirm(found, texts, width, threshold), "links", 250)
    if repeated:
        links = write_table(links.union(same_ids(join_groups(sets.select("doc_id", *key), heads.select(*key, "head", "size"), key, "size", total), total)), "links-and-ids")
    labels = components(links)
    extra = write_table(open_links(in_shared.select("node", "key"), labels, firsts, plain, texts, width, threshold, total, wide), "open-links", 4)
    if extra.limit(1).count():
        labels = components(links.union(extra), "labels-again")
    classes = heads.join(labels.withColumnRenamed("node", "head"), "head", "left").withColumn("class", F.coalesce("label", "head")).select(*key, "size", "class", "first")
    if repeated:
        least = classes.groupBy("class").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("sets"))
        classes = join_groups(classes, least, ["class"], "sets", total).select(*key, "size", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("stay"))
    else:
        classes = classes.select(*key, "size", F.col("class").alias("component_id"), F.col("class").alias("stay"))
    met = join_groups(sets.select("node", "doc_id", *key), write_table(classes, "near-classes"), key, "size", total)
    met = met.select("node", "doc_id", "n_shingles", "component_id", (F.col("node") == F.col("stay")).alias("stays"))
    return met.union(table.where(~has_set).select("node", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(read(spark, sf_dir, "documents"), width=2, threshold=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: five-word shingles, similarity 0.8; one row of each
    component stays, that of the smallest doc_id."""
    rows, repeated = noded(docs.select(*DOCUMENT_COLUMNS))
    gone = node_components(rows.select("node", "doc_id", "text"), repeated).where("not stays").select("node")
    return join_ids(rows, gone, "node", "left_anti").select(*DOCUMENT_COLUMNS)
