"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of order 2, 1 and 0,

    p(w|u) = a_b c(u,w)/c(u) + b_b c(w)/N + c_b 1/(V+1),

with weights per bucket b of the context's frequency (powers of two), learned
by expectation-maximisation on held-out counts: each training token is scored
with its own occurrence deleted from all counts.

All counts cover the whole corpus and none of them is broadcast or collected:

1. Every task turns its texts into blocks of at most ``BLOCK`` tokens and
   writes each block once: token numbers into the block's distinct words.
2. A block asks for its distinct n-grams, once each, with its own training
   counts: sorted 64-bit hashes cut by hash range, one row per range.  The
   hashes are delta-coded in bytes for the whole block, so a row is a slice of
   them; a block gives no more rows than it has n-grams, however many ranges
   there are.  A hot word is one entry per block.
3. A range's task adds the counts up and answers each block in the order asked.
4. Blocks meet their answers.  A first visit yields a histogram of deleted
   estimates per bucket, at most BUCKETS x BINS x BINS numbers in all, on which
   the weights are learned; a second visit scores the documents.  A bin is a
   quarter octave wide, so an estimate is off by at most 2^(1/8) while weights
   are learned; scores use the exact counts.

Defined results: null and empty texts are the end token alone; without training
documents N and V are 0 and the model is uniform; rows that repeat a doc_id are
documents of their own; null doc_id is not held out; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import read, write_table
from helixframe.llm.text import WordHashes, crc_of_id, mix64, words

BLOCK = 1_500_000
KEYS_PER_RANGE = 1_000_000
BUCKETS, BINS = 26, 128
#: The lowest bit of a key tells words (1) from pairs (0).
ONE = np.uint64(1)
END = np.uint64(0x5DEECE66D1234567)
START = np.uint64(0x2545F4914F6CDD1C)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def squeeze(x: np.ndarray) -> bytes:
    """Compressed bytes of an unsigned array, byte planes apart."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())


def unsqueeze(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def deltas(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def pack_numbers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits each, the last of a number marked by its top bit, and
    the place where each number begins (one more at the end)."""
    x = np.ascontiguousarray(x, np.uint64)
    size = np.ones(len(x), np.int64)
    for k in range(1, 10):
        size += x >= np.uint64(1) << np.uint64(7 * k)
    begin = np.r_[0, np.cumsum(size)]
    out = np.zeros(begin[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[begin[at] + k] = (x[at] >> np.uint64(7 * k)) & np.uint64(127)
    out[begin[1:] - 1] |= 128
    return out, begin


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw >= 128)
    first = np.r_[0, last[:-1] + 1]
    out = np.zeros(len(last), np.uint64)
    for k in range(int((last - first).max(initial=-1)) + 1):
        at = first + k <= last
        out[at] |= (raw[first[at] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def _encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = WordHashes()
    task, number = TaskContext.get().partitionId(), 0
    ids: list = []
    held: list = []
    hashes: list[np.ndarray] = []

    def block() -> pd.DataFrame:
        nonlocal number
        size = np.array([len(h) for h in hashes], np.uint32)
        keys, at = np.unique(np.concatenate(hashes), return_inverse=True)
        row = pd.DataFrame({
            "block": [(task << 24) + number], "ids": [list(ids)], "held": [np.array(held, np.uint8).tobytes()],
            "sizes": [squeeze(size)], "keys": [squeeze(deltas(keys))], "tokens": [squeeze(at.astype(np.uint32))], "n": [int(size.sum())],
        })
        number += 1
        ids.clear(), held.clear(), hashes.clear()
        return row

    waiting = 0
    for batch in batches:
        for doc_id, out, text in zip(batch["doc_id"], batch["held_out"], batch["text"]):
            h = np.append(table.array(words(text)) | ONE, END)
            if waiting and waiting + len(h) > BLOCK:
                yield block()
                waiting = 0
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            held.append(bool(out))
            hashes.append(h)
            waiting += len(h)
    if hashes:
        yield block()


class Block:
    """A written block, unpacked."""

    def __init__(self, row):
        self.ids = list(row["ids"])
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.sizes = unsqueeze(row["sizes"], "u4").astype(np.int64)
        self.words = np.cumsum(unsqueeze(row["keys"], "u8"), dtype=np.uint64)
        self.word_at = unsqueeze(row["tokens"], "u4").astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~self.held, self.sizes)
        hashes = self.words[self.word_at]
        before = np.r_[START, hashes[:-1]]
        before[self.first] = START
        with np.errstate(over="ignore"):
            pairs = mix64(mix64(before) * _STEP + hashes) & ~ONE
        self.pairs, self.pair_at = np.unique(pairs, return_inverse=True)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of words and pairs, this block's training counts
        of them, and their order as places in words and pairs end to end."""
        keys = np.concatenate([self.words, self.pairs])
        counts = np.concatenate([np.bincount(at[self.training], minlength=n) for at, n in ((self.word_at, len(self.words)), (self.pair_at, len(self.pairs)))])
        order = np.argsort(keys, kind="stable")
        return keys[order], counts[order], order


def _ask(ranges: int):
    edges = (np.arange(1, ranges, dtype=np.float64) / ranges * 2.0**64).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                keys, counts, _ = Block(row).asked()
                cuts = np.r_[0, np.searchsorted(keys, edges), len(keys)]
                used = np.flatnonzero(np.diff(cuts))
                step = deltas(keys)
                step[cuts[used]] = keys[cuts[used]]  # each row starts anew
                # whole low bytes as they are, the little above them as numbers
                low = int(np.clip((64 - np.log2(len(keys) + 1)) // 8, 1, 7))
                high, begin = pack_numbers(step >> np.uint64(8 * low))
                low_bytes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()
                high_bytes = high.tobytes()
                count_bytes, counted = pack_numbers(counts)
                count_bytes = count_bytes.tobytes()
                a, b = cuts[used], cuts[used + 1]
                yield pd.DataFrame({
                    "range": used.astype(np.int32), "block": row["block"], "low": [low_bytes[i:j] for i, j in zip(a * low, b * low)],
                    "high": [high_bytes[i:j] for i, j in zip(begin[a], begin[b])], "counts": [count_bytes[i:j] for i, j in zip(counted[a], counted[b])],
                })

    return run


def keys_of(low: bytes, high: bytes) -> np.ndarray:
    """The sorted keys of one row."""
    top = unpack_numbers(high)
    width = len(low) // len(top)
    step = np.zeros((len(top), 8), np.uint8)
    step[:, :width] = np.frombuffer(low, np.uint8).reshape(-1, width)
    return np.cumsum(step.view("<u8").ravel() | top << np.uint64(8 * width), dtype=np.uint64)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    keys = [keys_of(a, b) for a, b in zip(group["low"], group["high"])]
    counts = unpack_numbers(b"".join(group["counts"]))
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(found)).astype(np.uint64)
    ends = np.r_[0, np.cumsum([len(k) for k in keys])]
    data, begin = pack_numbers(total[at])
    data, spot = data.tobytes(), begin[ends]
    word = (found & ONE) > 0
    out = pd.DataFrame({"block": group["block"].to_numpy(), "range": group["range"].to_numpy(), "totals": [data[i:j] for i, j in zip(spot[:-1], spot[1:])], "tokens": 0, "types": 0})
    out.loc[0, ["tokens", "types"]] = int(total[word].sum()), int((total[word] > 0).sum())
    return out


class Model:
    """N, V and the weights of each bucket."""

    def __init__(self, tokens: int, types: int, weights: np.ndarray | None = None):
        self.tokens, self.types = tokens, types
        self.weights = np.tile([0.0, 0.0, 1.0] if not tokens else [0.4, 0.4, 0.2], (BUCKETS, 1)) if weights is None else weights

    def learn(self, histogram: pd.DataFrame, rounds: int = 40) -> Model:
        """Expectation-maximisation over (bucket, bin of p2, bin of p1, n)."""
        w = self.weights.copy()
        if not len(histogram):
            return self
        b, n = histogram["bucket"].to_numpy(), histogram["n"].to_numpy(float)
        p = np.c_[unbin(histogram["two"].to_numpy()), unbin(histogram["one"].to_numpy()), np.full(len(b), 1 / (self.types + 1))]
        for _ in range(rounds):
            share = w[b] * p
            share /= share.sum(axis=1, keepdims=True)
            gained = np.zeros_like(w)
            np.add.at(gained, b, share * n[:, None])
            total = gained.sum(axis=1, keepdims=True)
            w = np.where(total > 0, (gained + [0.05, 0.05, 0.05]) / (total + 0.15), w)
        return Model(self.tokens, self.types, w)


def bins(p: np.ndarray) -> np.ndarray:
    """0 for 0, else quarter octaves below 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(BINS - 1 + np.round(4 * np.log2(p)), 1, BINS - 1), 0).astype(np.int64)


def unbin(k: np.ndarray) -> np.ndarray:
    return np.where(k > 0, 2.0 ** ((k - (BINS - 1)) / 4), 0.0)


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def counts_of(row, answers: pd.DataFrame) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray]:
    """Per token of a block: corpus counts of the pair, the context, the word."""
    own = Block(row)
    _, _, order = own.asked()
    totals = np.empty(len(order))
    totals[order] = unpack_numbers(b"".join(answers.sort_values("range")["totals"]))
    one, two = totals[: len(own.words)], totals[len(own.words) :]
    word = one[own.word_at]
    context = np.r_[0.0, word[:-1]]
    ends = one[np.searchsorted(own.words, END)]
    context[own.first] = ends
    return own, two[own.pair_at], context, word


def _histogram(tokens: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, row in left.iterrows():
            own, pair, context, word = counts_of(row, right)
            t = own.training
            pair, context, word = pair[t] - 1, context[t] - 1, word[t] - 1
            two = np.where(context > 0, pair / np.maximum(context, 1), 0)
            one = word / max(1, tokens - 1)
            key, n = np.unique((bucket(context) * BINS + bins(two)) * BINS + bins(one), return_counts=True)
            parts.append(pd.DataFrame({"bucket": key // BINS // BINS, "two": key // BINS % BINS, "one": key % BINS, "n": n}))
        return pd.concat(parts) if parts else pd.DataFrame({"bucket": [], "two": [], "one": [], "n": []}, dtype="int64")

    return run


def _score(model: Model):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, row in left.iterrows():
            own, pair, context, word = counts_of(row, right)
            w = model.weights[bucket(context)]
            floor = 1 / (model.types + 1)
            # what an empty context or corpus cannot say goes to the lower orders
            has = context > 0
            two = np.where(has, pair / np.maximum(context, 1), 0)
            p = w[:, 0] * two + w[:, 1] * word / max(1, model.tokens) + w[:, 2] * floor
            p = np.where(has, p, p / np.maximum(1 - w[:, 0], 1e-9))
            base = np.log10((word + 1) / (model.tokens + model.types + 1))
            add = lambda x: np.add.reduceat(x, own.first)  # noqa: E731, B023
            parts.append(pd.DataFrame({
                "doc_id": pd.array(own.ids, dtype="Int64"), "held_out": own.held, "n_tokens": own.sizes, "n_known": add((word > 0).astype(np.int64)),
                "train_tokens": model.tokens, "base_score": add(base), "score": add(np.log10(p)),
            }))
        return pd.concat(parts)

    return run


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables of the blocks and of the answers to them."""
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id(F.col("doc_id")) % 7 == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks = write_table(marked.mapInPandas(_encode, "block long, ids array<long>, held binary, sizes binary, keys binary, tokens binary, n long"), "lm-blocks")
    tokens = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = max(16, -(-tokens // KEYS_PER_RANGE))
    asked = blocks.mapInPandas(_ask(ranges), "range int, block long, low binary, high binary, counts binary")
    return blocks, write_table(asked.groupBy("range").applyInPandas(_answer, "block long, range int, totals binary, tokens long, types long"), "lm-answers")


def fit(blocks: DataFrame, answers: DataFrame) -> Model:
    total = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    model = Model(total["tokens"] or 0, total["types"] or 0)
    seen = meeting(blocks, answers).applyInPandas(_histogram(model.tokens), "bucket long, two long, one long, n long")
    return model.learn(seen.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).toPandas().sort_values(["bucket", "two", "one"]))


def meeting(blocks: DataFrame, answers: DataFrame):
    return blocks.groupBy("block").cogroup(answers.select("block", "range", "totals").groupBy("block"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks, answers = counted(docs)
    return meeting(blocks, answers).applyInPandas(_score(fit(blocks, answers)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
