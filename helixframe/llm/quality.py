"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features; the probability
that it is preferred to another is the logistic function of the difference of
their strengths.  The weights minimise the logistic loss on the feature
differences of preference pairs (a document marked 1 against one marked 0) by
Newton's method with a ridge penalty.  The threshold is the quantile of the
training strengths at the share of documents marked 0, halfway between the two
documents it parts; strengths are mapped to (0, 1) by a logistic curve that
passes ``THRESHOLD`` at that quantile.  The features are general counts of a
text's characters, words and lines; none of them has a ceiling.

The pairs come from a bounded sample of labelled rows (``MAX_LABELLED``), chosen
by the hash of the identifier; features of every document are computed from its
whole text, batch by batch, with nothing kept between batches.

Defined results: null and empty texts have all features 0 and get a score like
any other; without labels of both kinds every score is 0.5; rows that repeat a
doc_id are scored each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import read
from helixframe.llm.text import DOCUMENT_COLUMNS, crc_of_id

MAX_LABELLED = 20_000
MOST_BROADCAST = 100_000
PAIRS = 60_000
RIDGE = 1e-3
THRESHOLD = 0.3
FEATURES = (
    "log_words", "log_word_length", "upper", "digits", "spaces", "stops", "marks", "symbols", "beyond_ascii", "distinct_words", "doubled_words", "top_word",
    "distinct_lines", "log_line_words", "short_lines", "one_case", "long_words", "marked_words", "character_entropy", "byte_pairs",
)

#: Kinds of bytes: upper, lower, digit, space, stops, marks inside text, symbols,
#: beyond ASCII.
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b" \t\n\r\x0b\x0c")] = 3
_CLASS[list(b".!?:;")] = 4
_CLASS[list(b",'\"()-")] = 5
_CLASS[128:] = 7


def features(text: str | None) -> list[float]:
    """The features of one whole text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, np.uint8)
    kind = _CLASS[codes]
    n = np.bincount(kind, minlength=8)
    visible = max(1, len(raw) - int(n[3]))
    tokens = raw.split()
    count = max(1, len(tokens))
    seen: dict[bytes, int] = {}
    for w in tokens:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rows = max(1, len(lines))
    share = np.bincount(codes, minlength=256) / len(raw)
    share = share[share > 0]
    pairs = np.unique(codes[:-1].astype(np.uint16) << 8 | codes[1:]) if len(raw) > 1 else codes
    return [
        np.log1p(count),
        np.log1p(visible / count),
        n[0] / visible,
        n[2] / visible,
        n[3] / len(raw),
        n[4] / count,
        n[5] / count,
        n[6] / visible,
        n[7] / visible,
        len(seen) / count,
        sum(a == b for a, b in zip(tokens, tokens[1:])) / count,
        max(0, max(seen.values(), default=0) - 1) / count,
        len(set(lines)) / rows,
        np.log1p(count / rows),
        sum(len(x) < 20 for x in lines) / rows,
        sum(len(w) > 2 and w.isupper() for w in tokens) / count,
        sum(len(w) > 25 for w in tokens) / count,
        int((kind[np.flatnonzero(kind == 3) - 1] == 6).sum()) / count,
        -float((share * np.log2(share)).sum()),
        np.log1p(len(pairs)) - np.log1p(len(raw)) / 2,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


class BradleyTerry:
    """Weights, scale and offset; small enough to travel with every task."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, cut: float, slope: float):
        self.weights, self.mean, self.spread, self.cut, self.slope = weights, mean, spread, cut, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        # summed row by row, so that a text's value does not depend on its batch
        return ((x - self.mean) / self.spread * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS) -> BradleyTerry | None:
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / spread
    rng = np.random.default_rng(7)
    total = min(pairs, len(good) * len(bad))
    d = z[rng.choice(good, total)] - z[rng.choice(bad, total)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) / total + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / total + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    strengths = z @ w
    cut = float(np.quantile(strengths, len(bad) / len(label), method="hazen"))
    return BradleyTerry(w, mean, spread, cut, float(4 / max(1e-6, strengths.std())))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> BradleyTerry | None:
    """Fit on labelled rows outside the held-out fold, at most ``max_labelled``
    of them, the smallest by hash of the identifier."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(crc_of_id(F.col("doc_id")) % 5 != 0)
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": list(matrix(batch["text"]))})

    # identifiers and marks of at most MOST_BROADCAST rows, so that no text is shuffled
    chosen = F.broadcast(chosen) if max_labelled <= MOST_BROADCAST else chosen
    got = docs.select("doc_id", "text").join(chosen, "doc_id").mapInPandas(rows, "doc_id long, quality int, x array<double>").toPandas()
    if not len(got):
        return None
    got = got.sort_values("doc_id", kind="stable")
    return fit(np.stack(got["x"].to_list()), got["quality"].to_numpy())


def score(docs: DataFrame, model: BradleyTerry | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            value = np.full(len(batch), 0.5) if model is None else model.score(matrix(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": value, "predicted": (value >= THRESHOLD).astype("int32")})

    marked = docs.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out"), "text")
    return marked.mapInPandas(rows, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = train(docs, read(spark, sf_dir, "labels"))
    names = list(DOCUMENT_COLUMNS)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.ones(len(batch), bool) if model is None else model.score(matrix(batch["text"])) >= THRESHOLD
            yield batch.loc[keep, names]

    plain = docs.select(*names)
    return plain.mapInPandas(rows, plain.schema)
