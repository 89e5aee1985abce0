"""Language identification by interpolated Kneser-Ney character models.

Per language, character n-grams up to order 4 inside words with boundaries;
every order but the highest counts distinct left extensions, and one discount
per order is taken from its counts of counts.  The models of all languages are
kept as one sorted array of n-gram hashes per order beside a matrix of log
probabilities and one of back-off weights.  A text gets the language with the
lowest cross-entropy per character; temperature and rejection threshold are
calibrated on labelled rows that the counts did not see.

The classifier is fitted on a bounded sample of labelled rows: about
``DOCS_PER_LANGUAGE`` of each language by the hash of the identifier, less where
there are so many languages that it would be over ``MOST_DOCS`` in all; a fifth
of them is for calibration.  The model is dense over n-grams and languages and
is sent to every task; beyond ``MOST_CELLS`` numbers it is an error that asks for
a smaller sample.  Every text is scored whole; as n-grams stay inside a word, a
word's scores are computed once and looked up.  The score is the posterior of
the language over all letters of the text.

Defined results: null text and text without letters give ``und`` with score 0;
with nothing learned every text does; rows that repeat a doc_id are predicted
each; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.store import read
from helixframe.llm.text import crc_of_id, mix64

ORDER = 4
DOCS_PER_LANGUAGE, MOST_DOCS = 3000, 120_000
MOST_CELLS = 100_000_000
#: Up to so many languages, their counts are sent to every task.
MOST_BROADCAST = 10_000
TEMPERATURES = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
EDGE = "\x02"
UNDETERMINED = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_letters = re.compile(r"[^\W\d_]+").findall


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, by order 1..ORDER."""
    with np.errstate(over="ignore"):
        out = [mix64(codes.astype(np.uint64) + np.uint64(1))]
        for _ in range(ORDER - 1):
            last = out[-1]
            out.append(mix64(np.r_[np.uint64(0), last[:-1]] * _STEP + codes))
    return out


def hash_of(gram: str) -> np.uint64:
    return gram_hashes(np.array([ord(c) for c in gram], np.uint64))[len(gram) - 1][-1]


def _discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(one / max(1, one + 2 * two), 0.1, 0.9))


def kneser_ney(grams: Counter) -> tuple[dict[str, float], dict[str, float]]:
    """``grams``: counts of n-grams of order ORDER, and of shorter ones that
    begin at a word's edge -> log probability of each n-gram, log back-off of
    each context."""
    levels: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
    for g, n in grams.items():
        levels[len(g)][g] = n
    for k in range(ORDER, 1, -1):
        for g in levels[k]:
            if g[0] != EDGE or k > 1:
                levels[k - 1][g[1:]] = levels[k - 1].get(g[1:], 0) + 1
    prob: dict[str, float] = {}
    back: dict[str, float] = {}
    letters = len(levels[1]) + 1
    for k in range(1, ORDER + 1):
        counts = levels[k]
        d = _discount(np.array(list(counts.values()) or [1]))
        total: Counter = Counter()
        kinds: Counter = Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            kinds[g[:-1]] += 1
        for c in total:
            back[c] = d * kinds[c] / total[c]
        for g, n in counts.items():
            lower = prob.get(g[1:], 1e-9) if k > 1 else 1 / letters
            prob[g] = max(n - d, 0) / total[g[:-1]] + back[g[:-1]] * lower
    floor = back.get("", 1.0) / letters
    prob[""] = floor
    return {g: float(np.log(p)) for g, p in prob.items()}, {g: float(np.log(b)) for g, b in back.items() if g}


class Identifier:
    """Sorted hash arrays of all languages."""

    def __init__(self, models: dict[str, Counter]):
        self.languages = sorted(models)
        fitted = [kneser_ney(models[x]) for x in self.languages]
        if len(fitted) * sum(len(p) + len(b) for p, b in fitted) > MOST_CELLS:
            raise ValueError("too many n-grams for a model in memory: give a smaller sample per language")
        self.unknown = np.array([p[""] for p, _ in fitted], np.float32)
        self.keys, self.prob, self.back = [], [], []
        for k in range(1, ORDER + 1):
            grams = sorted({g for p, b in fitted for x in (p, b) for g in x if len(g) == k})
            hashes = np.array([hash_of(g) for g in grams], np.uint64)
            order = np.argsort(hashes)
            self.keys.append(hashes[order])
            self.prob.append(np.array([[p.get(grams[i], np.nan) for p, _ in fitted] for i in order], np.float32).reshape(len(grams), -1))
            self.back.append(np.array([[b.get(grams[i], 0.0) for _, b in fitted] for i in order], np.float32).reshape(len(grams), -1))
        self.temperature, self.reject = 1.0, np.full(len(self.languages), np.inf)

    def words(self, found: list[str]) -> np.ndarray:
        """Summed log probability of each word with its closing edge."""
        joined = "".join(EDGE + w + EDGE for w in found)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in found])
        first = np.cumsum(size) - size
        depth = np.arange(len(codes)) - np.repeat(first, size)
        score = np.zeros((len(codes), len(self.languages)), np.float32)
        before = None
        for k, h in enumerate(gram_hashes(codes)):
            keys = self.keys[k]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            seen = (keys[at] == h) & (depth >= k)
            own = np.where(seen[:, None], self.prob[k][at], np.nan)
            if k == 0:
                score = np.where(np.isnan(own), self.unknown, own)
            else:
                score = np.where(np.isnan(own), score + np.where((depth >= k)[:, None], np.vstack([np.zeros((1, score.shape[1]), np.float32), before[:-1]]), 0), own)
            before = np.where(seen[:, None], self.back[k][at], 0)
        score[first] = 0
        return np.add.reduceat(score.astype(np.float64), first, axis=0)


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            seen: Counter = Counter()
            for text in part["text"]:
                if text:
                    seen.update(_letters(text.lower()))
            grams: Counter = Counter()
            for w, n in seen.items():
                x = EDGE + w + EDGE
                for i in range(2, len(x) + 1):
                    grams[x[max(0, i - ORDER) : i]] += n
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})


class WordScores:
    """word -> row of a growing matrix of scores, emptied beyond ``limit``."""

    def __init__(self, model: Identifier, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages)))

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in each language, and its letters."""
        found = [_letters(t.lower()) if t else [] for t in texts]
        n = len(self.model.languages)
        entropy, size = np.zeros((len(found), n)), np.zeros(len(found), np.int64)
        for k, tokens in enumerate(found):
            if not tokens:
                continue
            new = [w for w in dict.fromkeys(tokens) if w not in self.place]
            if new:
                if len(self.place) > self.limit:
                    self.clear()
                    new = list(dict.fromkeys(tokens))
                for at in range(0, len(new), 50_000):
                    part = new[at : at + 50_000]
                    base = len(self.place)
                    self.place.update((w, base + i) for i, w in enumerate(part))
                    if base + len(part) > len(self.rows):
                        self.rows = np.vstack([self.rows, np.zeros((max(20_000, len(part), len(self.rows)), n))])
                    self.rows[base : base + len(part)] = self.model.words(part)
            at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
            size[k] = sum(map(len, tokens)) + len(tokens)
            entropy[k] = -self.rows[at].sum(axis=0) / size[k]
        return entropy, size


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Identifier | None:
    labelled = docs.where("lang is not null and text is not null").where(crc_of_id(F.col("doc_id")) % 4 != 2).select("doc_id", "lang", "text")
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).withColumnRenamed("lang", "c_lang")
    known = counts.limit(MOST_BROADCAST + 1).collect()
    per_language = min(per_language, max(1, MOST_DOCS // max(1, len(known))))
    if len(known) <= MOST_BROADCAST:
        # so that no text is shuffled by its language to be sampled
        counts = F.broadcast(docs.sparkSession.createDataFrame(known, counts.schema))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    chosen = labelled.join(counts, F.col("lang") == F.col("c_lang")).where(draw * F.col("rows") < per_language).withColumn("fifth", F.pmod(F.xxhash64("doc_id", F.lit("fifth")), F.lit(5)))
    got = chosen.where("fifth > 0").select("lang", "text").mapInPandas(_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return None
    models = {lang: Counter(dict(zip(part["gram"], part["n"]))) for lang, part in got.groupby("lang")}
    model = Identifier(models)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(model)
        for batch in batches:
            e, n = scores.texts(batch["text"])
            yield pd.DataFrame({"lang": batch["lang"], "size": n, "entropy": list(e)})

    seen = chosen.where("fifth = 0").select("lang", "text").mapInPandas(rows, "lang string, size long, entropy array<double>").toPandas()
    seen = seen[(seen["size"] > 0) & seen["lang"].isin(model.languages)]
    if len(seen):
        e = np.stack(seen["entropy"].to_list())
        truth = seen["lang"].map({x: i for i, x in enumerate(model.languages)}).to_numpy()
        loss = {t: -np.log(np.maximum(posterior(e, seen["size"].to_numpy(), t)[np.arange(len(e)), truth], 1e-12)).mean() for t in TEMPERATURES}
        model.temperature = min(loss, key=loss.get)
        own = e[np.arange(len(e)), truth]
        model.reject = np.array([np.quantile(own[truth == i], 0.999) * 1.25 if (truth == i).any() else np.inf for i in range(len(model.languages))])
    return model


def posterior(entropy: np.ndarray, size: np.ndarray, temperature: float) -> np.ndarray:
    z = -entropy * size[:, None] * temperature
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Identifier | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.  ``rejected``
    marks texts whose cross-entropy no learned language explains."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(model) if model else None
        for batch in batches:
            n = len(batch)
            lang, score, rejected = np.full(n, UNDETERMINED, object), np.zeros(n), np.ones(n, bool)
            if model:
                e, size = scores.texts(batch["text"])
                best = e.argmin(axis=1)
                p = posterior(e, size, model.temperature)[np.arange(n), best]
                have = size > 0
                lang[have] = np.array(model.languages, object)[best[have]]
                score[have] = p[have]
                rejected = ~have | (e[np.arange(n), best] > model.reject[best])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": lang, "score": score, "rejected": rejected})

    marked = docs.select("doc_id", F.coalesce(crc_of_id(F.col("doc_id")) % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return marked.mapInPandas(rows, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return predict(docs, train(docs))
