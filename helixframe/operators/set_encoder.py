"""Set encoders over mutation tokens, trained by distributed gradients.

A token is the sum of the embeddings of its ids; tokens are averaged into genes,
and the genes of a sample are pooled by mean, maximum and sum over the root of
their number.  The pools, with any dense features beside them, go through one
hidden layer to the classes.  The flat form pools tokens without genes between.

Every step is one pass over the rows: tasks turn their samples into arrays of ids
with segment numbers, sum the gradient of the weighted loss, and send it in
slices of ``SLICE`` numbers that are added up where they meet.  The driver holds
the parameters alone, which grow with the vocabulary and not with the rows, and
takes AdamW steps on a cosine; the parameters of the best loss on held-out rows
stay, and training ends when it has not fallen for ``patience`` steps.

Defined results: a sample without tokens has pools of 0; ids beyond the
vocabulary count as 0, the unknown; an empty table leaves the parameters as
drawn.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from helixframe.sources.shared import write_once

IDS = ("gene_id", "kind_id", "ref_id", "alt_id", "position_id")
SLICE = 65_536


def collated(tokens: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, ids): every sample's tokens as flat ids, gene by gene, from the
    rows of the ``token_ids`` plan."""
    rows = tokens.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in IDS]))).alias("t"))
    flat = F.flatten(F.transform("t", lambda t: F.array(*[t[c] for c in IDS])))
    return samples.join(rows, "sample_id", "left").withColumn("ids", F.coalesce(flat, F.array().cast("array<int>"))).drop("t")


def segments(batch: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token ids (n, 5), each token's gene segment, each gene segment's sample."""
    parts = [np.asarray(x, np.int64).reshape(-1, len(IDS)) for x in batch]
    ids = np.concatenate(parts) if parts else np.zeros((0, len(IDS)), np.int64)
    sample = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    fresh = np.r_[True, (np.diff(sample) != 0) | (np.diff(ids[:, 0]) != 0)][: len(ids)]
    return ids, np.cumsum(fresh) - 1, sample[fresh]


class SetEncoder:
    """``fit`` reads ids, y and weight, and x (an array) where ``dense`` is not 0;
    ``transform`` adds ``proba``."""

    def __init__(self, sizes: Sequence[int], dense: int = 0, size: int = 16, hidden: int = 32, genes: bool = True, steps: int = 60, rate: float = 0.02, decay: float = 0.01, smoothing: float = 0.0, focal: float = 0.0, patience: int = 12, seed: int = 42):
        self.sizes, self.dense, self.size, self.hidden, self.genes = tuple(sizes), dense, size, hidden, genes
        self.steps, self.rate, self.decay, self.smoothing, self.focal, self.patience, self.seed = steps, rate, decay, smoothing, focal, patience, seed

    def draw(self, classes: int) -> dict[str, np.ndarray]:
        rng, width = np.random.default_rng(self.seed), 3 * self.size + self.dense
        out = {f"e{k}": rng.normal(0, 0.3, (n, self.size)) for k, n in enumerate(self.sizes)}
        return out | {"w": rng.normal(0, width**-0.5, (width, self.hidden)), "b": np.zeros(self.hidden), "v": rng.normal(0, self.hidden**-0.5, (self.hidden, classes)), "c": np.zeros(classes)}

    def forward(self, p: dict[str, np.ndarray], batch: pd.DataFrame) -> tuple:
        ids, gene, sample = segments(batch["ids"])
        n, d = len(batch), self.size
        ids = np.where(ids < np.array(self.sizes), ids, 0)
        tokens = np.maximum(sum(p[f"e{k}"][ids[:, k]] for k in range(len(IDS))), 0)
        if self.genes:
            per_gene = np.bincount(gene, minlength=len(sample)).astype(float)
            items = np.zeros((len(sample), d))
            np.add.at(items, gene, tokens)
            items /= np.maximum(per_gene, 1)[:, None]
        else:
            items, sample = tokens, sample[gene]
        count = np.maximum(np.bincount(sample, minlength=n), 1).astype(float)[:, None]
        total, top = np.zeros((n, d)), np.full((n, d), -np.inf)
        np.add.at(total, sample, items)
        np.maximum.at(top, sample, items)
        top = np.where(np.isinf(top), 0, top)
        extra = np.stack(batch["x"].to_list()) if self.dense else np.zeros((n, 0))
        pooled = np.hstack([total / count, top, total / np.sqrt(count), np.nan_to_num(extra)])
        inner = np.maximum(pooled @ p["w"] + p["b"], 0)
        z = inner @ p["v"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        return ids, gene, sample, tokens, items, count, top, pooled, inner, q / q.sum(axis=1, keepdims=True)

    def loss(self, q: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
        """Weighted sum of the smoothed and focused cross-entropy, and its gradient
        by the logits."""
        k = q.shape[1]
        t = np.full(q.shape, self.smoothing / k)
        t[np.arange(len(y)), y] += 1 - self.smoothing
        log_q = np.log(np.maximum(q, 1e-12))
        entropy, true = -(t * log_q).sum(axis=1), q[np.arange(len(y)), y]
        focus = (1 - true) ** self.focal
        slope = q - t
        own = np.zeros_like(q)
        own[np.arange(len(y)), y] = 1
        turn = -self.focal * (1 - true) ** max(self.focal - 1, 0) * true if self.focal else np.zeros(len(y))
        gradient = weight[:, None] * (focus[:, None] * slope + (entropy * turn)[:, None] * (own - q))
        return float((weight * focus * entropy).sum()), gradient

    def gradient(self, p: dict[str, np.ndarray], batch: pd.DataFrame) -> tuple[float, dict[str, np.ndarray]]:
        ids, gene, sample, tokens, items, count, top, pooled, inner, q = self.forward(p, batch)
        value, dz = self.loss(q, batch["y"].to_numpy(), batch["weight"].to_numpy())
        g = {"v": inner.T @ dz, "c": dz.sum(axis=0)}
        di = dz @ p["v"].T * (inner > 0)
        g |= {"w": pooled.T @ di, "b": di.sum(axis=0)}
        dp, d = di @ p["w"].T, self.size
        first = (items == top[sample]) & (items > 0)
        ties = np.zeros_like(top)
        np.add.at(ties, sample, first.astype(float))
        ditems = (dp[:, :d] / count + dp[:, 2 * d : 3 * d] / np.sqrt(count))[sample] + np.where(first, dp[:, d : 2 * d][sample] / np.maximum(ties[sample], 1), 0)
        dtokens = (ditems / np.maximum(np.bincount(gene, minlength=len(items)), 1)[:, None])[gene] if self.genes else ditems
        dtokens = dtokens * (tokens > 0)
        for k, n in enumerate(self.sizes):
            g[f"e{k}"] = np.zeros((n, d))
            np.add.at(g[f"e{k}"], ids[:, k], dtokens)
        return value, g

    def _flat(self, p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[k].ravel() for k in self.names])

    def _shaped(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        return {k: x.reshape(s) for k, x, s in zip(self.names, np.split(flat, ends[:-1]), self.shapes)}

    def _pass(self, rows: DataFrame, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient over the train rows; (loss, weight) of train and held rows."""
        own, size = self, len(flat)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            p, total, sums = own._shaped(flat), np.zeros(size), np.zeros(4)
            for batch in batches:
                held = batch["held"].to_numpy(bool)
                train, test = batch[~held], batch[held]
                if len(train):
                    value, g = own.gradient(p, train)
                    total += own._flat(g)
                    sums[:2] += value, train["weight"].sum()
                if len(test):
                    sums[2:] += own.loss(own.forward(p, test)[-1], test["y"].to_numpy(), test["weight"].to_numpy())[0], test["weight"].sum()
            whole = np.r_[sums, total]
            yield pd.DataFrame({"slot": range(0, len(whole), SLICE), "part": [whole[k : k + SLICE].tobytes() for k in range(0, len(whole), SLICE)]})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"slot": group["slot"].iloc[:1], "part": [sum(np.frombuffer(x, np.float64) for x in group["part"]).tobytes()]})

        got = rows.mapInPandas(run, "slot long, part binary").groupBy("slot").applyInPandas(add, "slot long, part binary").toPandas().sort_values("slot")
        whole = np.frombuffer(b"".join(got["part"]), np.float64) if len(got) else np.zeros(4 + size)
        return whole[4:], whole[:4]

    def fit(self, table: DataFrame, classes: int) -> SetEncoder:
        drawn = self.draw(classes)
        self.names, self.shapes = list(drawn), [x.shape for x in drawn.values()]
        held = F.pmod(F.xxhash64("sample_id", F.lit(self.seed)), F.lit(8)) == 0
        rows = write_once(table.select("ids", F.col("y").cast("long").alias("y"), F.col("weight").cast("double").alias("weight"), held.alias("held"), *(["x"] if self.dense else [])), "sets")
        flat = self._flat(drawn)
        one, two = np.zeros_like(flat), np.zeros_like(flat)
        best, stale, self.best = np.inf, 0, flat
        self.losses: list[tuple[float, float]] = []
        for step in range(1, self.steps + 1):
            gradient, (loss, weight, held_loss, held_weight) = self._pass(rows, flat)
            if not weight:
                break
            seen = held_loss / held_weight if held_weight else loss / weight
            self.losses.append((loss / weight, seen))
            stale = 0 if seen < best - 1e-6 else stale + 1
            if not stale:
                best, self.best = seen, flat.copy()
            if stale > self.patience:
                break
            gradient = gradient / weight
            one, two = 0.9 * one + 0.1 * gradient, 0.999 * two + 0.001 * gradient**2
            rate = self.rate * 0.5 * (1 + np.cos(np.pi * (step - 1) / self.steps))
            flat = flat - rate * (one / (1 - 0.9**step) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8) + self.decay * flat)
        return self

    def predict(self, batch: pd.DataFrame) -> np.ndarray:
        return self.forward(self._shaped(self.best), batch)[-1]

    def transform(self, table: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(ArrayType(DoubleType()))
        def proba(ids: pd.Series, x: pd.Series) -> pd.Series:
            return pd.Series(list(model.predict(pd.DataFrame({"ids": ids, "x": x}))) if len(ids) else [], dtype=object)

        return table.withColumn("proba", proba("ids", F.col("x") if self.dense else F.array(F.lit(0.0))))
