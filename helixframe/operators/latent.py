"""Latent bases over the gene dimension: SVD, NMF, gene modules.

The gene dimension is bounded (thousands), the sample dimension is not: Gram
and factor sums over samples are made in Spark, gene-sized algebra on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_GENES = 20_000


def matrix(variants: DataFrame, train: str = "sample_id % 5 <> 0", least: int = 5) -> tuple[DataFrame, list[str]]:
    """(sample_id, gene, value) with idf weights and unit rows; genes of at
    least ``least`` train samples."""
    genes = variants.select("sample_id", "gene").distinct()
    n = genes.where(train).select("sample_id").distinct().count()
    df = genes.where(train).groupBy("gene").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    names = [r["gene"] for r in df.orderBy("gene").limit(MOST_GENES + 1).collect()]
    if len(names) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    raw = genes.join(df, "gene").withColumn("w", F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    # Added up in the order of the genes, so that equal sets have equal rows to the last bit.
    rows = raw.where("sample_id is not null").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("gene", "w"))).alias("r"))
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, v: s + v["w"] * v["w"]))
    return rows.select("sample_id", norm.alias("norm"), F.explode("r").alias("r")).select("sample_id", F.col("r.gene").alias("gene"), (F.col("r.w") / F.col("norm")).alias("value")), names


def packed(genes: DataFrame, train: str = "sample_id % 5 <> 0", least: int = 5) -> tuple[DataFrame, list[str]]:
    """The rows of ``matrix`` as (sample_id, places, values), out of distinct
    (sample_id, gene); the other functions take these for the matrix."""
    n = genes.where(train).select("sample_id").distinct().count()
    found = genes.where(train).groupBy("gene").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least).orderBy("gene").limit(MOST_GENES + 1).collect()
    if len(found) > MOST_GENES:
        raise ValueError(f"more than {MOST_GENES} genes")
    w = genes.sparkSession.createDataFrame([(r["gene"], k, float(np.log((1 + n) / (1 + r["df"])) + 1)) for k, r in enumerate(found)], "gene string, place int, w double")
    rows = genes.join(F.broadcast(w), "gene").where("sample_id is not null").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("place", "w"))).alias("r"))
    norm = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, v: s + v["w"] * v["w"]))
    return rows.withColumn("norm", norm).select("sample_id", F.col("r.place").alias("places"), F.transform("r", lambda v: v["w"] / F.col("norm")).alias("values")), [r["gene"] for r in found]


def gram(x: DataFrame, names: list[str]) -> np.ndarray:
    out = np.zeros((len(names), len(names)))
    if len(names) <= DENSE_GENES:

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(out.shape)
            for batch in batches:
                for dense, n in _dense(batch, len(total)):
                    total += (dense * n[:, None]).T @ dense
            yield pa.RecordBatch.from_pydict({"part": np.arange(len(total)), "row": list(total)})

        got = fit_rows(x, names).mapInArrow(sums, "part long, row array<double>").select("part", F.posexplode("row")).groupBy("part", "pos").agg(F.sum("col").alias("v")).toPandas()
        out[got["part"], got["pos"]] = got["v"]
        return out
    if "places" in x.columns:
        known = x.sparkSession.createDataFrame(list(enumerate(names)), "place int, gene string")
        x = x.select("sample_id", F.explode(F.arrays_zip("places", "values")).alias("r")).select("sample_id", F.col("r.places").alias("place"), F.col("r.values").alias("value")).join(known, "place")
    pairs = x.alias("a").join(x.alias("b"), "sample_id").where("a.gene <= b.gene").groupBy(F.col("a.gene").alias("g"), F.col("b.gene").alias("h")).agg(F.sum(F.col("a.value") * F.col("b.value")).alias("s")).toPandas()
    at = {g: i for i, g in enumerate(names)}
    i, j = pairs["g"].map(at).to_numpy(), pairs["h"].map(at).to_numpy()
    out[i, j] = out[j, i] = pairs["s"]
    return out


def svd_components(x: DataFrame, names: list[str], k: int) -> np.ndarray:
    """Right singular vectors, k x genes, signs fixed by the largest entry."""
    values, vectors = np.linalg.eigh(gram(x, names))
    out = vectors[:, np.argsort(-values)[:k]].T
    return out * np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])[:, None]


def _packed(x: DataFrame) -> DataFrame:
    """sample_id, genes, values: a sample's row, genes in order."""
    row = F.sort_array(F.collect_list(F.struct("gene", "value")))
    return x.groupBy("sample_id").agg(row.alias("r")).select("sample_id", F.col("r.gene").alias("genes"), F.col("r.value").alias("values"))


def fit_rows(x: DataFrame, names: list[str]) -> DataFrame:
    """n, places, values: the rows of the matrix, each once; ``n`` samples have it."""
    lists = ["places", "values"] if "places" in x.columns else ["genes", "values"]
    equal = (x if "places" in x.columns else _packed(x)).groupBy(lists).agg(F.count(F.lit(1)).alias("n"))
    return equal.select("n", *lists) if "places" in x.columns else _placed(equal, names, "n")


def _placed(rows: DataFrame, names: list[str], other: str) -> DataFrame:
    """Genes as places in ``names``; genes that are not among those are left out."""
    known = pa.array(names, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            genes, values = batch["genes"], batch["values"]
            places, sizes = pc.index_in(genes.flatten(), known), pc.fill_null(pc.list_value_length(genes), 0).to_numpy(zero_copy_only=False)
            found = places.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(found)])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), part.filter(pa.array(found))) for part in (places, values.flatten())]
            yield pa.RecordBatch.from_arrays([batch[other].cast(pa.int64()), *lists], ["key", "places", "values"])

    return rows.select(other, "genes", "values").mapInArrow(run, "key long, places array<int>, values array<double>").withColumnRenamed("key", other)


#: Rows that are dense at a time, so that they stay in a core's cache; genes
#: up to which a task holds a square of them; cells of the matrix, equal rows once, up
#: to which the driver holds it.
DENSE_ROWS, DENSE_GENES, MOST_CELLS = 2_000, 1_000, 5_000_000


def _dense(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dense rows and their first column, some at a time."""
    flat = lambda name: batch[name].flatten().to_numpy(zero_copy_only=False)
    places, values, key = flat("places"), flat("values"), batch[0].to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(batch["places"].value_lengths().to_numpy(zero_copy_only=False))])
    for start in range(0, len(key), DENSE_ROWS):
        stop = min(start + DENSE_ROWS, len(key))
        part = slice(ends[start], ends[stop])
        out = np.zeros((stop - start, width))
        out[np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1])), places[part]] = values[part]
        yield out, key[start:stop]


def project(x: DataFrame, names: list[str], basis: np.ndarray, nonnegative: bool = False, rounds: int = 60) -> DataFrame:
    """sample_id, latent (array<double>): X basis', or the nonnegative weights
    that the fixed basis gives by multiplicative updates."""
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dense, key in _dense(batch, width):
                found = weights(dense, basis, rounds) if nonnegative else dense @ basis.T
                ends = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32) if found.shape[1] else np.zeros(len(key) + 1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))], ["sample_id", "latent"])

    rows = x.select("sample_id", "places", "values") if "places" in x.columns else _placed(_packed(x), names, "sample_id")
    return rows.mapInArrow(run, "sample_id long, latent array<double>")


def weights(x: np.ndarray, h: np.ndarray, rounds: int) -> np.ndarray:
    w = np.full((len(x), len(h)), 1 / len(h))
    top, square = x @ h.T, h @ h.T
    below = np.empty_like(w)
    for _ in range(rounds):
        np.matmul(w, square, out=below)
        below += 1e-12
        np.divide(top, below, out=below)
        w *= below
    return w


def nmf_components(x: DataFrame, names: list[str], k: int, rounds: int = 200, seed: int = 42, tolerance: float = 1e-4) -> np.ndarray:
    """Multiplicative updates: tasks give sums of W'X and W'W, the driver
    updates the k x genes basis, up to ``rounds`` times, or until the error falls
    by less than ``tolerance`` of the first in ten rounds.  Equal rows are one row
    with a count; where few are left, the driver makes the sums."""
    fitted = fit_rows(x, names).checkpoint()
    square = fitted.select(F.sum(F.col("n") * F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0
    errors: list[float] = []
    width = len(names)
    h = np.random.default_rng(seed).random((k, width)) + 0.1

    few = fitted.count() * width <= MOST_CELLS
    held = fitted.toArrow().to_batches() if few else []

    def sums(batches: Iterable[pa.RecordBatch], now: np.ndarray) -> np.ndarray:
        both = np.zeros((k, width + k))
        for batch in batches:
            for dense, n in _dense(batch, width):
                w = weights(dense, now, 10)
                both += (w * n[:, None]).T @ np.hstack([dense, w])
        return both

    for _ in range(rounds):
        now = h.copy()

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"part": np.arange(k), "both": list(sums(batches, now))})  # noqa: B023

        if few:
            total = sums(held, now)
        else:
            got = fitted.mapInArrow(part, "part long, both array<double>").select("part", F.posexplode("both")).groupBy("part", "pos").agg(F.sum("col").alias("v")).toPandas()
            total = np.zeros((k, width + k))
            total[got["part"], got["pos"]] = got["v"]
        wx, ww = total[:, :width], total[:, width:]
        errors.append(float(np.sqrt(max(0.0, square - 2 * (wx * h).sum() + (ww * (h @ h.T)).sum()))))
        if len(errors) > 10 and len(errors) % 10 == 1 and errors[-11] - errors[-1] < tolerance * errors[0]:
            break
        h *= wx / (ww @ h + 1e-12)
    return h


def gene_modules(x: DataFrame, names: list[str], k: int = 5, components: int = 8, seed: int = 42, basis: np.ndarray | None = None) -> DataFrame:
    """module, gene, distance_to_centroid, module_size: k-means over the unit
    loadings of genes, by singular vectors that the caller may have."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    basis = (svd_components(x, names, min(components, len(names) - 1)) if basis is None else basis).T
    unit = basis / np.maximum(np.linalg.norm(basis, axis=1, keepdims=True), 1e-12)
    table = x.sparkSession.createDataFrame([(g, [float(v) for v in unit[i]]) for i, g in enumerate(names)], "gene string, profile array<double>").withColumn("features", array_to_vector("profile"))
    model = KMeans(k=min(k, len(names)), seed=seed, maxIter=50).fit(table)
    centers = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    placed = model.transform(table).withColumn("p", vector_to_array("features")).withColumn("c", centers[F.col("prediction")])
    distance = F.sqrt(F.aggregate(F.zip_with("p", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    sizes = placed.groupBy("prediction").agg(F.count(F.lit(1)).alias("module_size"))
    return placed.join(sizes, "prediction").select(F.col("prediction").alias("module"), "gene", distance.alias("distance_to_centroid"), "module_size")


def alignment(one: np.ndarray, two: np.ndarray) -> float:
    """Mean cosine of the principal angles of two row spaces."""
    q, r = (np.linalg.qr(m.T)[0] for m in (one, two))
    return float(np.clip(np.linalg.svd(q.T @ r, compute_uv=False), 0, 1).mean())
