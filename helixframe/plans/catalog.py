"""The query catalogue of the variant operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import ensemble, groups, latent, models, reports, set_encoder
from helixframe.operators.relations import STAR, apply, run_text
from helixframe.plans.configs import dense_matrix
from helixframe.plans.independent import QUERIES, second
from helixframe.plans.matrices import MATRIX_PLANS, dense_text, long_matrix
from helixframe.plans.oracle import oracle
from helixframe.plans.portable import _FREQ_KEYS, _PREDS
from helixframe.plans.reports import ALL_PLANS
from helixframe.sources.shared import shared_dir, write_once
from helixframe.sources.tables import star_dealt, star_samples, star_variants
from helixframe.streaming.scoring import event_windows

Query = Callable[[SparkSession, str], DataFrame]


def base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    variants = star_variants(spark, sf_dir)
    return variants, star_samples(spark, sf_dir, variants)


def written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The base relations with the tokens written once, for plans that read them
    several times."""
    variants = write_once(base(spark, sf_dir)[0], "tokens")
    return variants, star_samples(spark, sf_dir, variants)


def plan(name: str) -> Query:
    """A portable plan; one that reads the tokens more than twice, its cells and
    words included, has them written first.  Keys of families are read twice."""
    text = ALL_PLANS[name]
    reads = sum(text.count("{" + r + "}") for r in ("variants", "cellkeys", "words", "sigbuckets", "comutpairs")) * (2 if _FREQ_KEYS in text else 1)
    return lambda spark, sf_dir: apply(name, *(written if reads > 2 else base)(spark, sf_dir), STAR)


def text_query(text: str) -> Query:
    return lambda spark, sf_dir: run_text(spark, text, *written(spark, sf_dir), STAR)


def _labelled_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Probabilities of three synthetic members as arrays in class order."""
    rows = run_text(spark, f"WITH {_PREDS} SELECT sample_id, member, y_true, cls, ci, p FROM preds", *base(spark, sf_dir))
    arrays = rows.groupBy("sample_id", "member", "y_true").agg(F.transform(F.sort_array(F.collect_list(F.struct("ci", "p"))), lambda x: x["p"]).alias("proba"))
    classes = [r["cls"] for r in rows.select("cls").distinct().orderBy("cls").collect()]
    return arrays, classes


def _rows(spark: SparkSession, preds: DataFrame, classes: list[str]) -> ensemble.Rows:
    shared_dir(spark)
    return ensemble.searched(*ensemble.pack(preds, classes), len(classes))


def blend_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, classes = _labelled_members(spark, sf_dir)
    rows = _rows(spark, preds, classes)
    found = ensemble.MacroF1Blender().fit(rows)
    return ensemble.apply_weights(preds, {i + 1: float(w) for i, w in enumerate(found.weights_)})


def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, classes = _labelled_members(spark, sf_dir)
    rows = _rows(spark, preds, classes)
    found = ensemble.GreedySelector().fit(rows)
    return spark.createDataFrame([(i + 1, float(w)) for i, w in enumerate(found.weights_)], "member int, weight double")


def logit_bias_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, classes = _labelled_members(spark, sf_dir)
    rows = _rows(spark, preds, classes)
    found = ensemble.LogitBias().fit(rows)
    return ensemble.apply_bias(preds.where("member = 1").select("sample_id", "proba"), found.bias_)


def crossfit_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, classes = _labelled_members(spark, sf_dir)
    shared_dir(spark)
    packed, members = ensemble.pack(preds, classes, F.col("sample_id") % 5)
    learned = ensemble.crossfit(ensemble.searched(packed, members, len(classes)))
    return ensemble.apply_crossfit(packed, learned, members, len(classes))


#: Folds of the registered model queries.  Models that take many jobs a fold
#: have two; the operators take any.
FOLDS = {"rf": 5, "logistic": 5, "ridge": 5}


def _ready(spark: SparkSession, sf_dir: str, folds: int) -> DataFrame:
    table = write_once(dense_matrix("f1", *written(spark, sf_dir)).withColumn("fold", F.col("sample_id") % folds), "dense")
    columns = [c for c in table.columns if c not in ("sample_id", "label", "fold")]
    return models.assemble(table, columns).checkpoint()


def model_oof(name: str) -> Query:
    return lambda spark, sf_dir: models.out_of_fold(_ready(spark, sf_dir, FOLDS.get(name, 2)), name)


def stack_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic model over the members' logits, fitted across folds."""
    return _stacked(spark, sf_dir, "logistic")


def stack_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge regression over the members' logits, fitted across folds."""
    return _stacked(spark, sf_dir, "ridge")


def _stacked(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    preds, _ = _labelled_members(spark, sf_dir)
    logits = F.transform("proba", lambda p: F.log(p) - F.log(1 - p))
    wide = preds.withColumn("z", logits).groupBy("sample_id", F.col("y_true").alias("label")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("member", "z"))), lambda x: x["z"])).alias("z"))
    shared_dir(spark)
    wide = wide.checkpoint()
    width = len(wide.first()["z"])
    table = wide.select("sample_id", "label", (F.col("sample_id") % 2).alias("fold"), *[F.col("z")[k].alias(f"z{k}") for k in range(width)])
    return models.out_of_fold(models.assemble(table, [f"z{k}" for k in range(width)]).checkpoint(), model)


def set_encoder_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, fold, y_true, proba of set encoders over the tokens, each fold
    predicted by one trained on the other."""
    variants, samples = written(spark, sf_dir)
    tokens = apply("token_ids", variants, samples, STAR)
    table = write_once(set_encoder.collated(tokens, samples), "collated")
    classes = [r["label"] for r in samples.select("label").distinct().orderBy("label").collect()]
    sizes = tokens.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in set_encoder.IDS]).first()
    place = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, k)])
    counts = table.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    total = table.count()
    ready = table.join(F.broadcast(counts), "label").select("sample_id", "label", "ids", place[F.col("label")].alias("y"), (F.lit(total) / (len(classes) * F.col("c"))).alias("weight"), (F.col("sample_id") % 2).alias("fold"))
    out = None
    for fold in (0, 1):
        model = set_encoder.SetEncoder([n + 1 for n in sizes], steps=15).fit(ready.where(F.col("fold") != fold), len(classes))
        part = model.transform(ready.where(F.col("fold") == fold)).select("sample_id", "fold", F.col("label").alias("y_true"), "proba")
        out = part if out is None else out.union(part)
    return out


def svd_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, names = latent.matrix(star_variants(spark, sf_dir))
    train = x.where("sample_id % 5 <> 0")
    return latent.project(x, names, latent.svd_components(train, names, min(8, len(names) - 1)))


def nmf_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    x, names = latent.matrix(star_variants(spark, sf_dir))
    h = latent.nmf_components(x.where("sample_id % 5 <> 0"), names, min(64, len(names) - 1))
    return latent.project(x, names, h, nonnegative=True)


def gene_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, names = latent.matrix(star_variants(spark, sf_dir))
    return latent.gene_modules(x.where("sample_id % 5 <> 0"), names)


def twin_groups_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    variants, samples = base(spark, sf_dir)
    return groups.twin_groups(variants, samples)


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.stratified_folds(base(spark, sf_dir)[1])


def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_folds(groups.group_keys(groups.profiles(*base(spark, sf_dir))))


def frame_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.fingerprint(base(spark, sf_dir)[1], ["sample_id", "label"])


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("sample_id"), F.col("source").alias("label"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("profile_hash"), F.lit(3).alias("n_genes"))
    return docs.where("sample_id % 2 = 0"), docs.where("sample_id % 2 = 1")


SOURCE_PAIRS = {f"src{k}": f"src{k ^ 1}" for k in range(10)}


def pair_rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.pair_rule(*_halves(spark, sf_dir), pairs=SOURCE_PAIRS)


PAIR_SQL = """WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '')) AS profile FROM documents),
one AS (SELECT profile, min(source) AS matched_label FROM h WHERE doc_id % 2 = 0 GROUP BY profile HAVING count(*) = 1)
SELECT doc_id AS sample_id, matched_label, CASE WHEN length(matched_label) = 4 THEN 'src' || CAST(xor(CAST(substr(matched_label, 4) AS INT), 1) AS VARCHAR) END AS new_label
FROM h JOIN one USING (profile) WHERE doc_id % 2 = 1"""


def pair_rule_premises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pair_premises(_halves(spark, sf_dir)[0], SOURCE_PAIRS)


PREMISES_SQL = """WITH g AS (SELECT count(*) AS n, min(source) AS low, max(source) AS high FROM documents WHERE doc_id % 2 = 0 GROUP BY coalesce(text, '')),
kinds AS (SELECT low, CASE WHEN n = 1 AND length(low) = 4 THEN 'orphan' WHEN n > 1 AND low = high THEN 'same_label' WHEN n = 2 AND length(low) = 4 AND high = 'src' || CAST(xor(CAST(substr(low, 4) AS INT), 1) AS VARCHAR) THEN 'pair_label' END AS premise FROM g)
SELECT premise, CASE WHEN premise = 'orphan' THEN low ELSE '' END AS label, CAST(count(*) AS BIGINT) AS n FROM kinds WHERE premise IS NOT NULL GROUP BY ALL"""


def oof_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the first member's table, damaged by rule: every 97th sample is
    missing, folds are dealt over six, every 50th prediction is the true label."""
    preds, classes = _labelled_members(spark, sf_dir)
    top = reports.argmax_label(F.col("proba"), classes)
    oof = preds.where("member = 1 and sample_id % 97 <> 0").select("sample_id", (F.col("sample_id") % 6).alias("fold"), "y_true", F.when(F.col("sample_id") % 50 == 0, F.col("y_true")).otherwise(top).alias("y_pred"), "proba")
    return reports.oof_faults(oof, base(spark, sf_dir)[1], classes)


FAULTS = f"""WITH {_PREDS}, o AS (SELECT sample_id, sample_id % 6 AS fold, y_pred AS top, CASE WHEN sample_id % 50 = 0 THEN y_true ELSE y_pred END AS y_pred FROM best WHERE member = 1 AND sample_id % 97 <> 0)
SELECT {", ".join(f"CAST({how} AS BIGINT) AS {name}" for name, how in {"rows": "count(*)", "repeated_ids": "count(sample_id) - count(DISTINCT sample_id)", "bad_fold": "sum(CASE WHEN fold > 4 THEN 1 ELSE 0 END)", "unknown_label": "0", "bad_width": "0", "bad_value": "0", "bad_sum": "0", "not_argmax": "sum(CASE WHEN y_pred <> top THEN 1 ELSE 0 END)", "missing_ids": "(SELECT count(*) FROM {samples} WHERE sample_id % 97 = 0)", "unexpected_ids": "0"}.items())} FROM o"""


def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, classes = _labelled_members(spark, sf_dir)
    rows = _rows(spark, preds, classes)
    found = reports.fit_temperatures(rows, by="log_loss")
    return spark.createDataFrame([(k + 1, t) for k, t in enumerate(found)], "member int, temperature double")


def per_class_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds, classes = _labelled_members(spark, sf_dir)
    rows = _rows(spark, preds, classes)
    w = reports.PerClassBlender().fit(rows).weights_
    return spark.createDataFrame([(classes[c], m + 1, float(w[c, m])) for c in range(w.shape[0]) for m in range(w.shape[1])], "cls string, member int, weight double")


def latent_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = star_variants(spark, sf_dir)
    x, names = latent.matrix(variants)
    train = x.where("sample_id % 5 <> 0")
    basis = latent.svd_components(train, names, min(8, len(names) - 1))
    burden = variants.groupBy("sample_id").agg(F.count_distinct("gene").alias("burden"))
    return reports.latent_report(latent.project(train, names, basis), latent.project(x.where("sample_id % 5 = 0"), names, basis), burden)


def module_seed_ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the gene modules of two seeds."""
    x, names = latent.matrix(star_variants(spark, sf_dir))
    train = x.where("sample_id % 5 <> 0")
    parts = [latent.gene_modules(train, names, seed=s).select(F.col("gene").alias("item"), F.col("module").alias("part")) for s in (42, 7)]
    return reports.rand_index(*parts)


def event_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_windows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return found.select("window_start", "event_type", F.col("n").cast("long").alias("n"), F.round("total", 4).alias("total"))


EVENT_SQL = "SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def matrix_f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants, parts = star_dealt(spark, sf_dir)
    return long_matrix("f11", variants, star_samples(spark, sf_dir, variants), genes=STAR, parts=parts)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {name: plan(name) for name in ALL_PLANS}
    found |= {f.__name__: f for f in (blend_search, greedy_select, logit_bias_fit, crossfit_blend, stack_logistic, stack_ridge, set_encoder_oof, svd_projection, nmf_projection, gene_modules, twin_groups_jaccard, stratified_folds, group_folds, frame_fingerprint, pair_rule_matches, pair_rule_premises, oof_faults, temperature_fit, per_class_fit, latent_inspect, module_seed_ari, event_burden)}
    found |= {f"{name}_oof": model_oof(name) for name in models.DEFAULTS}
    found |= {name: text_query(text) for name, text in MATRIX_PLANS.items()}
    found["matrix_f4rc"] = lambda spark, sf_dir: long_matrix("f4rc", *written(spark, sf_dir), genes=STAR)
    found["matrix_f5"] = lambda spark, sf_dir: long_matrix("f5", *written(spark, sf_dir), genes=STAR)
    found["matrix_f11"] = matrix_f11
    found["dense_matrix_f1"] = lambda spark, sf_dir: dense_matrix("f1", *base(spark, sf_dir))
    return found


def oracle_sql() -> dict[str, str]:
    """SQL to compare with; plans that have a second formula are compared with
    that one."""
    found = {name: oracle(second(name)) for name in ALL_PLANS} | {name: oracle(text) for name, text in (MATRIX_PLANS | QUERIES).items()}
    found["dense_matrix_f1"] = oracle(dense_text("f1"))
    return found | {"pair_rule_matches": PAIR_SQL, "pair_rule_premises": PREMISES_SQL, "oof_faults": oracle(FAULTS), "event_burden": EVENT_SQL}
