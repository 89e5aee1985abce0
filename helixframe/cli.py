"""Command line: features, folds, matrices, training, ladders, search, blends, submissions.

    python -m helixframe.cli features sample_burden25 --input train.csv --output out/burden
    python -m helixframe.cli train rf --config f4r --input train.csv --test test.csv --output out/rf
    python -m helixframe.cli ladder --configs f1,f4r --models rf,logistic --seeds 42,7 --input train.csv --output out
    python -m helixframe.cli tune rf --trials 30 --input train.csv --output out
    python -m helixframe.cli ablate gbt --config f16 --blocks gtype,comut,lsvd,lnmf,gmod,csig --input train.csv --output out/ablation
    python -m helixframe.cli train rf --settings run.yaml --input train.csv --output out/rf
    python -m helixframe.cli blend out/a/oof.csv out/b/oof.csv --output out/blend.csv
    python -m helixframe.cli submit --sample sample.csv --predictions out/rf/test.csv --output out/submission.csv

Runs are appended to runs.jsonl in the output folder; a ladder or an ablation
leaves out what the file already holds, so that one that was stopped goes on.
``--settings`` names a JSON or YAML mapping of options, which those given on the
command line override.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import ensemble, groups, models, reports, training
from helixframe.operators.relations import apply
from helixframe.operators.study import Real, Study
from helixframe.plans.configs import CONFIGS
from helixframe.plans.matrices import long_matrix
from helixframe.plans.reports import ALL_PLANS
from helixframe.sources import predictions as P
from helixframe.sources.shared import shared_dir, write_once
from helixframe.sources.tables import build_submission, read_wide_csv, samples_of, variants_of

SPACES = {
    "rf": {"numTrees": Real(20, 300, whole=True), "maxDepth": Real(3, 14, whole=True)},
    "logistic": {"regParam": Real(1e-4, 1.0, log=True)},
    "gbt": {"rounds": Real(5, 100, whole=True), "depth": Real(2, 6, whole=True), "rate": Real(0.03, 0.5, log=True)},
    "ridge": {"penalty": Real(1e-2, 1e3, log=True)},
    "mlp": {"maxIter": Real(20, 200, whole=True)},
    "extra_trees": {"trees": Real(10, 200, whole=True), "depth": Real(3, 10, whole=True)},
}


def dealt(variants: DataFrame, samples: DataFrame, cv: str, k: int, seed: int) -> DataFrame:
    """sample_id, label, group_key, fold; ``cv`` is skf (by label) or sgkf
    (whole groups of equal profiles)."""
    grouped = groups.group_keys(groups.profiles(variants, samples)).select("sample_id", "label", "group_key")
    if cv == "sgkf":
        folds = groups.group_folds(grouped, k, seed)
        groups.check_groups(folds)
        return folds.select("sample_id", "label", "group_key", "fold")
    return grouped.join(groups.stratified_folds(samples, k, seed).select("sample_id", "fold"), "sample_id")


class Run:
    """What the training commands share: cells read once, folds, the log."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.args, self.out = args, Path(args.output)
        train = read_wide_csv(spark, args.input)
        self.variants, samples = variants_of(train), samples_of(train)
        self.variants = write_once(self.variants, "tokens")
        self.folds = write_once(dealt(self.variants, samples, args.cv, args.folds, args.fold_seed), "folds")
        self.classes = [r["label"] for r in samples.select("label").distinct().orderBy("label").collect()]
        self.rows = self.folds
        if args.test:
            ahead = read_wide_csv(spark, args.test, label=False)
            self.variants = write_once(self.variants.unionByName(variants_of(ahead)), "tokens")
            self.rows = self.folds.unionByName(ahead.select("sample_id").distinct(), allowMissingColumns=True)

    @cached_property
    def cache(self) -> training.FoldCache:
        return training.FoldCache(self.variants, self.rows)

    def one(self, model: str, config: str, folder: Path | None = None, blocks: tuple[str, ...] | None = None, **params) -> float:
        """Train on a named configuration, or on ``blocks`` under the name and the
        weighting of ``config`` (before a colon, if it has one)."""
        began = time.monotonic()
        oof, test = training.train_config(self.variants, self.rows, blocks or config, model, CONFIGS[config.split(":")[0]][1], self.classes, self.cache, **params)
        score = training.oof_score(oof, self.classes)
        if folder is not None:
            folder.mkdir(parents=True, exist_ok=True)
            P.write_csv_file(P.prediction_frame(oof.withColumnRenamed("sample_id", "ID"), self.classes), str(folder / "oof.csv"), overwrite=self.args.overwrite)
            if self.args.test:
                P.write_csv_file(P.prediction_frame(test.withColumnRenamed("sample_id", "ID"), self.classes), str(folder / "test.csv"), overwrite=self.args.overwrite)
            row = {"stem": f"{model}_{config}_{self.args.cv}", "seed": params.get("seed", models.DEFAULTS[model].get("seed", 0)), "macro_f1": score, "seconds": round(time.monotonic() - began, 1), "params": params}
            self.out.mkdir(parents=True, exist_ok=True)
            with (self.out / "runs.jsonl").open("a") as log:
                log.write(json.dumps(row) + "\n")
        return score


def logged(folder: Path) -> list[dict]:
    path = folder / "runs.jsonl"
    return [json.loads(line) for line in path.read_text().splitlines() if line.endswith("}")] if path.exists() else []


def features(spark: SparkSession, args: argparse.Namespace) -> None:
    cells = read_wide_csv(spark, args.input)
    apply(args.block, variants_of(cells), samples_of(cells)).write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.output)


def matrix(spark: SparkSession, args: argparse.Namespace) -> None:
    """The matrix that a model of fold ``--held`` sees."""
    cells = read_wide_csv(spark, args.input)
    variants = write_once(variants_of(cells), "tokens")
    rows = training.numbered(dealt(variants, samples_of(cells), args.cv, args.folds, args.fold_seed))
    tokens, samples, key = training.coded(variants, rows, args.held)
    long = long_matrix(args.config, write_once(tokens, "tokens"), samples).join(key, "sample_id")
    long.select(F.col("own_id").alias("sample_id"), "feature", "value").write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.output)


def folds(spark: SparkSession, args: argparse.Namespace) -> None:
    cells = read_wide_csv(spark, args.input)
    table = dealt(variants_of(cells), samples_of(cells), args.cv, args.folds, args.fold_seed)
    table.write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.output)
    spark.read.parquet(args.output).groupBy("fold").pivot("label").count().orderBy("fold").show(args.folds, truncate=False)


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    print(Run(spark, args).one(args.model, args.config, Path(args.output), **json.loads(args.params)))


def ladder(spark: SparkSession, args: argparse.Namespace) -> None:
    done = {(r["stem"], r["seed"]) for r in logged(Path(args.output))}
    run = Run(spark, args)
    for model in args.models.split(","):
        for config in args.configs.split(","):
            for seed in map(int, args.seeds.split(",")) if "seed" in models.DEFAULTS[model] else (0,):
                stem = f"{model}_{config}_{args.cv}"
                if (stem, seed) not in done:
                    run.one(model, config, run.out / f"{stem}_{seed}", **({"seed": seed} if seed else {}))
    rows = [(r["stem"], r["seed"], r["macro_f1"]) for r in logged(run.out)]
    reports.seed_report(spark.createDataFrame(rows, "stem string, seed long, macro_f1 double"), []).orderBy(F.desc("mean")).show(1000, truncate=False)


def ablations(blocks: tuple[str, ...], targets: list[str]) -> dict[str, tuple[str, ...]]:
    """All blocks, all but one target, no target, and one target alone; blocks
    keep their order."""
    if absent := [t for t in targets if t not in blocks]:
        raise ValueError(f"the configuration has no block {absent}")
    runs = {"full": blocks} | {f"drop:{t}": tuple(b for b in blocks if b != t) for t in targets}
    return runs | {"base": tuple(b for b in blocks if b not in targets)} | {f"add:{t}": tuple(b for b in blocks if b not in targets or b == t) for t in targets}


def ablate(spark: SparkSession, args: argparse.Namespace) -> None:
    """What each block gains: the loss when it leaves the whole, the gain when it
    joins the rest."""
    run = Run(spark, args)
    done = {r["stem"] for r in logged(run.out)}
    for name, blocks in ablations(CONFIGS[args.config][0], args.blocks.split(",")).items():
        label = f"{args.config}:{name}"
        if f"{args.model}_{label}_{args.cv}" not in done:
            run.one(args.model, label, run.out / label.replace(":", "_"), blocks=blocks)
    ends = f"_{args.cv}"
    rows = [(r["stem"].removeprefix(f"{args.model}_{args.config}:").removesuffix(ends), r["macro_f1"]) for r in logged(run.out) if r["stem"].startswith(f"{args.model}_{args.config}:") and r["stem"].endswith(ends)]
    reports.ablation(spark.createDataFrame(rows, "config string, macro_f1 double")).show(100, truncate=False)


def tune(spark: SparkSession, args: argparse.Namespace) -> None:
    run, base = Run(spark, args), {k: v for k, v in models.DEFAULTS[args.model].items() if k in SPACES[args.model]}
    study = Study(SPACES[args.model], run.out / f"{args.model}_{args.config}.jsonl").run(lambda params, report: run.one(args.model, args.config, **params), args.trials, baseline=base)
    for trial in study.top(5):
        print(json.dumps({"number": trial.number, "value": trial.value, "params": trial.params}))


def blend(spark: SparkSession, args: argparse.Namespace) -> None:
    """Weights that maximise macro F1 out of fold, and the blend of the files."""
    read = [P.read_predictions(spark, path) for path in args.files]
    classes = read[0][1]
    if any(c != classes for _, c in read):
        raise ValueError("the files' classes differ")
    union = None
    for k, (table, _) in enumerate(read):
        part = table.select(F.col("ID").alias("sample_id"), F.lit(k + 1).alias("member"), "y_true", "proba")
        union = part if union is None else union.union(part)
    found = ensemble.MacroF1Blender().fit(ensemble.searched(*ensemble.pack(union, classes), len(classes)))
    print(json.dumps({"weights": dict(zip(args.files, map(float, found.weights_)))}))
    mixed = ensemble.apply_weights(union, {k + 1: float(w) for k, w in enumerate(found.weights_)}).join(union.where("member = 1").select("sample_id", "y_true"), "sample_id")
    P.write_csv_file(P.prediction_frame(mixed.withColumnRenamed("sample_id", "ID"), classes), args.output, overwrite=args.overwrite)


def submit(spark: SparkSession, args: argparse.Namespace) -> None:
    table, classes = P.read_predictions(spark, args.predictions)
    named = P.prediction_frame(table, classes).select("ID", F.col("y_pred").alias("SUBCLASS"))
    sample = spark.read.option("header", True).csv(args.sample)
    sample = sample.toDF(*[c.lstrip(P.MARK) for c in sample.columns])
    P.write_csv_file(build_submission(sample, named), args.output, overwrite=args.overwrite, mark=True)
    named.groupBy("SUBCLASS").count().orderBy(F.desc("count"), "SUBCLASS").show(100, truncate=False)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def add(run, source: bool = True, cv: bool = False, test: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__, help=(run.__doc__ or "").split("\n")[0])
        p.set_defaults(run=run)
        p.add_argument("--output", required=True)
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--settings", help="a JSON or YAML mapping of options")
        if source:
            p.add_argument("--input", required=True)
        if cv:
            p.add_argument("--cv", choices=("skf", "sgkf"), default="skf")
            p.add_argument("--folds", type=int, default=5)
            p.add_argument("--fold-seed", type=int, default=42)
        if test:
            p.add_argument("--test")
        return p

    add(features).add_argument("block", choices=sorted(ALL_PLANS))
    add(folds, cv=True)
    p = add(matrix, cv=True)
    p.add_argument("config", choices=sorted(CONFIGS))
    p.add_argument("--held", type=int, default=0)
    p = add(train, cv=True, test=True)
    p.add_argument("model", choices=sorted(models.DEFAULTS))
    p.add_argument("--config", choices=sorted(CONFIGS), default="f4r")
    p.add_argument("--params", default="{}")
    p = add(ladder, cv=True, test=True)
    for name, value in (("configs", "f1,f4r"), ("models", "rf"), ("seeds", "42")):
        p.add_argument(f"--{name}", default=value)
    p = add(ablate, cv=True, test=True)
    p.add_argument("model", choices=sorted(models.DEFAULTS))
    p.add_argument("--config", choices=sorted(CONFIGS), default="f16")
    p.add_argument("--blocks", default="gtype,comut,lsvd,lnmf,gmod,csig")
    p = add(tune, cv=True, test=True)
    p.add_argument("model", choices=sorted(SPACES))
    p.add_argument("--config", choices=sorted(CONFIGS), default="f4r")
    p.add_argument("--trials", type=int, default=20)
    add(blend, source=False).add_argument("files", nargs="+")
    p = add(submit, source=False)
    p.add_argument("--sample", required=True)
    p.add_argument("--predictions", required=True)
    return top


def mapping(path: str) -> dict:
    """A JSON or YAML file that holds a mapping."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def arguments(argv: list[str]) -> argparse.Namespace:
    """The options of ``argv``, after those of its settings file."""
    if "--settings" not in argv:
        return parser().parse_args(argv)
    settings = mapping(argv[argv.index("--settings") + 1])
    given = [x for k, v in settings.items() if f"--{k.replace('_', '-')}" not in argv for x in ([f"--{k.replace('_', '-')}"] if v is True else [] if v in (False, None) else [f"--{k.replace('_', '-')}", json.dumps(v) if isinstance(v, (dict, list)) else str(v)])]
    return parser().parse_args([*argv, *given])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(sys.argv[1:] if argv is None else argv)
    spark = spark or SparkSession.builder.appName("helixframe").getOrCreate()
    shared_dir(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
