"""Profile groups, near-identical twins, folds, fingerprints, and the pair rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.dims import PAIR_LABELS
from helixframe.functions.tokens import EMPTY_CELLS


def profiles(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id, label, profile_hash, n_genes over all (gene, sorted tokens)."""
    cells = variants.groupBy("sample_id", "gene").agg(F.array_join(F.sort_array(F.collect_list("token")), " ").alias("cell"))
    own = cells.groupBy("sample_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("gene", "cell")))), 256).alias("profile_hash"), F.count(F.lit(1)).alias("n_genes"))
    return samples.join(own, "sample_id", "left").select("sample_id", "label", F.coalesce("profile_hash", F.lit("")).alias("profile_hash"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


def group_keys(profile: DataFrame) -> DataFrame:
    """The smallest sample of each profile names its group."""
    return profile.withColumn("group_key", F.min("sample_id").over(W.partitionBy("profile_hash")))


def connected(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> (node, label): smallest reachable node, by rounds of
    neighbour minimum and pointer jump, each cut by a checkpoint."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        mid = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        new = mid.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid", "left").select("node", "old", F.least("mid", "far").alias("label")).checkpoint()
        labels = new.select("node", "label")
        if not new.where("label < old").limit(1).count():
            return labels


def twin_groups(variants: DataFrame, samples: DataFrame, threshold: float = 0.999, least: int = 3) -> DataFrame:
    """Exact profile groups united with pairs of gene sets of at least
    ``least`` genes whose Jaccard similarity reaches ``threshold``.

    Two sets that similar share one of the ``ceil((1 - threshold) * n) + 1``
    rarest genes of each (prefix filter), so candidates meet on rare genes.  Sets
    that differ at all differ in one of their union, so only those of at least
    ``threshold / (1 - threshold)`` genes can be similar without being equal."""
    genes = variants.select("sample_id", "gene").distinct()
    freq = genes.groupBy("gene").agg(F.count(F.lit(1)).alias("df"))
    sets = genes.join(freq, "gene").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("df", "gene"))).alias("g")).where(F.size("g") >= least)
    sets = sets.withColumn("genes", F.transform("g", lambda x: x["gene"])).withColumn("mark", F.sha2(F.array_join("genes", "\x1f"), 256))
    same = sets.groupBy("mark").agg(F.min("sample_id").alias("head"))
    heads = sets.join(same.select(F.col("head").alias("sample_id")), "sample_id", "left_semi").checkpoint()
    large = heads.where(F.size("genes") * (1 - threshold) >= threshold - 1e-9) if threshold < 1 else heads.limit(0)
    prefix = large.select("sample_id", F.explode(F.slice("genes", F.lit(1), F.ceil((1 - threshold) * F.size("genes")).cast("int") + 1)).alias("gene"))
    pairs = prefix.alias("x").join(prefix.alias("y"), "gene").where("x.sample_id < y.sample_id").select(F.col("x.sample_id").alias("a"), F.col("y.sample_id").alias("b")).distinct()
    side = lambda n: heads.select(F.col("sample_id").alias(n), F.col("genes").alias(f"g_{n}"))
    both = F.size(F.array_intersect("g_a", "g_b"))
    linked = pairs.join(side("a"), "a").join(side("b"), "b").where(both >= threshold * (F.size("g_a") + F.size("g_b") - both)).select("a", "b")
    within = sets.join(same, "mark").where("sample_id <> head").select(F.col("head").alias("a"), F.col("sample_id").alias("b"))
    exact = group_keys(profiles(variants, samples)).where("n_genes > 0 and sample_id <> group_key").select(F.col("group_key").alias("a"), F.col("sample_id").alias("b"))
    labels = connected(linked.union(within).union(exact))
    return samples.join(labels.withColumnRenamed("node", "sample_id"), "sample_id", "left").select("sample_id", F.coalesce(labels["label"], F.col("sample_id")).alias("group_key"))


def dealing(column: str, seed: int) -> Column:
    """What rows are put in order by to be dealt out: the same on any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")).cast("binary"))


def stratified_folds(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """sample_id, fold: each label's samples dealt in hash order."""
    order = W.partitionBy("label").orderBy(dealing("sample_id", seed), "sample_id")
    return samples.select("sample_id", "label", ((F.row_number().over(order) - 1) % k).cast("int").alias("fold"))


def group_folds(grouped: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Whole groups in one fold: groups of a label, largest first, are dealt
    back and forth over the folds, which keeps label shares near."""
    groups = grouped.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.mode("label", deterministic=True).alias("label"))
    at = F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), dealing("group_key", seed), "group_key")) - 1
    turn = (at % (2 * k)).cast("int")
    dealt = groups.select("group_key", F.when(turn < k, turn).otherwise(2 * k - 1 - turn).alias("fold"))
    return grouped.join(dealt, "group_key")


def check_groups(folds: DataFrame) -> None:
    """Raises when a group is in two folds."""
    if folds.groupBy("group_key").agg(F.count_distinct("fold").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a group is in more than one fold")


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: order-independent digest of the rows, and their number."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    digest = F.md5(text.cast("binary"))
    number = lambda digits: F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")
    return df.select(number(15).alias("row"), number(6).alias("head")).agg(F.bit_xor("row").alias("xor"), F.sum("head").alias("total"), F.count(F.lit(1)).alias("n"))


def pair_rule(train: DataFrame, test: DataFrame, least: int = 3, pairs: dict[str, str] = PAIR_LABELS) -> DataFrame:
    """Test rows whose profile is that of exactly one train row with at least
    ``least`` mutated genes: sample_id, matched_label, new_label (null off the
    pair labels)."""
    one = train.where(F.col("n_genes") >= least).groupBy("profile_hash").agg(F.count(F.lit(1)).alias("n"), F.first("label").alias("matched_label")).where("n = 1")
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return test.join(one, "profile_hash").select("sample_id", "matched_label", table[F.col("matched_label")].alias("new_label"))


def line_profiles(spark: SparkSession, path: str, label: bool = True) -> DataFrame:
    """sample_id, label, profile_hash, n_genes from the lines of a wide file, which
    are cut at their first comma, or second with labels, and not parsed further:
    two rows are alike if the rest of their lines is.  Blank lines and the header
    are left out."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"))
    header = lines.first()[0]
    cut = r"^([^,]*),([^,]*),(.*)$" if label else r"^([^,]*),()(.*)$"
    part = lambda k: F.regexp_extract("line", cut, k)
    rest = lines.where((F.trim("line") != "") & (F.col("line") != header)).select(part(1).alias("sample_id"), F.when(F.lit(label), part(2)).alias("label"), part(3).alias("rest"))
    mutated = F.size(F.filter(F.split("rest", ","), lambda c: ~F.upper(F.trim(c)).isin(*EMPTY_CELLS)))
    return rest.select("sample_id", "label", F.sha2("rest", 256).alias("profile_hash"), mutated.alias("n_genes"))


def relabel(submission: DataFrame, rule: DataFrame) -> DataFrame:
    return submission.join(rule.select("sample_id", "new_label"), "sample_id", "left").select("sample_id", F.coalesce("new_label", "label").alias("label"))
