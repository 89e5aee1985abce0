"""Input tables: wide mutation files, the variant view of the star schema, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions import tokens as T
from helixframe.sources.shared import write_dealt, write_once

META = ("ID", "SUBCLASS", "fold")


def read_wide_csv(spark: SparkSession, path: str, label: bool = True) -> DataFrame:
    """Wide file ID,[SUBCLASS],gene... -> long cells (sample_id, label, gene,
    gene_idx, cell).  Lines are split and exploded against the header, so that
    no plan has thousands of columns; cells stay strings."""
    lines = spark.read.text(path)
    header = [c.strip().lstrip("﻿") for c in lines.first()[0].split(",")]
    first = header.index("SUBCLASS") + 1 if label and "SUBCLASS" in header else header.index("ID") + 1
    genes = [(i, g) for i, g in enumerate(header) if i >= first and g not in META]
    if not genes:
        raise ValueError("no gene column")
    names = F.array(*[F.lit(g) for _, g in genes])
    parts = lines.where(F.trim("value") != "").select(F.split(F.regexp_replace("value", "\r$", ""), ",").alias("p"))
    rows = parts.where(F.regexp_replace(F.col("p")[0], "^﻿", "") != header[0])
    cells = rows.select(
        F.col("p")[header.index("ID")].alias("sample_id"),
        (F.col("p")[header.index("SUBCLASS")] if "SUBCLASS" in header else F.lit(None).cast("string")).alias("label"),
        F.posexplode(F.slice("p", genes[0][0] + 1, len(genes))).alias("gene_idx", "cell"),
    )
    return cells.withColumn("gene", names[F.col("gene_idx")])


def variants_of(cells: DataFrame) -> DataFrame:
    """Long cells -> one annotated row per token."""
    found = cells.select("sample_id", "label", "gene", F.posexplode(T.split_tokens(F.col("cell"))).alias("at", "token"))
    return T.annotated(found.withColumn("seq", F.col("at") + 1).drop("at"))


def samples_of(cells: DataFrame) -> DataFrame:
    return cells.select("sample_id", "label").distinct()


def _star_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of the star schema, with the columns that order a cell's."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    places = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", F.col("r_name").alias("label"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x = lines.join(t("part").select("p_partkey", F.col("p_brand").alias("gene")), F.col("l_partkey") == F.col("p_partkey")).join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    r = F.substring(F.lit(T.AMINO), (F.col("l_partkey") % 20 + 1).cast("int"), F.lit(1))
    a = F.substring(F.lit(T.AMINO), (F.col("l_quantity").cast("int") % 20 + 1).cast("int"), F.lit(1))
    pos = F.col("l_partkey") % 60 + 1
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    forms = {
        0: F.concat(r, pos, F.lit("fs")), 1: F.concat(r, pos, a), 2: F.concat(r, pos, r), 3: F.concat(r, pos, F.lit("*")), 4: F.concat(r, pos, F.lit("del")),
        5: F.concat(pos, F.lit("_"), pos + 1, r, a, F.lit(">"), a, r), 6: F.concat(r, pos, F.lit("_"), a, pos + 1, F.lit("delins"), a),
        7: F.concat(r, pos, F.lit("_"), a, pos + 1, F.lit("ins"), a), 8: F.concat(r, pos, F.lit("X")),
    }
    token = F.when(F.lit(False), "")
    for n, form in forms.items():
        token = token.when(k == n, form)
    token = token.otherwise(F.when(F.col("l_partkey") % 11 == 0, "SPLICE").otherwise(F.concat(r, pos, a)))
    return x.select((F.col("l_suppkey") * 1000 + F.col("l_orderkey") % 40).alias("sample_id"), "label", "gene", token.alias("token"), "l_orderkey", "l_linenumber", "l_extendedprice")


def star_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant view of the star schema, one annotated row per token."""
    made = _star_rows(spark, sf_dir)
    seq = F.row_number().over(W.partitionBy("sample_id", "gene").orderBy("l_orderkey", "l_linenumber", "l_extendedprice", "token"))
    return T.annotated(made.withColumn("seq", seq).select("sample_id", "label", "gene", "seq", "token"))


#: Distinct tokens up to which their columns are broadcast.
MOST_TOKENS = 100_000
#: Tokens a bucket, where there are fewer buckets than shuffle partitions.
BUCKET_TOKENS = 75_000


def star_dealt(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The variant view without ``seq``, dealt by sample into the number of buckets
    that is returned.  All other columns depend on the token alone, so they are
    made once for each distinct token and joined when read."""
    tokens = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS)))
    plain = write_dealt(_star_rows(spark, sf_dir).select("sample_id", "label", "gene", "token").repartition(parts, "sample_id"), "tokens", "sample_id", parts)
    columns = write_once(T.annotated(plain.select(F.col("token")).distinct()), "token_columns").withColumnRenamed("token", "known")
    side = F.broadcast(columns) if columns.count() <= MOST_TOKENS else columns
    return plain.join(side, F.col("token").eqNullSafe(F.col("known")), "left").drop("known"), parts


def star_samples(spark: SparkSession, sf_dir: str, variants: DataFrame) -> DataFrame:
    """All samples, with one without mutations for each supplier."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    none = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select((F.col("s_suppkey") * 1000 + 999).alias("sample_id"), F.col("r_name").alias("label"))
    return variants.select("sample_id", "label").union(none).distinct()


def build_submission(sample: DataFrame, predictions: DataFrame) -> DataFrame:
    """Left join on ID, one to one; missing ids and null labels raise."""
    if predictions.groupBy("ID").count().where("count > 1").limit(1).count() or sample.groupBy("ID").count().where("count > 1").limit(1).count():
        raise ValueError("ID is not unique")
    joined = sample.select("ID").join(predictions.select("ID", "SUBCLASS"), "ID", "left")
    if joined.where("SUBCLASS is null").limit(1).count():
        raise ValueError("an ID has no predicted label")
    return joined


def write_single_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One CSV part with a header; an existing path is refused by default."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
