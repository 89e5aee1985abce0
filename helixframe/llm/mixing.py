"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by the digest of its identifiers and offered in up to
``max_passes`` passes.  A document's virtual finish time is the number of words
its source has served up to its end, divided by the source's target; the mix is
the global order of finish times, truncated where the total budget is served.

No step puts a source or the corpus into one task.  Words served before a
document come from prefix sums over about ``2 * sqrt(rows)`` digest buckets per
source.  The place where the global order reaches the budget is searched from
above: a histogram of words over ``BUCKETS`` stretches of virtual time gives the
stretch that holds it, which is divided again until it has at most ``FEW``
documents; only these are sorted one by one.  That document is taken in part,
all before it whole, and nothing behind it.

Defined results: null text has size 0 and takes 0; null source is a source of
its own, last in order; ties of digest are broken by identifier and size, ties
of finish time by source; extra columns are left alone; an empty table gives an
empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.store import read, write_table
from helixframe.llm.text import DOCUMENT_COLUMNS, WORD, word_count

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BUCKETS, FEW = 1024, 100_000


def source_targets(totals: DataFrame, weights: Sequence[int], max_passes: int) -> DataFrame:
    """``totals(source, source_size, n_rows)`` -> plus weight and target.

    Targets share the sum of all sizes by weight; one that exceeds
    ``max_passes`` times its source stops there and the excess is shared again.
    Capped sources are those of the smallest cap per weight, so one pass in
    that order finds the level.  The table has one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    wheel = F.array(*[F.lit(int(w)) for w in weights])
    ranked = totals.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(wheel, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    capped = ranked.withColumn("cap", F.col("source_size") * max_passes).withColumn("ratio", F.col("cap") / F.col("weight"))
    running = (
        capped.withColumn("all_size", F.sum("source_size").over(W.partitionBy()))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("place", F.row_number().over(by_ratio))
    )
    # the first source in that order that its own level leaves uncapped
    found = running.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(W.partitionBy()))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    return found.select("source", "source_size", "n_rows", "rank", "weight", target.alias("target"))


def queued(docs: DataFrame, weights: Sequence[int], max_passes: int) -> DataFrame:
    """Written table of the documents in their sources' queues: doc_id, source,
    rank, size, source_size, target, begin (words of the source before it)."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = write_table(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), digest.alias("digest")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    targets = source_targets(totals, weights, max_passes).withColumnRenamed("source", "t_source")
    spread = F.greatest(F.ceil(2 * F.sqrt(F.col("n_rows"))), F.lit(1))
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    dealt = sized.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("bucket", F.floor(place * spread / F.lit(4294967296.0)).cast("long"))
    sums = dealt.groupBy("rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = sums.select("rank", "bucket", F.coalesce(F.sum("bucket_size").over(W.partitionBy("rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = W.partitionBy("rank", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.withColumn("inside", F.sum("size").over(inside)).join(before, ["rank", "bucket"])
    return write_table(placed.select("doc_id", "source", "rank", "size", "source_size", "target", (F.col("offset") + F.col("inside") - F.col("size")).alias("begin")), "mix-queues")


def finish(number: int | Column) -> Column:
    """Virtual finish time of a document in a pass."""
    begin = F.col("begin") + F.lit(number) * F.col("source_size")
    return F.when(F.col("target") > 0, (begin + F.col("size")) / F.col("target"))


def truncation(queue: DataFrame, budget: int, max_passes: int) -> tuple[float, int, int]:
    """(finish, rank, words) of the document at which the global order of finish
    times reaches ``budget``, and the words it still takes."""
    offers = queue.where("size > 0").select("rank", "size", F.explode(F.array(*[finish(k) for k in range(max_passes)])).alias("finish"))
    low, left = 0.0, budget
    high = offers.agg(F.max("finish")).first()[0]
    inside = offers
    while True:
        width = (high - low) / BUCKETS
        bucket = F.least(F.floor((F.col("finish") - low) / width), F.lit(BUCKETS - 1)) if width > 0 else F.lit(0)
        rows = inside.groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).orderBy("bucket").collect()
        upto = list(accumulate(r["words"] for r in rows))
        at = next(k for k, words in enumerate(upto) if words >= left)
        left -= upto[at] - rows[at]["words"]
        whole = len(rows) == 1 and (low, high) == (rows[0]["low"], rows[0]["high"])
        low, high = rows[at]["low"], rows[at]["high"]
        inside = offers.where((F.col("finish") >= low) & (F.col("finish") <= high))
        if rows[at]["n"] <= FEW or whole:
            break
    running = F.sum("size").over(W.orderBy("finish", "rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    cut = inside.withColumn("upto", running).where(F.col("upto") >= left).orderBy("finish", "rank").first()
    return cut["finish"], cut["rank"], left - (cut["upto"] - cut["size"])


def schedule(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per document: size, source_size, target, and ``passes``, an
    array of (pass_no, finish, taken) with the words each pass contributes."""
    queue = queued(docs, weights, max_passes)
    budget = queue.agg(F.sum("size")).first()[0] or 0
    last, rank, words = truncation(queue, budget, max_passes) if budget else (-1.0, 0, 0)

    def one_pass(number: int) -> Column:
        end = finish(number)
        before = (end < last) | ((end == last) & (F.col("rank") < rank))
        taken = F.when(before, F.col("size")).when((end == last) & (F.col("rank") == rank), F.least("size", F.lit(words))).otherwise(0)
        return F.struct(F.lit(number).alias("pass_no"), end.alias("finish"), F.when(F.col("size") > 0, taken).otherwise(0).cast("long").alias("taken"))

    return queue.select("doc_id", "source", "rank", "size", "source_size", "target", F.array(*[one_pass(k) for k in range(max_passes)]).alias("passes"))


MIX_COLUMNS = ("mix_row", "mix_rank", "mix_size", "mix_pass", "mix_finish", "mix_taken")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mixed corpus in the order of virtual finish times: the columns of
    ``docs`` plus mix_pass, mix_finish, mix_taken (columns of those names are
    replaced).  Rows that take no word are left out; a straddling document's
    text is cut after its words.  Where doc_id does not tell all rows apart,
    rows get a written number of their own first."""
    own = docs.drop(*MIX_COLUMNS)
    alike = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if alike.limit(1).count():
        own = write_table(own.withColumn("mix_row", F.monotonically_increasing_id()), "mix-rows")
    else:
        own = own.withColumn("mix_row", F.col("doc_id"))
    plan = schedule(own.select(F.col("mix_row").alias("doc_id"), "source", "text"), weights, max_passes)
    taken = plan.select("doc_id", "rank", "size", F.explode("passes").alias("p")).where("p.taken > 0")
    taken = taken.select(F.col("doc_id").alias("mix_row"), F.col("rank").alias("mix_rank"), F.col("size").alias("mix_size"), F.col("p.pass_no").alias("mix_pass"), F.col("p.finish").alias("mix_finish"), F.col("p.taken").alias("mix_taken"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("mix_taken").cast("int")), " ")
    # the same join at every size
    mixed = own.join(taken.hint("merge"), "mix_row").withColumn("text", F.when(F.col("mix_taken") < F.col("mix_size"), head).otherwise(F.col("text")))
    return mixed.repartitionByRange("mix_finish", "mix_rank").sortWithinPartitions("mix_finish", "mix_rank").drop("mix_row", "mix_rank", "mix_size")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda total, p: total + p["taken"])
    return schedule(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the corpus in mixed order, documents repeated or cut as
    the mix takes them."""
    mixed = mix(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS digest
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM totals
), running AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) AS all_size FROM ranked
), levels AS (
  SELECT *, (all_size - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level,
         row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM running
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(arg_min(own_level, CASE WHEN own_level <= ratio THEN place END) OVER () * weight, CAST(cap AS DOUBLE))) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
         CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS beginning
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), offers AS (
  SELECT doc_id, source, size, CAST(beginning + pass * source_size + size AS DOUBLE) / target AS finish FROM placed CROSS JOIN (VALUES (0), (1), (2)) AS p(pass) WHERE size > 0
), served AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM offers
), mixed AS (
  SELECT doc_id, sum(least(size, greatest((SELECT sum(size) FROM sized) - (upto - size), 0))) AS taken FROM served GROUP BY doc_id
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM placed LEFT JOIN mixed USING (doc_id)
"""
