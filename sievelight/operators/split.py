"""Stratified split and group-wise positions, by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.operators.bootstrap import hash_number

#: Hash ranges of a class; only the one in which its quota falls is ranked.
RANGES = 4096


def split_allocation(rows: DataFrame, share_bp: int, label: str = "category", seed: int = 42) -> DataFrame:
    """Rows of each label that go to validation: ``category, records, quota``.

    The whole part of each label's share, and one more for the largest remainders until the share of all rows
    (a half rounds to the even number) is reached; ties by a hash of the label, then by the label. Null labels are
    in no class. Shares are in 1/10,000, so that all of it is exact.
    """
    if not 0 < share_bp < 10_000:
        raise ValueError("share_bp must be between 0 and 10000")
    counts = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("category")).agg(F.count("*").alias("records"))
    part = F.col("records") * share_bp
    parts = counts.withColumns({"floor": F.expr(f"records * {share_bp} div 10000"), "rest": part % 10_000})
    whole = W.partitionBy()
    missing = F.bround(F.sum("records").over(whole) * share_bp / 10_000, 0).cast("long") - F.sum("floor").over(whole)
    tie = hash_number(F.lit(str(seed)), F.col("category"))
    place = F.row_number().over(W.orderBy(F.desc("rest"), tie, "category"))
    ranked = parts.withColumns({"missing": missing, "place": place})
    return ranked.select("category", "records", (F.col("floor") + (F.col("place") <= F.col("missing")).cast("long")).alias("quota"))


def stratified_split(rows: DataFrame, share_bp: int, label: str = "category", key: str = "record_id", seed: int = 42) -> DataFrame:
    """``key, category, part`` of each row with a label: ``validation`` for the quota of each label, else ``train``.

    A label's rows are ordered by a hash of seed and key, so the split doesn't depend on partitions. No class is
    sorted whole: hashes are counted in ranges, and only the range in which the quota falls is ranked. Rows with a
    null key are never in validation. Allocations are as many as labels and are broadcast.
    """
    quotas = split_allocation(rows, share_bp, label, seed)
    plain = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("category"))
    hashed = plain.withColumn("order", hash_number(F.lit(str(seed)), F.col("key").cast("string"))).withColumn("range", F.shiftright("order", 40))
    hashed = hashed.withColumn("range", F.when(F.col("key").isNull(), RANGES).otherwise(F.col("range")))
    counted = hashed.groupBy("category", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("category").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edges = (
        counted.withColumn("before", before)
        .join(F.broadcast(quotas.select("category", "quota")), "category")
        .where("before <= quota and before + n > quota")
        .select("category", F.col("range").alias("edge"), (F.col("quota") - F.col("before")).alias("open"))
    )
    marked = hashed.join(F.broadcast(edges), "category", "left")
    taken = F.coalesce(F.col("range") < F.col("edge"), F.lit(True)) & F.col("key").isNotNull()
    outside = marked.where(~F.col("range").eqNullSafe(F.col("edge"))).withColumn("in", taken)
    place = F.row_number().over(W.partitionBy("category").orderBy("order", "key"))
    inside = marked.where("range = edge").withColumn("in", (place <= F.col("open")) & F.col("key").isNotNull())
    part = F.when(F.col("in"), "validation").otherwise("train").alias("part")
    return outside.unionByName(inside).select(F.col("key").alias(key), "category", part)


def first_positions(rows: DataFrame, by: str, order: list[str], count: int, inside: str = "calibration", outside: str = "held_out") -> DataFrame:
    """``rows`` with ``part``: the first ``count`` rows of each group are ``inside``, the others ``outside``.

    Rows that tie with the last of them are inside, too. Only the first rows of each partition reach the group's
    sort, which finds the last place; one place for each group then goes back to the rows. Null groups are a group,
    and null values come first.
    """
    place = F.struct(*order)
    last = first_rows(rows.select(F.struct(F.col(by).alias("by")).alias("group"), place.alias("last")), ["group"], ["last"], count)
    ends = last.where(F.col("place") == count).select("group", "last")
    marked = rows.withColumn("__group", F.struct(F.col(by).alias("by"))).join(ends.withColumnRenamed("group", "__group"), "__group", "left")
    part = F.when(F.col("last").isNull() | (place <= F.col("last")), inside).otherwise(outside)
    return marked.withColumn("part", part).drop("__group", "last")


def first_rows(rows: DataFrame, by: list[str], order: list[Column | str], count: int) -> DataFrame:
    """The first ``count`` rows of each group, with their ``place``; each task cuts its own rows first."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= count)
