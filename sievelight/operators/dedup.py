"""Audit and removal of duplicates by canonical text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import canonical_text


def duplicate_audit(records: DataFrame, text: str = "text", label: str = "label", split: str = "source_split") -> DataFrame:
    """One row of seven counters over all rows with a text.

    Groups of equal raw text and their excess rows, those that cross splits; groups of equal canonical text
    whose members aren't all raw duplicates and their excess, canonical groups that cross splits, and canonical
    groups with more than one label (a null label is one). Raw texts are counted first, so the second
    grouping works on distinct texts and a frequent text is never gathered.
    """
    null = F.lit("\x00")
    kept = records.where(F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.coalesce(F.col(split), null).alias("split"), F.coalesce(F.col(label), null).alias("label")
    )
    raw = kept.groupBy("text").agg(
        F.count("*").alias("n"), F.min("split").alias("s0"), F.max("split").alias("s1"), F.min("label").alias("l0"), F.max("label").alias("l1")
    )
    canonical = raw.groupBy(canonical_text("text").alias("key")).agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("n") > 1).alias("raw_groups"),
        F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("raw_excess"),
        F.count_if((F.col("n") > 1) & (F.col("s0") != F.col("s1"))).alias("raw_crossing"),
        F.bool_and(F.col("n") > 1).alias("all_raw"),
        F.min("s0").alias("s0"),
        F.max("s1").alias("s1"),
        F.min("l0").alias("l0"),
        F.max("l1").alias("l1"),
    )
    only = (F.col("n") > 1) & ~F.col("all_raw")
    zero = F.lit(0)
    return canonical.agg(
        F.coalesce(F.sum("raw_groups"), zero).alias("raw_duplicate_groups"),
        F.coalesce(F.sum("raw_excess"), zero).alias("raw_duplicate_excess_records"),
        F.coalesce(F.sum("raw_crossing"), zero).alias("raw_cross_source_split_groups"),
        F.count_if(only).alias("canonical_only_duplicate_groups"),
        F.coalesce(F.sum(F.when(only, F.col("n") - 1)), zero).alias("canonical_only_duplicate_excess_records"),
        F.count_if((F.col("n") > 1) & (F.col("s0") != F.col("s1"))).alias("canonical_cross_source_split_groups"),
        F.count_if((F.col("n") > 1) & (F.col("l0") != F.col("l1"))).alias("conflicting_label_duplicate_groups"),
    )


def deduplicate_preserving(records: DataFrame, reserved: str = "test", trained: str = "train", order: tuple[str, ...] = ("source_index", "record_id")) -> DataFrame:
    """``records`` of the two splits with ``kept``: every reserved row is kept, duplicates among them too.

    A row of the other split is dropped if its canonical text stands in the reserved split or earlier in its own
    split, by ``order``. Rows with a null text are kept, since they equal nothing. The first row of a
    text is found by a pre-aggregated minimum, not by a window, so one text may fill a third of the table.
    """
    rows = records.where(F.col("source_split").isin(reserved, trained)).withColumn("key", F.sha2(canonical_text("text"), 256))
    place = F.struct(*[F.col(c) for c in order])
    first = rows.where("key is not null").groupBy("key").agg(
        F.min(F.when(F.col("source_split") == trained, place)).alias("first"), F.max(F.col("source_split") == reserved).alias("reserved")
    )
    joined = rows.join(first.where("first is not null"), "key", "left")
    kept = (F.col("source_split") == reserved) | F.col("key").isNull() | (~F.col("reserved") & (place == F.col("first")))
    return joined.withColumn("kept", F.coalesce(kept, F.lit(True))).drop("key", "first", "reserved")
