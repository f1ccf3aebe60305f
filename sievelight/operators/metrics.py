"""Classification metrics from the long confusion table.

All of it starts from one aggregation by (approach, actual, predicted). What follows works on tables that
the label set bounds, so the size of the predictions never matters again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions.structured import INVALID_OUTPUT, shown_label


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where the whole is 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def label_summary(records: DataFrame, label: str = "category", by: str = "source_split") -> DataFrame:
    """Records of each label, with the number of labels and the smallest and largest label of each ``by``.

    Rows with a null label or split are not counted.
    """
    counts = records.where(F.col(label).isNotNull() & F.col(by).isNotNull()).groupBy(by, label).agg(F.count("*").alias("records"))
    whole = W.partitionBy(by)
    return counts.select(
        by,
        label,
        "records",
        F.count("*").over(whole).alias("classes"),
        F.min("records").over(whole).alias("min_records"),
        F.max("records").over(whole).alias("max_records"),
    )


def majority_labels(records: DataFrame, label: str = "category") -> DataFrame:
    """The most frequent labels: ``label, records, chosen``; of several the smallest in code point order is chosen."""
    counts = records.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("records"))
    top = counts.agg(F.max("records").alias("records"))
    tied = counts.join(F.broadcast(top), "records")
    return tied.select("label", "records", (F.col("label") == F.min("label").over(W.partitionBy("records"))).alias("chosen"))


def confusion(predictions: DataFrame, by: str = "approach", sentinel: str = INVALID_OUTPUT) -> DataFrame:
    """Counts of each actual and predicted label, invalid predictions under ``sentinel``."""
    shown = shown_label(F.col("predicted"), F.col("label_valid"), sentinel)
    return predictions.groupBy(by, "actual", shown.alias("predicted")).agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame, labels: DataFrame, by: str = "approach") -> DataFrame:
    """Precision, recall, F1 and support of each label of ``labels``; a ratio with nothing below it is 0.

    An invalid prediction is a miss for its actual label and a false alarm for none. ``matrix`` may come from
    :func:`confusion` or from a replicate of a bootstrap.
    """
    kept = labels.where("category is not null").select("category").distinct()
    support = matrix.groupBy(by, F.col("actual").alias("category")).agg(F.sum("n").alias("support"))
    claimed = matrix.groupBy(by, F.col("predicted").alias("category")).agg(
        F.sum("n").alias("claimed"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("hits")
    )
    frame = matrix.select(by).distinct().crossJoin(F.broadcast(kept))
    joined = frame.join(support, [by, "category"], "left").join(claimed, [by, "category"], "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("support", "claimed", "hits")}
    counted = joined.withColumns(zero).withColumns({"precision": ratio(F.col("hits"), F.col("claimed")), "recall": ratio(F.col("hits"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return counted.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).select(
        by, "category", "precision", "recall", "f1", "support", "claimed", "hits"
    )


def macro(matrix: DataFrame, labels: DataFrame, by: str = "approach") -> DataFrame:
    """Accuracy and the plain means over the labels; ``correct`` counts the diagonal, ``total`` all rows."""
    means = per_class(matrix, labels, by).groupBy(by).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    totals = matrix.groupBy(by).agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("correct")
    )
    return totals.join(means, by).withColumn("accuracy", ratio(F.col("correct"), F.col("total")))


def wide_confusion(matrix: DataFrame, labels: list[str], by: str = "approach", sentinel: str = INVALID_OUTPUT) -> DataFrame:
    """One row for each approach and actual label, one column for each predicted label and the sentinel.

    ``labels`` is the bounded list of labels that make the columns.
    """
    pivoted = matrix.groupBy(by, "actual").pivot("predicted", [*labels, sentinel]).agg(F.sum("n"))
    return pivoted.na.fill(0)


def top_confusions(matrix: DataFrame, count: int, by: str = "approach") -> DataFrame:
    """The ``count`` most frequent errors of each approach, ties by label names."""
    errors = matrix.where("actual <> predicted")
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("n"), "actual", "predicted"))
    return errors.withColumn("rank", rank).where(F.col("rank") <= count)


def error_examples(predictions: DataFrame, confusions: DataFrame, count: int = 3, by: str = "approach", sentinel: str = INVALID_OUTPUT) -> DataFrame:
    """The first ``count`` rows of each of the given confusions, by row index."""
    shown = shown_label(F.col("predicted"), F.col("label_valid"), sentinel)
    rows = predictions.select(by, "row_index", "actual", shown.alias("predicted"), "text")
    found = rows.join(F.broadcast(confusions.select(by, "actual", "predicted", "rank", "n")), [by, "actual", "predicted"])
    place = F.row_number().over(W.partitionBy(by, "rank").orderBy("row_index"))
    return found.withColumn("example", place).where(F.col("example") <= count)


def lowest_f1(classes: DataFrame, count: int = 10, by: str = "approach") -> DataFrame:
    """The ``count`` labels of lowest F1 of each approach, ties by name."""
    rank = F.row_number().over(W.partitionBy(by).orderBy("f1", "category"))
    return classes.withColumn("rank", rank).where(F.col("rank") <= count)


def error_totals(predictions: DataFrame, classes: DataFrame, by: str = "approach") -> DataFrame:
    """Errors by kind of each approach, and its numbers of labels with F1 of 0 and below one half."""
    wrong = ~F.coalesce("correct", F.lit(False))
    invalid = wrong & ~F.coalesce("label_valid", F.lit(True))
    errors = predictions.groupBy(by).agg(
        F.count_if(wrong).alias("errors"), F.count_if(invalid).alias("invalid"), F.count_if(wrong & ~invalid).alias("valid_label_errors")
    )
    low = classes.groupBy(by).agg(F.count_if(F.col("f1") == 0).alias("zero_f1"), F.count_if(F.col("f1") < 0.5).alias("below_half_f1"))
    return errors.join(low, by)


def output_rates(predictions: DataFrame, by: str = "approach") -> DataFrame:
    """Valid and invalid structured outputs; rates over the rows that have the flags, null without any."""
    kept = predictions.where("json_valid is not null")
    counts = kept.groupBy(by).agg(
        F.count("*").alias("records"),
        *(F.count_if(f"{c}").alias(c) for c in ("json_valid", "schema_valid", "label_valid")),
    )
    wrong = {f"{c}_invalid_rate": 1.0 - ratio(F.col(c), F.col("records")) for c in ("json_valid", "schema_valid", "label_valid")}
    return counts.withColumns(wrong)


def prediction_counts(predictions: DataFrame, by: str = "approach", sentinel: str = INVALID_OUTPUT) -> DataFrame:
    """How often each label is predicted, the sentinel included."""
    shown = shown_label(F.col("predicted"), F.col("label_valid"), sentinel)
    return predictions.groupBy(by, shown.alias("predicted")).agg(F.count("*").alias("n"))


def nearest_rank_summary(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Minimum, upper median, nearest-rank 95th and 99th percentile and maximum of an integer column.

    Values are counted first, and percentiles are read off the running counts of distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    order = W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(W.partitionBy(by))})

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("upto") >= place, F.col(value)))

    return ranked.groupBy(by).agg(
        F.max("total").alias("rows"),
        F.min(value).alias("min"),
        at(F.floor(F.col("total") / 2) + 1).alias("median"),
        at(F.ceil(F.col("total") * 95 / 100)).alias("p95"),
        at(F.ceil(F.col("total") * 99 / 100)).alias("p99"),
        F.max(value).alias("max"),
    )


def interpolated_percentiles(rows: DataFrame, value: str, by: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between neighbours: one column for each name of ``shares``.

    Like :func:`nearest_rank_summary` it works on running counts of distinct values, so no group is ever held whole.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    order = W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(W.partitionBy(by))})

    def point(share: float) -> Column:
        place = F.lit(share) * (F.col("total") - 1)
        low, high = (F.min(F.when(F.col("upto") > edge, F.col(value))).cast("double") for edge in (F.floor(place), F.ceil(place)))
        return low + (high - low) * F.max(place - F.floor(place))

    return ranked.groupBy(by).agg(F.max("total").alias("rows"), *(point(share).alias(name) for name, share in shares.items()))


def checked_limit(rows: DataFrame, count: int | None, order: list[str]) -> DataFrame:
    """The first ``count`` rows by ``order``, all without a count; a ValueError if it isn't positive."""
    if count is None:
        return rows
    if count < 1:
        raise ValueError("limit must be positive")
    return rows.orderBy(*order).limit(count)


def finite_metrics(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """``name, value`` of the rows whose value is a finite number, as a double."""
    number = F.col(value).try_cast("double")
    kept = rows.select(F.col(name).alias("name"), number.alias("value"))
    return kept.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def throughput(rows: DataFrame, begin: str, end: str, by: str) -> DataFrame:
    """``by, per_second``: rows with both times over the seconds from the first begin to the last end, null where that is 0 or less."""
    kept = rows.where(F.col(begin).isNotNull() & F.col(end).isNotNull())
    elapsed = (F.max(F.unix_micros(end)) - F.min(F.unix_micros(begin))) / 1_000_000
    found = kept.groupBy(F.col(by).alias("by")).agg(F.count("*").alias("n"), elapsed.alias("elapsed"))
    return found.select("by", F.when(F.col("elapsed") > 0, F.col("n") / F.col("elapsed")).alias("per_second"))
