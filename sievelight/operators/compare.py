"""Comparison of two approaches on the same rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions.structured import is_correct
from sievelight.operators.metrics import confusion, per_class, ratio


def _pair(predictions: DataFrame, left: str, right: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    def side(name: str, mark: str) -> DataFrame:
        chosen = predictions.where(F.col("approach") == name)
        return chosen.select("row_index", *(F.col(c).alias(f"{mark}_{c}") for c in columns))

    return side(left, "left"), side(right, "right")


def alignment_violations(predictions: DataFrame, left: str, right: str) -> DataFrame:
    """Rows in which the prediction sets disagree: ``row_index, rule``.

    Rules: a row missing on a side, another text, another actual label, and on each side a stored flag of
    correctness that doesn't follow from its labels, and a row index given twice.
    """
    one, two = _pair(predictions, left, right, "text", "actual", "predicted", "label_valid", "correct")
    joined = one.withColumn("l", F.lit(True)).join(two.withColumn("r", F.lit(True)), "row_index", "full")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()

    def flag(mark: str):
        computed = is_correct(F.col(f"{mark}_actual"), F.col(f"{mark}_predicted"), F.col(f"{mark}_label_valid"))
        return both & ~F.col(f"{mark}_correct").eqNullSafe(computed)

    rules = {
        "missing_left": F.col("l").isNull(),
        "missing_right": F.col("r").isNull(),
        "text": both & ~F.col("left_text").eqNullSafe(F.col("right_text")),
        "actual": both & ~F.col("left_actual").eqNullSafe(F.col("right_actual")),
        "left_correct": flag("left"),
        "right_correct": flag("right"),
    }
    found = joined.select("row_index", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    twice = predictions.where(F.col("approach").isin(left, right)).groupBy("approach", "row_index").count().where("count > 1")
    return found.unionByName(twice.select("row_index", F.lit("repeated").alias("rule"))).distinct()


def correctness_overlap(predictions: DataFrame, left: str, right: str) -> DataFrame:
    """One row: rows that both, only one or neither of the approaches have right, and each one's accuracy on them."""
    one, two = _pair(predictions, left, right, "correct")
    joined = one.join(two, "row_index")
    a, b = F.coalesce("left_correct", F.lit(False)), F.coalesce("right_correct", F.lit(False))
    return joined.agg(
        F.count("*").alias("records"),
        F.count_if(a & b).alias("both_correct"),
        F.count_if(a & ~b).alias("left_only_correct"),
        F.count_if(~a & b).alias("right_only_correct"),
        F.count_if(~a & ~b).alias("both_incorrect"),
        ratio(F.count_if(a), F.count("*")).alias("left_accuracy"),
        ratio(F.count_if(b), F.count("*")).alias("right_accuracy"),
    )


def checkpoint_violations(predictions: DataFrame, records: DataFrame, by: str = "approach") -> DataFrame:
    """Why scoring can't go on from the rows there are: approach, ``row_index, rule``.

    Rules: ``gap``, a row whose predecessor is missing; ``repeated``, an index given twice; ``unknown``, an index that
    no row of ``records`` (``row_index, text, actual``) has; ``text`` and ``actual``, another text or label than
    the record's. Predecessors are found by a join and not by numbering all rows in one task.
    """
    rows = predictions.select(by, "row_index", "text", "actual")
    before = rows.select(by, (F.col("row_index") + 1).alias("row_index")).distinct()
    gaps = rows.select(by, "row_index").where("row_index > 0").distinct().join(before, [by, "row_index"], "left_anti")
    twice = rows.groupBy(by, "row_index").count().where("count > 1")
    given = records.select("row_index", F.col("text").alias("given_text"), F.col("actual").alias("given_actual"), F.lit(True).alias("there"))
    joined = rows.join(given, "row_index", "left")
    there = F.col("there").isNotNull()
    rules = {
        "unknown": ~there,
        "text": there & ~F.col("text").eqNullSafe(F.col("given_text")),
        "actual": there & ~F.col("actual").eqNullSafe(F.col("given_actual")),
    }
    found = joined.select(by, "row_index", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    named = (frame.select(by, "row_index", F.lit(rule).alias("rule")) for frame, rule in ((gaps, "gap"), (twice, "repeated")))
    return found.unionByName(next(named)).unionByName(next(named)).distinct()


def support_violations(predictions: DataFrame, by: str = "approach") -> DataFrame:
    """Labels of another support than the most frequent support: approach, ``actual, records, wanted``.

    A paired resampling of equal classes needs none. Of several most frequent supports the greatest is wanted.
    """
    counts = predictions.groupBy(by, "actual").agg(F.count("*").alias("records"))
    usual = counts.groupBy(by, "records").agg(F.count("*").alias("labels")).groupBy(by).agg(F.max(F.struct("labels", "records")).alias("most"))
    joined = counts.join(usual.select(by, F.col("most.records").alias("wanted")), by)
    return joined.where(F.col("records") != F.col("wanted")).select(by, "actual", "records", "wanted")


OUTCOMES = ("both", "left_only", "right_only", "neither")


def _distinct_examples(candidates: pd.DataFrame) -> pd.DataFrame:
    """One row of each outcome, the first of an actual label that no example before has, or else the first."""
    used: set[str] = set()
    chosen = []
    for outcome in OUTCOMES:
        rows = candidates[candidates["outcome"] == outcome].sort_values("row_index")
        if len(rows):
            fresh = rows[~rows["actual"].isin(used)]
            chosen.append((fresh if len(fresh) else rows).head(1))
            used.update(chosen[-1]["actual"])
    return pd.concat(chosen)


def showcase_examples(predictions: DataFrame, left: str, right: str) -> DataFrame:
    """An example of each outcome, with distinct actual labels as far as there are: ``outcome, actual, row_index``.

    Chosen from the first rows by outcome and label, a table that the labels bound.
    """
    first = outcome_examples(predictions, left, right)
    return first.groupBy().applyInPandas(_distinct_examples, first.schema)


def outcome_examples(predictions: DataFrame, left: str, right: str) -> DataFrame:
    """The first row of each of the four outcomes and of each actual label in it: ``outcome, actual, row_index``."""
    one, two = _pair(predictions, left, right, "correct", "actual")
    joined = one.join(two.drop("right_actual"), "row_index")
    a, b = F.coalesce("left_correct", F.lit(False)), F.coalesce("right_correct", F.lit(False))
    outcome = F.when(a & b, "both").when(a, "left_only").when(b, "right_only").otherwise("neither")
    return joined.groupBy(outcome.alias("outcome"), F.col("left_actual").alias("actual")).agg(F.min("row_index").alias("row_index"))


def class_comparison(classes: DataFrame, left: str, right: str, tolerance: float = 1e-12) -> DataFrame:
    """F1 of each label for both approaches, the difference, who is better, and the ranks of the advantages."""
    one = classes.where(F.col("approach") == left).select("category", F.col("f1").alias("left_f1"))
    two = classes.where(F.col("approach") == right).select("category", F.col("f1").alias("right_f1"))
    joined = one.join(two, "category").withColumn("difference", F.col("left_f1") - F.col("right_f1"))
    better = F.when(F.col("difference") > tolerance, "left").when(F.col("difference") < -tolerance, "right").otherwise("tie")
    return joined.select(
        "*",
        better.alias("better"),
        F.row_number().over(W.orderBy(F.desc("difference"), "category")).alias("left_rank"),
        F.row_number().over(W.orderBy("difference", "category")).alias("right_rank"),
    )


def ranking(scores: DataFrame) -> DataFrame:
    """Approaches by macro F1, the best first; ties by name."""
    return scores.withColumn("rank", F.row_number().over(W.orderBy(F.desc("macro_f1"), "approach")))


def largest_advantages(compared: DataFrame, count: int = 10) -> DataFrame:
    """The labels of largest advantage of each side: ``side, rank, category, difference``; ties have none."""
    sides = {"left": F.desc("difference"), "right": F.asc("difference")}
    parts = []
    for side, order in sides.items():
        rank = F.row_number().over(W.orderBy(order, "category"))
        ranked = compared.where(F.col("better") == side).select("category", "difference").withColumn("rank", rank)
        parts.append(ranked.where(F.col("rank") <= count).select(F.lit(side).alias("side"), "rank", "category", "difference"))
    return parts[0].unionByName(parts[1])


def report_consistency(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals of each approach by three ways: rows, matrix and supports, and whether all agree on them.

    ``fingerprint`` is a sum of hashes of what was predicted for, so it must be one for all approaches.
    """
    rows = predictions.groupBy("approach").agg(
        F.count("*").alias("records"),
        F.count_if("correct").alias("correct"),
        F.sum(F.crc32(F.concat_ws(":", F.col("row_index").cast("string"), "actual"))).alias("fingerprint"),
    )
    matrix = confusion(predictions)
    sums = matrix.groupBy("approach").agg(F.sum("n").alias("matrix_total"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("diagonal"))
    supports = per_class(matrix, labels).groupBy("approach").agg(F.sum("support").alias("support_total"))
    joined = rows.join(sums, "approach").join(supports, "approach")
    every = W.partitionBy()
    same = F.min("fingerprint").over(every) == F.max("fingerprint").over(every)
    agree = (F.col("records") == F.col("matrix_total")) & (F.col("records") == F.col("support_total")) & (F.col("correct") == F.col("diagonal"))
    return joined.select("approach", "records", "correct", "matrix_total", "diagonal", "support_total", agree.alias("consistent"), same.alias("same_rows"))
