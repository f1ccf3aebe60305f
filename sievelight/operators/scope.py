"""Rejection of requests out of scope: threshold search, decisions and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.operators.metrics import ratio

UNKNOWN, KNOWN = "out_of_scope", "in_scope"


def rejected(label_valid: Column, score: Column | None, threshold: Column | None) -> Column:
    """Rejected if the label isn't valid (null counts as invalid), or if the score is below the threshold.

    A null score isn't below any threshold.
    """
    invalid = ~F.coalesce(label_valid, F.lit(False))
    if score is None or threshold is None:
        return invalid
    return invalid | F.coalesce(score < threshold, F.lit(False))


def scope_of(label: Column, known: tuple[str, ...]) -> Column:
    """In scope for one of the ``known`` labels, out of scope for any other and for null."""
    return F.when(F.coalesce(label.isin(*known), F.lit(False)), KNOWN).otherwise(UNKNOWN)


def category_correct(scope: Column, correct: Column) -> Column:
    """Whether the label is right, null for requests out of scope, which have no right one; an unknown label is wrong."""
    return F.when(scope == KNOWN, F.coalesce(correct, F.lit(False)))


def threshold_candidates(rows: DataFrame, score: str = "score", digits: int = 6) -> DataFrame:
    """Every threshold that decides differently: ``threshold, known_below, unknown_below``.

    Thresholds lie midway between neighbouring distinct scores, and one below the least and above the greatest. The
    counts are of rows with a valid label whose score is below it. Scores are rounded to ``digits`` first, so a
    score in [0, 1] has at most a million values however many rows there are, and running sums over the distinct
    values replace a join of thresholds with rows.
    """
    valid = F.coalesce(F.col("label_valid"), F.lit(False))
    rounded = rows.where(F.col(score).isNotNull()).select(F.round(score, digits).alias("value"), "scope", valid.alias("valid"))
    counts = rounded.groupBy("value").agg(
        F.count_if((F.col("scope") == KNOWN) & F.col("valid")).alias("known"), F.count_if((F.col("scope") == UNKNOWN) & F.col("valid")).alias("unknown")
    )
    upto = W.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    following = F.lead("value").over(W.orderBy("value"))
    above = counts.select(
        F.coalesce((F.col("value") + following) / 2, F.col("value") + 1.0).alias("threshold"),
        F.sum("known").over(upto).alias("known_below"),
        F.sum("unknown").over(upto).alias("unknown_below"),
    )
    least = rounded.agg(F.min("value").alias("value")).where("value is not null")
    zero = F.lit(0).cast("long")
    return least.select((F.col("value") - 1.0).alias("threshold"), zero.alias("known_below"), zero.alias("unknown_below")).unionByName(above)


def threshold_search(rows: DataFrame, score: str = "score", digits: int = 6) -> DataFrame:
    """The best threshold, one row: greatest balanced accuracy, then fewest known and most unknown rejections.

    Columns ``threshold, balanced_accuracy, known_rejected, unknown_rejected``; the greatest threshold of several
    equal ones holds. Rows: ``scope`` (in_scope or out_of_scope), ``label_valid`` and the score. No row comes out
    where there is no score, and the accuracy of a scope without rows is 0.
    """
    scored = rows.where(F.col(score).isNotNull())
    invalid = ~F.coalesce(F.col("label_valid"), F.lit(False))
    known, unknown = F.col("scope") == KNOWN, F.col("scope") == UNKNOWN
    totals = scored.agg(
        F.count_if(known).alias("known"),
        F.count_if(unknown).alias("unknown"),
        F.count_if(known & invalid).alias("known_invalid"),
        F.count_if(unknown & invalid).alias("unknown_invalid"),
    )
    joined = threshold_candidates(rows, score, digits).crossJoin(F.broadcast(totals))
    counted = joined.withColumns(
        {"known_rejected": F.col("known_below") + F.col("known_invalid"), "unknown_rejected": F.col("unknown_below") + F.col("unknown_invalid")}
    )
    balanced = (ratio(F.col("unknown_rejected"), F.col("unknown")) + ratio(F.col("known") - F.col("known_rejected"), F.col("known"))) / 2
    order = F.struct(balanced.alias("balanced_accuracy"), (-F.col("known_rejected")).alias("spared"), "unknown_rejected", "threshold")
    best = counted.agg(F.max(order).alias("best")).where("best is not null")
    return best.select("best.threshold", "best.balanced_accuracy", (-F.col("best.spared")).alias("known_rejected"), "best.unknown_rejected")


def decisions(rows: DataFrame, thresholds: DataFrame | None = None, score: str = "score") -> DataFrame:
    """``rows`` with ``rejected`` and ``outcome``: known or unknown, accepted or rejected.

    ``thresholds`` is the one row of a finished search; without it only invalid labels are rejected.
    """
    if thresholds is None:
        marked = rows.withColumn("rejected", rejected(F.col("label_valid"), None, None))
    else:
        frozen = F.broadcast(thresholds.select(F.col("threshold").alias("__threshold")))
        marked = rows.crossJoin(frozen).withColumn("rejected", rejected(F.col("label_valid"), F.col(score), F.col("__threshold"))).drop("__threshold")
    side = F.when(F.col("scope") == UNKNOWN, "unknown").otherwise("known")
    return marked.withColumn("outcome", F.concat_ws("_", side, F.when(F.col("rejected"), "rejected").otherwise("accepted")))


def decision_counts(decided: DataFrame, by: str = "probe_group") -> DataFrame:
    """Rows of each outcome in all (null group) and by group; outcomes that don't occur have no row."""
    return decided.groupingSets([["outcome"], [by, "outcome"]], by, "outcome").agg(F.count("*").alias("records"))


def decision_rates(decided: DataFrame) -> DataFrame:
    """One row: shares of unknown and of known requests that are rejected, null where there are none."""

    def share(scope: str) -> Column:
        return F.count_if(F.col("outcome") == f"{scope}_rejected") / F.nullif(F.count_if(F.col("outcome").startswith(scope)), F.lit(0))

    return decided.agg(share("unknown").alias("unknown_rejection_rate"), share("known").alias("known_false_rejection_rate"))


def rejection_audit(decided: DataFrame, by: str = "approach") -> DataFrame:
    """Counts of rejected, accepted and right rows; the accuracy of accepted ones is null without any."""
    right, no = F.coalesce("correct", F.lit(False)), F.col("rejected")
    counts = decided.groupBy(by).agg(
        F.count("*").alias("records"),
        F.count_if(no).alias("rejected"),
        F.count_if(~no).alias("accepted"),
        F.count_if(~no & right).alias("accepted_correct"),
        F.count_if(no & right).alias("correct_rejected"),
    )
    return counts.withColumns(
        {"rejected_rate": ratio(F.col("rejected"), F.col("records")), "accepted_accuracy": F.col("accepted_correct") / F.nullif(F.col("accepted"), F.lit(0))}
    )


def external_counts(decided: DataFrame, by: str = "probe_group") -> DataFrame:
    """Accepted and rejected rows of each group."""
    return decided.groupBy(by).agg(F.count_if(~F.col("rejected")).alias("accepted"), F.count_if("rejected").alias("rejected"))
