"""Robustness probes: their rules, and scores by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.structured import explicit_unknown
from sievelight.operators.metrics import ratio

GROUPS = ("short", "long", "ambiguous", "out_of_scope")


def probe_violations(probes: DataFrame, labels: DataFrame, source: str, groups: tuple[str, ...] = GROUPS, per_group: int | None = None) -> DataFrame:
    """Broken rules: ``id, rule``. No row means that the probes may be used.

    ``labels`` is the dimension of allowed labels. A group of which there is no probe has a row with its name as id,
    and so has one of another number of probes than ``per_group``.
    """
    allowed = labels.where("category is not null").agg(F.collect_set("category").alias("allowed"))
    rows = probes.crossJoin(F.broadcast(allowed))
    none = F.array().cast("array<string>")
    acceptable, expected = F.coalesce("acceptable_categories", none), F.col("expected_category")
    group, one = F.col("probe_group"), F.col("probe_group").isin("short", "long")
    no = F.lit(False)
    rules = {
        "group": ~F.coalesce(group.isin(*groups), no),
        "source": ~F.coalesce(F.col("source") == source, no),
        "blank_text": F.coalesce(F.col("text").rlike(r"(?U)\A\s*\z"), F.lit(True)),
        "unknown_acceptable": F.size(F.array_except(acceptable, "allowed")) > 0,
        "inconsistent_expected": expected.isNotNull() & ~(F.array_contains("allowed", expected) & (F.array_distinct(acceptable) == F.array(expected))),
        "expected_missing": one & expected.isNull(),
        "ambiguous_target": (group == "ambiguous") & (expected.isNotNull() | (F.size(acceptable) == 0)),
        "scope_target": (group == "out_of_scope") & (expected.isNotNull() | (F.size(acceptable) > 0)),
    }
    found = rows.select("id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    twice = probes.groupBy("id").count().where("count > 1").select("id", F.lit("repeated_id").alias("rule"))
    spark = probes.sparkSession
    wanted = spark.createDataFrame([(g,) for g in groups], "id string")
    missing = wanted.join(probes.select(group.alias("id")).distinct(), "id", "left_anti").select("id", F.lit("missing_group").alias("rule"))
    every = found.unionByName(twice).unionByName(missing)
    if per_group is not None:
        counts = probes.where(group.isin(*groups)).groupBy(group.alias("id")).count().where(F.col("count") != per_group)
        every = every.unionByName(counts.select("id", F.lit("group_size").alias("rule")))
    return every.distinct()


def scored_probes(probes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each probe with each approach's prediction: ``exact_match, acceptable_match, explicit_unknown``.

    ``predictions`` has ``id, approach, predicted`` and may have the validity flags; a null label flag counts as
    valid, as classical approaches have none.
    """
    flags = [F.col(c) if c in predictions.columns else F.lit(None).cast("boolean").alias(c) for c in ("json_valid", "schema_valid", "label_valid")]
    given = predictions.select("id", "approach", F.col("predicted").alias("predicted"), *flags)
    joined = probes.select("id", "probe_group", "expected_category", "acceptable_categories").join(given, "id")
    valid = F.coalesce("label_valid", F.lit(True))
    return joined.withColumns(
        {
            "label_valid": valid,
            "exact_match": valid & F.coalesce(F.col("predicted") == F.col("expected_category"), F.lit(False)),
            "acceptable_match": valid & F.coalesce(F.array_contains("acceptable_categories", F.col("predicted")), F.lit(False)),
            "explicit_unknown": explicit_unknown(F.col("predicted")),
        }
    )


def probe_scores(scored: DataFrame) -> DataFrame:
    """One row for each group and approach; a group's success is what it asks for.

    Short and long probes ask for the expected label, ambiguous ones for an acceptable label, and those out of scope
    for an explicit unknown label; a made-up label is not safe.
    """
    success = (
        F.when(F.col("probe_group").isin("short", "long"), F.col("exact_match"))
        .when(F.col("probe_group") == "ambiguous", F.col("acceptable_match"))
        .otherwise(F.col("explicit_unknown"))
    )
    counts = scored.groupBy("probe_group", "approach").agg(
        F.count("*").alias("records"),
        F.count_if(success).alias("successes"),
        F.count_if("label_valid").alias("forced"),
        F.count_if(~F.col("label_valid")).alias("invalid"),
        F.count_if("explicit_unknown").alias("explicit_unknown"),
    )
    return counts.withColumn("success_rate", ratio(F.col("successes"), F.col("records")))


def failed_probes(scored: DataFrame) -> DataFrame:
    """Probes that miss what their group asks for."""
    group = F.col("probe_group")
    failed = F.when(group.isin("short", "long"), ~F.col("exact_match")).when(group == "ambiguous", ~F.col("acceptable_match")).otherwise(~F.col("explicit_unknown"))
    return scored.where(failed).select("id", "probe_group", "approach", "predicted")
