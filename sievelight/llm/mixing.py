"""Mixes of several sources with target shares of tokens, within allowed repeats.

Weights come from the sources' own token shares p and the wanted shares q by temperature: they are in
proportion to p ** (1 - a) * q ** a, between the least and the most that a source may have. The most is its
repetition limit, the least its wanted share or, if that is less, the limit. The exponent a is the greatest up
to 1, found by bisection, under which no source that can reach its share presses against its limit: at a = 1
the mix has the wanted shares, at 0 it takes every source as it is. The weights become budgets of tokens, and a
budget is filled with whole blocks, each one random permutation of the source's documents, and the beginning of
one more permutation.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.llm.bpe_automaton import count_tokens

PRECISION = 2.0**-48


def source_tokens(sized: DataFrame) -> DataFrame:
    """Tokens and documents of each source: ``source, tokens, documents``. A null source is left out."""
    return sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))


def _with_tokens(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """One row for each plan and source; of targets given twice, the greatest values hold."""
    kept = targets.where("plan_id is not null and source is not null").groupBy("plan_id", "source").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in ("share_bp", "max_repeats", "total_tokens"))
    )
    joined = kept.join(totals, "source", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents")})


def temperature(own: list[int], wanted: list[float], exponent: float) -> list[float]:
    """``own ** (1 - exponent) * wanted ** exponent`` in proportion to the greatest; all must be positive."""
    logs = [(1 - exponent) * math.log(p) + exponent * math.log(q) for p, q in zip(own, wanted)]
    return [math.exp(x - max(logs)) for x in logs]


def normalised(parts: list[float], least: list[float], most: list[float], total: float) -> tuple[list[float], float]:
    """``factor * parts`` within the bounds so that it adds up to ``total``, and the factor, found by bisection."""

    def at(factor: float) -> list[float]:
        return [min(max(factor * x, low), high) for x, low, high in zip(parts, least, most)]

    low, high = 0.0, max(high / x for x, high in zip(parts, most))
    while high - low > PRECISION * high:
        middle = (low + high) / 2
        low, high = (low, middle) if sum(at(middle)) >= total else (middle, high)
    return at(high), high


def mix_weights(own: list[int], wanted: list[int], limits: list[float]) -> tuple[list[float], float]:
    """Weights of the sources, adding up to 1 where the limits allow it, and the exponent they were found with.

    ``own`` are the sources' tokens, ``wanted`` their target shares in any unit, ``limits`` the largest weight
    that repeats allow. See the module's text; sources without tokens or without a wanted share have no weight.
    """
    whole = sum(wanted)
    used = [i for i, q in enumerate(wanted) if q > 0 and own[i] > 0 and limits[i] > 0]
    if not used:
        return [0.0] * len(own), 1.0
    parts, share, most = [own[i] for i in used], [wanted[i] / whole for i in used], [limits[i] for i in used]
    least = [min(q, limit) for q, limit in zip(share, most)]
    total = min(1.0, sum(most))

    def at(exponent: float) -> tuple[list[float], bool]:
        """Weights, and whether a source that can reach its share would pass its limit."""
        shaped = temperature(parts, share, exponent)
        weights, factor = normalised(shaped, least, most, total)
        return weights, any(factor * x > high * (1 + 1e-9) and high > q for x, high, q in zip(shaped, most, share))

    low, high = (0.0, 1.0) if at(1.0)[1] else (1.0, 1.0)
    while high - low > PRECISION:
        middle = (low + high) / 2
        low, high = (low, middle) if at(middle)[1] else (middle, high)
    found = dict(zip(used, at(low)[0]))
    return [found.get(i, 0.0) for i in range(len(own))], low


def _plan_budgets(plan: pd.DataFrame) -> pd.DataFrame:
    """Budgets of one plan's sources, a few dozen rows."""
    plan = plan.sort_values("source")
    size = int(plan["total_tokens"].iloc[0])
    own, repeats, wanted = (plan[c].tolist() for c in ("tokens", "max_repeats", "share_bp"))
    limits = [r * t / size if size else 0.0 for r, t in zip(repeats, own)]
    weights, exponent = mix_weights(own, wanted, limits)
    budgets = [min(int(round(w * size)), r * t) for w, r, t in zip(weights, repeats, own)]
    # A weight clipped at its limit; whole numbers decide, as weights are rounded.
    clipped = [r * t * 10_000 < size * q for r, t, q in zip(repeats, own, wanted)]
    return plan.assign(weight=weights, exponent=exponent, budget=budgets, clipped=clipped)[BUDGET_COLUMNS]


BUDGETS = (
    "plan_id string, source string, share_bp long, max_repeats long, total_tokens long, tokens long, weight double, "
    "exponent double, budget long, clipped boolean"
)
BUDGET_COLUMNS = [column.split()[0] for column in BUDGETS.split(", ")]


def mix_budgets(targets: DataFrame, totals: DataFrame) -> DataFrame:
    """Weight and budget of tokens of each plan and source, plan by plan in parallel.

    ``exponent`` is that of the plan's temperature, and ``clipped`` says that the repetition limit keeps the source
    below its wanted share.
    """
    return _with_tokens(targets, totals).groupBy("plan_id").applyInPandas(_plan_budgets, BUDGETS)


def mix(sized: DataFrame, budgets: DataFrame, seed: int = 42) -> DataFrame:
    """How often each plan uses each document: ``plan_id, doc_id, source, n_tokens, copies``.

    ``sized`` has ``doc_id, source, n_tokens``. A budget holds ``budget div tokens`` whole blocks; of one more
    permutation it takes the documents up to the budget, the last one if more than half of it fits. That place is found by
    token sums of 4,096 ranges of the random keys, so that only one range is ever ordered and summed up row
    by row, however large the source. Documents without tokens or with a null id are never used, and rows given
    twice under one id are one document, though the budgets count the tokens of both.
    """
    usable = sized.where("doc_id is not null and source is not null and n_tokens > 0").dropDuplicates(["doc_id"])
    chosen = budgets.where("budget > 0 and tokens > 0").select(
        "plan_id", "source", F.expr("budget div tokens").alias("blocks"), F.expr("budget % tokens").alias("rest")
    )
    # Bounded by plans x sources.
    offered = usable.join(F.broadcast(chosen), "source").withColumn("key", F.xxhash64(F.lit(seed), "plan_id", "doc_id"))
    offered = offered.withColumn("bucket", F.shiftrightunsigned("key", 52).cast("int"))
    cell = ["plan_id", "source"]
    sums = offered.groupBy(*cell, "rest", "bucket").agg(F.sum("n_tokens").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.partitionBy(*cell).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = (
        sums.withColumn("before", before)
        .where("before <= rest and before + sum > rest")
        .select(*cell, F.col("bucket").alias("edge"), (F.col("rest") - F.col("before")).alias("open"))
    )
    # Where the rest is more than all usable documents hold, there is no edge, and all of them are in.
    marked = offered.join(F.broadcast(edge), cell, "left")
    columns = [*cell, "doc_id", "n_tokens", "blocks"]
    within = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(True))
    outside = marked.where(~F.col("bucket").eqNullSafe(F.col("edge"))).select(*columns, within.alias("more"))
    running = F.sum("n_tokens").over(W.partitionBy(*cell).orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    inside = marked.where("bucket = edge").withColumn("more", 2 * running - F.col("n_tokens") <= 2 * F.col("open")).select(*columns, "more")
    copies = (F.col("blocks") + F.col("more").cast("long")).alias("copies")
    return outside.unionByName(inside).select("plan_id", "doc_id", "source", "n_tokens", copies).where("copies > 0")


def mix_report(mixed: DataFrame, budgets: DataFrame) -> DataFrame:
    """Wanted and actual tokens and shares of each plan and source; shares are of the plan's actual total."""
    used = mixed.groupBy("plan_id", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("repeats")
    )
    joined = budgets.join(used, ["plan_id", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("used_tokens", "repeats")})
    total = F.sum("used_tokens").over(W.partitionBy("plan_id"))
    return joined.select(
        "plan_id",
        "source",
        "share_bp",
        "budget",
        "used_tokens",
        "repeats",
        F.round(10_000 * F.col("used_tokens") / F.nullif(total, F.lit(0)), 4).alias("actual_bp"),
    )


def sized_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, source, n_tokens`` of each document, kept in memory or on disk since several steps use it."""
    return count_tokens(documents, ["doc_id", "source"], path=path).persist(StorageLevel.MEMORY_AND_DISK)
