"""Samples with target shares of each category, by controlled rounding and exact random-key quotas.

The quota of a category is spread over the ``source`` values of its records in proportion, which gives a
two-way table with fractional cells. Controlled rounding makes every cell the whole number below or
above, by a maximum flow, so that each category keeps its quota and each source total is the whole
number below or above its own. Within a cell, the records with the smallest random keys are drawn.
"""

from __future__ import annotations

from collections import deque
from fractions import Fraction

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions.text import canonical_category

BUCKETS = 4096
NO_SOURCE = "\x00"
CELL = "plan_id string, source_split string, category string, channel string, quota long, available long"


def needed_rows(targets: DataFrame) -> DataFrame:
    """``targets`` with ``needed``: the greater of the minimum and the whole part of the share."""
    share = F.expr("cast(sample_size as bigint) * cast(target_bp as bigint) div 10000")
    return targets.withColumn("needed", F.greatest(F.coalesce(F.col("min_rows").cast("long"), F.lit(0)), F.coalesce(share, F.lit(0))))


def category_counts(records: DataFrame) -> DataFrame:
    """Rows of each split, canonical category and source: ``source_split, category, channel, available``.

    A null source is a channel of its own; rows with a null category or split are in none. Names are
    brought to label form on the counts, not on the rows: the rows are counted as they are first.
    """
    stored = records.where("source_split is not null and category is not null").groupBy("source_split", "category", "source").agg(F.count("*").alias("n"))
    channel = F.coalesce("source", F.lit(NO_SOURCE)).alias("channel")
    return stored.groupBy("source_split", canonical_category("category").alias("category"), channel).agg(F.sum("n").alias("available"))


def category_quotas(wanted: list[Fraction], needed: list[int], available: list[int], size: int) -> list[int]:
    """Whole quotas of a plan's categories, in order: what each needs, and one more for the largest remainders.

    As many categories get one more as rows are missing from ``size``. No category gets more than is
    available, and what one lacks isn't given to others, whose shares it would distort. Minimums may
    lift the sum above ``size``.
    """
    quota = list(needed)
    below = sorted((i for i in range(len(quota)) if wanted[i] > quota[i]), key=lambda i: (quota[i] - wanted[i], i))
    for i in below[: max(0, size - sum(quota))]:
        quota[i] += 1
    return [min(q, a) for q, a in zip(quota, available)]


def controlled_rounding(cells: list[list[Fraction]], rows: list[int]) -> list[list[int]]:
    """Whole numbers next to ``cells`` whose row sums are ``rows`` and whose column sums are next to the cells' own.

    The exact row sums must be ``rows``. Maximum flow from rows over fractional cells to columns: a unit of
    flow rounds a cell up. First every column gets the whole part of its fraction, then at most one more.
    """
    width = len(cells[0]) if cells else 0
    rounded = [[x.numerator // x.denominator for x in row] for row in cells]
    left = [total - sum(row) for total, row in zip(rows, rounded)]
    fractions = [sum((cells[i][j] - rounded[i][j] for i in range(len(cells))), Fraction(0)) for j in range(width)]
    room = [f.numerator // f.denominator for f in fractions]
    usable = [[j for j in range(width) if cells[i][j] != rounded[i][j]] for i in range(len(cells))]
    up: list[set[int]] = [set() for _ in cells]
    into: list[set[int]] = [set() for _ in range(width)]

    def augment(limit: list[int]) -> bool:
        """Sends one more unit along a shortest path to a column with room."""
        queue = deque(i for i in range(len(cells)) if left[i] > 0)
        came: dict[tuple[str, int], tuple[str, int] | None] = {("r", i): None for i in queue}
        while queue:
            i = queue.popleft()
            for j in usable[i]:
                if j in up[i] or ("c", j) in came:
                    continue
                came["c", j] = ("r", i)
                if len(into[j]) < limit[j]:
                    node: tuple[str, int] = ("c", j)
                    while (row := came[node]) is not None:
                        up[row[1]].add(node[1])
                        into[node[1]].add(row[1])
                        before = came[row]
                        if before is None:
                            left[row[1]] -= 1
                            return True
                        up[row[1]].discard(before[1])
                        into[before[1]].discard(row[1])
                        node = before
                for k in into[j]:
                    if ("r", k) not in came:
                        came["r", k] = ("c", j)
                        queue.append(k)
        return False

    while augment(room):
        pass
    room = [r + (f.denominator > 1) for r, f in zip(room, fractions)]
    while augment(room):
        pass
    for i, columns in enumerate(up):
        for j in columns:
            rounded[i][j] += 1
    return rounded


def _plan_cells(plan: pd.DataFrame) -> pd.DataFrame:
    """Cells of one plan: a row for each of its categories and sources, at most labels x sources."""
    size = int(plan["sample_size"].iloc[0])
    cells: list[tuple] = []
    categories = sorted({(s, c) for s, c in zip(plan["source_split"], plan["category"])})
    channels = sorted(set(plan["channel"].dropna()))
    first = plan.drop_duplicates(["source_split", "category"]).set_index(["source_split", "category"])
    counts = {(s, c, ch): int(n) for s, c, ch, n in zip(plan["source_split"], plan["category"], plan["channel"], plan["available"]) if isinstance(ch, str)}
    available = [sum(counts.get((s, c, ch), 0) for ch in channels) for s, c in categories]
    wanted = [Fraction(size * int(first.at[x, "target_bp"]), 10_000) for x in categories]
    needed = [int(first.at[x, "needed"]) for x in categories]
    quotas = category_quotas(wanted, needed, available, size)
    exact = [
        [Fraction(q * counts.get((s, c, ch), 0), a) if a else Fraction(0) for ch in channels]
        for (s, c), q, a in zip(categories, quotas, available)
    ]
    whole = controlled_rounding(exact, quotas)
    name = plan["plan_id"].iloc[0]
    for (split, category), row in zip(categories, whole):
        cells += [(name, split, category, ch, q, n) for ch, q in zip(channels, row) if (n := counts.get((split, category, ch), 0))]
    return pd.DataFrame(cells, columns=["plan_id", "source_split", "category", "channel", "quota", "available"])


def sample_cells(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The whole quota of each plan, split, category and source that has any row.

    A plan's table has as many rows as it has targets and as many columns as there are sources; plans are
    worked on in parallel. Targets with a null plan, split or category are ignored, and of a target given
    twice the greatest values hold.
    """
    kept = targets.where("plan_id is not null and source_split is not null and category is not null")
    kept = kept.groupBy("plan_id", "source_split", "category").agg(
        *(F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("target_bp", "min_rows", "sample_size"))
    )
    joined = needed_rows(kept).join(category_counts(records), ["source_split", "category"], "left")
    return joined.groupBy("plan_id").applyInPandas(_plan_cells, CELL)


def draw_sample(records: DataFrame, targets: DataFrame, id_col: str = "record_id", seed: int = 42) -> DataFrame:
    """The sample of each plan: ``plan_id, record_id, source_split, category``.

    Keys are a hash of seed, plan and id, so the draw is reproducible. Every row counts: an id that stands in
    several rows is available, and may be drawn, as often. A row whose id is null is never drawn. No cell is
    sorted whole: keys are counted in 4,096 ranges, all rows of the ranges below the quota are taken, and only the
    range in which the quota falls is ranked.
    """
    cells = sample_cells(records, targets).where("quota > 0")
    plain = records.where(F.col(id_col).isNotNull() & F.col("category").isNotNull()).select(
        F.col(id_col).alias("record_id"), "source_split", canonical_category("category").alias("category"), F.coalesce("source", F.lit(NO_SOURCE)).alias("channel")
    )
    # Cells are bounded by plans x labels x sources, so they go to the rows and not the rows to them.
    key = F.xxhash64(F.lit(seed), "plan_id", "record_id")
    offered = plain.join(F.broadcast(cells.drop("available")), ["source_split", "category", "channel"]).withColumn("key", key)
    offered = offered.withColumn("bucket", F.shiftrightunsigned("key", 52).cast("int"))
    cell = ["plan_id", "source_split", "category", "channel"]
    counted = offered.groupBy(*cell, "quota", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*cell).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The last range of which any row is drawn, and how many of its rows are.
    last = F.max_by(F.struct("bucket", F.least("n", F.col("quota") - F.col("before")).alias("rest")), "bucket").alias("last")
    bounds = counted.withColumn("before", before).where("before < quota").groupBy(*cell).agg(last).select(*cell, "last.*").withColumnRenamed("bucket", "edge")
    marked = offered.join(F.broadcast(bounds), cell).where("bucket <= edge").persist(StorageLevel.MEMORY_AND_DISK)
    ranked = marked.where("bucket = edge").withColumn("rank", F.row_number().over(W.partitionBy(*cell).orderBy("key", "record_id")))
    out = [*cell[:1], "record_id", "source_split", "category"]
    return marked.where("bucket < edge").select(*out).unionByName(ranked.where("rank <= rest").select(*out))


def sample_report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Of each target: rows wanted, needed, available and drawn by the quotas of its cells, and whether those are enough."""
    drawn = sample_cells(records, targets).groupBy("plan_id", "source_split", "category").agg(F.sum("quota").alias("drawn"), F.sum("available").alias("available"))
    joined = needed_rows(targets).join(drawn, ["plan_id", "source_split", "category"], "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("drawn", "available")})
    return filled.select("plan_id", "source_split", "category", "target_bp", "needed", "available", "drawn", (F.col("drawn") >= F.col("needed")).alias("met"))
