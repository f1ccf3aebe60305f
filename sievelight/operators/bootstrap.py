"""Stratified paired bootstrap with deterministic draws.

A metric only needs the counts of each (actual, predicted, ...) cell, so a draw picks a cell of its class
and not a row: the rows of a class are numbered through its cells in label order, draw j of replicate b
takes number ``hash(seed, b, class, j) mod support``, and the cell whose range holds the number is drawn. All
approaches share the draw, since a cell has the predictions of all of them. Draws are generated where they
are counted and meet only the table of cells, which labels bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelight.functions.structured import INVALID_OUTPUT, shown_label
from sievelight.operators.metrics import per_class, ratio


#: Draws that are spread from one row.
DRAWS_AT_ONCE = 4096
#: Ranges of numbers in a class.
RANGES = 256


def hash_number(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the parts joined by colons, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def outcome_cells(predictions: DataFrame, approaches: list[str], sentinel: str = INVALID_OUTPUT) -> DataFrame:
    """Cells of the aligned rows: actual label, one predicted label for each approach, count and range of numbers."""
    shown = predictions.select("row_index", "approach", "actual", shown_label(F.col("predicted"), F.col("label_valid"), sentinel).alias("shown"))
    sides = [F.max(F.when(F.col("approach") == name, F.col("shown"))).alias(f"p{k}") for k, name in enumerate(approaches)]
    rows = shown.groupBy("row_index", "actual").agg(*sides).na.drop()
    names = [f"p{k}" for k in range(len(approaches))]
    cells = rows.groupBy("actual", *names).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("actual").orderBy(*names).rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumns({"end": upto, "support": F.sum("n").over(W.partitionBy("actual"))}).withColumn("start", F.col("end") - F.col("n"))


def replicate_counts(cells: DataFrame, approaches: list[str], replicates: int, seed: int) -> DataFrame:
    """Confusion counts of each replicate: ``replicate, approach, actual, predicted, n``.

    Every class is drawn as often as it has rows.
    """
    if replicates < 1:
        raise ValueError("replicates must be positive")
    spark = cells.sparkSession
    classes = cells.select("actual", "support").distinct()
    rounds = spark.range(replicates).select(F.col("id").alias("replicate"))
    # In two steps, so that no row ever holds as many numbers as its class has rows.
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("support") - 1, F.lit(DRAWS_AT_ONCE).cast("long"))).alias("first")
    spread = rounds.crossJoin(F.broadcast(classes)).select("replicate", "actual", "support", runs)
    draws = spread.select("replicate", "actual", "support", F.explode(F.sequence("first", F.least(F.col("first") + DRAWS_AT_ONCE, "support") - 1)).alias("j"))
    number = hash_number(F.lit(str(seed)), F.col("replicate").cast("string"), F.col("actual"), F.col("j").cast("string")) % F.col("support")
    # Cells are looked up by ranges of numbers, so that a draw meets few of its class.
    drawn = draws.select("replicate", "actual", number.alias("number"), F.expr(f"greatest(1, support div {RANGES})").alias("step"))
    picks = drawn.select("replicate", "actual", "number", F.expr("number div step").alias("range"))
    ranged = cells.withColumn("step", F.expr(f"greatest(1, support div {RANGES})")).select(
        "actual", "start", "end", *(f"p{k}" for k in range(len(approaches))), F.explode(F.expr("sequence(start div step, (end - 1) div step)")).alias("range")
    )
    met = picks.join(F.broadcast(ranged), ["actual", "range"]).where("number >= start and number < end")
    hit = met.groupBy("replicate", "actual", *(f"p{k}" for k in range(len(approaches)))).agg(F.count("*").alias("times"))
    sides = F.explode(F.array(*(F.struct(F.lit(name).alias("approach"), F.col(f"p{k}").alias("predicted")) for k, name in enumerate(approaches))))
    return hit.select("replicate", "actual", "times", sides.alias("side")).groupBy(
        "replicate", "side.approach", "actual", "side.predicted"
    ).agg(F.sum("times").alias("n"))


def replicate_metrics(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Accuracy and macro F1 of each replicate and approach."""
    keyed = counts.withColumn("key", F.concat_ws("|", F.col("replicate").cast("string"), "approach"))
    macro_f1 = per_class(keyed, labels, "key").groupBy("key").agg(F.avg("f1").alias("macro_f1"))
    totals = keyed.groupBy("key", "replicate", "approach").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))), F.lit(0)).alias("correct")
    )
    return totals.join(macro_f1, "key").select("replicate", "approach", ratio(F.col("correct"), F.col("total")).alias("accuracy"), "macro_f1")


def multinomial_metrics(cells: DataFrame, labels: DataFrame, approaches: list[str], replicates: int, seed: int) -> DataFrame:
    """Accuracy and macro F1 of each replicate and approach, like :func:`replicate_metrics` of :func:`replicate_counts`.

    Draws with replacement from the rows of a class put a multinomial count on each of its cells, so the work is
    replicates x cells however many rows there are. The cells, which labels bound, go to the tasks; each
    replicate has a generator of its own, so it is the same in any partition.
    """
    if replicates < 1:
        raise ValueError("replicates must be positive")
    spark = cells.sparkSession
    names = [f"p{k}" for k in range(len(approaches))]
    local = sorted(tuple(row) for row in cells.select("actual", *names, "n", "support").collect())
    places = {row.category: k for k, row in enumerate(labels.where("category is not null").select("category").distinct().orderBy("category").collect())}
    kind = "replicate long, approach string, accuracy double, macro_f1 double"
    if not local or not places:
        return spark.createDataFrame([], kind)
    classes = {actual: k for k, actual in enumerate(sorted({row[0] for row in local}))}
    members: list[list[int]] = [[] for _ in classes]
    for k, row in enumerate(local):
        members[classes[row[0]]].append(k)
    width, other = max(map(len, members)), len(places)
    support = np.array([local[own[0]][-1] for own in members])
    # Zeros stand first, so that what rounding leaves goes to a cell of the class.
    chances, where = np.zeros((len(members), width)), np.zeros(len(local), np.int64)
    for c, own in enumerate(members):
        for j, k in enumerate(sorted(own, key=lambda k: -local[k][-2]), width - len(own)):
            chances[c, j], where[k] = local[k][-2] / support[c], c * width + j
    actual = np.array([places.get(row[0], other) for row in local])
    sides = [(np.array([places.get(row[1 + s], other) for row in local]), np.array([row[0] == row[1 + s] for row in local])) for s in range(len(approaches))]
    shared = spark.sparkContext.broadcast((support, chances, where, actual, sides))

    def ratios(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        support, chances, where, actual, sides = shared.value
        for batch in batches:
            out: list[tuple] = []
            for replicate in batch.column(0).to_pylist():
                chance = np.random.Generator(np.random.Philox(key=np.array([seed, replicate], np.uint64)))
                times = chance.multinomial(support, chances).ravel()[where]
                there = np.bincount(actual, times, other + 1)[:other]
                for name, (predicted, right) in zip(approaches, sides):
                    hits = np.bincount(predicted, times * right, other + 1)[:other]
                    precision, recall = ratios(hits, np.bincount(predicted, times, other + 1)[:other]), ratios(hits, there)
                    f1 = ratios(2 * precision * recall, precision + recall)
                    out.append((replicate, name, times[right].sum() / times.sum(), f1.mean()))
            if out:
                columns = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.float64()))], kind_names)

    kind_names = ["replicate", "approach", "accuracy", "macro_f1"]
    return spark.range(replicates).mapInArrow(draw, kind)


def intervals(metrics: DataFrame, level: float = 0.95) -> DataFrame:
    """Linear percentile interval of each approach and metric: ``approach, metric, low, high``."""
    tail = (1 - level) / 2
    long = metrics.unpivot(["replicate", "approach"], ["accuracy", "macro_f1"], "metric", "value")
    ends = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return long.groupBy("approach", "metric").agg(ends.alias("e")).select("approach", "metric", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))


def paired_differences(metrics: DataFrame, points: DataFrame, left: str, right: str, level: float = 0.95) -> DataFrame:
    """Difference of two approaches, its interval on the same replicates, and whether this excludes 0.

    ``points`` has the approaches' scores on all rows: ``approach, accuracy, macro_f1``.
    """
    tail = (1 - level) / 2
    chosen = (F.max(F.when(F.col("approach") == name, F.col("value"))) for name in (left, right))
    difference = next(chosen) - next(chosen)
    long = metrics.unpivot(["replicate", "approach"], ["accuracy", "macro_f1"], "metric", "value")
    sides = long.groupBy("replicate", "metric").agg(difference.alias("d"))
    ends = F.percentile("d", F.array(F.lit(tail), F.lit(1 - tail)))
    out = sides.groupBy("metric").agg(ends.alias("e")).select("metric", F.col("e")[0].alias("low"), F.col("e")[1].alias("high"))
    whole = points.unpivot(["approach"], ["accuracy", "macro_f1"], "metric", "value").groupBy("metric").agg(difference.alias("difference"))
    joined = whole.join(F.broadcast(out), "metric").select("metric", "difference", "low", "high")
    return joined.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))
