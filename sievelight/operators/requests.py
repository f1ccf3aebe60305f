"""Batch form of the service: checks of requests, routes and suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stripped(text: Column | str) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"(?U)\A\s+|\s+\z", "")


def request_status(text: Column, longest: int = 2000) -> Column:
    """``accepted``, ``empty`` (null, too) or ``too_long``, by code points of the stripped text."""
    length = F.length(stripped(text))
    return F.when(F.coalesce(length, F.lit(0)) == 0, "empty").when(length > longest, "too_long").otherwise("accepted")


#: Fixed value: the name of the only policy of routes there is.
ROUTING_POLICY = "provisional_project_mapping"


def body_status(body: Column, field: str = "text", longest: int = 2000) -> Column:
    """Status of a request's JSON body: that of its text, or ``invalid`` for one that isn't an object of the one string ``field``."""
    fields = F.from_json(body, "map<string,string>")
    only = F.coalesce(F.map_keys(fields) == F.array(F.lit(field)), F.lit(False))
    return F.when(~only | F.element_at(fields, field).isNull(), "invalid").otherwise(request_status(F.element_at(fields, field), longest))


def route_violations(routes: DataFrame, labels: DataFrame, priorities: tuple[str, ...] = ("urgent", "standard", "low")) -> DataFrame:
    """Broken rules of the routes: ``category, rule``.

    Every label must have exactly one team and a known priority, and no other label may have one.
    """
    wanted = labels.where("category is not null").select("category").distinct()
    counts = routes.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("team").isNull()).alias("teamless"), F.count_if(~F.coalesce(F.col("priority").isin(*priorities), F.lit(False))).alias("bad"))
    joined = wanted.withColumn("wanted", F.lit(True)).join(counts, "category", "full")
    rules = {
        "no_route": F.col("n").isNull(),
        "unknown_category": F.col("wanted").isNull(),
        "several_routes": F.col("n") > 1,
        "no_team": F.col("teamless") > 0,
        "priority": F.col("bad") > 0,
    }
    return joined.select("category", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))


def classify_requests(
    outputs: DataFrame, routes: DataFrame, longest: int = 2000, enabled: bool = True, label: str = "predicted", readable: int | None = None
) -> DataFrame:
    """Answer of the service to each row of ``text`` and model label: ``status_code, category, priority, team, routing_policy``.

    503 if the service is off, 422 for a text that isn't accepted, 413 for one with more than ``readable``
    characters, which the model can't read, 422 for a label without a route, else 200. Routes are as many as labels;
    Spark broadcasts them by their size.
    """
    plain = routes.groupBy("category").agg(F.first("priority").alias("priority"), F.first("team").alias("team"))
    joined = outputs.join(plain.withColumnRenamed("category", "category_routed"), F.col(label) == F.col("category_routed"), "left")
    unread = F.lit(False) if readable is None else F.length(stripped("text")) > readable
    status = (
        F.when(F.lit(not enabled), 503).when(request_status(F.col("text"), longest) != "accepted", 422).when(unread, 413)
        .when(F.col("category_routed").isNotNull(), 200).otherwise(422)
    )
    sources = {"category": F.col("category_routed"), "priority": F.col("priority"), "team": F.col("team"), "routing_policy": F.lit(ROUTING_POLICY)}
    return joined.withColumns({"status_code": status} | {c: F.when(status == 200, x) for c, x in sources.items()}).drop("category_routed")


def suggestions(outputs: DataFrame, labels: DataFrame, longest: int = 2000, label: str = "predicted", enabled: bool = True) -> DataFrame:
    """``outputs`` with ``suggested, suggestion_status, review_required``; a suggestion always needs a review.

    While the assistant is off there is no suggestion, and the status is ``disabled``.
    """
    allowed = labels.where("category is not null").select(F.col("category").alias("suggested")).distinct()
    joined = outputs.join(allowed, F.col(label) == F.col("suggested"), "left")
    too_long = request_status(F.col("text"), longest) == "too_long"
    status = (
        F.when(F.lit(not enabled), "disabled").when(too_long, "input_too_long")
        .when(F.col("suggested").isNotNull(), "available").otherwise("invalid_model_output")
    )
    return joined.withColumns({"suggestion_status": status, "suggested": F.when(status == "available", F.col("suggested")), "review_required": F.lit(True)})


def label_names(*tables: DataFrame) -> DataFrame:
    """``category, place`` of the labels of all tables together, in order; labels bound the table that is ordered."""
    every = reduce(DataFrame.unionByName, (t.where("category is not null").select("category") for t in tables)).distinct()
    return every.withColumn("place", F.row_number().over(W.orderBy("category")))


#: Fixed value: the text before the list of labels in the instruction of a model.
INSTRUCTION = (
    "Classify one banking support request. Respond with exactly one JSON object "
    'using this schema: {"category":"one_allowed_category"}. '
    "Do not add markdown, explanation, or extra keys. The allowed categories are: "
)


def instruction(labels: DataFrame) -> DataFrame:
    """One row: the instruction that names all labels in order, and its SHA-256: ``prompt, sha256, labels``."""
    names = labels.where("category is not null").agg(F.array_sort(F.collect_set("category")).alias("names"))
    return names.select(F.concat(F.lit(INSTRUCTION), F.array_join("names", ", ")).alias("prompt"), F.size("names").alias("labels")).withColumn("sha256", F.sha2("prompt", 256))


def instruction_violations(labels: DataFrame, count: int, sha256: str) -> DataFrame:
    """Whether the instruction is the one that was evaluated: a ``rule`` for another number of labels or another hash."""
    rules = {"labels": F.col("labels") != count, "sha256": F.col("sha256") != sha256}
    return instruction(labels).select(F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
