"""Strict validation of structured model outputs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kept apart since reports and comparisons write them differently.
INVALID_OUTPUT = "__invalid_output__"
INVALID_OR_DISALLOWED = "__invalid_or_disallowed__"


def read_output(raw: str | None) -> tuple[bool, bool, str | None]:
    """Whether ``raw`` is JSON, whether it is an object with one string field ``category``, and that string.

    The whole string must be JSON as Python's reader takes it, so NaN counts and of a repeated key the last
    value holds. A string with half of a surrogate pair has a valid schema and no category.
    """
    if raw is None:
        return False, False, None
    try:
        value = json.loads(raw)
    except (ValueError, RecursionError):
        return False, False, None
    if not isinstance(value, dict) or set(value) != {"category"} or not isinstance(value["category"], str):
        return True, False, None
    category = value["category"]
    return True, True, category if category.encode("utf-8", "ignore").decode() == category else None


PARSED = "json_valid boolean, schema_valid boolean, predicted_category string"


def parse_outputs(outputs: DataFrame, raw_col: str, labels: DataFrame, label_col: str = "category") -> DataFrame:
    """``outputs`` with ``parsed``: a struct of json_valid, schema_valid, label_valid and predicted_category.

    The category is given wherever the schema is valid, also for a label that isn't allowed. A null output
    is invalid in every way. ``labels`` is the dimension of allowed labels; Spark broadcasts it if it is small.
    Names of other columns don't matter.
    """
    fields = [*outputs.columns]
    plain = outputs.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), F.col(raw_col).cast("string").alias("raw"))
    kind = plain.schema["row"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_output(raw) for raw in batch.column(1).to_pylist()]
            flags = zip(*found) if found else ((), (), ())
            kinds = (pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, k) for x, k in zip(flags, kinds))], ["row", "json_valid", "schema_valid", "predicted_category"]
            )

    allowed = labels.where(F.col(label_col).isNotNull()).select(F.col(label_col).alias("allowed")).distinct()
    parsed = plain.mapInArrow(parse, f"row {kind}, {PARSED}")
    joined = parsed.join(allowed, F.col("predicted_category") == F.col("allowed"), "left")
    valid = F.struct("json_valid", "schema_valid", F.col("allowed").isNotNull().alias("label_valid"), "predicted_category")
    return joined.select("row.*", valid.alias("parsed"))


def shown_label(predicted: Column, label_valid: Column, sentinel: str = INVALID_OUTPUT) -> Column:
    """The predicted label, or the sentinel where it isn't valid; a null flag counts as valid if there is a label."""
    valid = F.coalesce(label_valid, predicted.isNotNull()) & predicted.isNotNull()
    return F.when(valid, predicted).otherwise(F.lit(sentinel))


def is_correct(actual: Column, predicted: Column, label_valid: Column) -> Column:
    """A valid label that equals the actual one; false where anything is null."""
    return F.coalesce(label_valid, F.lit(True)) & F.coalesce(predicted == actual, F.lit(False))


def compact_response(category: Column) -> Column:
    """``{"category":"x"}`` without blanks."""
    return F.to_json(F.struct(category.alias("category")))


#: The labels by which a model says that it doesn't know.
UNKNOWN_LABELS = ("cannot_classify", "out_of_scope", "unknown", "unsupported_request")


def explicit_unknown(predicted: Column, names: tuple[str, ...] = UNKNOWN_LABELS) -> Column:
    """Whether a model says in a label of its own that it doesn't know; false for null."""
    return F.coalesce(F.lower(predicted).isin(*names), F.lit(False))
