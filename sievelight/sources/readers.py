"""Readers of split files, prediction files, reports and file lists. None of them brings rows to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.structured import INVALID_OR_DISALLOWED


def require_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``frame``, or a ValueError that names the columns it lacks."""
    missing = sorted(set(columns) - set(frame.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def require_rows(frame: DataFrame, what: str = "table") -> DataFrame:
    """``frame``, or a ValueError if it is empty; reads one row."""
    if frame.isEmpty():
        raise ValueError(f"{what} is empty")
    return frame


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, all strings; quoted values may hold line ends, quotes are doubled.

    Empty values are empty strings, as quoted and bare ones can't be told apart by readers that know no nulls.
    """
    frame = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).na.fill("")
    return require_columns(frame, columns or [])


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """A split file as ``text, category, source_split``."""
    return read_csv(spark, path, ["text", "category"]).select("text", "category", F.lit(split).alias("source_split"))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON Lines; blank lines are skipped, and a line that isn't JSON is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


CLASSICAL = ["row_index", "text", "actual", "predicted", "correct"]
MODEL = (
    "row_index long, text string, actual_category string, raw_output string, json_valid boolean, schema_valid boolean, "
    "label_valid boolean, predicted_category string, correct boolean"
)


def read_predictions(spark: SparkSession, path: str, approach: str, form: str, sentinel: str = INVALID_OR_DISALLOWED) -> DataFrame:
    """Predictions of either form in one schema; those without a valid label are ``sentinel``."""
    if form == "csv":
        rows = read_csv(spark, path, CLASSICAL)
        none = F.lit(None).cast("boolean")
        return rows.select(
            F.lit(approach).alias("approach"), F.col("row_index").cast("long").alias("row_index"), "text", "actual", "predicted",
            (F.col("correct") == "True").alias("correct"), none.alias("json_valid"), none.alias("schema_valid"), F.lit(True).alias("label_valid"),
        )
    if form != "jsonl":
        raise ValueError("form must be csv or jsonl")
    shown = F.when(F.coalesce("label_valid", F.lit(False)), F.col("predicted_category")).otherwise(sentinel)
    return read_json_lines(spark, path, MODEL).select(
        F.lit(approach).alias("approach"), "row_index", "text", F.col("actual_category").alias("actual"), shown.alias("predicted"), "correct",
        "json_valid", "schema_valid", "label_valid",
    )


def read_confusion(spark: SparkSession, path: str) -> DataFrame:
    """A wide confusion matrix as ``actual, predicted, n``."""
    wide = read_csv(spark, path)
    first, *labels = wide.columns
    counts = wide.select(F.col(f"`{first}`").alias("actual"), *(F.col(f"`{c}`").cast("long").alias(c) for c in labels))
    return counts.unpivot(["actual"], [f"`{c}`" for c in labels], "predicted", "n")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report of one JSON document."""
    return spark.read.json(path, multiLine=True)


REPORT = "metrics struct<per_class:map<string,struct<precision:double,recall:double,f1:double,support:long>>>"


def read_report_labels(spark: SparkSession, path: str, count: int | None = None) -> list[str]:
    """The labels of a report's ``metrics.per_class``, in order; a ValueError if there are none, or not ``count``."""
    rows = spark.read.schema(REPORT).json(path, multiLine=True).select(F.array_sort(F.map_keys("metrics.per_class")).alias("labels")).collect()
    labels = list(rows[0].labels or []) if rows else []
    if not labels or count is not None and len(labels) != count:
        raise ValueError(f"the report has {len(labels)} labels")
    return labels


PROBE = "id string, group string, text string, expected_category string, acceptable_categories array<string>, source string"
PROBE_FIELDS = [field.split()[0] for field in PROBE.split(", ")]


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probes of a JSON Lines file, with ``probe_group`` for its ``group`` and ``keys_valid``: exactly the known fields.

    Blank lines are skipped; a line that isn't JSON has null fields and invalid keys.
    """
    lines = spark.read.text(path).where(r"value rlike '\\S'")
    keys = F.array_sort(F.json_object_keys("value"))
    parsed = lines.select(F.from_json("value", PROBE).alias("probe"), F.coalesce(keys == F.array(*map(F.lit, sorted(PROBE_FIELDS))), F.lit(False)).alias("keys_valid"))
    return parsed.select("probe.*", "keys_valid").withColumnRenamed("group", "probe_group")


def read_external(spark: SparkSession, path: str, sha256: str, groups: dict[str, str], per_label: int = 30) -> DataFrame:
    """``text, label, group`` of the pinned outside set, a JSON document with ``[text, label]`` pairs under ``test``.

    Only labels of ``groups`` are taken. A ValueError if the file has another hash, or a label another number of
    rows than ``per_label``; labels bound that check.
    """
    files = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"))
    if [row.sha256 for row in files.select("sha256").collect()] != [sha256]:
        raise ValueError("the file isn't the pinned one")
    pair = F.explode(F.from_json("text", "test array<array<string>>")["test"])
    named = F.create_map(*(F.lit(x) for entry in groups.items() for x in entry))
    rows = files.select(pair.alias("pair")).select(F.get("pair", F.lit(0)).alias("text"), F.get("pair", F.lit(1)).alias("label"))
    chosen = rows.where(F.col("label").isin(*groups)).withColumn("group", named[F.col("label")])
    counts = {row.label: row["count"] for row in chosen.groupBy("label").count().collect()}
    if wrong := sorted(label for label in groups if counts.get(label) != per_label):
        raise ValueError(f"not {per_label} rows: {', '.join(wrong)}")
    return chosen


def artifact_rows(spark: SparkSession, path: str) -> int:
    """Records of an artifact: rows of a CSV file, or lines that aren't blank."""
    return read_csv(spark, path).count() if path.endswith(".csv") else spark.read.text(path).where(r"value rlike '\\S'").count()


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_violations(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files missing, unexpected, or of another size or content: ``path, rule``."""
    two = wanted.select("path", F.col("bytes").alias("wanted_bytes"), F.col("sha256").alias("wanted_sha256"))
    joined = found.join(two, "path", "full")
    rule = (
        F.when(F.col("bytes").isNull(), "missing")
        .when(F.col("wanted_bytes").isNull(), "unexpected")
        .when(F.col("bytes") != F.col("wanted_bytes"), "bytes")
        .when(F.col("sha256") != F.col("wanted_sha256"), "sha256")
    )
    return joined.select("path", rule.alias("rule")).where("rule is not null")
