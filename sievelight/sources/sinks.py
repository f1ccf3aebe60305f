"""Writers. Row tables are written by the tasks; only reports of bounded size are one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled, as :func:`sievelight.sources.readers.read_csv` reads it."""
    frame.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def write_split(rows: DataFrame, path: str) -> None:
    write_csv(rows.select("text", "category"), path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """A predictions file of one approach, as :func:`sievelight.sources.readers.read_predictions` reads it."""
    flag = F.when(F.coalesce("correct", F.lit(False)), "True").otherwise("False").alias("correct")
    write_csv(predictions.select("row_index", "text", "actual", "predicted", flag), path)


def write_near_duplicates(pairs: DataFrame, records: DataFrame, path: str, key: str = "record_id") -> None:
    """Pairs of :func:`sievelight.operators.near_duplicates.near_duplicates` with place, label and text of both sides.

    The most similar come first, then by split and place.
    """

    def side(mark: str) -> DataFrame:
        columns = {"split": "source_split", "id": key, "index": "source_index", "category": "category", "text": "text"}
        return records.select(*(F.col(c).alias(f"{mark}_{name}") for name, c in columns.items()))

    joined = pairs.join(side("left"), ["left_split", "left_id"]).join(side("right"), ["right_split", "right_id"])
    names = [f"{m}_{c}" for m in ("left", "right") for c in ("split", "index", "category", "text")]
    write_csv(joined.orderBy(F.desc("similarity"), "left_split", "left_index", "right_index").select(*names, "similarity"), path)


def write_json_lines(frame: DataFrame, path: str) -> None:
    """JSON Lines with null fields."""
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_report(row: DataFrame, path: str) -> None:
    """One row as one JSON document."""
    value = F.to_json(F.struct(*(F.col(f"`{c}`") for c in row.columns)), {"ignoreNullFields": "false", "pretty": "true"})
    row.select(value.alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def _shown(value: object, places: int) -> str:
    return "" if value is None else f"{value:.{places}f}" if isinstance(value, float) else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(frame: DataFrame, rows: int = 200, places: int = 6) -> str:
    """A table of bounded size as Markdown; more than ``rows`` rows are an error, not cut off."""
    found = frame.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report table has more than {rows} rows")
    lines = [frame.columns, ["---"] * len(frame.columns), *([_shown(v, places) for v in row] for row in found)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines) + "\n"


def markdown_report(title: str, sections: dict[str, DataFrame | str], rows: int = 200, places: int = 6) -> str:
    """A report with a section for each heading, of a table or of plain text."""
    parts = [f"# {title}\n"]
    for heading, body in sections.items():
        parts.append(f"## {heading}\n\n{body.rstrip() + chr(10) if isinstance(body, str) else markdown_table(body, rows, places)}")
    return "\n".join(parts)
