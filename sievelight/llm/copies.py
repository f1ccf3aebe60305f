"""Copies that differ in layout only: white space, letter case, punctuation, order of fields.

A record's canonical key is the words of its fields. Canonical records are range-partitioned and sorted
by (key, id), which Spark does externally, and one scan over each partition compares the full keys of
neighbours. Rows of one key may continue in the next partition, so a key that fills a third of the table
spreads over many tasks; only the first and last run of each partition are matched up afterwards.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.llm.term_counts import WORD

FIELD, PART = "\x1f", " "


def _strict(text: str) -> dict[str, object] | None:
    """The JSON object that ``text`` holds, or None if it isn't exactly one valid JSON object."""

    def refuse(name: str) -> object:
        raise ValueError(name)

    try:
        value = json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def payload_key(payload: str | None, fields: tuple[str, ...], required: tuple[str, ...]) -> str | None:
    """The canonical key of a payload, or None where it is in no group.

    Field names count in any letter case; of a name given twice, the last holds. A required field must not be
    null, and the first field must have a word. A field that is missing or null otherwise has no words;
    a number, truth value or nested value counts with the words of its JSON text. Words are runs of
    letters and digits after case folding, so that a letter and its accented form differ.
    """
    if not payload or (found := _strict(payload)) is None:
        return None
    named = {name.lower(): value for name, value in found.items()}
    if any(named.get(field) is None for field in required):
        return None
    parts = []
    for field in fields:
        value = named.get(field)
        text = "" if value is None else value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)
        parts.append(PART.join(WORD.findall(text.casefold())))
    return FIELD.join(parts) if parts[0] else None


def _keys(fields: tuple[str, ...], required: tuple[str, ...]):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [payload_key(payload, fields, required) for payload in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], ["id", "key"])

    return fill


def canonical_payloads(
    raw: DataFrame,
    id_col: str = "raw_id",
    payload_col: str = "payload",
    fields: tuple[str, ...] = ("text", "category", "source"),
    required: tuple[str, ...] = ("text", "category"),
) -> DataFrame:
    """``id, key`` of each row that can have copies (see :func:`payload_key`); rows with a null id are left out."""
    chosen = raw.select(F.col(id_col).cast("long").alias("id"), F.col(payload_col).cast("string").alias("payload"))
    keyed = chosen.where("id is not null and payload is not null").mapInArrow(_keys(fields, required), "id long, key string")
    return keyed.where("key is not null")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent runs of a partition sorted by (key, id): each id with the first id of its run.

    A row with a key and no id names the first or the last run, which may go on in another partition.
    """

    def batch_of(ids: list, kept: list, keys: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((ids, kept, keys), kinds)], ["id", "kept", "key"])

    runs: list[tuple[int, str]] = []  # the first run of the partition, and the present one
    last = None
    for batch in batches:
        ids, kept = [], []
        for key, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not runs or key != runs[-1][1]:
                runs[1:] = [(number, key)]
            elif number == last:
                continue
            last = number
            ids.append(number)
            kept.append(runs[-1][0])
        yield batch_of(ids, kept, [None] * len(ids))
    if runs:
        yield batch_of([None] * len(runs), *map(list, zip(*runs)))


def copy_runs(keyed: DataFrame) -> DataFrame:
    """``kept_id, copy_id`` of each row of :func:`canonical_payloads`: the smallest id of its group, and its own.

    The smallest id of a group is paired with itself, so that every row comes out once; an id given twice
    is one row. Edge runs are at most two a partition; their table is broadcast.
    """
    # Range partitioning samples its input first; without this it would read every payload twice.
    kept = keyed.persist(StorageLevel.MEMORY_AND_DISK)
    ordered = kept.repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("key", "id")
    scanned = ordered.mapInArrow(_scan, "id long, kept long, key string").persist(StorageLevel.MEMORY_AND_DISK)
    edges = scanned.where("id is null").select("key", "kept").distinct()
    first = edges.groupBy("key").agg(F.min("kept").alias("first"), F.count("*").alias("runs")).where("runs > 1")
    moved = edges.join(first, "key").where("kept <> first").select("kept", "first")
    rows = scanned.where("id is not null").join(F.broadcast(moved), "kept", "left")
    return rows.select(F.coalesce("first", "kept").alias("kept_id"), F.col("id").alias("copy_id"))


def copies(raw: DataFrame, **options) -> DataFrame:
    """``kept_id, copy_id`` of every row that is a copy of a kept one with a smaller id."""
    return copy_runs(canonical_payloads(raw, **options)).where("copy_id <> kept_id")


def collapsed(raw: DataFrame, **options) -> DataFrame:
    """One row for each group, those of a single row too: ``kept_id`` and ``copies``, the number of its rows."""
    return copy_runs(canonical_payloads(raw, **options)).groupBy("kept_id").agg(F.count("*").alias("copies"))
