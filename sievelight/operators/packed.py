"""Rows on equal keys, met in packed form: sorted keys leave a task as their differences, many rows in one binary value.

Written row by row, a key of a few bytes costs several times its size. Here rows of a task are sorted by key, cut
where the ranges of keys of the partitions end, and written byte plane by byte plane, compressed. A partition
decodes what it got, and equal keys meet in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PACKED = "part int, n int, packed binary"
#: Pairs that are expanded at once.
AT_ONCE = 1 << 20


def _planes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(len(values), 8)[:, :width]


def pack(keys: np.ndarray, bits: int, columns: list[tuple[np.ndarray, int]], parts: int) -> pa.RecordBatch:
    """``part, n, packed`` of keys below ``2 ** bits`` and unsigned ``columns``, each with its number of bytes."""
    order = np.argsort(keys)
    keys = keys[order]
    part = (keys >> np.uint64(bits - 24)) * np.uint64(parts) >> np.uint64(24)
    bounds = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    steps = np.diff(keys, prepend=np.uint64(0))
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    steps[starts] = keys[starts]
    planes = np.concatenate([_planes(steps, -(-bits // 8)), *(_planes(values[order], width) for values, width in columns)], axis=1)
    codec = pa.Codec("zstd", 1)
    found = [(p, e - s, codec.compress(planes[s:e].T.tobytes(), asbytes=True)) for p, (s, e) in enumerate(zip(bounds, bounds[1:])) if e > s]
    number, count, packed = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(count, pa.int32()), pa.array(packed, pa.binary())], ["part", "n", "packed"])


def unpack(batches: Iterator[pa.RecordBatch], bits: int, widths: list[int]) -> dict[int, list[np.ndarray]]:
    """By part the keys and columns of all rows that :func:`pack` gave."""
    codec, widths = pa.Codec("zstd"), [-(-bits // 8), *widths]
    ends = np.cumsum(widths)
    found: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        for part, n, packed in zip(*(column.to_pylist() for column in batch.columns)):
            planes = np.frombuffer(codec.decompress(packed, n * int(ends[-1])), np.uint8).reshape(ends[-1], n)
            columns = []
            for end, width in zip(ends, widths):
                values = np.zeros((n, 8), np.uint8)
                values[:, :width] = planes[end - width : end].T
                columns.append(values.view("<u8").ravel())
            columns[0] = np.cumsum(columns[0])
            found.setdefault(part, []).append(columns)
    return {part: [np.concatenate(column) for column in zip(*rows)] for part, rows in found.items()}


def routed(frame: DataFrame, parts: int) -> DataFrame:
    """Rows of :func:`pack`, each part in one partition."""
    return frame.repartitionById(parts, "part")


def part_count(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def meetings(keys: np.ndarray, left: np.ndarray, right: np.ndarray, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a ``left`` and a ``right`` place with equal keys, in slices of ``at_once`` pairs or one left place."""
    left, right = left[np.argsort(keys[left])], right[np.argsort(keys[right])]
    low, high = (np.searchsorted(keys[right], keys[left], side) for side in ("left", "right"))
    met = np.flatnonzero(high > low)
    left, low, counts = left[met], low[met], (high - low)[met]
    upto = np.cumsum(counts)
    first = 0
    while first < len(left):
        before = upto[first] - counts[first]
        last = max(first + 1, int(np.searchsorted(upto, before + at_once, "right")))
        n = counts[first:last]
        inside = np.arange(upto[last - 1] - before) - np.repeat(upto[first:last] - n - before, n)
        yield np.repeat(left[first:last], n), right[np.repeat(low[first:last], n) + inside]
        first = last
