"""Multinomial logistic regression whose coefficients, labels x terms, lie in files of the shared checkpoint folder.

Rows are cut into blocks and slots into ranges. Of each block and range a tile holds the entries that are not zero.
Steps are those of conjugate gradients, scaled for each slot by its squares. In each, tasks of some blocks read the
direction range by range and write how it moves their rows' margins; once the length of the step is found on these,
they write what the rows are off by, and tasks of a range read that block by block and write coefficients and
gradient. The driver has a few numbers for each label.
"""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.session import checkpoint_dir, stored

#: Most rows of a block and slots of a range, fewer where labels are so many that a table of them had more numbers than this.
BLOCK_ROWS, RANGE_SLOTS, NUMBERS = 1 << 13, 1 << 15, 1 << 21
#: Blocks that a task holds, and entries that it multiplies at once.
HELD_BLOCKS, AT_ONCE = 16, 1 << 15
#: A slot that more than this share of a tile's rows have is multiplied as a dense column.
DENSE_SHARE = 0.015
#: Runs of equal places that are summed up together.
SHORT_RUN = 8
#: Variance of a label's probability that the scales take for given, times the number of labels.
VARIANCE = 0.25
#: Lengths of a step are tried at a guess, and at it divided and multiplied by this, up to so many times.
SPREAD, SEARCHES = 3.0, 12
#: So many steps in a row must improve the loss by less than the tolerance.
SLOW_STEPS = 3


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()


def _put(uri: str, data: bytes) -> None:
    system, path = FileSystem.from_uri(uri)
    with system.open_output_stream(path) as file:
        file.write(data)


def _get(uri: str) -> pa.Buffer:
    system, path = FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        return file.read_buffer()


def _table(uri: str, columns: int) -> np.ndarray:
    return np.frombuffer(_get(uri), np.float32).reshape(-1, columns)


def _drop(uris: Iterable[str]) -> None:
    """Removes those of the files that are still there."""
    for system, path in map(FileSystem.from_uri, uris):
        if system.get_file_info(path).type != FileType.NotFound:
            system.delete_file(path)


def _once(uri: str, work: Callable[[], object], old: Iterable[str] = ()) -> object:
    """What ``work`` returns, kept in ``uri`` so that a repeated task doesn't do it again; the files ``old`` go after it."""
    system, path = FileSystem.from_uri(uri)
    if system.get_file_info(path).type == FileType.NotFound:
        _put(f"{uri}.new", pickle.dumps(work()))
        system.move(f"{path}.new", path)
    _drop(old)
    return pickle.loads(_get(uri))


def _halves(numbers: np.ndarray) -> np.ndarray:
    """The upper 16 bits of each number, rounded: its sign, its power of two and eight binary places."""
    bits = numbers.view(np.uint32)
    return ((bits + ((bits >> 16) & 1) + np.uint32(0x7FFF)) >> 16).astype(np.uint16)


def _whole(uri: str, columns: int) -> np.ndarray:
    """The table whose :func:`_halves` are in ``uri``."""
    numbers = np.frombuffer(_get(uri), np.uint16).astype(np.uint32)
    numbers <<= 16
    return numbers.view(np.float32).reshape(-1, columns)


def _product(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.einsum("ij,ij->i", a, b).sum(dtype=np.float64))


def _entries(features: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of each entry of a column of vectors, by row."""
    if isinstance(features, pa.ExtensionArray):
        features = features.storage
    _kind, _size, slots, values = features.flatten()
    counts = np.diff(values.offsets.to_numpy())
    load = values.flatten().to_numpy().astype(np.float32)
    row = np.repeat(np.arange(len(features)), counts)
    if slots.null_count:  # dense vectors have no indices
        slot = np.concatenate([np.arange(n) if not s.is_valid else s.values.to_numpy() for s, n in zip(slots, counts)] or [np.empty(0, np.int64)])
    else:
        slot = slots.flatten().to_numpy()
    return row, slot.astype(np.int64), load


def _sums(products: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each run of ``products`` its sum: short runs one place after the other, all at once, long ones by themselves."""
    sums = np.take(products, starts, axis=0)
    short = counts <= SHORT_RUN
    for place in range(1, min(SHORT_RUN, int(counts.max()))):
        chosen = np.flatnonzero(short & (counts > place))
        sums[chosen] += np.take(products, starts[chosen] + place, axis=0)
    if not short.all():
        rows = np.flatnonzero(np.repeat(~short, counts))
        n = counts[~short]
        sums[~short] = np.add.reduceat(np.take(products, rows, axis=0), np.cumsum(n) - n, axis=0)
    return sums


def _add(target: np.ndarray, index: np.ndarray, source: np.ndarray, place: np.ndarray, load: np.ndarray) -> None:
    """``target[index] += load * source[place]`` for an ``index`` in order."""
    for start in range(0, len(index), AT_ONCE):
        part = slice(start, start + AT_ONCE)
        products = np.take(source, place[part], axis=0)
        products *= load[part, None]
        own = index[part].astype(np.int64)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        target[own[starts]] += _sums(products, starts, np.diff(starts, append=len(own)))


def _dense(rows: int, slots: int, row: np.ndarray, slot: np.ndarray, load: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile the slots that many rows have, a table of rows x these slots, and the entries that are not in it."""
    busy = np.flatnonzero(np.bincount(slot, minlength=slots) > rows * DENSE_SHARE)
    place = np.full(slots, -1, np.int32)
    place[busy] = np.arange(len(busy))
    to = np.take(place, slot)
    within = to >= 0
    table = np.zeros((rows, len(busy)), np.float32)
    table[row[within], to[within]] = load[within]
    return busy, table, np.flatnonzero(~within)


def _add_rows(target: np.ndarray, own: np.ndarray, row: np.ndarray, slot: np.ndarray, load: np.ndarray) -> None:
    """Adds a tile, rows x slots and in order of rows, times ``own``, slots x labels."""
    busy, table, rest = _dense(len(target), len(own), row, slot, load)
    target += table @ np.take(own, busy, axis=0)
    _add(target, row[rest], own, slot[rest], load[rest])


def _add_slots(target: np.ndarray, off: np.ndarray, row: np.ndarray, slot: np.ndarray, load: np.ndarray) -> None:
    """Adds a tile, turned to slots x rows, times ``off``, rows x labels."""
    busy, table, rest = _dense(len(off), len(target), row, slot, load)
    target[busy] += table.T @ off
    rest = rest[np.argsort(slot[rest], kind="stable")]
    _add(target, slot[rest], off, row[rest], load[rest])


def _length(slopes: Callable[[list[float]], list[tuple[float, float]]], guess: float) -> float:
    """Where the slope, negative at 0, is zero: ``slopes`` gives it and its rise at some lengths. 0 if there is no such place."""
    known: dict[float, tuple[float, float]] = {}
    for _ in range(SEARCHES):
        tried = [guess / SPREAD, guess, guess * SPREAD]
        known |= dict(zip(tried, slopes(tried)))
        low, high = max((a for a, s in known.items() if s[0] <= 0), default=0.0), min((a for a, s in known.items() if s[0] > 0), default=np.inf)
        if not np.isfinite(high):
            guess = max(known) * SPREAD**2
        elif not low:
            guess = high / SPREAD**2
        else:
            break
    else:
        return low
    # The cubic that has the slopes and rises of both ends.
    (a, rise_a), (b, rise_b), width = known[low], known[high], high - low
    begin, end = 0.0, 1.0
    for _ in range(40):
        t = (begin + end) / 2
        at = (1 + 2 * t) * (1 - t) ** 2 * a + t * (1 - t) ** 2 * width * rise_a + t * t * (3 - 2 * t) * b - t * t * (1 - t) * width * rise_b
        begin, end = (t, end) if at <= 0 else (begin, t)
    return low + width * begin


def _softmax(margins: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponents; ``margins`` become probabilities."""
    most = margins.max(axis=1, keepdims=True)
    np.exp(margins - most, out=margins)
    total = margins.sum(axis=1, keepdims=True)
    margins /= total
    return (np.log(total) + most).ravel()


TILE = pa.schema([("row", pa.uint16()), ("slot", pa.uint16()), ("load", pa.float32())])


class Tiles:
    """Tiles and labels of the train rows under ``folder``, cut into ranges of ``width`` of ``size`` slots."""

    def __init__(self, folder: str, size: int, width: int, labels: list[str]):
        self.folder, self.size, self.width, self.labels = folder, size, width, labels
        self.ranges = -(-size // width)

    def write(self, block: str, row: np.ndarray, slot: np.ndarray, load: np.ndarray, label: np.ndarray) -> None:
        order = np.argsort(slot // self.width, kind="stable")
        row, slot, load = row[order].astype(np.uint16), slot[order], load[order]
        bounds = np.searchsorted(slot // self.width, np.arange(self.ranges + 1))
        low = (slot % self.width).astype(np.uint16)
        system, path = FileSystem.from_uri(f"{self.folder}/{block}.arrow")
        with system.open_output_stream(path) as file, pa.ipc.new_file(file, TILE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            for a, b in zip(bounds, bounds[1:]):
                writer.write_batch(pa.record_batch([row[a:b], low[a:b], load[a:b]], schema=TILE))
        _put(f"{self.folder}/{block}.labels", label.astype(np.int32).tobytes())

    def open(self, block: str) -> pa.ipc.RecordBatchFileReader:
        system, path = FileSystem.from_uri(f"{self.folder}/{block}.arrow")
        return pa.ipc.open_file(system.open_input_file(path))

    def tile(self, block: pa.ipc.RecordBatchFileReader, place: int) -> list[np.ndarray]:
        return [c.to_numpy() for c in block.get_batch(place).columns]

    def label(self, block: str) -> np.ndarray:
        return np.frombuffer(_get(f"{self.folder}/{block}.labels"), np.int32)

    def slots(self, place: int) -> int:
        return min(self.width, self.size - place * self.width)

    def cut(self, frame: DataFrame) -> list[tuple[str, int]]:
        """Writes the blocks of ``features, category``: their names and rows."""
        rows_at_once, known = max(1, min(BLOCK_ROWS, NUMBERS // len(self.labels))), pa.array(self.labels, pa.string())

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, held, n, done = TaskContext.get(), [], 0, []

            def flush() -> None:
                if n:
                    block = f"{task.partitionId()}-{task.taskAttemptId()}-{len(done)}"
                    self.write(block, *map(np.concatenate, zip(*held)))
                    done.append((block, n))
                    held.clear()

            for batch in batches:
                start = 0
                while start < len(batch):
                    part = batch.slice(start, rows_at_once - n)
                    row, slot, load = _entries(part.column(0))
                    held.append((row + n, slot, load, pc.index_in(part.column(1).cast(pa.string()), value_set=known).to_numpy()))
                    start, n = start + len(part), n + len(part)
                    if n == rows_at_once:
                        flush()
                        n = 0
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in done], pa.string()), pa.array([k for _, k in done], pa.int32())], ["block", "n"])

        return [tuple(r) for r in stored(frame.select("features", "category").where("category is not null").mapInArrow(write, "block string, n int")).collect()]


class LinearClassifier:
    """Labels, an intercept for each, and coefficients in the files ``folder/range`` of ``width`` slots each."""

    def __init__(self, folder: str, size: int, width: int, labels: list[str], intercepts: list[float]):
        self.folder, self.size, self.width, self.labels, self.intercepts = folder, size, width, labels, intercepts

    def transform(self, rows: DataFrame) -> DataFrame:
        """``id, predicted, probability`` of ``id, features``."""

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            columns, at_once = len(self.labels), max(1, min(BLOCK_ROWS, NUMBERS // len(self.labels)))
            names = np.array(self.labels, object)
            for held in _regrouped(batches, at_once):
                row, slot, load = _entries(held.column(1))
                order = np.argsort(slot // self.width, kind="stable")
                row, slot, load = row[order], slot[order], load[order]
                margins = np.repeat(np.array([self.intercepts], np.float32), len(held), axis=0)
                met, starts = np.unique(slot // self.width, return_index=True)
                for place, a, b in zip(met, starts, [*starts[1:], len(slot)]):
                    _add(margins, row[a:b], _table(f"{self.folder}/{place}", columns), slot[a:b] % self.width, load[a:b])
                _softmax(margins)
                best = margins.argmax(axis=1)
                probability = margins[np.arange(len(held)), best].astype(np.float64)
                yield pa.RecordBatch.from_arrays([held.column(0), pa.array(names[best], pa.string()), pa.array(probability)], ["id", "predicted", "probability"])

        kinds = [rows.schema["id"], T.StructField("predicted", T.StringType()), T.StructField("probability", T.DoubleType())]
        return rows.select("id", "features").mapInArrow(predict, T.StructType(kinds))

    def save(self, spark: SparkSession, path: str) -> None:
        target, old = _qualified(spark, path), FileSystem.from_uri(self.folder)
        new = FileSystem.from_uri(target)
        new[0].create_dir(new[1])
        new[0].delete_dir_contents(new[1])
        for file in old[0].get_file_info(FileSelector(old[1])):
            _put(f"{target}/{file.base_name}", _get(f"{self.folder}/{file.base_name}").to_pybytes())
        _put(f"{target}/classifier.json", json.dumps({k: v for k, v in vars(self).items() if k != "folder"}).encode())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearClassifier:
        folder = _qualified(spark, path)
        return cls(folder=folder, **json.loads(_get(f"{folder}/classifier.json").to_pybytes()))


def _regrouped(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``at_once``."""
    held, n = [], 0
    for batch in batches:
        start = 0
        while start < len(batch):
            held.append(batch.slice(start, at_once - n))
            start, n = start + len(held[-1]), n + len(held[-1])
            if n == at_once:
                yield pa.concat_batches(held)
                held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _fit(frames: Iterator[DataFrame], size: int, inverse_strength: float, iterations: int, tolerance: float, labels: list[str]) -> LinearClassifier:
    """The regression on ``features, category`` of all ``frames``, each of which is read once. Categories are among ``labels``."""
    first = next(frames)
    spark, columns = first.sparkSession, len(labels)
    context = spark.sparkContext
    folder = f"{_qualified(spark, checkpoint_dir(spark))}/classifier-{uuid.uuid4().hex}"
    system, path = FileSystem.from_uri(folder)
    tasks = 2 * context.defaultParallelism
    width = max(1, min(RANGE_SLOTS, NUMBERS // columns, max(1 << 10, -(-size // tasks))))
    system.create_dir(f"{path}/train")
    tiles = Tiles(f"{folder}/train", size, width, labels)
    blocks = [block for frame in chain([first], frames) for block in tiles.cut(frame)]
    rows = sum(n for _, n in blocks)
    if not rows:
        raise ValueError("no train row has a label")
    names = [name for name, _ in blocks]
    held = max(1, min(HELD_BLOCKS, -(-len(names) // context.defaultParallelism)))
    groups = [names[k : k + held] for k in range(0, len(names), held)]
    penalty, variance = 1.0 / max(1.0, inverse_strength * rows), VARIANCE / columns
    system.create_dir(f"{path}/fit")

    def spread(things: list, task) -> list:
        return context.parallelize(list(enumerate(things)), max(1, len(things))).map(lambda x: task(*x)).collect()

    def file(kind: str, step: int, own: int | str) -> str:
        return f"{folder}/fit/{kind}-{step}-{own}"

    def coefficients(place: int, step: int) -> np.ndarray:
        """Those of step 0 are zeros without files."""
        return _table(f"{folder}/{step}/{place}", columns) if step else np.zeros((tiles.slots(place), columns), np.float32)

    def count(_: int, group: list[str]) -> np.ndarray:
        return sum(np.bincount(tiles.label(block), minlength=columns) for block in group)

    def scales(place: int, _) -> None:
        squares = np.zeros(tiles.slots(place))
        for block in names:
            _row, slot, load = tiles.tile(tiles.open(block), place)
            squares += np.bincount(slot, np.square(load, dtype=np.float64), minlength=len(squares))
        _put(f"{folder}/fit/{place}.scale", (variance * squares / rows + penalty).astype(np.float32).tobytes())

    def advance(step: int, length: float, intercepts: np.ndarray):
        """Writes the margins of the step and what rows are off by; the loss, and for each label the sum of these."""

        def task(_: int, group: list[str]) -> tuple[float, np.ndarray]:
            def work(block: str) -> tuple[float, np.ndarray]:
                label = tiles.label(block)
                if step:
                    margin = _table(file("margin", step - 1, block), columns) + np.float32(length) * _table(file("along", step - 1, block), columns)
                else:
                    margin = np.repeat(intercepts.astype(np.float32)[None], len(label), axis=0)
                _put(file("margin", step, block), margin.tobytes())
                at = np.arange(len(label))
                right = margin[at, label].astype(np.float64)
                loss = float((_softmax(margin) - right).sum())
                margin[at, label] -= 1
                _put(file("off", step, block), margin.tobytes())
                return loss, margin.sum(axis=0, dtype=np.float64)

            done = [_once(file("advanced", step, b), lambda b=b: work(b), [file(kind, step - 1, b) for kind in ("margin", "along", "advanced")]) for b in group]
            return sum(d[0] for d in done), sum(d[1] for d in done)

        return task

    def backward(step: int, length: float, last: bool):
        """Writes the step's coefficients, unless it is 0, and its scaled gradient, unless it is the last."""

        def task(place: int, _) -> tuple[float, float, float]:
            def work() -> tuple[float, float, float]:
                own = coefficients(place, max(0, step - 1))
                if step:
                    own = own + np.float32(length) * _whole(file("direction", step - 1, place), columns)
                    _put(f"{folder}/{step}/{place}", own.tobytes())
                if last:
                    return 0.0, 0.0, 0.0
                gradient = np.zeros(own.shape, np.float32)
                for block in names:
                    _add_slots(gradient, _table(file("off", step, block), columns), *tiles.tile(tiles.open(block), place))
                gradient /= np.float32(rows)
                gradient += np.float32(penalty) * own
                halves = _halves(gradient / _table(f"{folder}/fit/{place}.scale", 1))
                _put(file("gradient", step, place), halves.tobytes())
                before = _product(gradient, _whole(file("gradient", step - 1, place), columns)) if step else 0.0
                return _product(gradient, _whole(file("gradient", step, place), columns)), before, _product(own, own)

            old = [file("gradient", step - 1, place), file("stepped", step - 1, place), f"{folder}/{step - 1}/{place}"]
            return _once(file("stepped", step, place), work, old)

        return task

    def turn(step: int, share: float, again: bool):
        """Writes the direction of the step: the scaled gradient downwards and a share of the last direction."""

        def task(place: int, _) -> tuple[float, float, float]:
            def work() -> tuple[float, float, float]:
                gradient = _whole(file("gradient", step, place), columns)
                direction = np.float32(share) * _whole(file("direction", step - 1, place), columns) - gradient if share else -gradient
                _put(file("direction", step, place), _halves(direction).tobytes())
                direction = _whole(file("direction", step, place), columns)
                gradient *= _table(f"{folder}/fit/{place}.scale", 1)
                return _product(gradient, direction), _product(coefficients(place, step), direction) if step else 0.0, _product(direction, direction)

            return _once(file("turned-again" if again else "turned", step, place), work, [file(kind, step - 1, place) for kind in ("direction", "turned", "turned-again")])

        return task

    def slopes(step: int, lengths: list[float]):
        """The loss's slope and its rise along the direction, at some lengths."""

        def task(_: int, group: list[str]) -> np.ndarray:
            found = np.zeros((len(lengths), 2))
            for block in group:
                label, margin, along = tiles.label(block), _table(file("margin", step, block), columns), _table(file("along", step, block), columns)
                right, squared = along[np.arange(len(label)), label].sum(dtype=np.float64), np.square(along)
                for k, length in enumerate(lengths):
                    likely = margin + np.float32(length) * along
                    _softmax(likely)
                    mean = np.einsum("ij,ij->i", likely, along).astype(np.float64)
                    found[k] += mean.sum() - right, _product(likely, squared) - np.square(mean).sum()
            return found

        return task

    def forward(step: int, intercepts: np.ndarray, lengths: list[float]):
        """Writes how the direction moves margins; the slopes."""

        def task(number: int, group: list[str]) -> np.ndarray:
            def work() -> None:
                opened = [tiles.open(block) for block in group]
                moves = [np.repeat(intercepts.astype(np.float32)[None], len(tiles.label(block)), axis=0) for block in group]
                for place in range(tiles.ranges):
                    own = _whole(file("direction", step, place), columns)
                    for given, move in zip(opened, moves):
                        _add_rows(move, own, *tiles.tile(given, place))
                for block, move in zip(group, moves):
                    _put(file("along", step, block), move.tobytes())

            # What rows were off by isn't read any more, and makes room.
            _drop(file("off", step, block) for block in group)
            _once(file("moved", step, number), work, [file("moved", step - 1, number)])
            return slopes(step, lengths)(number, group)

        return task

    ranges = [None] * tiles.ranges
    bias = np.log(np.maximum(sum(spread(groups, count)), 0.5) / rows)
    spread(ranges, scales)
    found = spread(groups, advance(0, 0.0, bias))
    best = sum(f[0] for f in found) / rows
    stepped = spread(ranges, backward(0, 0.0, False))
    now, slow, guess, before, ahead = 0, 0, 1.0, 0.0, np.zeros(columns)
    uphill_before = np.zeros(columns)
    for left in reversed(range(iterations)):
        rise = sum(f[1] for f in found) / rows
        uphill = rise / variance
        size_now = sum(s[0] for s in stepped) + float(rise @ uphill)
        share = max(0.0, (size_now - sum(s[1] for s in stepped) - float(rise @ uphill_before)) / before) if before > 0 else 0.0
        for again in (False, True):
            turned = spread(ranges, turn(now, share, again))
            forth = share * ahead - uphill
            if sum(t[0] for t in turned) + float(rise @ forth) < 0 or not share:
                break
            share = 0.0
        if not sum(t[0] for t in turned) + float(rise @ forth) < 0:
            break
        ahead, before, uphill_before = forth, size_now, uphill
        square, with_own, own_square = sum(s[2] for s in stepped), sum(t[1] for t in turned), sum(t[2] for t in turned)
        written = False

        def along(lengths: list[float]) -> list[tuple[float, float]]:
            nonlocal written
            given = sum(spread(groups, slopes(now, lengths) if written else forward(now, ahead, lengths))) / rows
            written = True
            return [(float(g[0]) + penalty * (with_own + a * own_square), float(g[1]) + penalty * own_square) for a, g in zip(lengths, given)]

        length = _length(along, guess)
        if not length:
            break
        found = spread(groups, advance(now + 1, length, bias))
        value = sum(f[0] for f in found) / rows + 0.5 * penalty * (square + length * (2 * with_own + length * own_square))
        if not value < best:
            break
        slow = slow + 1 if best - value <= tolerance * abs(value) else 0
        now, guess, best, bias = now + 1, length, value, bias + length * ahead
        system.create_dir(f"{path}/{now}")
        stepped = spread(ranges, backward(now, length, slow >= SLOW_STEPS or not left))
        if slow >= SLOW_STEPS:
            break
    if not now:
        now = 1
        system.create_dir(f"{path}/{now}")
        for place in range(tiles.ranges):
            _put(f"{folder}/{now}/{place}", coefficients(place, 0).tobytes())
    for file in system.get_file_info(FileSelector(path)):
        if file.base_name != str(now):
            system.delete_dir(file.path)
    return LinearClassifier(f"{folder}/{now}", size, width, labels, bias.tolist())


def fit_logistic(
    train: DataFrame | Iterable[DataFrame],
    inverse_strength: float = 1.0,
    iterations: int = 1000,
    tolerance: float = 1e-4,
    size: int | None = None,
    labels: list[str] | None = None,
) -> LinearClassifier:
    """Multinomial logistic regression on ``features, category``, from which ``predicted`` and ``probability`` come.

    The penalty is ``1 / (inverse_strength * rows)`` and doesn't touch intercepts. Labels are ordered by name; rows
    without one are left out. A ``train`` of one label predicts it. The fit ends when three steps in a row improve the
    loss by less than ``tolerance``, relative to it; ``iterations`` only bounds it. Several frames are slices of the
    train rows, whose shuffle files go before the next; each is read once if ``size``, the slots of ``features``, and
    ``labels`` are given.
    """
    frames = [train] if isinstance(train, DataFrame) else train
    if labels is None or size is None:
        frames = list(frames)
        every = reduce(DataFrame.union, (f.select("features", "category") for f in frames)).where("category is not null")
        if labels is None:
            labels = [r.category for r in every.select("category").distinct().collect()]
        if size is None:
            first = every.select("features").first()
            size = first.features.size if first else 0
    if not labels:
        raise ValueError("no train row has a label")
    return _fit(iter(frames), max(1, size), inverse_strength, iterations, tolerance, sorted(labels))


def logistic_predictions(model: LinearClassifier, rows: DataFrame) -> DataFrame:
    """``id, predicted, probability`` of ``id, features``: the most probable label, and the probability of it."""
    return model.transform(rows)


def save_classifier(model: LinearClassifier, terms: DataFrame, path: str) -> None:
    """Writes the fitted labels and coefficients, and the table ``term, idf, slot`` of their features."""
    model.save(terms.sparkSession, f"{path}/model")
    terms.select("term", "idf", "slot").write.mode("overwrite").parquet(f"{path}/terms")


def load_classifier(spark: SparkSession, path: str) -> tuple[LinearClassifier, DataFrame]:
    """What :func:`save_classifier` wrote: the model, and ``term, idf, slot``."""
    return LinearClassifier.load(spark, f"{path}/model"), spark.read.parquet(f"{path}/terms")
