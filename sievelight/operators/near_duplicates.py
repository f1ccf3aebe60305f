"""Near-duplicate records of different splits, by an exact join on equal parts of the sets of character trigrams.

Two sets with a Dice similarity of at least t differ in few pieces, so of some more parts several are
equal. Distinct comparison texts are joined on their parts, and only pairs whose sizes and marks allow the
threshold leave the join. No candidate is cut off: parts, sizes and marks only rule out what cannot reach the
threshold.

Equal comparison texts of one split are a class, named by its smallest id. Pairs are between classes, with
their numbers of records, and each record has a row with its class; copies are never expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.text import comparison_text
from sievelight.operators.packed import PACKED, meetings, pack, part_count, routed, unpack
from sievelight.session import stored, unsent

SYMBOLS = 37
#: Sets of three characters of a-z, 0-9 and the blank.
MOST_PIECES = SYMBOLS**3
#: One spare part for so many needed ones.
SPARE = 4
#: Words of 64 bits in which the pieces of a text are marked.
MARKS = 4
#: Bits of a key and of a text's name in the join; others that share them are told apart when pairs are verified.
KEY_BITS, NAME_BITS = 48, 40
#: Keys are joined in passes, one for those of so many texts up to about so many passes, as the files of a pass go before the next.
PASS_TEXTS, MOST_PASSES = 150_000, 8
ROWS_AT_ONCE, PAIRS_AT_ONCE, HELD_PAIRS = 512, 1 << 18, 1 << 20
#: Texts of one key are compared as a table from so many pairs on, in blocks of so many pairs.
TABLE_PAIRS, TABLE_BLOCK = 512, 1 << 16

_SYMBOL = np.zeros(256, np.uint32)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[ord("0") : ord("9") + 1] = np.arange(27, 37)


def _piece_hashes() -> np.ndarray:
    value = np.arange(1, MOST_PIECES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ value >> np.uint64(shift)) * np.uint64(factor)
    return value ^ value >> np.uint64(31)


PIECE_HASHES = _piece_hashes()


def piece_sets(forms: list[str]) -> np.ndarray:
    """Of each non-empty comparison text its distinct pieces as ``row * MOST_PIECES + piece``, in order."""
    found = [np.empty(0, np.int64)]
    for start in range(0, len(forms), ROWS_AT_ONCE):
        part = forms[start : start + ROWS_AT_ONCE]
        flat = _SYMBOL[np.frombuffer((" " + "  ".join(part) + " ").encode(), np.uint8)]
        lengths = np.fromiter(map(len, part), np.int64, len(part)) + 2
        pieces = (flat[:-2] * np.uint32(SYMBOLS) + flat[1:-1]) * np.uint32(SYMBOLS) + flat[2:]
        inside = np.ones(len(pieces), bool)
        ends = np.cumsum(lengths)[:-1]
        inside[ends - 1] = inside[ends - 2] = False
        owner = np.repeat(np.arange(len(part), dtype=np.uint32), lengths)[: len(pieces)]
        keys = (owner * np.uint32(MOST_PIECES) + pieces)[inside]
        keys.sort()
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        found.append(keys[new].astype(np.int64) + start * MOST_PIECES)
    return np.concatenate(found)


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``form`` and other columns with ``size``, the number of distinct pieces."""
    for batch in batches:
        sizes = np.bincount(piece_sets(batch.column(0).to_pylist()) // MOST_PIECES, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32())], [*batch.schema.names, "size"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``piece, n``: how many of a task's texts hold each piece."""
    counts = np.zeros(MOST_PIECES, np.int64)
    for batch in batches:
        counts += np.bincount(piece_sets(batch.column(0).to_pylist()) % MOST_PIECES, minlength=MOST_PIECES)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], ["piece", "n"])


def _rarity(texts: DataFrame) -> np.ndarray:
    """Of each possible piece, of which there are some fifty thousand, a weight from 1 up that grows the fewer texts hold it."""
    counts, total = np.zeros(MOST_PIECES), texts.count()
    for row in texts.select("form").mapInArrow(_held, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[row.piece] = row.n
    return 1 + np.rint(16 * np.log((total + 1) / (counts + 1))).clip(0)


class Signer:
    """Keys on which texts of similar size meet, for sets of pieces at a Dice similarity of ``threshold`` or more.

    Texts are in classes of size, and a pair belongs to the class of its larger set; since a partner is at most one
    class away, a text is signed for its own class and the next. A pair of a class differs in at most d pieces.
    Hashes of the pieces spread them over d + 1 + e parts, so at least e + 1 parts of both are equal, and each text
    may leave out its e parts of least weight (ties by number): the heaviest equal part of a pair is never left out on
    either side. A key is the content of one part. Weight is the sum of ``weights`` of the pieces, or their number; with
    weights of rare pieces, parts that texts of a template have in common are the ones left out.
    """

    def __init__(self, threshold: float, weights: np.ndarray | None = None):
        self.weights = weights
        base = max((2 - threshold) / threshold, 1.05)
        lower = {math.ceil(base**c - 1e-9) for c in range(int(math.log(MOST_PIECES, base)) + 4)}
        self.lower = np.array(sorted(lower), np.int64)
        most = np.append(self.lower[1:], self.lower[-1] * 2) - 1
        differing = np.floor((1 - threshold) * 2 * most + 1e-9).astype(np.int64)
        self.spare = (differing + 1 + SPARE - 1) // SPARE
        self.parts = differing + 1 + self.spare

    def marks(self, hashes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        """Bits that the pieces flip, ``MARKS`` words a row: sets that differ in d pieces differ in at most d bits."""
        width = 64 * MARKS
        flips = np.bincount(owner * width + (hashes % np.uint64(width)).astype(np.int64), minlength=rows * width)
        return np.packbits((flips & 1).astype(np.uint8).reshape(rows, width), axis=1).view(np.int64)

    def classes(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lower, sizes, "right") - 1

    def passes(self, sizes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Passes of about as many keys, for so many texts of each size: first class, class behind the last, part of keys, parts.

        Texts are signed only in passes of their own class and the next.
        """
        own = np.bincount(self.classes(sizes), weights=counts, minlength=len(self.lower))[: len(self.lower)]
        keys = (own + np.append(0, own[:-1])) * (self.parts - self.spare)
        most = max(keys.sum() * PASS_TEXTS / max(1, own.sum()), keys.sum() / MOST_PASSES)
        found, first = [], 0
        for c in np.flatnonzero(keys):
            if keys[first : c + 1].sum() > most:
                if keys[first:c].sum():
                    found.append((first, int(c), 0, 1))
                first = int(c)
            if keys[c] > most:
                parts = math.ceil(keys[c] / most)
                found += [(int(c), int(c) + 1, k, parts) for k in range(parts)]
                first = int(c) + 1
        return found + [(first, len(keys), 0, 1)] if keys[first:].sum() or not found else found

    def keys(self, hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray, step: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and keys for the class ``step`` above each text's own; ``weights`` are those of the pieces."""
        classes = self.classes(sizes) + step
        parts = self.parts[classes]
        starts = np.cumsum(parts) - parts
        slot = starts[owner] + ((hashes >> np.uint64(20)) % parts[owner].astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), parts)
        content = np.zeros(len(row), np.uint64)
        np.add.at(content, slot, hashes * np.uint64(0x9E3779B97F4A7C15))
        counts = np.minimum(np.bincount(slot, weights, len(row)).astype(np.int64), (1 << 20) - 1)
        part = np.arange(len(row)) - starts[row]
        # Rows stay together, so the place in a row is the number of its part. One value holds the order, which sorts faster than three.
        order = row << 40 | counts << 20 | part
        order.sort()
        kept = part >= self.spare[classes][row]
        row, part = row[kept], order[kept] & ((1 << 20) - 1)
        key = content[starts[row] + part] + (classes[row] << 20 | part).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        key = (key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        return row, (key ^ key >> np.uint64(29)).view(np.int64)

    def signed(self, first: int, last: int, part: int, passes: int, parts: int):
        """Packed keys of one pass of ``side, name, form``: with side, size and step, the text's name and its marks."""

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sides, names = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.uint64) for k in (0, 1))
                owner, pieces = np.divmod(piece_sets(batch.column(2).to_pylist()), MOST_PIECES)
                sizes = np.bincount(owner, minlength=len(names))
                hashes = PIECE_HASHES[pieces]
                weights = None if self.weights is None else self.weights[pieces]
                marks = self.marks(hashes, owner, len(names)).view(np.uint64)
                classes = self.classes(sizes)
                for step in (0, 1):
                    texts = np.flatnonzero((classes + step >= first) & (classes + step < last))
                    number = np.full(len(names), -1)
                    number[texts] = np.arange(len(texts))
                    own = number[owner] >= 0
                    row, key = self.keys(hashes[own], number[owner[own]], sizes[texts], step, None if weights is None else weights[own])
                    key = key.view(np.uint64)
                    if passes > 1:
                        chosen = key % np.uint64(passes) == part
                        row, key = row[chosen], key[chosen]
                    row, key = texts[row], key >> np.uint64(64 - KEY_BITS)
                    kind = sizes[row].astype(np.uint64) << np.uint64(8) | sides[row] << np.uint64(1) | np.uint64(step == 0)
                    yield pack(key, KEY_BITS, [(kind, 4), (names[row], NAME_BITS // 8), *((marks[row, k], 8) for k in range(MARKS))], parts)

        return sign


def _close(keys: np.ndarray, left: np.ndarray, right: np.ndarray, folds: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of :func:`meetings` whose ``folds`` differ in at most the ``most`` bits of the left place.

    Texts of a template share keys, so nearly all pairs are of a few keys with many texts. Those are compared as tables,
    block by block, and only places of pairs that are left are written out.
    """
    left, right = left[np.argsort(keys[left])], right[np.argsort(keys[right])]
    low, high = (np.searchsorted(keys[right], keys[left], side) for side in ("left", "right"))
    starts = np.flatnonzero(np.diff(keys[left], prepend=~keys[left[:1]]))
    lefts = np.diff(starts, append=len(left))
    dense = lefts * (high - low)[starts] >= TABLE_PAIRS
    for first, last in zip(starts[dense], (starts + lefts)[dense]):
        row = right[low[first] : high[first]]
        fold = folds[row]
        step = max(1, TABLE_BLOCK // len(row))
        for begin in range(first, last, step):
            column = left[begin : min(last, begin + step)]
            near = np.flatnonzero(np.bitwise_count(folds[column, None] ^ fold) <= most[column, None])
            if len(near):
                one, two = np.divmod(near, len(row))
                yield column[one], row[two]
    for one, two in meetings(keys, left[~np.repeat(dense, lefts)], right, PAIRS_AT_ONCE):
        near = np.bitwise_count(folds[one] ^ folds[two]) <= most[one]
        yield one[near], two[near]


def _met(threshold: float, sides: int):
    """Pairs of texts of different sides that have a key in common, and sizes and marks that allow the threshold."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, kinds, names, *marks in unpack(batches, KEY_BITS, [4, NAME_BITS // 8, *[8] * MARKS]).values():
            size, side, own = (kinds >> np.uint64(8)).astype(np.int64), (kinds >> np.uint64(1) & np.uint64(127)).astype(np.int64), kinds & np.uint64(1) == 1
            # A partner is larger by (2 - threshold) / threshold at most, which bounds the pieces in which they differ.
            folds, bound = np.bitwise_xor.reduce(marks), np.minimum((1 - threshold) * 2 / threshold * size + 1e-9, 64).astype(np.uint8)
            held: list[np.ndarray] = []
            waiting = 0

            def found() -> pa.RecordBatch:
                pairs = np.unique(np.concatenate(held), axis=0)
                held.clear()
                kinds_of = (pa.int32(), pa.int64()) * 2
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()).cast(kind) for k, kind in enumerate(kinds_of)], [c.split()[0] for c in MET.split(", ")])

            for left, right in _close(keys, np.flatnonzero(side < sides), np.flatnonzero(side > 1), folds, bound):
                near = (side[left] < side[right]) & (own[left] | own[right]) & (names[left] != names[right])
                left, right = left[near], right[near]
                both = size[left] + size[right]
                most = np.floor((1 - threshold) * both + 1e-9)
                apart = np.where(2 * np.minimum(size[left], size[right]) >= threshold * both - 1e-9, 0, np.inf)
                for words in marks:
                    near = apart <= most
                    left, right, most, apart = left[near], right[near], most[near], apart[near]
                    apart = apart + np.bitwise_count(words[left] ^ words[right])
                near = apart <= most
                left, right = left[near], right[near]
                held.append(np.stack((side[left], names[left].astype(np.int64), side[right], names[right].astype(np.int64)), axis=1))
                waiting += len(left)
                if waiting > HELD_PAIRS:
                    yield found()
                    waiting = 0
            if held:
                yield found()

    return meet


MET = "l_side int, l_h long, r_side int, r_h long"


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Dice similarity of the first two columns, before the others."""
    for batch in batches:
        one, two = (piece_sets(batch.column(k).to_pylist()) for k in (0, 1))
        both = np.concatenate((one, two))
        both.sort()
        common = both[1:][both[1:] == both[:-1]] // MOST_PIECES
        similarity = 2.0 * np.bincount(common, minlength=batch.num_rows) / np.bincount(both // MOST_PIECES, minlength=batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(similarity), *batch.columns[2:]], ["similarity", *batch.schema.names[2:]])


SPLITS = ("train", "validation", "test")


def _sided(records: DataFrame, splits: tuple[str, ...], key: str, text: str, split: str, *columns: str) -> DataFrame:
    """``id, side, form`` and ``columns`` of the rows of the named splits that have a comparison text."""
    number = F.array_position(F.array(*map(F.lit, splits)), F.col(split)).cast("int")
    rows = records.where(F.col(split).isin(*splits) & F.col(text).isNotNull())
    return rows.select(F.col(key).alias("id"), number.alias("side"), comparison_text(text).alias("form"), *columns).where("form <> ''")


def near_duplicates(
    records: DataFrame,
    threshold: float = 0.9,
    key: str = "record_id",
    text: str = "text",
    split: str = "source_split",
    splits: tuple[str, ...] = SPLITS,
    length_bound: bool = True,
) -> DataFrame:
    """Pairs of classes of different splits: ``left_split, right_split, left_id, right_id, left_records, right_records, similarity``.

    A pair has different comparison texts whose Dice similarity over sets of three-character pieces is at least
    ``threshold``, and with ``length_bound`` also the ratio of the texts' lengths, which sets of pieces don't
    imply. The earlier of ``splits`` is on the left. Null and empty texts have no partner. Equal comparison texts
    are exact duplicates and not reported. Similarity is rounded to six places.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    rows = _sided(records, splits, key, text, split)
    grouped = rows.groupBy("form", "side").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    texts = stored(grouped.mapInArrow(_sized, T.StructType([*grouped.schema, T.StructField("size", T.IntegerType())])))
    texts = texts.withColumn("h", F.shiftrightunsigned(F.xxhash64("form"), 64 - NAME_BITS))
    parts, signer = part_count(records), Signer(threshold, _rarity(texts))
    sizes = texts.groupBy("size").count().collect()

    def candidates(first: int, last: int, part: int, passes: int) -> DataFrame:
        fitting = (F.col("size") >= int(signer.lower[max(0, first - 1)])) & (F.col("size") < int(signer.lower[last]) if last < len(signer.lower) else F.lit(True))
        packed = routed(texts.where(fitting).select("side", "h", "form").mapInArrow(signer.signed(first, last, part, passes, parts), PACKED), parts)
        return stored(packed.mapInArrow(_met(threshold, len(splits)), MET).distinct())

    every = signer.passes(np.array([r["size"] for r in sizes], np.int64), np.array([r["count"] for r in sizes], np.int64))
    met = reduce(DataFrame.union, (candidates(*given) for given in every)).distinct()
    texts = texts.drop("size")
    one = texts.select(*(F.col(c).alias(f"l_{c}") for c in texts.columns))
    two = texts.select(*(F.col(c).alias(f"r_{c}") for c in texts.columns))
    short, long = F.least(F.length("l_form"), F.length("r_form")), F.greatest(F.length("l_form"), F.length("r_form"))
    bound = 2.0 * short / (short + long) >= threshold if length_bound else F.lit(True)
    carried = [f"{m}_{c}" for c in ("side", "id", "n") for m in "lr"]
    joined = met.join(unsent(one), ["l_side", "l_h"]).join(unsent(two), ["r_side", "r_h"]).where(bound & (F.col("l_form") != F.col("r_form")))
    kinds = T.StructType([T.StructField("similarity", T.DoubleType()), *(joined.schema[c] for c in carried)])
    verified = joined.select("l_form", "r_form", *carried).mapInArrow(_similar, kinds).where(F.col("similarity") >= threshold)
    names = F.array(*map(F.lit, splits))
    return verified.select(
        F.element_at(names, F.col("l_side")).alias("left_split"),
        F.element_at(names, F.col("r_side")).alias("right_split"),
        F.col("l_id").alias("left_id"),
        F.col("r_id").alias("right_id"),
        F.col("l_n").alias("left_records"),
        F.col("r_n").alias("right_records"),
        F.bround("similarity", 6).alias("similarity"),
    )


def record_classes(
    records: DataFrame, key: str = "record_id", text: str = "text", split: str = "source_split", splits: tuple[str, ...] = SPLITS, columns: tuple[str, ...] = ()
) -> DataFrame:
    """``id, split, class_id`` and ``columns`` of each row with a comparison text: the smallest id of the rows of its split equal to it."""
    rows = _sided(records, splits, key, text, split, *columns)
    classes = rows.groupBy("side", "form").agg(F.min("id").alias("class_id"))
    return rows.join(unsent(classes), ["side", "form"]).select("id", F.element_at(F.array(*map(F.lit, splits)), F.col("side")).alias("split"), "class_id", *columns)


def class_labels(
    records: DataFrame, label: str, key: str = "record_id", text: str = "text", split: str = "source_split", splits: tuple[str, ...] = SPLITS
) -> DataFrame:
    """``split, class_id, label, n``: records of each label in each class of :func:`record_classes`, a null label being one.

    Records are read once and not joined with their classes: labels are counted by text, and a text's labels go to its class.
    """
    counted = _sided(records, splits, key, text, split, label).groupBy("side", "form", F.col(label).alias("label")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = counted.groupBy("side", "form").agg(F.min("id").alias("class_id"), F.collect_list(F.struct("label", "n")).alias("labels"))
    return classes.select(F.element_at(F.array(*map(F.lit, splits)), F.col("side")).alias("split"), "class_id", F.inline("labels"))


def near_duplicate_links(pairs: DataFrame, records: DataFrame, **options) -> DataFrame:
    """Each record with its class and ``links``, how many records of other splits are near-duplicates of it.

    ``id, split, class_id, links``, of all rows with a comparison text. Options go to :func:`record_classes`.
    """
    sides = pairs.select(F.col("left_split").alias("split"), F.col("left_id").alias("class_id"), F.col("right_records").alias("n"))
    sides = sides.unionByName(pairs.select(F.col("right_split").alias("split"), F.col("right_id").alias("class_id"), F.col("left_records").alias("n")))
    links = sides.groupBy("split", "class_id").agg(F.sum("n").alias("links"))
    joined = record_classes(records, **options).join(unsent(links), ["split", "class_id"], "left")
    return joined.select("id", "split", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_rollup(pairs: DataFrame, records: DataFrame, label: str = "category", **options) -> DataFrame:
    """By pair of splits: pairs of records, records on each side, and pairs with the same and with another label.

    Counted from pairs of classes and the labels of each class; a null label is one. ``pairs`` is read three times.
    """
    labels = class_labels(records, label, **options)
    left, right = (
        labels.select(F.col("split").alias(f"{m}_split"), F.col("class_id").alias(f"{m}_id"), F.col("label").alias(f"{m}_label"), F.col("n").alias(f"{m}_n"))
        for m in ("left", "right")
    )
    both = ["left_split", "right_split"]
    met = pairs.join(unsent(left), ["left_split", "left_id"]).join(unsent(right), ["right_split", "right_id"]).where(F.col("left_label").eqNullSafe(F.col("right_label")))
    same = met.groupBy(*both).agg(F.sum(F.col("left_n") * F.col("right_n")).alias("same_label"))
    total = pairs.groupBy(*both).agg(F.sum(F.col("left_records") * F.col("right_records")).alias("pairs"))
    for side in ("left", "right"):
        own = pairs.select(*both, f"{side}_id", f"{side}_records").distinct()
        total = total.join(own.groupBy(*both).agg(F.sum(f"{side}_records").alias(f"{side}_records")), both)
    joined = total.join(same, both, "left").withColumn("same_label", F.coalesce("same_label", F.lit(0)))
    return joined.select("*", (F.col("pairs") - F.col("same_label")).alias("other_label"))


def flagged_records(pairs: DataFrame) -> DataFrame:
    """Records of each split in any pair, from either side: ``source_split, records``."""
    sides = pairs.select(F.col("left_split").alias("source_split"), F.col("left_id").alias("id"), F.col("left_records").alias("n"))
    every = sides.union(pairs.select("right_split", "right_id", "right_records")).distinct()
    return every.groupBy("source_split").agg(F.sum("n").alias("records"))
