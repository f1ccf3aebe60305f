"""Greatest TF-IDF cosine of each query with the texts of a table, on hashed terms and in arrays.

Terms and weights are those of :mod:`features`. A term is known by 64 bits of its content, so that no row of a term
leaves a task, save how many texts of the task hold it. Frequencies lie in files by ranges of hashes, which tasks read
one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.operators.features import WORDS, without_accents
from sievelight.operators.packed import PACKED, pack, part_count, routed, unpack
from sievelight.session import stored

#: Terms that a task holds before it compares or counts them, queries of a block, and cosines worked out at once.
TERMS_AT_ONCE, BLOCK, CELLS = 1 << 22, 8192, 1 << 20
#: Terms of queries that count as common at most, and the queries that must hold such a term.
COMMON, COMMON_QUERIES = 128, 32


def _mixed(value: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ value >> np.uint64(shift)) * np.uint64(factor)
    return value ^ value >> np.uint64(31)


#: A random number for each byte at each of 256 places.
_BYTES = _mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def texts_by_id(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``id, texts``: the texts of each key without accents; rows with a null key or text are left out."""
    chosen = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    return chosen.select(F.col(key).alias("id"), without_accents(F.col(text)).alias("plain")).groupBy("id").agg(F.collect_list("plain").alias("texts"))


def _worded(texts: DataFrame) -> DataFrame:
    return texts.select("id", F.transform("texts", lambda t: F.regexp_extract_all(t, F.lit(WORDS), F.lit(0))).alias("words"))


def _terms(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and frequency of the terms of each row's texts, in order of row and hash."""
    texts = lists.flatten()
    words = texts.flatten()
    none = np.empty(0, np.int64)
    if not len(words):
        return none, none.astype(np.uint64), none
    of_text = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    starts = ends[:-1] - ends[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(ends))
    hashes = np.add.reduceat(_BYTES[(place & 255) << 8 | data] * (place >> 8 << 1 | 1).astype(np.uint64), starts)
    same = np.flatnonzero(text[1:] == text[:-1])
    pairs = hashes[same] * np.uint64(0x9E3779B97F4A7C15) + _mixed(hashes[same + 1]) + np.uint64(0xD1B54A32D192ED03)
    row = of_text[np.concatenate((text, text[same]))]
    term = np.concatenate((_mixed(hashes), _mixed(pairs)))
    order = np.argsort(term)
    order = order[np.argsort(row[order].astype(np.uint16 if len(lists) < 1 << 16 else np.int64), kind="stable")]
    row, term = row[order], term[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(term, prepend=~term[:1]) != 0))
    return row[first], term[first], np.diff(first, append=len(row))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def inverse_frequencies(texts: DataFrame, total: int, min_records: int = 2) -> DataFrame:
    """``term, idf`` as of :func:`features.inverse_frequencies`, by hash and stored, of ``texts`` by id and ``total`` rows in all."""
    parts = part_count(texts)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, most = [(np.empty(0, np.uint64), np.empty(0, np.int64))], TERMS_AT_ONCE
        for batch in batches:
            term = _terms(batch.column(1))[1]
            waiting.append((term, np.ones(len(term), np.int64)))
            if sum(len(t) for t, _ in waiting) > most:
                waiting = [_sums(*map(np.concatenate, zip(*waiting)))]
                if len(waiting[0][0]) > TERMS_AT_ONCE:
                    yield pack(waiting[0][0], 64, [(waiting[0][1].astype(np.uint64), 4)], parts)
                    waiting = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
                most = len(waiting[0][0]) + TERMS_AT_ONCE
        keys, counts = _sums(*map(np.concatenate, zip(*waiting)))
        yield pack(keys, 64, [(counts.astype(np.uint64), 4)], parts)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys, counts) in sorted(unpack(batches, 64, [4]).items(), key=lambda found: found[0]):
            keys, counts = _sums(keys, counts)
            keys, counts = keys[counts >= min_records], counts[counts >= min_records]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.log((1.0 + total) / (1.0 + counts)) + 1.0)], ["term", "idf"])

    return stored(routed(_worded(texts).mapInArrow(held, PACKED), parts).mapInArrow(weighed, "term long, idf double"))


def _opened(uri: str):
    system, path = FileSystem.from_uri(uri)
    return system.open_input_file(path)


def _weights(row: np.ndarray, term: np.ndarray, frequency: np.ndarray, rows: int, files: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of the terms that have an idf; the weights of a row have length 1."""
    asked, place = np.unique(term, return_inverse=True)
    idf = np.zeros(len(asked))
    for uri in files:
        with _opened(uri) as file:
            table = pq.read_table(file)
        given, values = table.column("term").to_numpy().view(np.uint64), table.column("idf").to_numpy()
        if len(given):
            low, high = np.searchsorted(asked, given[:1])[0], np.searchsorted(asked, given[-1:], "right")[0]
            at = np.searchsorted(given, asked[low:high])
            found = given[at] == asked[low:high]
            idf[low:high][found] = values[at[found]]
    weight = (1.0 + np.log(frequency)) * idf[place]
    known = weight > 0
    row, term, weight = row[known], term[known], weight[known]
    return row, term, weight / np.sqrt(np.bincount(row, weight * weight, rows))[row]


def _chunks(batches: Iterator[pa.RecordBatch], files: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some rows, and row, hash and weight of their terms, in order of row."""
    ids, held, rows = [], [], 0

    def found():
        return pa.concat_arrays(ids), *_weights(*map(np.concatenate, zip(*held)), rows, files)

    for batch in batches:
        row, term, frequency = _terms(batch.column(1))
        ids.append(batch.column(0))
        held.append((row + rows, term, frequency))
        rows += batch.num_rows
        if sum(len(t) for t, *_ in held) >= TERMS_AT_ONCE:
            yield found()
            ids, held, rows = [], [], 0
    if held:
        yield found()


class Block:
    """Some queries, and the greatest cosine of each so far.

    Cosines are worked out on rare terms first. Common terms, which have little weight, are added for the pairs that
    could exceed the greatest cosine by the length of both sides' common weights; no other can.
    """

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, count: int):
        self.count, self.best = count, np.zeros(count)
        self.terms, code, held = np.unique(term, return_inverse=True, return_counts=True)
        common = np.argsort(-held, kind="stable")[:COMMON]
        common = common[held[common] >= COMMON_QUERIES]
        self.column = np.full(len(self.terms), -1)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((count, len(common)))
        often = self.column[code] >= 0
        self.dense[owner[often], self.column[code[often]]] = weight[often]
        self.length = np.sqrt((self.dense**2).sum(axis=1))
        order = np.flatnonzero(~often)[np.argsort(code[~often], kind="stable")]
        self.owner, self.weight = owner[order], weight[order]
        self.held = np.bincount(code[order], minlength=len(self.terms))
        self.start = np.cumsum(self.held) - self.held

    def meet(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Raises the greatest cosines by those with rows, given in order of row."""
        if not self.count or not len(self.terms):
            return
        code = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        known = self.terms[code] == term
        row, code, weight = row[known], code[known], weight[known]
        row = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
        step = max(1, CELLS // self.count)
        rows = int(row[-1]) + 1 if len(row) else 0
        bounds = np.searchsorted(row, np.arange(0, rows + step, step))
        for first, low, high in zip(range(0, rows, step), bounds, bounds[1:]):
            self._meet(min(step, rows - first), row[low:high] - first, code[low:high], weight[low:high])

    def _meet(self, rows: int, row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> None:
        column = self.column[code]
        often = column >= 0
        dense = np.zeros((rows, self.dense.shape[1]))
        dense[row[often], column[often]] = weight[often]
        row, code, weight = row[~often], code[~often], weight[~often]
        n = self.held[code]
        at = np.arange(n.sum()) + np.repeat(self.start[code] - np.cumsum(n) + n, n)
        cells = np.bincount(np.repeat(row * self.count, n) + self.owner[at], np.repeat(weight, n) * self.weight[at], rows * self.count)
        sums = cells.astype(np.float64, copy=False).reshape(rows, self.count)
        np.maximum(self.best, sums.max(axis=0), out=self.best)
        most = np.sqrt((dense**2).sum(axis=1))[:, None] * (self.length * (1 + 1e-9))
        most += sums
        near = np.flatnonzero(most > self.best)
        if len(near) > most.size // 16:
            sums += dense @ self.dense.T
            np.maximum(self.best, sums.max(axis=0), out=self.best)
        else:
            one, two = np.divmod(near, self.count)
            np.maximum.at(self.best, two, sums[one, two] + np.einsum("ij,ij->i", dense[one], self.dense[two]))


def nearest_cosine(queries: DataFrame, texts: DataFrame, idf: DataFrame) -> DataFrame:
    """``id, cosine``: for each query the greatest cosine with any of ``texts``; no row for one without a shared term.

    Both are those of :func:`texts_by_id`, and ``idf`` is that of :func:`inverse_frequencies`. Queries are stored once
    in the shared checkpoint folder and read by each task block by block.
    """
    files, kind = sorted(idf.inputFiles()), queries.schema["id"]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, term, weight in _chunks(batches, files):
            ends = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (term.view(np.int64), weight)]
            yield pa.RecordBatch.from_arrays([ids, *lists], ["id", "terms", "weights"])

    kinds = [kind, T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))]
    asked = sorted(stored(_worded(queries).mapInArrow(listed, T.StructType(kinds))).inputFiles())

    def given(columns: list[str]) -> Iterator[pa.RecordBatch]:
        for uri in asked:
            with _opened(uri) as file:
                yield from pq.ParquetFile(file).iter_batches(BLOCK, columns=columns)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greatest: list[np.ndarray] = []
        for _, row, term, weight in _chunks(batches, files):
            for place, queries_of in enumerate(given(["terms", "weights"])):
                terms, weights = queries_of.columns
                owner = np.repeat(np.arange(len(terms)), pc.list_value_length(terms).to_numpy())
                block = Block(owner, terms.flatten().to_numpy().view(np.uint64), weights.flatten().to_numpy(), len(terms))
                if place == len(greatest):
                    greatest.append(block.best)
                block.best = greatest[place]
                block.meet(row, term, weight)
        for cosines, queries_of in zip(greatest, given(["id"])):
            found = np.flatnonzero(cosines > 0)
            yield pa.RecordBatch.from_arrays([queries_of.column(0).take(pa.array(found)), pa.array(cosines[found])], ["id", "cosine"])

    found = _worded(texts).mapInArrow(best, T.StructType([kind, T.StructField("cosine", T.DoubleType())]))
    return found.groupBy("id").agg(F.max("cosine").alias("cosine"))
