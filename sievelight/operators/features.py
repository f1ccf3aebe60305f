"""TF-IDF weights, nearest texts, and a linear classifier on them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.functions.text import ASCII_ONLY
from sievelight.operators.logistic import fit_logistic, load_classifier, logistic_predictions, save_classifier  # noqa: F401
from sievelight.session import stored

#: Words of two or more letters, digits and underscores of any script.
WORDS = r"[\p{L}\p{N}_]{2,}"
#: Rows and queries that a task compares at a time, and numbers of eight bytes that it multiplies at once.
CHUNK, BLOCK, AT_ONCE = 4096, 1024, 1 << 22


@F.pandas_udf(T.StringType())
def _without_accents(values: pd.Series) -> pd.Series:
    def plain(text: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))

    return values.map(plain, na_action="ignore")


def without_accents(text: Column) -> Column:
    """Lower case without accents; ASCII texts never leave the JVM."""
    ascii_only = text.rlike(ASCII_ONLY)
    return F.when(ascii_only, F.lower(text)).otherwise(_without_accents(F.when(~ascii_only, text)))


def term_frequencies(rows: DataFrame, key: str, text: str = "text", pattern: str = WORDS) -> DataFrame:
    """``id, term, tf``: how often each word and each pair of neighbouring words stands in each row's text.

    Words are lower-cased and without accents. Rows with a null key or text, and texts without words, have no
    terms. The words of a row are routed by its key, so counting its terms takes no further shuffle.
    """
    chosen = rows.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    words = chosen.select(F.col(key).alias("id"), F.regexp_extract_all(without_accents(F.col(text)), F.lit(pattern), F.lit(0)).alias("words"))
    # As many partitions as are set, since each row becomes many terms only behind the shuffle.
    routed = words.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").where(F.size("words") > 0)
    pairs = F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    return routed.select("id", F.explode(F.concat("words", pairs)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def inverse_frequencies(frequencies: DataFrame, documents: DataFrame, min_records: int = 2) -> DataFrame:
    """``term, idf`` of terms in at least ``min_records`` rows: ``ln((1 + rows) / (1 + records)) + 1``.

    ``documents`` are all rows the table was made of, those without terms too.
    """
    records = frequencies.groupBy("term").agg(F.count("*").alias("records")).where(F.col("records") >= min_records)
    total = documents.agg(F.count("*").alias("rows"))
    return records.crossJoin(F.broadcast(total)).select("term", (F.log((1.0 + F.col("rows")) / (1.0 + F.col("records"))) + 1.0).alias("idf"))


def tfidf_rows(frequencies: DataFrame, idf: DataFrame, *carried: str) -> DataFrame:
    """``id, entries`` of each row with a known term: its terms in order with weight ``(1 + ln tf) * idf``, of length 1.

    An entry has the ``term``, its ``weight`` and the ``carried`` columns of ``idf``. The length is worked out on the
    row's own entries, which its text bounds.
    """
    entry = F.struct("term", ((1.0 + F.log("tf")) * F.col("idf")).alias("weight"), *carried)
    raw = frequencies.join(idf, "term").select("id", entry.alias("entry"))
    rows = raw.groupBy("id").agg(F.array_sort(F.collect_list("entry")).alias("entries"))

    def scaled(square: Column) -> Column:
        return F.transform("entries", lambda e: e.withField("weight", e["weight"] / F.sqrt(square)))

    # The length is the aggregate's own variable: as a column, the optimizer would move it into the function of each entry.
    entries = F.aggregate("entries", F.lit(0.0), lambda total, e: total + e["weight"] * e["weight"], scaled)
    return rows.select("id", entries.alias("entries"))


def tfidf_weights(frequencies: DataFrame, idf: DataFrame) -> DataFrame:
    """``id, term, weight``: the entries of :func:`tfidf_rows` as a long table. Terms without an idf are left out."""
    return tfidf_rows(frequencies, idf).select("id", F.inline("entries"))


def _field(entries: str, name: str) -> Column:
    return F.transform(entries, lambda e: e[name])


def _products(queries: pa.Table, rows: pa.Table, at_once: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query of a block its place and greatest cosine with any row of a chunk.

    Queries are taken in slices whose dense table of terms, and rows in slices whose products, hold at most
    ``at_once`` numbers, or there is a single one.
    """
    asked, given = queries.column("terms").combine_chunks(), rows.column("terms").combine_chunks()
    best = np.zeros(len(queries))
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(asked).to_numpy())))
    words = asked.flatten()
    weights = queries.column("weights").combine_chunks().flatten().to_numpy()
    ends = np.cumsum(pc.list_value_length(given).to_numpy())
    owners = np.repeat(np.arange(len(rows)), np.diff(ends, prepend=0))
    loads = rows.column("weights").combine_chunks().flatten().to_numpy()
    begin = 0
    while begin < len(queries):
        width = max(1, min(len(queries) - begin, int(np.sqrt(at_once))))
        while width > 1 and width * (bounds[begin + width] - bounds[begin]) > at_once:
            width = max(1, width // 2)
        own = slice(bounds[begin], bounds[begin + width])
        coded = words[own].dictionary_encode()
        dense = np.zeros((len(coded.dictionary), width))
        dense[coded.indices.to_numpy(), np.repeat(np.arange(width), np.diff(bounds[begin : begin + width + 1]))] = weights[own]
        places = pc.index_in(given.flatten(), value_set=coded.dictionary)
        known = np.flatnonzero(pc.is_valid(places).to_numpy(zero_copy_only=False))
        term, owner, load = pc.fill_null(places, 0).to_numpy()[known], owners[known], loads[known]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        step = max(1, at_once // width)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + step, "right")) - 1)
            low, high = starts[first], starts[last] if last < len(starts) else len(term)
            sums = np.add.reduceat(dense[term[low:high]] * load[low:high, None], starts[first:last] - low, axis=0)
            np.maximum(best[begin : begin + width], sums.max(axis=0), out=best[begin : begin + width])
            first = last
        begin += width
    found = np.flatnonzero(best > 0)
    return found, best[found]


def nearest_cosine(
    queries: DataFrame, rows: DataFrame, query_count: int, row_count: int, block: int = BLOCK, chunk: int = CHUNK, at_once: int = AT_ONCE
) -> DataFrame:
    """``id, cosine``: for each query the greatest cosine with any of ``rows``; no row for one without a shared term.

    Both tables are those of :func:`tfidf_rows`. The stated set of queries is stored once in the shared checkpoint
    folder. Each task takes its rows in chunks, reads the queries in blocks for each chunk, and keeps one number a
    query, so that neither rows nor queries are copied for each other and nothing comes to the driver. The counts
    bound the sizes of blocks and chunks.
    """
    block, chunk = max(1, min(block, query_count)), max(1, min(chunk, row_count))

    def arrays(frame: DataFrame) -> DataFrame:
        return frame.select("id", _field("entries", "term").alias("terms"), _field("entries", "weight").alias("weights"))

    asked = stored(arrays(queries))
    files = sorted(asked.inputFiles())

    def blocks() -> Iterator[pa.Table]:
        for uri in files:
            system, path = FileSystem.from_uri(uri)
            with system.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(block):
                    yield pa.Table.from_batches([batch])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, len(batch), chunk):
                held.append(batch.slice(start, chunk))
                if sum(map(len, held)) >= chunk:
                    yield pa.Table.from_batches(held)
                    held = []
        if held:
            yield pa.Table.from_batches(held)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greatest: list[np.ndarray] = []
        for rows_of in chunks(batches):
            for place, queries_of in enumerate(blocks()):
                if place == len(greatest):
                    greatest.append(np.zeros(len(queries_of)))
                found, cosines = _products(queries_of, rows_of, at_once)
                greatest[place][found] = np.maximum(greatest[place][found], cosines)
        for cosines, queries_of in zip(greatest, blocks()):
            found = np.flatnonzero(cosines > 0)
            ids = queries_of.column("id").combine_chunks().take(pa.array(found))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cosines[found])], ["id", "cosine"])

    kinds = T.StructType([queries.schema["id"], T.StructField("cosine", T.DoubleType())])
    return arrays(rows).mapInArrow(best, kinds).groupBy("id").agg(F.max("cosine").alias("cosine"))


def numbered_terms(idf: DataFrame, buckets: int = 256) -> DataFrame:
    """``idf`` with ``slot``: the terms numbered from 0 without gaps, in hashed buckets, so that no task sees all of them."""
    placed = idf.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = sizes.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("start"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("term")) - 1
    numbered = placed.withColumn("place", place).join(F.broadcast(starts), "bucket")
    return numbered.select(*idf.columns, (F.col("start") + F.col("place")).cast("int").alias("slot"))


def vectors(rows: DataFrame, ids: DataFrame, size: int, *carried: str) -> DataFrame:
    """``id, features``: a sparse vector of ``size`` slots for each row of ``ids``, empty for one without a known term.

    ``rows`` are those of :func:`tfidf_rows` with the ``slot`` of each term carried along. Columns ``carried`` of ``ids``
    follow.
    """
    kind = ids.schema["id"].dataType
    slots = F.array_sort(F.transform("entries", lambda e: F.struct(e["slot"].alias("slot"), e["weight"].alias("weight"))))
    none = F.array().cast("array<struct<slot:int,weight:double>>")
    placed = ids.select("id", *carried).join(rows, "id", "left").select("id", F.coalesce(slots, none).alias("slots"), *carried)
    arrays = placed.select("id", _field("slots", "slot").alias("slot"), _field("slots", "weight").alias("weight"), *carried)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), batch.column(1), batch.column(2)]
            features = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([batch.column(0), features, *batch.columns[3:]], ["id", "features", *carried])

    kinds = [T.StructField("id", kind), T.StructField("features", VectorUDT()), *(ids.schema[c] for c in carried)]
    return arrays.mapInArrow(build, T.StructType(kinds))


def majority_predictions(rows: DataFrame, majority: DataFrame, key: str = "record_id", label: str = "category") -> DataFrame:
    """Predictions of the most frequent label for every row: ``approach, row_index, actual, predicted``."""
    chosen = F.broadcast(majority.where("chosen").select(F.col("label").alias("predicted")))
    return rows.select(F.lit("majority").alias("approach"), F.col(key).alias("row_index"), F.col(label).alias("actual")).crossJoin(chosen)


def padded_length(tokens: Column, multiple: int = 8) -> Column:
    """The length of an array padded to a multiple."""
    return (F.ceil(F.size(tokens) / multiple) * multiple).cast("int")


def padded(tokens: Column, filler: int, multiple: int = 8) -> Column:
    """``tokens`` with ``filler`` at the end up to a multiple; an empty array stays empty."""
    return F.concat(tokens, F.array_repeat(F.lit(filler), padded_length(tokens, multiple) - F.size(tokens)))


def response_labels(tokens: Column, prompt_length: Column, ignored: int = -100) -> Column:
    """Targets of a training example: the tokens, with those of the prompt ignored."""
    kept = F.least(prompt_length, F.size(tokens))
    return F.concat(F.array_repeat(F.lit(ignored), kept), F.slice(tokens, kept + 1, F.greatest(F.size(tokens) - kept, F.lit(0))))


def example_fault(tokens: Column, prompt: Column, longest: int) -> Column:
    """Why a training example can't be used: its prompt isn't its beginning, or it is too long; null if it can."""
    begins = F.slice(tokens, 1, F.greatest(F.size(prompt), F.lit(0))) == prompt
    return F.when(~F.coalesce(begins, F.lit(False)), "prompt").when(F.size(tokens) > longest, "too_long")
