"""Frequencies of every term or sequence of terms, by sorted suffixes.

Each record's words give its suffixes, cut to ``max_terms`` words. Equal suffixes of a task are added
up before anything is shuffled; the rows are then routed by their first word, sorted in descending
order within a partition, and one pass with a stack turns them into the counts of all prefixes: the
stack holds the open prefixes of the present suffix, and one that the next suffix doesn't share is
complete. Instead of sets of records, which a frequent word would make unbounded, a suffix carries for
each of its prefixes in how many records it is the first to show that prefix; these marks add up to
the number of distinct records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters and digits (Unicode categories L and N).
WORD = re.compile(r"[^\W_]+")
FLUSH = 200_000
SALTS = 32


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _suffix_batch(counts: dict[str, list[int]], max_terms: int) -> pa.RecordBatch:
    marks = list(zip(*counts.values())) if counts else [()] * (max_terms + 1)
    names = ["suffix", "occurrences", *(f"first_{k + 1}" for k in range(max_terms))]
    arrays = [pa.array(list(counts), pa.string()), *(pa.array(x, pa.int64()) for x in marks)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _suffixes(max_terms: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                seen: set[str] = set()
                for i, prefix in enumerate(words):
                    first = [prefix not in seen]
                    seen.add(prefix)
                    for word in words[i + 1 : i + max_terms]:
                        prefix = f"{prefix} {word}"
                        first.append(prefix not in seen)
                        seen.add(prefix)
                    if (entry := counts.get(prefix)) is None:
                        counts[prefix] = entry = [0] * (max_terms + 1)
                    entry[0] += 1
                    for k, new in enumerate(first, 1):
                        entry[k] += new
            if len(counts) > FLUSH:
                yield _suffix_batch(counts, max_terms)
                counts = {}
        yield _suffix_batch(counts, max_terms)

    return collect


def _prefix_counts(max_terms: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []
        totals: list[list[int]] = []
        done: list[tuple[str, int, int, int]] = []

        def close(depth: int) -> None:
            while len(path) > depth:
                occurrences, records = totals.pop()
                done.append((" ".join(path), len(path), occurrences, records))
                path.pop()
                if totals:
                    totals[-1][0] += occurrences

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [(), (), (), ()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], ["term", "words", "occurrences", "records"])
            done.clear()
            return batch

        for batch in batches:
            suffixes, occurrences, *marks = (column.to_pylist() for column in batch.columns)
            for suffix, n, *first in zip(suffixes, occurrences, *marks):
                terms = suffix.split(" ")
                shared = 0
                while shared < min(len(terms), len(path)) and terms[shared] == path[shared]:
                    shared += 1
                close(shared)
                while len(path) < len(terms):
                    path.append(terms[len(path)])
                    totals.append([0, 0])
                totals[-1][0] += n
                for level, new in zip(totals, first):
                    level[1] += new
            yield batch_of()
        close(0)
        yield batch_of()

    return fold


def term_counts(records: DataFrame, text_col: str = "text", max_terms: int = 1) -> DataFrame:
    """How often each sequence of 1 to ``max_terms`` words occurs, and in how many rows.

    Columns ``term`` (words joined by blanks), ``words``, ``occurrences``, ``records``. Words are runs of
    letters and digits of the lower-cased text. Every row counts as a record, repeated ones too; null,
    empty and wordless texts add nothing; an empty table gives an empty result. Other columns are not read.

    Rows are routed by first word; a salt of the second word keeps the suffixes of a frequent first word
    from meeting in one task, and the partial counts of that word are added up at the end.
    """
    if max_terms < 1:
        raise ValueError("max_terms must be positive")
    texts = records.select(F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    marks = "".join(f", first_{k + 1} long" for k in range(max_terms))
    suffixes = texts.mapInArrow(_suffixes(max_terms), f"suffix string, occurrences long{marks}")
    terms = F.split("suffix", " ")
    routed = suffixes.repartition(F.get(terms, F.lit(0)), F.pmod(F.xxhash64(F.get(terms, F.lit(1))), F.lit(SALTS)))
    prefixes = routed.sortWithinPartitions(F.desc("suffix")).mapInArrow(
        _prefix_counts(max_terms), "term string, words int, occurrences long, records long"
    )
    return prefixes.groupBy("term", "words").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(
    records: DataFrame,
    text_col: str = "text",
    max_terms: int = 1,
    rare_at_most: int = 2,
    common_above: Fraction = Fraction(1, 10),
) -> DataFrame:
    """:func:`term_counts` with ``mark``: ``rare``, ``common`` or null.

    A term is rare in at most ``rare_at_most`` records, common in more than the share ``common_above`` of the
    records with a non-null text. In a table so small that both hold, it is rare.
    """
    share = Fraction(common_above)
    total = records.select(F.count(text_col).alias("texts"))
    rare = F.col("records") <= rare_at_most
    common = F.col("records") * share.denominator > F.col("texts") * share.numerator
    counted = term_counts(records, text_col, max_terms).crossJoin(F.broadcast(total))
    return counted.withColumn("mark", F.when(rare, "rare").when(common, "common")).drop("texts")
