"""Rows that meet on equal keys in packed form, and what the joins on them leave on disk."""

import re
import time
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight import session
from sievelight.llm import overlap
from sievelight.operators import near_duplicates, packed
from sievelight.plans import catalog


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_packed_rows_meet_on_equal_keys(parts):
    chance = np.random.default_rng(5)
    sides = [(chance.integers(0, 60, n).astype(np.uint64) << np.uint64(28), chance.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(3)) for n in (70, 90)]
    sides[0][0][0] = sides[1][0][0] = (1 << 34) - 1
    batches = [packed.pack(k, 34, [(np.full(len(k), s, np.uint64), 1), (v, 8)], parts) for s, (k, v) in enumerate(sides)]
    found = set()
    for part, (keys, side, values) in packed.unpack(iter(batches), 34, [1, 8]).items():
        assert 0 <= part < parts
        for at_once in (1, 7, 1 << 20):
            slices = list(packed.meetings(keys, np.flatnonzero(side == 0), np.flatnonzero(side == 1), at_once))
            pairs = [(int(values[i]), int(values[j])) for left, right in slices for i, j in zip(left, right)]
            assert len(pairs) == len(set(pairs))
            found |= set(pairs)
    wanted = {(int(a), int(b)) for (k, a), (m, b) in product(zip(*sides[0]), zip(*sides[1])) if k == m}
    assert found == wanted and len(wanted) > 60


def test_overlaps_keep_nothing(spark):
    """What is kept of every record goes to disk where memory ends, beside what is shuffled."""
    rows = [(1, "the card was stolen in town", "train"), (2, "the card was stolen in town!", "test"), (3, "a loan", "test"), (4, "", "train")]
    stored = spark.sparkContext._jsc.sc().getPersistentRDDs
    before = stored().size()
    found = overlap.overlap_pairs(spark.createDataFrame(rows, "record_id long, text string, source_split string")).collect()
    assert [(r.held_out_id, r.train_id, r.similarity) for r in found] == [(2, 1, 1.0)]
    assert stored().size() == before


TEXTS = ["where is my new card", "where is my new cards", "where is my newer card", "please close my old account", "please close my old accounts", "loan", "loans", "", None]


def test_near_duplicates_do_not_depend_on_passes(spark, monkeypatch):
    rows = [(i, t, ("train", "validation", "test")[i % 3]) for i, t in enumerate(TEXTS * 3 + TEXTS[:4])]
    frame = spark.createDataFrame(rows, "record_id long, text string, source_split string")
    found = []
    for texts, held in ((1_000, 1_000), (5, 1), (1, 2)):
        monkeypatch.setattr(near_duplicates, "PASS_TEXTS", texts)
        monkeypatch.setattr(near_duplicates, "HELD_PAIRS", held)
        found.append(sorted(map(tuple, near_duplicates.near_duplicates(frame, 0.8).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def test_stored_frames_free_what_they_shuffle(spark):
    """Keys of all passes at once took 10 times the input; the files of a pass go before the next."""

    def shuffled() -> set[str]:
        return set(re.findall(r"shuffle_\w+\.data", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")))

    before = shuffled()
    found = session.stored(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):  # they are removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert sorted(map(tuple, found.collect())) == [(k, 142 + (k < 6)) for k in range(7)]
    assert spark.conf.get(session.CLEANUP) == "false"


def test_texts_of_a_template_are_compared_as_tables(monkeypatch):
    """Pairs of a key with many texts were all written out; now only those close enough are, and rare keys as before."""
    chance, written = np.random.default_rng(8), []
    meet = near_duplicates.meetings
    monkeypatch.setattr(near_duplicates, "meetings", lambda *given: ((written.append(len(one)), (one, two))[1] for one, two in meet(*given)))
    monkeypatch.setattr(near_duplicates, "TABLE_BLOCK", 1 << 10)
    keys = np.concatenate((np.full(400, 7), chance.integers(0, 99, 300) * 2)).astype(np.uint64)
    folds = chance.integers(0, 2**64, 700, dtype=np.uint64)
    side, most = chance.integers(1, 4, 700), chance.integers(20, 30, 700).astype(np.uint8)
    left, right = np.flatnonzero(side < 3), np.flatnonzero(side > 1)
    found = [(int(a), int(b)) for one, two in near_duplicates._close(keys, left, right, folds, most) for a, b in zip(one, two)]
    wanted = [(int(a), int(b)) for a in left for b in right if keys[a] == keys[b] and int(folds[a] ^ folds[b]).bit_count() <= most[a]]
    assert sorted(found) == sorted(wanted) and len(wanted) > 100
    assert sum(written) < 5_000  # some 70,000 pairs share a key
    assert not list(near_duplicates._close(keys, left[:0], right, folds, most))


def test_passes_take_each_class_once(monkeypatch):
    """Each class of size is in one pass, or in all parts of its keys, and texts whose class isn't in a pass aren't signed there."""
    signer = near_duplicates.Signer(0.9)
    sizes, counts = np.array([3, 60, 108, 110, 300]), np.array([10, 500, 9_000, 8_000, 40])
    monkeypatch.setattr(near_duplicates, "PASS_TEXTS", 4_000)
    every = signer.passes(sizes, counts)
    assert len(every) > 4
    for step in (0, 1):
        for c in signer.classes(sizes) + step:
            own = [(part, parts) for first, last, part, parts in every if first <= c < last]
            assert own == [(k, own[0][1]) for k in range(own[0][1])]
    forms = ["where is my new card", "x" * 9 + " close my account please and thanks for all"]
    for form in forms:
        batch = pa.RecordBatch.from_pydict({"side": pa.array([1], pa.int32()), "h": [5], "form": [form]})
        c = int(signer.classes(np.array([len(near_duplicates.piece_sets([form]))]))[0])
        keys = [sum(sum(b.column(1).to_pylist()) for b in signer.signed(first, last, 0, 1, 2)(iter([batch]))) for first, last in ((0, c), (c, c + 1), (c + 1, c + 2), (c + 2, 99))]
        assert keys[0] == keys[3] == 0 < min(keys[1], keys[2])


def test_parts_of_common_pieces_are_left_out():
    """Of ten parts a text leaves out those whose pieces are common, however many pieces they have."""
    signer = near_duplicates.Signer(0.9)
    hashes, sizes = np.random.default_rng(2).integers(0, 2**64, 108, dtype=np.uint64), np.array([108])
    plain = set(signer.keys(hashes, np.zeros(108, np.int64), sizes, 0)[1].tolist())
    c = int(signer.classes(sizes)[0])
    part = (hashes >> np.uint64(20)) % np.uint64(signer.parts[c])
    common = int(np.bincount(part.astype(np.int64)).argmax())
    weights = np.where(part == common, 0, 50)
    kept = set(signer.keys(hashes, np.zeros(108, np.int64), sizes, 0, weights)[1].tolist())
    assert len(kept) == len(plain) and kept != plain


COUNTED = {
    "records": lambda pairs, frame: near_duplicates.flagged_records(pairs),
    "links": lambda pairs, frame: near_duplicates.near_duplicate_links(pairs, frame),
    "rollup": lambda pairs, frame: near_duplicates.near_duplicate_rollup(pairs.persist(), frame.withColumn("category", F.lit("x"))),
}


@pytest.mark.parametrize("name", COUNTED)
def test_counts_do_not_depend_on_passes(spark, monkeypatch, name):
    rows = [(i, t, ("train", "validation", "test")[i % 3]) for i, t in enumerate(TEXTS * 3 + TEXTS[:4])]
    frame = spark.createDataFrame(rows, "record_id long, text string, source_split string")
    found = []
    for texts in (1_000, 1):
        monkeypatch.setattr(near_duplicates, "PASS_TEXTS", texts)
        found.append(sorted(map(tuple, COUNTED[name](near_duplicates.near_duplicates(frame, 0.8), frame).collect())))
    assert found[0] == found[1] and found[0]


def test_cosines_do_not_depend_on_slices(spark, sf_dir, monkeypatch):
    found = []
    for rows in (100_000, 60):
        monkeypatch.setattr(catalog, "SLICE_ROWS", rows)
        found.append(sorted(map(tuple, catalog.QUERIES["nearest_training_cosine"](spark, sf_dir).collect())))
    assert found[0] == found[1] and any(cosine for _, cosine in found[0])


def test_labels_of_classes_come_from_one_reading(spark):
    """Records were read and their texts compared twice, and joined with their classes, once for each side of a pair."""
    rows = [(9, "A b", "x", "train"), (4, "a  B", "x", "train"), (6, "a b", None, "train"), (3, "a b", "y", "test"), (5, "c", None, "test"), (8, "C", None, "test"), (1, "", "x", "test"), (2, None, "x", "train"), (7, "a b", "x", "other")]
    frame = spark.createDataFrame(rows, "record_id long, text string, category string, source_split string")
    found = near_duplicates.class_labels(frame, "category")
    assert set(map(tuple, found.collect())) == {("train", 4, "x", 2), ("train", 4, None, 1), ("test", 3, "y", 1), ("test", 5, None, 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("== Initial Plan ==")[0].count("Scan ExistingRDD") <= 1
