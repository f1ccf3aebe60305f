"""Queries that must do their whole job, on fixtures where a part of it would show."""

import pickle
import re
from itertools import product
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.operators import bootstrap, features, logistic, near_duplicates
from sievelight.plans import catalog
from sievelight.plans.catalog import LEFT, QUERIES, RIGHT

RECORD = "record_id long, text string, category string, source_split string, source_index long"


def test_every_test_record_is_predicted(spark, tmp_path):
    train = [("lost my card", "card"), ("card was stolen", "card"), ("my card is lost", "card"), ("loan rate please", "loan"), ("what loan rate", "loan"), (None, "card"), ("", "card"), ("zzz", "card")]
    test = ["my lost card", "loan rate", None, "", "  ", "qqq www"]
    rows = [(i, t, c, "train", i) for i, (t, c) in enumerate(train)] + [(100 + i, t, "card", "test", i) for i, t in enumerate(test)]
    spark.createDataFrame(rows, RECORD).write.parquet(str(tmp_path / "records.parquet"))
    found = {r.id: r for r in QUERIES["logreg_predictions"](spark, str(tmp_path)).collect()}
    assert sorted(found) == [100 + i for i in range(len(test))]
    assert (found[100].predicted, found[101].predicted) == ("card", "loan")
    without = {(found[i].predicted, round(found[i].probability, 9)) for i in range(102, 106)}
    assert len(without) == 1 and without.pop()[0] == "card"


def test_full_bootstrap_follows_all_possible_draws(spark, tmp_path):
    """Two labels of three rows: each of the 27 x 27 draws of rows is as likely."""
    rows = [("a", "a", "a"), ("a", "b", "a"), ("a", "b", None), ("b", "b", "b"), ("b", "a", "b"), ("b", "a", "a")]
    given = [(name, i, "t", row[0], row[1 + s], row[0] == row[1 + s], row[1 + s] is not None) for i, row in enumerate(rows) for s, name in enumerate((LEFT, RIGHT))]
    spark.createDataFrame(given, "approach string, row_index long, text string, actual string, predicted string, correct boolean, label_valid boolean").write.parquet(str(tmp_path / "predictions.parquet"))
    spark.createDataFrame([("a",), ("b",)], "category string").write.parquet(str(tmp_path / "routes.parquet"))

    def scores(drawn, s):
        f1 = []
        for label in "ab":
            hits = sum(r[0] == label == r[1 + s] for r in drawn)
            whole = sum(r[0] == label for r in drawn) + sum(r[1 + s] == label for r in drawn)
            f1.append(2 * hits / whole if whole else 0.0)
        return sum(r[0] == r[1 + s] for r in drawn) / len(drawn), sum(f1) / 2

    draws = [[*x, *y] for x in product(rows[:3], repeat=3) for y in product(rows[3:], repeat=3)]
    exact = np.array([[scores(d, s) for s in (0, 1)] for d in draws])
    frame = bootstrap.outcome_cells(spark.read.parquet(str(tmp_path / "predictions.parquet")), [LEFT, RIGHT])
    found = bootstrap.multinomial_metrics(frame, spark.read.parquet(str(tmp_path / "routes.parquet")), [LEFT, RIGHT], 10_000, 42).collect()
    assert len({r.replicate for r in found}) == 10_000 and len(found) == 20_000
    for s, name in enumerate((LEFT, RIGHT)):
        for m, metric in enumerate(("accuracy", "macro_f1")):
            drawn, all_ = np.array([r[metric] for r in found if r.approach == name]), exact[:, s, m]
            for value in np.unique(all_.round(9)):
                assert abs((drawn <= value + 1e-8).mean() - (all_ <= value + 1e-8).mean()) < 0.02
    for r in QUERIES["bootstrap_ci_full"](spark, str(tmp_path)).collect():
        all_ = exact[:, (LEFT, RIGHT).index(r.approach), ("accuracy", "macro_f1").index(r.metric)]
        for end, share in ((r.low, 0.025), (r.high, 0.975)):
            assert np.quantile(all_, share - 0.01) - 1e-6 <= end <= np.quantile(all_, share + 0.01) + 1e-6
    differences = exact[:, 0] - exact[:, 1]
    for r in QUERIES["paired_difference_ci_full"](spark, str(tmp_path)).collect():
        all_ = differences[:, ("accuracy", "macro_f1").index(r.metric)]
        assert np.quantile(all_, 0.015) - 1e-6 <= r.low <= np.quantile(all_, 0.035) + 1e-6
        assert r.excludes_zero == (r.low > 0 or r.high < 0)


@pytest.mark.parametrize("sizes", [(1, 1, 1), (3, 7, 8), (1_000, 1_000, 60), (1_000, 1_000, 1 << 20)])
def test_cosines_come_from_blocks(spark, sizes):
    """Whatever the sizes of blocks, chunks and products, each query meets each row."""
    chance = np.random.default_rng(3)
    dense = {k: np.where(chance.random(12) < 0.4, chance.random(12), 0.0) for k in range(30)}
    rows = [(k, [(f"t{t:02d}", float(w)) for t, w in enumerate(row) if w]) for k, row in dense.items() if row.any()]
    frame = spark.createDataFrame(rows, "id long, entries array<struct<term:string,weight:double>>")
    alone = spark.createDataFrame([(99, [("zz", 1.0)])], frame.schema)
    found = {r.id: r.cosine for r in features.nearest_cosine(frame.where("id < 20").unionByName(alone), frame.where("id > 4"), 21, 25, *sizes).collect()}
    wanted = {k: max(float(dense[k] @ dense[j]) for j in range(5, 30)) for k in range(20) if dense[k].any()}
    assert found == pytest.approx({k: v for k, v in wanted.items() if v > 0})


def test_audit_decides_on_six_digits(spark, sf_dir, monkeypatch):
    """A test row 0.0004 below the threshold is rejected, one 0.0004 above it is not."""
    given = spark.read.parquet(f"{sf_dir}/predictions.parquet").where("record_id % 100 = 0")
    first = given.agg({"record_id": "min"}).first()[0]
    threshold = spark.createDataFrame([(0.5,)], "threshold double")
    monkeypatch.setattr(catalog, "_calibrated", lambda *given: (None, threshold))
    monkeypatch.setattr(catalog, "_cosines", lambda s, d, rows, key: rows.selectExpr("record_id as id", f"if(record_id = {first}, 0.4996D, 0.5004D) as cosine"))
    valid = given.where("label_valid").groupBy("approach").agg(F.count_if(F.col("record_id") == first).alias("low"), F.count("*").alias("n")).collect()
    invalid = {r.approach: r.n for r in given.groupBy("approach").agg(F.count_if(~F.coalesce("label_valid", F.lit(False))).alias("n")).collect()}
    found = {r.approach: r.rejected for r in QUERIES["rejection_audit"](spark, sf_dir).collect()}
    assert sum(r.low for r in valid) > 0
    assert found == {r.approach: r.low + invalid[r.approach] for r in valid}


def test_manifest_lists_every_table(spark, tmp_path):
    for name in ("routes.parquet", "records.parquet/part-0.parquet"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    found = {(r.name, r.bytes) for r in QUERIES["table_manifest"](spark, str(tmp_path)).collect()}
    assert found == {("routes.parquet", 14), ("records.parquet/part-0.parquet", 30)}


#: What is as long as the number of records or texts.
GROWING = re.compile(r"form|_h#|class_id|left_id|right_id|\bid#")


def broadcast_keys(monkeypatch, build):
    """Keys of the broadcast joins in the plans of a query: its own and those of what it stores."""
    frames, stored = [], near_duplicates.stored
    keep = lambda frame: (frames.append(frame), stored(frame))[1]
    for module in (near_duplicates, catalog):
        monkeypatch.setattr(module, "stored", keep)
    frames.append(build())
    plans = "\n".join(f._jdf.queryExecution().executedPlan().toString() for f in frames)
    assert "SortMergeJoin" in plans
    return re.findall(r"Broadcast\w+Join (\[.*?\])", plans)


@pytest.mark.parametrize("name", ["near_duplicate_links", "near_duplicate_records", "near_duplicate_rollup"])
def test_texts_and_classes_are_never_broadcast(spark, sf_dir, monkeypatch, name):
    """The texts are small here, so without care Spark sends them to all tasks, as it does with large ones whose files are small."""
    keys = broadcast_keys(monkeypatch, lambda: QUERIES[name](spark, sf_dir))
    assert not [k for k in keys if GROWING.search(k)]


def test_regression_lies_in_files_and_agrees_with_another(spark, monkeypatch):
    """Blocks and ranges of a few rows and slots; the model that comes to the driver has no coefficients."""
    monkeypatch.setattr(logistic, "BLOCK_ROWS", 7)
    monkeypatch.setattr(logistic, "RANGE_SLOTS", 9)
    chance, size = np.random.default_rng(11), 40
    rows = []
    for k in range(90):
        dense = np.where(chance.random(size) < 0.2, chance.random(size), 0.0)
        label = ["a", "b", "c"][int(dense[:3].argmax())] if k % 10 else None
        rows.append((k, Vectors.dense(dense) if k % 7 == 0 else Vectors.sparse(size, np.flatnonzero(dense), dense[dense > 0]), label))
    frame = spark.createDataFrame(rows, T.StructType().add("id", "long").add("features", VectorUDT()).add("category", "string"))
    model = features.fit_logistic([frame.where("id < 50"), frame.where("id >= 50")], tolerance=1e-7)
    assert len(pickle.dumps(model)) < 1_000
    found = {r.id: (r.predicted, r.probability) for r in features.logistic_predictions(model, frame).collect()}
    train = frame.where("category is not null").withColumn("label", F.expr("cast(ascii(category) - 97 as double)"))
    other = LogisticRegression(family="multinomial", maxIter=1000, tol=1e-9, standardization=False, regParam=1 / train.count()).fit(train)
    wanted = {r.id: r.probability for r in other.transform(frame).select("id", "probability").collect()}
    assert {k: p for k, (_, p) in found.items()} == pytest.approx({k: max(p) for k, p in wanted.items()}, abs=2e-3)
    assert all("abc"[int(np.argmax(wanted[k]))] == p for k, (p, _) in found.items() if np.ptp(sorted(wanted[k])[-2:]) > 4e-3)


@pytest.mark.parametrize("name", ["classifier_group_scores", "probability_threshold"])
def test_classifier_queries_keep_coefficients_off_the_driver(spark, sf_dir, monkeypatch, name):
    fits, fit = [], features.fit_logistic
    monkeypatch.setattr(features, "fit_logistic", lambda *given, **options: (fits.append(fit(*given, **options)), fits[-1])[1])
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert [len(pickle.dumps(m)) < 10_000 for m in fits] == [True]


@pytest.mark.parametrize("name", ["classifier_group_scores", "probability_threshold"])
def test_stored_texts_make_room_for_the_fit(spark, sf_dir, monkeypatch, name):
    """Of what was stored for the features, texts are gone when the fit has begun; the terms are still needed."""
    kept, store = [], catalog.stored
    monkeypatch.setattr(catalog, "stored", lambda frame: (kept.append(store(frame)), kept[-1])[1])
    assert QUERIES[name](spark, sf_dir).count() > 0
    left = [frame.columns for frame in kept if any(Path(unquote(urlparse(f).path)).exists() for f in frame.inputFiles())]
    assert left == [["term", "idf", "slot"]]


def test_threshold_of_probabilities_has_a_small_plan(spark, sf_dir, monkeypatch):
    """The classifier and the split of the probes aren't in the plan, which the driver holds anew for each stage that ends."""
    rows, search = [], catalog.scope.threshold_search
    monkeypatch.setattr(catalog.scope, "threshold_search", lambda given: (rows.append(given), search(given))[1])
    found = QUERIES["probability_threshold"](spark, sf_dir)
    assert found.count() == 1 and rows[0].count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.findall("InMemoryTableScan|MapInArrow|Parquet|WindowGroupLimit", plan)
    assert len(plan) < 20_000
