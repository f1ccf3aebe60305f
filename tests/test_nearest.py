"""Cosines on hashed terms against those of the tables of terms, and what they spare."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.operators import features, nearest
from sievelight.plans import catalog

TEXTS = ["Where is my new card", "where is my card", "Pâté, my old_account 12", "где моя карта", "", None, "a b", "close my account my account", "my my my", "x" * 300 + " loan"]


def test_hashed_cosines_are_those_of_terms(spark):
    rows = [(i % 13 if i % 17 else None, t) for i, t in enumerate(TEXTS * 3)]
    train = spark.createDataFrame(rows, "record_id long, text string")
    asked = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate([*TEXTS, "nothing known here", "new карта loan"])], "id string, text string")
    terms = features.term_frequencies(train, "record_id")
    idf = features.inverse_frequencies(terms, train)
    wanted = features.nearest_cosine(features.tfidf_rows(features.term_frequencies(asked, "id"), idf), features.tfidf_rows(terms, idf), 12, 30).collect()
    texts = nearest.texts_by_id(train, "record_id")
    own = nearest.inverse_frequencies(texts, train.count())
    assert sorted(r.idf for r in own.collect()) == pytest.approx(sorted(r.idf for r in idf.collect()))
    found = nearest.nearest_cosine(nearest.texts_by_id(asked, "id"), texts, own).collect()
    assert {r.id: r.cosine for r in found} == pytest.approx({r.id: r.cosine for r in wanted}) and len(found) > 6
    none = texts.where("false")
    assert nearest.nearest_cosine(nearest.texts_by_id(asked, "id"), none, nearest.inverse_frequencies(none, 0)).count() == 0
    assert nearest.nearest_cosine(nearest.texts_by_id(asked.where("false"), "id"), texts, own).count() == 0


@pytest.mark.parametrize("common, cells", [(0, 1), (3, 40), (12, 1 << 20)])
def test_no_pair_that_could_be_greatest_is_left_out(monkeypatch, common, cells):
    """Whichever terms are common, and however many cosines are worked out at once, in several chunks of rows."""
    monkeypatch.setattr(nearest, "COMMON", common)
    monkeypatch.setattr(nearest, "COMMON_QUERIES", 4)
    monkeypatch.setattr(nearest, "CELLS", cells)
    chance = np.random.default_rng(6)
    for share in (0.05, 0.3, 0.9):
        rows, asked = (np.where(chance.random((n, 30)) < np.linspace(share, 0.02, 30), chance.random((n, 30)) ** 3, 0.0) for n in (300, 25))
        sparse = lambda m: (*np.nonzero(m), m[np.nonzero(m)])
        owner, term, weight = sparse(asked)
        block = nearest.Block(owner, term.astype(np.uint64), weight, len(asked))
        for part in (rows[:120], rows[120:120], rows[120:]):
            row, held, load = sparse(part)
            block.meet(row, held.astype(np.uint64), load)
        assert block.best == pytest.approx((asked @ rows.T).max(axis=1))


def test_terms_are_told_apart_by_content():
    lists = pa.array([[["ab", "ba", "ab"], ["ab"]], [], [["ab" * 200, "ab" * 200], []], [["ba"]]])
    row, term, frequency = nearest._terms(lists.slice(0))
    assert list(zip(row.tolist(), sorted(frequency[row == 0].tolist()))) [:4] == [(0, 1), (0, 1), (0, 1), (0, 3)]
    assert np.bincount(row).tolist() == [4, 0, 2, 1] and len(set(term.tolist())) == 6
    again = nearest._terms(lists.slice(2))
    assert again[1].tolist() == term[row >= 2].tolist()


def test_audit_prepares_the_train_records_once(spark, sf_dir, monkeypatch):
    """Probes and test rows are compared with the same frequencies; they were worked out for each of the two."""
    made, trained = [], catalog._trained
    monkeypatch.setattr(catalog, "_trained", lambda *given: (made.append(given), trained(*given))[1])
    found = catalog.QUERIES["rejection_audit"](spark, sf_dir)
    assert found.agg(F.sum("records")).first()[0] > 0
    assert len(made) == 1
