"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns for each numbered problem."""

import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_problems import WORD, pieces_of, reference_tokenizer

from sievelight.functions.text import comparison_value
from sievelight.llm import bpe_automaton, copies, lookalike, mixing, overlap, pieces, quota_sample, term_counts
from sievelight.llm.pieces import boundary_strengths
from sievelight.llm.queries import QUERIES

CLASHING = "id form h code codes word size key suffix occurrences first_1 kept bucket edge n channel n_tokens tokens limit overlap piece".split()
LONG = " ".join(f"word{i % 977} of a long letter, part {i}." for i in range(6_000))
RECORDS = "record_id long, text string, category string, source_split string, source string"


def clashing(frame):
    """``frame`` with further columns of names that the operators use inside."""
    return frame.withColumns({c: F.lit("clash") for c in CLASHING if c not in frame.columns})


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "Where is my new card?", "card", "train", "app"),
        (2, "where is  my new card", "card", "test", None),
        (3, "where is my new card!", None, "validation", "app"),
        (3, "where is my new card!", None, "validation", "app"),
        (4, "Where is my new cards?", "card", "test", "web"),
        (5, None, "card", "train", "app"),
        (6, "", "card", "test", "app"),
        (7, " ​ ", "Card ", "train", "app"),
        (8, LONG, "other", "train", "web"),
        (9, LONG.replace("letter", "Letter"), "other", "test", "web"),
        (10, "where is my new card", "card", None, "app"),
        (None, "where is my new card", "card", "train", "app"),
        (11, "?!", "card", "test", "app"),
        (12, "a", "card", "train", "app"),
        (13, "A", "card", "test", "app"),
    ]
    return clashing(spark.createDataFrame(rows, RECORDS)).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [
        (1, LONG, "mail"),
        (2, LONG, "mail"),
        (3, None, "mail"),
        (4, "", "chat"),
        (5, "short text", "chat"),
        (5, "short text", "chat"),
        (6, "no limit " * 50, "unknown"),
        (7, "no source " * 50, None),
        (8, "x" * 5_000, "chat"),
        (9, "汉字没有空格" * 200, "chat"),
        (None, "a text without id", "chat"),
    ]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")).repartition(3)


def test_overlaps(records):
    found = {tuple(r) for r in overlap.overlap_pairs(records).select("held_out_id", "train_id").collect()}
    rows = [(r.record_id, r.source_split, comparison_value(r.text or "")) for r in records.collect() if r.record_id is not None and r.source_split]
    sets = {f: pieces_of(f) for *_, f in rows if f}
    near = {(x, y) for x, y in product(sets, sets) if 2 * len(sets[x] & sets[y]) >= 0.9 * (len(sets[x]) + len(sets[y]))}
    assert found == {(a, b) for a, s, x in rows for b, t, y in rows if s != "train" and t == "train" and (x, y) in near}
    chosen = {r.record_id: r for r in records.collect() if r.record_id is not None}
    wanted = {}
    for a, b in found:
        held, train = chosen[a], chosen[b]
        entry = wanted.setdefault((held.source_split, held.source), [set(), 0, 0, 0])
        entry[0].add(a)
        entry[1] += 1
        entry[2] += comparison_value(held.text) == comparison_value(train.text)
        entry[3] += held.category == train.category
    report = {(r.source_split, r.source): (r.flagged, r.pairs, r.equal_pairs, r.same_category) for r in overlap.overlap_report(records).collect()}
    assert report == {key: (len(ids), *rest) for key, (ids, *rest) in wanted.items()}
    none = records.where("false")
    assert overlap.overlap_pairs(none).count() == overlap.overlap_report(none).count() == 0


def test_fingerprints_by_their_definition():
    """Segments are literally parts of the fingerprint, and the words are bits of it."""
    forms = ["a", "where is my card", "where is my new card " * 40, "0 9 z"]
    blocks, width = 16, 6
    segments, words, sizes = overlap.fingerprints(forms, blocks, width, 42)
    ranks = overlap._ranks(42, blocks * width)
    symbols = " abcdefghijklmnopqrstuvwxyz0123456789"
    for k, form in enumerate(forms):
        least = np.array([ranks[sum(symbols.index(c) * 37 ** (2 - i) for i, c in enumerate(piece))] for piece in pieces_of(form)]).min(axis=0)
        assert sizes[k] == len(pieces_of(form))
        for block in range(blocks):
            own = least[width * block : width * (block + 1)]
            assert [int(segments[k, block]) >> 5 * j & 31 for j in range(width)] == [int(x) & 31 for x in own]
            assert int(segments[k, block]) >> 5 * width == block
        bits = np.unpackbits(np.ascontiguousarray(words[k]).view(np.uint8))
        assert bits.tolist() == ([int(x) & 1 for x in least] + [int(x) >> 1 & 1 for x in least])[:192]


def test_recall_at_the_threshold():
    """Sets just at the threshold share a segment and lie within both radii with probability 0.99 or more."""
    chance, kept, tries = random.Random(9), 0, 0
    letters = "abcdefghijklmnopqrstuvwxyz"
    pairs = []
    while len(pairs) < 600:
        one = "".join(chance.choices(letters, k=60))
        two = one[:54] + "".join(chance.choices(letters, k=6))
        shared = 2 * len(pieces_of(one) & pieces_of(two)) / (len(pieces_of(one)) + len(pieces_of(two)))
        if 0.9 <= shared < 0.905:
            pairs.append((one, two))
        elif shared < 0.9:
            two = one[:56] + "".join(chance.choices(letters, k=4))
            shared = 2 * len(pieces_of(one) & pieces_of(two)) / (len(pieces_of(one)) + len(pieces_of(two)))
            if 0.9 <= shared < 0.905:
                pairs.append((one, two))
        tries += 1
        assert tries < 100_000
    a, b = (overlap.fingerprints(list(side), 16, 6, 42) for side in zip(*pairs))
    bits = [np.unpackbits(np.ascontiguousarray(x[1]).view(np.uint8), axis=None).reshape(len(pairs), -1) for x in (a, b)]
    apart = bits[0] != bits[1]
    within = (apart[:, :64].sum(1) <= overlap.radius(64, 64, 0.9)) & (apart.sum(1) <= overlap.radius(96, 192, 0.9))
    kept = ((a[0] == b[0]).any(1) & within).mean()
    assert kept >= 0.99, kept


def test_a_hot_text_meets_its_partners_as_one(spark):
    """Copies of one text in both splits are one pair of texts; only their ids multiply."""
    text = F.when(F.col("id") % 3 > 0, "where is my card").when(F.col("id") == 0, "where is my cards").otherwise(F.format_string("text %d of its own", "id"))
    frame = spark.range(600).select(F.col("id").alias("record_id"), text.alias("text"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("source_split"), F.lit("x").alias("source"), F.lit("c").alias("category"))
    classes = overlap.chosen_records(frame).groupBy("held_out", "text").agg(F.count("*").alias("tag"))
    hot = [r for r in overlap.matched_texts(classes).collect() if "card" in r.e_form]
    assert {(r.e_form, r.t_form, *r.e_tags, *r.t_tags) for r in hot} == {("where is my card", "where is my card", 200, 200), ("where is my card", "where is my cards", 200, 1)}
    ids = [tuple(r) for r in overlap.overlap_pairs(frame).where("similarity = 1").select("held_out_id", "train_id").collect()]
    assert len(ids) == len(set(ids)) == 200 * 200
    assert overlap.overlap_report(frame).first().pairs >= 200 * 201


@pytest.mark.parametrize("max_terms", [1, 2])
def test_terms(records, max_terms):
    occurrences, rows = Counter(), Counter()
    for r in records.collect():
        words = WORD.findall((r.text or "").lower())
        grams = [" ".join(words[i : i + n]) for n in range(1, max_terms + 1) for i in range(len(words) - n + 1)]
        occurrences.update(grams)
        rows.update(set(grams))
    found = term_counts.term_counts(records, max_terms=max_terms).collect()
    assert {r.term: (r.occurrences, r.records) for r in found} == {g: (n, rows[g]) for g, n in occurrences.items()}
    assert len(found) == len(occurrences)
    texts = records.where("text is not null").count()
    marks = {r.term: r.mark for r in term_counts.marked_terms(records, max_terms=max_terms).collect()}
    assert marks == {g: "rare" if n <= 2 else "common" if 10 * n > texts else None for g, n in rows.items()}
    assert term_counts.marked_terms(records.where("false")).count() == 0


def test_a_hot_term_and_no_words(spark):
    frame = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "the the card").when(F.col("id") % 3 == 1, "?!").alias("text")).repartition(8)
    found = {r.term: (r.occurrences, r.records) for r in term_counts.term_counts(frame).collect()}
    assert found == {"the": (2_000, 1_000), "card": (1_000, 1_000)}


def test_lookalikes(spark):
    rows = [
        ("r:1", "pay now"),
        ("r:1", "pay now"),
        ("r:2", "рay now​"),
        ("r:3", "PAY now"),
        ("r:4", None),
        ("r:5", "​ "),
        (None, "pay now"),
        ("r:6", LONG),
        ("r:7", LONG.replace("a", "а", 1)),
        ("p:1", "pay  now"),
        ("p:2", "payé"),
        ("p:3", "payé"),
        ("p:4", "paye"),
        ("p:5", "Привет"),
    ]
    frame = clashing(spark.createDataFrame(rows, "key string, text string"))
    found = [tuple(r) for r in lookalike.lookalike_pairs(frame).collect()]
    assert sorted(found) == [("p:1", "r:1"), ("p:1", "r:2"), ("p:2", "p:3"), ("r:1", "r:2"), ("r:6", "r:7")]
    forms = {r.key: r.form for r in lookalike.consistent_forms(frame).collect()}
    assert forms["r:2"] == "pay now" and forms["p:5"] == "Привет" and "r:4" not in forms and "r:5" not in forms
    assert lookalike.lookalike_pairs(frame.where("false")).count() == 0


def test_letters_of_any_script_shaped_like_latin_ones(spark):
    alike = {"APPLE": "ᎪᏢᏢᏞᎬ", "CASH": "ꓚꓮꓢꓧ", "cop": "ⲥⲟⲣ", "city": "cıty", "pay": "pɑγ", "TOOL": "ТОӀL"}
    rows = [(f"{k}{side}", text) for k, pair in enumerate(alike.items()) for side, text in zip("ab", pair)]
    own = ["Κώστας σόλο", "Ребёнок у Юры", "משלוח סוס", "هوا ہو", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ"]
    rows += [(f"own{k}", text) for k, text in enumerate(own)]
    frame = spark.createDataFrame(rows * 2, "key string, text string")
    found = {tuple(r) for r in lookalike.lookalike_pairs(frame).collect()}
    assert found == {(f"{k}a", f"{k}b") for k, (x, y) in enumerate(alike.items()) if "I" not in y and "Ӏ" not in y}
    forms = {r.key: r.form for r in lookalike.consistent_forms(frame).collect()}
    assert [forms[f"own{k}"] for k in range(len(own))] == own  # a text of one script keeps its letters
    assert forms["0b"] == forms["0a"] and forms["5b"] == "TOIL"


def test_a_form_of_many_copies(spark):
    """Copies of one text meet the one other spelling of it, and never each other."""
    text = F.when(F.col("id") == 7, "рay now").when(F.col("id") % 3 > 0, "pay now").otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    frame = spark.range(9_000).select(F.format_string("%05d", "id").alias("key"), text.alias("text")).repartition(8)
    found = {tuple(r) for r in lookalike.lookalike_pairs(frame).collect()}
    assert found == {tuple(sorted((f"{i:05d}", "00007"))) for i in range(9_000) if i % 3 and i != 7}


def test_samples(spark, records):
    rows = [
        ("p", "train", "card", 8_000, 2, 4),
        ("p", "train", "card", 8_000, 2, 4),
        ("p", "train", "other", 2_000, 1, 4),
        ("q", "test", "card", 10_000, 9, 4),
        ("q", "test", "missing", 0, 1, 4),
        ("z", "test", "card", 0, 0, 0),
        (None, "test", "card", 1, 1, 4),
        ("q", None, "card", 1, None, 4),
    ]
    targets = spark.createDataFrame(rows, "plan_id string, source_split string, category string, target_bp int, min_rows int, sample_size long")
    drawn = quota_sample.draw_sample(records, targets).collect()
    assert Counter((r.plan_id, r.category) for r in drawn) == {("p", "card"): 3, ("p", "other"): 1, ("q", "card"): 5}
    again = quota_sample.draw_sample(records.repartition(7), targets).collect()
    assert sorted(drawn) == sorted(again)
    report = quota_sample.sample_report(records, targets).where("plan_id is not null and source_split is not null and not met").collect()
    assert {(r.plan_id, r.category): (r.needed, r.available, r.drawn) for r in report} == {("q", "card"): (9, 5, 5), ("q", "missing"): (1, 0, 0)}
    for r, t in ((records.where("false"), targets), (records, targets.where("false")), (records.where("false"), targets.where("false"))):
        assert quota_sample.draw_sample(r, t).count() == 0
        assert quota_sample.sample_report(r, t).count() == t.count()


def test_rows_given_twice_are_drawn_as_often(spark):
    """Six rows of one id and six of other ids: a quota of all takes each row, one of half takes as many."""
    frame = spark.createDataFrame([(1, "c", "train", "app")] * 6 + [(i, "c", "train", "app") for i in range(2, 8)], "record_id long, category string, source_split string, source string")
    targets = spark.createDataFrame([("all", "train", "c", 10_000, 0, 12), ("half", "train", "c", 10_000, 0, 6)], "plan_id string, source_split string, category string, target_bp int, min_rows int, sample_size long")
    drawn = Counter((r.plan_id, r.record_id) for r in quota_sample.draw_sample(frame, targets).collect())
    assert {i: n for (p, i), n in drawn.items() if p == "all"} == {1: 6} | {i: 1 for i in range(2, 8)}
    half = {i: n for (p, i), n in drawn.items() if p == "half"}
    assert sum(half.values()) == 6 and half.get(1, 0) <= 6 and all(n == 1 for i, n in half.items() if i != 1)


def test_found_rows_come_from_the_operators(spark, sf_dir, monkeypatch):
    """Without quotas every target with a need falls short; without a wanted share no source is clipped."""
    targets = spark.read.parquet(f"{sf_dir}/sample_targets.parquet")
    needed = quota_sample.needed_rows(targets).where("needed > 0").select("plan_id", "category").distinct().count()
    real, budgets = quota_sample._plan_cells, mixing._plan_budgets
    monkeypatch.setattr(quota_sample, "_plan_cells", lambda plan: real(plan).assign(quota=0))
    assert QUERIES["p4_found"](spark, sf_dir).count() == needed
    monkeypatch.setattr(mixing, "_plan_budgets", lambda plan: budgets(plan.assign(share_bp=0)))
    assert QUERIES["p7_found"](spark, sf_dir).count() == 0


def test_weights_of_mixes():
    own, even = [800, 150, 50], [1, 1, 1]
    found, exponent = mixing.mix_weights(own, even, [9.0] * 3)
    assert found == pytest.approx([1 / 3] * 3) and exponent == 1.0
    clipped, _ = mixing.mix_weights(own, even, [9.0, 9.0, 0.1])
    assert clipped == pytest.approx([0.45, 0.45, 0.1])
    # The second may not rise to 0.45, and the first takes the rest at a lower exponent.
    weights, exponent = mixing.mix_weights(own, even, [9.0, 0.4, 0.1])
    assert weights == pytest.approx([0.5, 0.4, 0.1]) and 0 < exponent < 1
    assert weights[0] / weights[1] == pytest.approx((800 / 150) ** (1 - exponent), rel=1e-6)
    assert sum(mixing.mix_weights(own, even, [0.3] * 3)[0]) == pytest.approx(0.9)
    assert mixing.mix_weights([0, 10], [1, 1], [0.0, 1.0])[0] == pytest.approx([0.0, 1.0])
    assert mixing.mix_weights(own, [0, 0, 0], [1.0] * 3)[0] == [0.0] * 3
    chance = random.Random(1)
    for _ in range(300):
        n = chance.randint(1, 6)
        own, wanted = [chance.randint(0, 1_000) for _ in range(n)], [chance.randint(0, 9) for _ in range(n)]
        limits = [chance.choice([0.1, 0.3, 1.0, 3.0]) * x / 1_000 for x in own]
        found, _ = mixing.mix_weights(own, wanted, limits)
        share = [q / max(1, sum(wanted)) for q in wanted]
        assert all(w <= limit * (1 + 1e-9) for w, limit in zip(found, limits))
        assert all(w >= min(q, limit) - 1e-9 for w, q, limit in zip(found, share, limits)), (own, wanted, limits, found)
        usable = sum(limit for q, limit in zip(share, limits) if q)
        assert sum(found) == pytest.approx(min(1.0, usable) if any(share) else 0.0, abs=1e-9), (own, wanted, limits, found)


def test_rounding_keeps_both_margins():
    from fractions import Fraction

    chance = random.Random(7)
    for _ in range(60):
        height, width = chance.randint(1, 6), chance.randint(1, 6)
        rows = [chance.randint(0, 12) for _ in range(height)]
        parts = [[chance.randint(0, 5) for _ in range(width)] for _ in range(height)]
        parts = [row if any(row) else [1] * width for row in parts]
        cells = [[Fraction(total * x, sum(row)) for x in row] for total, row in zip(rows, parts)]
        whole = quota_sample.controlled_rounding(cells, rows)
        assert [sum(row) for row in whole] == rows
        assert all(abs(x - y) < 1 for exact, rounded in zip(cells, whole) for x, y in zip(exact, rounded))
        assert all(abs(sum(row[j] for row in cells) - sum(row[j] for row in whole)) < 1 for j in range(width))


def test_copies(spark):
    same = '{"text": "Card, lost", "category": "Card_Lost", "source": null}'
    rows = [
        (5, same),
        (2, '{"SOURCE":"", "Category":"card lost",\n"Text":"card   LOST!"}'),
        (9, '{"category": "card lost", "text": "card lost"}'),
        (9, '{"category": "card lost", "text": "card lost"}'),
        (3, '{"text": "cárd lost", "category": "card lost"}'),
        (4, '{"text": "card lost", "category": null}'),
        (6, '{"text": "!?", "category": "card lost"}'),
        (7, '{"text": "!?", "category": "card lost"}'),
        (8, same + " x"),
        (10, '{"text": "card lost", "category": "card lost", "source": NaN}'),
        (11, "[]"),
        (12, None),
        (13, ""),
        (None, same),
        (14, '{"text": ["é 1"], "category": "x"}'),
        (15, '{"text": "é 1", "category": "x"}'),
        (16, '{"text": "a\\ud800b", "category": "x"}'),
        (17, '{"text": "a b", "category": "x"}'),
        (18, '{"text": "' + LONG + '", "category": "y"}'),
        (19, '{"category": "Y", "text": "' + LONG.upper() + '"}'),
    ]
    frame = clashing(spark.createDataFrame(rows, "raw_id long, payload string")).repartition(4)
    assert {tuple(r) for r in copies.copies(frame).collect()} == {(2, 5), (2, 9), (14, 15), (16, 17), (18, 19)}
    assert {tuple(r) for r in copies.collapsed(frame).collect()} == {(2, 3), (3, 1), (14, 2), (16, 2), (18, 2)}
    assert copies.collapsed(frame.where("false")).count() == 0


def test_copies_of_one_key_in_many_partitions(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit('{"text":"hot","category":"c"}')).otherwise(F.format_string('{"text":"t%d","category":"c"}', F.col("id")))
    frame = spark.range(9_000).select(F.col("id").alias("raw_id"), hot.alias("payload"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed = copies.canonical_payloads(frame)
        parts = keyed.repartitionByRange("key", "id").where("key like 'hot%'").select(F.spark_partition_id()).distinct().count()
        found = copies.copies(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert parts > 1
    assert {r.kept_id for r in found} == {0} and sorted(r.copy_id for r in found) == list(range(3, 9_000, 3))


def test_ids(documents):
    tokenizer = reference_tokenizer()
    encoded = bpe_automaton.encode_texts(documents)
    found = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=repr)
    wanted = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in documents.collect()]
    assert found == sorted(wanted, key=repr)
    back = {r.doc_id: r.text for r in bpe_automaton.decode_ids(encoded).collect()}
    assert back == {r.doc_id: r.text or "" for r in documents.collect()}
    assert bpe_automaton.encode_texts(documents.where("false")).count() == 0


def test_automaton_on_any_text():
    automaton = bpe_automaton.Automaton(open(bpe_automaton.default_tokenizer(), encoding="utf-8").read(), bpe_automaton.default_pattern())
    tokenizer = reference_tokenizer()
    chance = random.Random(3)
    letters = "aabcdeehinorst  \n\t.,'\"0129éßüñ汉字かな가́​😀👍🏽<|>[]_\x00"
    for _ in range(3_000):
        text = "".join(chance.choices(letters, k=chance.randint(0, 40)))
        ids = automaton.encode(text)
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert automaton.decode(ids) == text


def test_mixes(spark, documents):
    rows = [
        ("a", "mail", 5_000, 1, 1_000_000),
        ("a", "chat", 5_000, 3, 1_000_000),
        ("b", "chat", 9_000, 2, 3_000),
        ("b", "none", 1_000, 2, 3_000),
        ("c", "chat", 10_000, 1, 0),
        (None, "chat", 1, 1, 1),
        ("d", None, 1, 1, 1),
        ("e", "mail", 10_000, None, 100),
    ]
    targets = spark.createDataFrame(rows, "plan_id string, source string, share_bp int, max_repeats int, total_tokens long")
    sized = mixing.sized_documents(documents)
    totals = mixing.source_tokens(sized)
    tokens = {r.source: r.tokens for r in totals.collect()}
    budgets = mixing.mix_budgets(targets, totals)
    short = {(r.plan_id, r.source) for r in budgets.where("clipped").collect()}
    assert short == {
        (p, s) for p, s, share, most, size in rows if p and s and (most or 0) * tokens.get(s, 0) * 10_000 < size * share
    }
    mixed = mixing.mix(sized, budgets).collect()
    limit = {(p, s): most for p, s, _, most, _ in rows}
    assert all(0 < r.copies <= limit[r.plan_id, r.source] for r in mixed)
    used = Counter()
    for r in mixed:
        used[r.plan_id, r.source] += r.copies * r.n_tokens
    # Every budget is met but for one part of a document; the row without an id is never used.
    largest = max(r.n_tokens for r in sized.collect())
    missed = {(r.plan_id, r.source): r.budget - used[r.plan_id, r.source] for r in budgets.collect()}
    assert all(abs(x) <= largest for x in missed.values()) and used["a", "mail"] == tokens["mail"]
    report = mixing.mix_report(mixing.mix(sized, budgets), budgets).collect()
    assert {(r.plan_id, r.source): r.used_tokens for r in report} == {key: used[key] for key in missed}
    for d, t in ((documents.where("false"), targets), (documents, targets.where("false"))):
        empty = mixing.sized_documents(d)
        assert mixing.mix(empty, mixing.mix_budgets(t, mixing.source_tokens(empty))).count() == 0


def test_mix_of_rows_given_twice(spark):
    frame = spark.createDataFrame([(1, "one two three", "s"), (1, "one two three", "s"), (None, "four", "s")], "doc_id long, text string, source string")
    sized = mixing.sized_documents(frame)
    size = sum(r.n_tokens for r in sized.collect()) - 1
    targets = spark.createDataFrame([("p", "s", 10_000, 1, size)], "plan_id string, source string, share_bp int, max_repeats int, total_tokens long")
    mixed = mixing.mix(sized, mixing.mix_budgets(targets, mixing.source_tokens(sized))).collect()
    assert [(r.doc_id, r.copies) for r in mixed] == [(1, 1)]


def test_pieces(spark, documents):
    tokenizer = reference_tokenizer()
    limits = {"mail": (300, 30), "chat": (7, 2)}
    rows = [(s, *x) for s, x in limits.items()] + [("chat", 9, 4), (None, 1, 1)]
    frame = spark.createDataFrame(rows, "source string, max_tokens int, overlap_tokens int")
    chosen = documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = pieces.split_documents(chosen, frame).collect()
    texts = {r.doc_id: (r.text, r.source) for r in chosen.collect()}
    by_document = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.piece)):
        by_document.setdefault(r.doc_id, []).append(r)
    assert set(by_document) == {i for i, (text, _) in texts.items() if text}
    for number, parts in by_document.items():
        text, source = texts[number]
        limit, overlap = limits.get(source, (10**9, 0))
        assert [p.piece for p in parts] == list(range(1, len(parts) + 1))
        assert all(len(tokenizer.encode(p.text, add_special_tokens=False).ids) == p.n_tokens <= limit for p in parts)
        assert parts[0].begin_token == 0 and text.startswith(parts[0].text) and text.endswith(parts[-1].text)
        for before, after in zip(parts, parts[1:]):
            assert overlap <= after.overlap == before.end_token - after.begin_token <= overlap + 3
        place = 0
        for part in parts:  # the pieces lie in order and leave no gap
            found_at = text.rfind(part.text, 0, place + len(part.text))
            assert 0 <= found_at <= place
            place = max(place, found_at + len(part.text))
        assert place == len(text)
    ends = Counter(p.boundary for p in by_document[1][:-1])
    assert ends["sentence"] > 0
    assert pieces.split_documents(documents.where("false"), frame).count() == 0
    assert all(r.piece == 1 for r in pieces.split_documents(chosen, frame.where("false")).collect())
    repeated = pieces.split_documents(documents, frame).where("doc_id = 5").count()
    assert repeated == 2


def test_documents_that_stay_whole_can_be_left_out(documents):
    limits = documents.sparkSession.createDataFrame([("mail", 300, 30), ("chat", 7, 2), ("chat", 9, 4), ("x", 0, 0)], "source string, max_tokens int, overlap_tokens int")
    every = pieces.split_documents(documents, limits).collect()
    cut = {r.doc_id for r in every if r.piece > 1}
    only = pieces.split_documents(documents, limits, cut_only=True).collect()
    assert sorted(only, key=repr) == sorted((r for r in every if r.doc_id in cut), key=repr) and {1, 2, 8, 9} <= cut


def test_a_vocabulary_must_have_every_byte():
    with pytest.raises(ValueError, match="each byte"):
        bpe_automaton.Automaton('{"model": {"vocab": {"a": 0, "b": 1}, "merges": []}}', r"\w+")


def test_boundaries_by_strength():
    text = "Intro text. More text\nnew line\n\n# Title\nrest of it"
    starts = list(range(len(text)))
    strengths = boundary_strengths(text, starts)
    at = {place: pieces.KINDS[s] for place, s in enumerate(strengths) if s}
    assert at[text.index("new")] == "line" and at[text.index("#")] == "section" and at[text.index(" More")] == "sentence"


def test_cuts_move_to_sentences_where_the_limit_leaves_room():
    automaton = bpe_automaton.Automaton(open(bpe_automaton.default_tokenizer(), encoding="utf-8").read(), bpe_automaton.default_pattern())
    text = " ".join(["The card was lost in the city today."] * 50)
    parts = pieces.split_text(automaton, text, 100, 0)
    assert len(parts) == -(-automaton.count(text) // 100) and {p[5] for p in parts[:-1]} == {"sentence"}
    assert "".join(p[6] for p in parts) == text
