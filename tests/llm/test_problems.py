"""The numbered problems against brute force on the smallest tables."""

import json
import re
from collections import Counter, defaultdict

import pytest
from compare import oracle_rows, query_rows

from sievelight.functions.text import comparison_value
from sievelight.llm import copies, lookalike, term_counts
from sievelight.llm.oracle import ORACLE_SQL
from sievelight.llm.queries import QUERIES

WORD = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert query_rows(QUERIES[name](spark, sf_dir)) == oracle_rows(ORACLE_SQL[name], sf_dir)


def pieces_of(form):
    padded = f" {form} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def test_overlaps_match_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/records.parquet").collect()
    forms = [(r.record_id, r.source_split == "train", f) for r in rows if r.text and (f := comparison_value(r.text))]
    sets = {f: pieces_of(f) for _, _, f in forms}
    wanted = {
        tuple(sorted((a, b)))
        for a, s, x in forms if not s
        for b, t, y in forms if t and 2 * len(sets[x] & sets[y]) >= 0.9 * (len(sets[x]) + len(sets[y]))
    }
    found = {tuple(r) for r in QUERIES["p1_found"](spark, sf_dir).collect()}
    assert found <= wanted and len(found) >= 0.99 * len(wanted)


def test_lookalikes_of_written_forms(spark):
    texts = {"a": "fix Café", "b": "ﬁx  Café​", "c": "fix Cafe", "d": "ｆix Café ", "e": "fiх Café", "f": "Fix Café", "g": None, "h": "", "i": "​", "j": "fix Café"}
    frame = spark.createDataFrame(list(texts.items()), "key string, text string")
    found = {tuple(r) for r in lookalike.lookalike_pairs(frame).collect()}
    alike = ["a", "b", "d", "e", "j"]
    assert found == {(x, y) for x in alike for y in alike if x < y and texts[x] != texts[y]}
    assert lookalike.lookalike_pairs(frame.where("false")).count() == 0


def test_copies_match_brute_force(spark, sf_dir):
    def key(payload):
        def refuse(_):
            raise ValueError

        try:
            value = json.loads(payload, parse_constant=refuse)
        except (ValueError, TypeError):
            return None
        if not isinstance(value, dict):
            return None
        value = {k.lower(): v for k, v in value.items()}
        if value.get("text") is None or value.get("category") is None or not WORD.findall(str(value["text"])):
            return None
        return tuple(tuple(WORD.findall(str(value.get(f) or "").casefold())) for f in ("text", "category", "source"))

    groups = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/raw_records.parquet").collect():
        if (k := key(r.payload)) is not None:
            groups[k].append(r.raw_id)
    wanted = {(min(g), x) for g in groups.values() for x in g if x != min(g)}
    assert {tuple(r) for r in QUERIES["p5_found"](spark, sf_dir).collect()} == wanted
    empty = spark.createDataFrame([], "raw_id long, payload string")
    assert copies.copies(empty).count() == 0


def test_ngram_counts_match_brute_force(spark):
    texts = ["a b a b", "b a", None, "", "A-b", "a b a b"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    occurrences, records = Counter(), Counter()
    for text in filter(None, texts):
        words = WORD.findall(text.lower())
        grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        occurrences.update(grams)
        records.update(set(grams))
    found = {r.term: (r.occurrences, r.records) for r in term_counts.term_counts(frame, max_terms=3).collect()}
    assert found == {g: (n, records[g]) for g, n in occurrences.items()}


def reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    return tokenizer


def test_ids_pieces_and_long_documents(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokenizer = reference_tokenizer()
    rows = documents.collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in rows}
    assert {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, sf_dir).collect()} == ids
    limits = {r.source: r.max_tokens for r in spark.read.parquet(f"{sf_dir}/piece_limits.parquet").collect()}
    wanted = {r.doc_id for r in rows if r.source in limits and len(ids[r.doc_id]) > limits[r.source]}
    assert {r.doc_id for r in QUERIES["p8_found"](spark, sf_dir).collect()} == wanted
    totals = Counter()
    for r in rows:
        totals[r.source] += len(ids[r.doc_id])
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet").collect()
    short = {(t.plan_id, t.source) for t in targets if t.max_repeats * totals[t.source] * 10_000 < t.total_tokens * t.share_bp}
    assert {tuple(r) for r in QUERIES["p7_found"](spark, sf_dir).collect()} == short


def test_forms_say_what_looks_the_same(spark, sf_dir):
    """Texts of the whole tables have one form exactly if they are a pair, and a form is its own form."""
    forms = {r.key: r.form for r in QUERIES["p3_forms"](spark, sf_dir).collect()}
    texts = {f"record:{r.record_id}": r.text for r in spark.read.parquet(f"{sf_dir}/records.parquet").collect()}
    texts |= {f"probe:{r.id}": r.text for r in spark.read.parquet(f"{sf_dir}/robustness_probes.parquet").collect()}
    groups = defaultdict(list)
    for key, form in forms.items():
        groups[form].append(key)
    wanted = {(x, y) for keys in groups.values() for x in keys for y in keys if x < y and texts[x] != texts[y]}
    assert {tuple(r) for r in QUERIES["p3_found"](spark, sf_dir).collect()} == wanted
    frame = spark.createDataFrame([(form, form) for form in groups], "key string, text string")
    bigrams = lookalike.train_bigrams(spark.createDataFrame([(t,) for t in texts.values()], "text string"))
    again = lookalike.consistent_forms(frame, bigrams=bigrams)
    assert [r for r in again.collect() if r.form != r.key] == []


def test_samples_and_their_report(spark, sf_dir):
    """Every target of the whole table draws what its report says, from rows of its split and label, each at most once."""
    records = {r.record_id: r for r in spark.read.parquet(f"{sf_dir}/records.parquet").collect()}
    drawn = QUERIES["p4_sample"](spark, sf_dir).collect()
    assert len({(r.plan_id, r.record_id) for r in drawn}) == len(drawn)
    assert all(records[r.record_id].source_split == r.source_split for r in drawn)
    counts = Counter((r.plan_id, r.source_split, r.category) for r in drawn)
    report = QUERIES["p4_report"](spark, sf_dir).collect()
    assert {(r.plan_id, r.source_split, r.category): r.drawn for r in report if r.drawn} == counts
    assert all(r.drawn <= r.available and r.met == (r.drawn >= r.needed) for r in report)
    assert all(r.drawn in (min(r.needed, r.available), min(r.needed + 1, r.available)) for r in report)


def test_mixes_and_their_shares(spark, sf_dir):
    """Each mix of the whole table has its size, keeps the repeats, and its shares are those of the documents used."""
    mixed = QUERIES["p7_mix"](spark, sf_dir).collect()
    targets = {(r.plan_id, r.source): r for r in spark.read.parquet(f"{sf_dir}/mix_targets.parquet").collect()}
    tokenizer, used, largest = reference_tokenizer(), Counter(), Counter()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        largest[r.source] = max(largest[r.source], len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))
    for r in mixed:
        assert 1 <= r.copies <= targets[r.plan_id, r.source].max_repeats
        used[r.plan_id, r.source] += r.copies * r.n_tokens
    shares = QUERIES["p7_shares"](spark, sf_dir).collect()
    short = {tuple(r) for r in QUERIES["p7_found"](spark, sf_dir).collect()}
    totals = Counter()
    for (plan, _), n in used.items():
        totals[plan] += n
    for r in shares:
        key = (r.plan_id, r.source)
        assert r.used_tokens == used[key] and abs(r.used_tokens - r.budget) <= largest[r.source]
        assert r.actual_bp == pytest.approx(10_000 * used[key] / totals[r.plan_id], abs=1e-4)
        wanted = targets[key].total_tokens * targets[key].share_bp / 10_000
        assert (r.budget < wanted - 1) == (key in short), (r, wanted)


def test_pieces_cover_their_documents(spark, sf_dir):
    """The pieces of every document of the whole table hold its text in order, the first from its begin and the last to its end."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = defaultdict(list)
    for r in sorted(QUERIES["p8_pieces"](spark, sf_dir).collect(), key=lambda r: (r.doc_id, r.piece)):
        found[r.doc_id].append(r.text)
    assert set(found) == {i for i, text in texts.items() if text}
    for i, parts in found.items():
        place = 0
        for part in parts:
            begin = texts[i].rfind(part, 0, place + len(part))
            assert 0 <= begin <= place
            place = max(place, begin + len(part))
        assert place == len(texts[i])
