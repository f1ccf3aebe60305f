"""The queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.structured import parse_outputs
from sievelight.functions.text import canonical_category, canonical_text, character_ngrams, comparison_text
from sievelight.operators import bootstrap, compare, dedup, features, metrics, near_duplicates, nearest, probes, requests, scope, split
from sievelight.operators.logistic import LinearClassifier
from sievelight.session import cut_lineage, stored, unsent, unstored
from sievelight.sources.readers import file_manifest
from sievelight.streaming.outputs import received_by_window

LEFT, RIGHT = "tfidf_logreg", "tuned_adapter"
#: Replicates of the queries that DuckDB repeats draw by draw, and of the full ones.
REPLICATES, FULL_REPLICATES, SEED = 200, 10_000, 42
#: Train records are compared in slices of so many, up to a number of slices.
SLICE_ROWS, MOST_SLICES = 100_000, 8

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").withColumn("category", canonical_category("category"))


def _train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).where("source_split = 'train'")


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "predictions"))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_class(_confusion(spark, sf_dir), table(spark, sf_dir, "routes"))


@query
def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split and label, with the number of labels, the least and the most."""
    return metrics.label_summary(_labelled(spark, sf_dir))


@query
def majority_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent labels of the train split."""
    return metrics.majority_labels(_train(spark, sf_dir))


@query
def majority_baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority label of the train split, scored on the test split."""
    tested = _labelled(spark, sf_dir).where("source_split = 'test' and category is not null")
    predicted = features.majority_predictions(tested, metrics.majority_labels(_train(spark, sf_dir)))
    matrix = metrics.confusion(predicted.withColumn("label_valid", F.lit(True)))
    return rounded(metrics.macro(matrix, table(spark, sf_dir, "routes")), "macro_precision", "macro_recall", "macro_f1", "accuracy")


@query
def canonical_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored forms of each label and their records."""
    stored = table(spark, sf_dir, "records").groupBy("category").agg(F.count("*").alias("records"))
    return stored.select("category", canonical_category("category").alias("label"), "records")


@query
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical and comparison text of each record."""
    return table(spark, sf_dir, "records").select("record_id", canonical_text("text").alias("canonical"), comparison_text("text").alias("comparison"))


@query
def character_ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold each three-character piece of the comparison text."""
    forms = table(spark, sf_dir, "records").select(comparison_text("text").alias("form"))
    pieces = forms.select(F.explode(character_ngrams("form")).alias("piece"))
    return pieces.groupBy("piece").agg(F.count("*").alias("records"))


@query
def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven counters of raw and canonical duplicates in records."""
    return dedup.duplicate_audit(_labelled(spark, sf_dir), label="category")


@query
def deduplicated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test records, and whether each is kept."""
    return dedup.deduplicate_preserving(table(spark, sf_dir, "records")).select("record_id", "source_split", "kept")


@query
def stratified_split_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train records of each label that become validation ones, at a share of 15 %."""
    return split.split_allocation(_train(spark, sf_dir), 1500)


@query
def stratified_split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each train record at a share of 15 %."""
    return split.stratified_split(_train(spark, sf_dir), 1500)


@query
def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of records of different splits."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "records"))


@query
def near_duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each record, and how many near-duplicates it has in other splits."""
    records = table(spark, sf_dir, "records")
    return near_duplicates.near_duplicate_links(stored(near_duplicates.near_duplicates(records)), records)


@query
def near_duplicate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate pairs counted by pair of splits."""
    records = _labelled(spark, sf_dir)
    return near_duplicates.near_duplicate_rollup(stored(near_duplicates.near_duplicates(records)), records)


@query
def near_duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split that have a near-duplicate."""
    return near_duplicates.flagged_records(stored(near_duplicates.near_duplicates(table(spark, sf_dir, "records"))))


@query
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of actual and predicted labels."""
    return _confusion(spark, sf_dir)


@query
def confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column for each label of the routes and the invalid outputs; the label list is bounded."""
    labels = [row.category for row in table(spark, sf_dir, "routes").select("category").distinct().orderBy("category").collect()]
    return metrics.wide_confusion(_confusion(spark, sf_dir), labels)


@query
def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and support of each label and approach."""
    return rounded(_classes(spark, sf_dir), "precision", "recall", "f1")


@query
def macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro means of each approach."""
    found = metrics.macro(_confusion(spark, sf_dir), table(spark, sf_dir, "routes"))
    return rounded(found, "macro_precision", "macro_recall", "macro_f1", "accuracy")


@query
def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent errors of each approach."""
    return metrics.top_confusions(_confusion(spark, sf_dir), 20)


@query
def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each of the 15 most frequent errors."""
    return metrics.error_examples(table(spark, sf_dir, "predictions"), metrics.top_confusions(_confusion(spark, sf_dir), 15))


@query
def lowest_f1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten labels of lowest F1 of each approach."""
    exact = metrics.lowest_f1(rounded(_classes(spark, sf_dir), "f1"))
    return exact.select("approach", "category", "f1", "support", "rank")


@query
def error_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by kind of each approach."""
    return metrics.error_totals(table(spark, sf_dir, "predictions"), _classes(spark, sf_dir))


@query
def structured_output_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid structured outputs of the approaches that have them."""
    found = metrics.output_rates(table(spark, sf_dir, "predictions"))
    return rounded(found, *(c for c in found.columns if c.endswith("_rate")))


@query
def structured_output_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stored raw output, read strictly."""
    outputs = table(spark, sf_dir, "predictions").where("raw_output is not null").select("approach", "row_index", "raw_output")
    return parse_outputs(outputs, "raw_output", table(spark, sf_dir, "routes")).select("approach", "row_index", "parsed.*")


@query
def prediction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each label is predicted."""
    return metrics.prediction_counts(table(spark, sf_dir, "predictions"))


@query
def prediction_alignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in which the two prediction sets disagree on what they predict for."""
    return compare.alignment_violations(table(spark, sf_dir, "predictions"), LEFT, RIGHT)


@query
def planted_alignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check with faults put in: rows of the second approach moved on, relabelled, changed and given twice."""
    rows = table(spark, sf_dir, "predictions")
    second, place = F.col("approach") == RIGHT, F.col("row_index")
    shifted = rows.withColumns(
        {
            "row_index": F.when(second & (place % 11 == 1), place + 1_000_000_000).otherwise(place),
            "actual": F.when(second & (place % 11 == 2), F.lit("other")).otherwise(F.col("actual")),
            "text": F.when(second & (place % 11 == 3), F.concat("text", F.lit(" "))).otherwise(F.col("text")),
            "correct": F.when(second & (place % 11 == 4), ~F.col("correct")).otherwise(F.col("correct")),
        }
    )
    return compare.alignment_violations(shifted.unionByName(shifted.where(second & (place % 11 == 5))), LEFT, RIGHT)


@query
def checkpoint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of the predictions, and rows in which they differ from the test records they were made for."""
    test = _labelled(spark, sf_dir).where("source_split = 'test'")
    first = test.groupBy(F.col("source_index").alias("row_index")).agg(F.min_by(F.struct("text", F.col("category").alias("actual")), "record_id").alias("r"))
    return compare.checkpoint_violations(table(spark, sf_dir, "predictions"), first.select("row_index", "r.*"))


@query
def support_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the predictions whose support isn't the usual one."""
    return compare.support_violations(table(spark, sf_dir, "predictions"))


@query
def correctness_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that both, one or none of the approaches have right, and their accuracies."""
    return rounded(compare.correctness_overlap(table(spark, sf_dir, "predictions"), LEFT, RIGHT), "left_accuracy", "right_accuracy")


@query
def outcome_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each outcome and label."""
    return compare.outcome_examples(table(spark, sf_dir, "predictions"), LEFT, RIGHT)


@query
def showcase_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each outcome, with distinct labels."""
    return compare.showcase_examples(table(spark, sf_dir, "predictions"), LEFT, RIGHT)


@query
def class_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of both approaches for each label, and the ranks of the advantages."""
    found = compare.class_comparison(rounded(_classes(spark, sf_dir), "f1"), LEFT, RIGHT, 5e-7)
    return rounded(found.drop("left_rank", "right_rank"), "difference")


@query
def largest_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten labels of largest advantage each way, by the rounded difference."""
    found = compare.class_comparison(_classes(spark, sf_dir), LEFT, RIGHT)
    return compare.largest_advantages(rounded(found, "difference"), 10)


@query
def approach_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approaches by macro F1."""
    return compare.ranking(macro_metrics(spark, sf_dir)).select("approach", "macro_f1", "accuracy", "rank")


def _replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = bootstrap.outcome_cells(table(spark, sf_dir, "predictions"), [LEFT, RIGHT])
    # Read four times by the scores; as large as replicates x pairs of labels.
    counts = bootstrap.replicate_counts(cells, [LEFT, RIGHT], REPLICATES, SEED).persist()
    return bootstrap.replicate_metrics(counts, table(spark, sf_dir, "routes"))


def _differences(spark: SparkSession, sf_dir: str, replicates: DataFrame) -> DataFrame:
    points = metrics.macro(_confusion(spark, sf_dir), table(spark, sf_dir, "routes"))
    return rounded(bootstrap.paired_differences(replicates, points, LEFT, RIGHT), "difference", "low", "high")


@query
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % intervals of accuracy and macro F1 by stratified bootstrap."""
    return rounded(bootstrap.intervals(_replicates(spark, sf_dir)), "low", "high")


@query
def paired_difference_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % intervals of the differences of the approaches on the same replicates."""
    return _differences(spark, sf_dir, _replicates(spark, sf_dir))


def _full_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = bootstrap.outcome_cells(table(spark, sf_dir, "predictions"), [LEFT, RIGHT])
    return bootstrap.multinomial_metrics(cells, table(spark, sf_dir, "routes"), [LEFT, RIGHT], FULL_REPLICATES, SEED)


@query
def bootstrap_ci_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bootstrap_ci`` from 10,000 replicates."""
    return rounded(bootstrap.intervals(_full_replicates(spark, sf_dir)), "low", "high")


@query
def paired_difference_ci_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paired_difference_ci`` from 10,000 replicates."""
    return _differences(spark, sf_dir, _full_replicates(spark, sf_dir))


@query
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer of the service to each predicted row, where the model reads 120 characters."""
    found = requests.classify_requests(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "routes"), readable=120)
    return found.select("approach", "row_index", "status_code", "category", "priority", "team", "routing_policy")


@query
def route_coverage_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of records whose routes break a rule."""
    return requests.route_violations(table(spark, sf_dir, "routes"), _labelled(spark, sf_dir).select("category").distinct())


@query
def planted_route_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check with the routes of labels from m on left out, and those up to c spoilt."""
    routes = table(spark, sf_dir, "routes").where("category < 'm'").withColumns(
        {"priority": F.when(F.col("category") < "b", "soon").otherwise(F.col("priority")), "team": F.when(F.col("category") >= "c", F.col("team"))}
    )
    every = routes.unionByName(routes.where("category < 'd'")).unionByName(routes.where("category < 'c'").withColumn("category", F.concat(F.lit("no_"), "category")))
    return requests.route_violations(every, _labelled(spark, sf_dir).select("category").distinct())


@query
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the train and validation records, in order."""
    records = _labelled(spark, sf_dir)
    return requests.label_names(records.where("source_split = 'train'"), records.where("source_split = 'validation'"))


@query
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests accepted or refused by split; documents' texts reach the limit."""
    records = table(spark, sf_dir, "records").select(F.lit("records").alias("origin"), "text")
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text")
    status = requests.request_status(F.col("text")).alias("status")
    return records.unionByName(documents).groupBy("origin", status).agg(F.count("*").alias("requests"))


@query
def agent_assist_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions by status for each approach."""
    found = requests.suggestions(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "routes"))
    return found.groupBy("approach", "suggestion_status").agg(F.count("*").alias("records"), F.count("suggested").alias("suggested"))


@query
def prompt_render_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruction with all labels, and its SHA-256."""
    return requests.instruction(_labelled(spark, sf_dir))


@query
def sequence_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the texts of each split."""
    return metrics.nearest_rank_summary(table(spark, sf_dir, "records").withColumn("length", F.length("text")), "length", "source_split")


@query
def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds from receipt to ingestion for each source, interpolated, and records a second from first to last."""
    seconds = F.expr("floor((unix_micros(ingested_at) - unix_micros(received_at)) / 1000000)")
    rows = table(spark, sf_dir, "records").withColumn("seconds", seconds)
    found = metrics.interpolated_percentiles(rows, "seconds", "source", {"p50": 0.5, "p95": 0.95})
    speed = metrics.throughput(rows, "received_at", "ingested_at", "source")
    joined = found.join(speed, F.col("source").eqNullSafe(F.col("by"))).drop("by")
    return rounded(joined, "p50", "p95").withColumn("per_second", F.round("per_second", 9))


@query
def received_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each day and source."""
    return received_by_window(table(spark, sf_dir, "records"))


@query
def probe_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the probes break."""
    return probes.probe_violations(table(spark, sf_dir, "robustness_probes"), table(spark, sf_dir, "routes"), "project_made_synthetic")


@query
def planted_probe_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same check, also on the size of groups, on probes that are spoilt by the number in their id."""
    spoilt, given = F.right("id", F.lit(3)).cast("int") % 9, table(spark, sf_dir, "robustness_probes")
    changes = {
        "probe_group": F.when(spoilt == 0, F.lit("medium")).otherwise(F.col("probe_group")),
        "text": F.when(spoilt == 1, F.lit(" \u2003")).otherwise(F.col("text")),
        "source": F.when(spoilt == 2, F.lit("web")).otherwise(F.col("source")),
        "expected_category": F.when(spoilt == 3, F.lit(None)).when(spoilt == 4, F.lit("nothing")).otherwise(F.col("expected_category")),
        "acceptable_categories": F.when(spoilt == 5, F.array(F.lit("nothing"))).when(spoilt == 6, F.array().cast("array<string>")).otherwise(F.col("acceptable_categories")),
    }
    rows = given.withColumns(changes)
    return probes.probe_violations(rows.unionByName(rows.where(spoilt == 7)), table(spark, sf_dir, "routes"), "project_made_synthetic", per_group=200)


def _word_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each probe the label most words of whose name it holds; null without any."""
    words = table(spark, sf_dir, "routes").select("category", F.explode(F.array_distinct(F.split("category", "_"))).alias("word"))
    own = F.regexp_extract_all(features.without_accents(F.col("text")), F.lit(features.WORDS), F.lit(0))
    held = table(spark, sf_dir, "robustness_probes").select("id", F.explode(F.array_distinct(own)).alias("word"))
    votes = held.join(words, "word").groupBy("id", "category").agg(F.count("*").alias("n"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("best"))
    return table(spark, sf_dir, "robustness_probes").select("id").join(best, "id", "left").select("id", F.col("best.category").alias("predicted"))


def _scored_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "robustness_probes")
    chosen = F.broadcast(metrics.majority_labels(_train(spark, sf_dir)).where("chosen").select(F.col("label").alias("predicted")))
    majority = given.select("id", F.lit("majority").alias("approach")).crossJoin(chosen).withColumn("label_valid", F.lit(True))
    voted = _word_votes(spark, sf_dir).select("id", F.lit("word_votes").alias("approach"), "predicted", F.col("predicted").isNotNull().alias("label_valid"))
    return probes.scored_probes(given, majority.unionByName(voted))


@query
def robustness_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the majority label and of votes by label words, for each group of probes."""
    return rounded(probes.probe_scores(_scored_probes(spark, sf_dir)), "success_rate")


@query
def failed_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes on which the majority label or the votes miss what their group asks for."""
    return probes.failed_probes(_scored_probes(spark, sf_dir))


@query
def probe_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the votes name each probe's label; null for probes out of scope, which have none."""
    rows = table(spark, sf_dir, "robustness_probes").join(_word_votes(spark, sf_dir), "id")
    known = tuple(g for g in probes.GROUPS if g != scope.UNKNOWN)
    side = scope.scope_of(F.col("probe_group"), known)
    right = F.array_contains("acceptable_categories", F.col("predicted"))
    return rows.select("id", side.alias("scope"), scope.category_correct(side, right).alias("category_correct"))


def _train_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Term frequencies of the train records, and the inverse frequencies of their terms."""
    train = table(spark, sf_dir, "records").where("source_split = 'train'")
    counts = features.term_frequencies(train, "record_id")
    return counts, features.inverse_frequencies(counts, train)


@query
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF weights of words and pairs of words of the train records."""
    return rounded(features.tfidf_weights(*_train_terms(spark, sf_dir)), "weight")


def _trained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The texts of the train records, by id, and the inverse frequencies of their terms, both stored."""
    train = table(spark, sf_dir, "records").where("source_split = 'train'")
    texts = stored(nearest.texts_by_id(train, "record_id"))
    return texts, nearest.inverse_frequencies(texts, train.count())


def _cosines(spark: SparkSession, train: tuple[DataFrame, DataFrame], rows: DataFrame, key: str) -> DataFrame:
    """``id, cosine`` of each row with the nearest of the train records of :func:`_trained`."""
    return stored(nearest.nearest_cosine(nearest.texts_by_id(rows, key), *train))


def _probe_cosines(spark: SparkSession, sf_dir: str, train: tuple[DataFrame, DataFrame]) -> DataFrame:
    given = table(spark, sf_dir, "robustness_probes")
    found = given.select("id").join(_cosines(spark, train, given, "id"), "id", "left")
    return found.select("id", F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"))


@query
def nearest_training_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each probe the cosine with the nearest train record, 0 where none shares a term."""
    return _probe_cosines(spark, sf_dir, _trained(spark, sf_dir))


def _split_scope(rows: DataFrame) -> DataFrame:
    """Probes with their scope, half of each group for calibration."""
    known = F.when(F.col("probe_group") == scope.UNKNOWN, scope.UNKNOWN).otherwise(scope.KNOWN)
    return split.first_positions(rows.withColumn("scope", known), "probe_group", ["id"], 100)


def _scope_rows(spark: SparkSession, sf_dir: str, train: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    given = table(spark, sf_dir, "robustness_probes").select("id", "probe_group")
    scored = given.join(_probe_cosines(spark, sf_dir, train or _trained(spark, sf_dir)), "id").join(_word_votes(spark, sf_dir), "id")
    rows = scored.select("id", "probe_group", F.col("cosine").alias("score"), F.col("predicted").isNotNull().alias("label_valid"))
    return _split_scope(rows.persist()).persist()


def _calibrated(spark: SparkSession, sf_dir: str, train: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    rows = _scope_rows(spark, sf_dir, train)
    return rows, scope.threshold_search(rows.where("part = 'calibration'"))


@query
def calibration_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred probes of each group are for calibration."""
    rows = table(spark, sf_dir, "robustness_probes").select("id", "probe_group")
    return split.first_positions(rows, "probe_group", ["id"], 100)


@query
def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of the cosine with what lies below them."""
    rows = _scope_rows(spark, sf_dir).where("part = 'calibration'")
    return scope.threshold_candidates(rows).withColumn("threshold", F.round("threshold", 7))


@query
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold of the cosine on the calibration probes."""
    rows = _scope_rows(spark, sf_dir).where("part = 'calibration'")
    return rounded(scope.threshold_search(rows), "balanced_accuracy").withColumn("threshold", F.round("threshold", 7))


@query
def decision_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the held-out probes under the frozen threshold, in all and by group."""
    rows, found = _calibrated(spark, sf_dir)
    return scope.decision_counts(scope.decisions(rows.where("part = 'held_out'"), found))


@query
def decision_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection rates of the held-out probes."""
    rows, found = _calibrated(spark, sf_dir)
    return rounded(scope.decision_rates(scope.decisions(rows.where("part = 'held_out'"), found)), "unknown_rejection_rate", "known_false_rejection_rate")


@query
def external_scope_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected held-out probes of each group."""
    rows, found = _calibrated(spark, sf_dir)
    return scope.external_counts(scope.decisions(rows.where("part = 'held_out'"), found))


@query
def external_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two probes of each group."""
    found = split.first_rows(table(spark, sf_dir, "robustness_probes"), ["probe_group"], ["id"], 2)
    return found.select("probe_group", "id", "place")


@query
def rejection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen threshold on test rows: the stated queries are those whose record id is divisible by 100."""
    train = _trained(spark, sf_dir)
    found = stored(_calibrated(spark, sf_dir, train)[1])
    tested = table(spark, sf_dir, "predictions").where("record_id % 100 = 0")
    cosines = _cosines(spark, train, tested.select("record_id", "text").dropDuplicates(["record_id"]), "record_id")
    scored = tested.join(cosines.withColumnRenamed("id", "record_id"), "record_id", "left").withColumns(
        {"score": F.round(F.coalesce("cosine", F.lit(0.0)), 6), "scope": F.lit(scope.KNOWN)}
    )
    return rounded(scope.rejection_audit(scope.decisions(scored, found)), "rejected_rate", "accepted_accuracy")


@query
def report_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed totals of each approach, and whether they agree with each other."""
    return compare.report_consistency(table(spark, sf_dir, "predictions"), table(spark, sf_dir, "routes"))


def _classifier(spark: SparkSession, sf_dir: str) -> tuple[LinearClassifier, DataFrame, int]:
    """The logistic regression on the TF-IDF of the train records, its terms and their number.

    Train records are stored once with their labels and come in slices, whose shuffle files go before the next.
    """
    labelled = _labelled(spark, sf_dir).where("source_split = 'train' and category is not null")
    train = stored(labelled.select(F.col("record_id").alias("id"), "text", "category"))
    # Stored, as the numbers of terms are worked out from two readings.
    idf = stored(features.inverse_frequencies(features.term_frequencies(train, "id"), train))
    terms = stored(features.numbered_terms(idf))
    size = max(1, terms.count())
    slices = min(MOST_SLICES, train.count() // SLICE_ROWS + 1)

    def parts() -> Iterator[DataFrame]:
        for number in range(slices):
            given = train.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == number)
            rows = features.tfidf_rows(features.term_frequencies(given, "id"), unsent(terms), "slot")
            yield features.vectors(rows, unsent(given), size, "category")
        # All slices have been read: what they were made of makes room for the fit.
        unstored(train)
        unstored(idf)

    labels = [r.category for r in train.select("category").distinct().collect()]
    return features.fit_logistic(parts(), size=size, labels=labels), terms, size


def _classified(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str) -> DataFrame:
    """``id, predicted, probability`` of every row by the classifier."""
    model, terms, size = _classifier(spark, sf_dir)
    own = features.tfidf_rows(features.term_frequencies(rows, key), unsent(terms), "slot")
    return features.logistic_predictions(model, features.vectors(own, rows.select(F.col(key).alias("id")), size))


@query
def logreg_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and probabilities of the test records by logistic regression on the TF-IDF of the train records."""
    return _classified(spark, sf_dir, table(spark, sf_dir, "records").where("source_split = 'test'"), "record_id")


def _classified_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "robustness_probes")
    return given.join(_classified(spark, sf_dir, given, "id"), "id")


@query
def classifier_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the fitted classifier for each group of probes."""
    found = _classified_probes(spark, sf_dir).select("id", F.lit("tfidf_logreg").alias("approach"), "predicted")
    return rounded(probes.probe_scores(probes.scored_probes(table(spark, sf_dir, "robustness_probes"), found)), "success_rate")


@query
def probability_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold of the classifier's greatest probability on the calibration probes, and the rates of the held-out ones."""
    scored = _classified_probes(spark, sf_dir).select("id", "probe_group", F.round("probability", 6).alias("score"), F.lit(True).alias("label_valid"))
    # The rows are read seven times. Their past would be in the plan as often, and in each of its updates on the driver.
    rows = cut_lineage(_split_scope(cut_lineage(scored)))
    found = scope.threshold_search(rows.where("part = 'calibration'"))
    rates = scope.decision_rates(scope.decisions(rows.where("part = 'held_out'"), found))
    return rounded(found.crossJoin(F.broadcast(rates)), "balanced_accuracy", "unknown_rejection_rate", "known_false_rejection_rate")


@query
def table_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of all files of the tables, named by their path below the folder."""
    return file_manifest(spark, sf_dir).select(F.substring_index("path", f"{sf_dir.rstrip('/')}/", -1).alias("name"), "bytes", "sha256")
