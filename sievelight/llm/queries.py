"""Queries over the given tables, one or more for each problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe_automaton, copies, lookalike, mixing, overlap, pieces, quota_sample, term_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of the train split and of another that are the same or nearly the same."""
    pairs = overlap.overlap_pairs(_table(spark, sf_dir, "records"))
    return pairs.select(
        F.least("held_out_id", "train_id").alias("left_id"), F.greatest("held_out_id", "train_id").alias("right_id")
    )


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps counted by held-out split and source."""
    return overlap.overlap_report(_table(spark, sf_dir, "records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of one word that are too rare or too common."""
    terms = term_counts.marked_terms(_table(spark, sf_dir, "records"))
    return terms.where("mark is not null").select("term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every word, with its mark."""
    return term_counts.marked_terms(_table(spark, sf_dir, "records")).select("term", "occurrences", "records", "mark")


def p2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every sequence of one to three words, with its mark."""
    return term_counts.marked_terms(_table(spark, sf_dir, "records"), max_terms=3)


def _visible_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "records").select(F.concat(F.lit("record:"), F.col("record_id").cast("string")).alias("key"), "text")
    probes = _table(spark, sf_dir, "robustness_probes").select(F.concat(F.lit("probe:"), F.col("id")).alias("key"), "text")
    return records.unionByName(probes)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of texts of records and probes that look the same but differ in a character."""
    return lookalike.lookalike_pairs(_visible_texts(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of each text of records and probes that shows something."""
    return lookalike.consistent_forms(_visible_texts(spark, sf_dir)).select("key", "form")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of sampling plans of which the quota table yields fewer rows than they need."""
    report = quota_sample.sample_report(_table(spark, sf_dir, "records"), _table(spark, sf_dir, "sample_targets"))
    return report.where("not met").select("plan_id", "category").distinct()


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records drawn for each sampling plan."""
    return quota_sample.draw_sample(_table(spark, sf_dir, "records"), _table(spark, sf_dir, "sample_targets"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows wanted, available and drawn for each target of the sampling plans."""
    return quota_sample.sample_report(_table(spark, sf_dir, "records"), _table(spark, sf_dir, "sample_targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records that are copies of one with a smaller id."""
    return copies.copies(_table(spark, sf_dir, "raw_records"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record for each group of copies, with their number."""
    return copies.collapsed(_table(spark, sf_dir, "raw_records"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe_automaton.encode_texts(_table(spark, sf_dir, "documents"))


def _mix_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.sized_documents(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "mix_targets")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose weight in a mix the allowed repeats clip below its share."""
    sized = bpe_automaton.count_tokens(_table(spark, sf_dir, "documents"), ["source"])
    budgets = mixing.mix_budgets(_table(spark, sf_dir, "mix_targets"), mixing.source_tokens(sized))
    return budgets.where("clipped").select("plan_id", "source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mix uses each document."""
    sized, targets = _mix_inputs(spark, sf_dir)
    return mixing.mix(sized, mixing.mix_budgets(targets, mixing.source_tokens(sized)))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual tokens and shares of each mix and source."""
    sized, targets = _mix_inputs(spark, sf_dir)
    budgets = mixing.mix_budgets(targets, mixing.source_tokens(sized))
    return mixing.mix_report(mixing.mix(sized, budgets), budgets)


def _pieces(spark: SparkSession, sf_dir: str, cut_only: bool) -> DataFrame:
    return pieces.split_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "piece_limits"), cut_only=cut_only)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: those with a second piece."""
    return _pieces(spark, sf_dir, True).where("piece = 2").select("doc_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document."""
    return _pieces(spark, sf_dir, False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found,
        p1_report,
        p2_found,
        p2_terms,
        p2_ngrams,
        p3_found,
        p3_forms,
        p4_found,
        p4_sample,
        p4_report,
        p5_found,
        p5_groups,
        p6_ids,
        p7_found,
        p7_mix,
        p7_shares,
        p8_found,
        p8_pieces,
    )
}
