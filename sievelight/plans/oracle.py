"""SQL for DuckDB that gives the same rows as the queries.

DuckDB has no NFKC: the SQL writes out its rules for width forms, blanks and ligatures, the only characters of the
tables on which they differ from NFC. The logistic regression, the full bootstrap and file lists have no SQL; they are
tested against brute force.
"""

from sievelight.operators.requests import INSTRUCTION

REPLICATES = 200


def _composed(text: str) -> str:
    """Width forms, blanks and ligatures as NFKC gives them."""
    chars = f"""array_to_string(list_transform(string_split({text}, ''), lambda c: CASE
      WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248)
      WHEN unicode(c) IN (160, 8199, 8239, 8287, 12288) OR unicode(c) BETWEEN 8192 AND 8202 THEN ' ' ELSE c END), '')"""
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")):
        chars = f"replace({chars}, '{ligature}', '{letters}')"
    return f"nfc_normalize({chars})"


def _folded(text: str) -> str:
    return f"replace(replace(lower({_composed(text)}), 'ß', 'ss'), 'ς', 'σ')"


def _canonical(text: str) -> str:
    return rf"trim(regexp_replace({_folded(text)}, '[\s\p{{Z}}\x{{0b}}\x{{85}}\x{{1c}}-\x{{1f}}]+', ' ', 'g'))"


def _compared(text: str) -> str:
    return f"trim(regexp_replace({_folded(text)}, '[^a-z0-9]+', ' ', 'g'))"


def _pieces(form: str) -> str:
    """The set of three-character pieces of a comparison text."""
    return f"list_distinct(list_transform(range(1, greatest(1, length({form})) + 1), lambda i: substr(' ' || {form} || ' ', i, 3)))"


def _words(text: str) -> str:
    """Words without accents; marks that don't combine, which ``strip_accents`` would delete, separate words."""
    plain = rf"regexp_replace({_composed(text)}, '[\x{{34f}}\x{{fe00}}-\x{{fe0f}}]', ' ', 'g')"
    return rf"regexp_extract_all(strip_accents(lower({plain})), '[\p{{L}}\p{{N}}_]{{2,}}')"


_STRIP = r"regexp_replace(text, '^[\s\p{Z}\x{85}\x{1c}-\x{1f}]+|[\s\p{Z}\x{85}\x{1c}-\x{1f}]+$', '', 'g')"

_LABELLED = """
labelled AS (
  SELECT * EXCLUDE (category), trim(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '_') AS category FROM records
)"""

_CONFUSION = """
shown AS (
  SELECT approach, row_index, text, actual, correct, label_valid,
         CASE WHEN coalesce(label_valid, true) AND predicted IS NOT NULL THEN predicted ELSE '__invalid_output__' END AS predicted
  FROM predictions
),
matrix AS (SELECT approach, actual, predicted, count(*) AS n FROM shown GROUP BY ALL)"""


def _scores(matrix: str, by: str, mark: str = "") -> str:
    """Scores of each label of the routes from a long confusion table; ``mark`` tells two sets of scores apart."""
    return f"""
{mark}support AS (SELECT {by}, actual AS category, sum(n)::BIGINT AS support FROM {matrix} GROUP BY ALL),
{mark}claimed AS (
  SELECT {by}, predicted AS category, sum(n)::BIGINT AS claimed, coalesce(sum(n) FILTER (actual = predicted), 0)::BIGINT AS hits
  FROM {matrix} GROUP BY ALL
),
{mark}counted AS (
  SELECT g.*, l.category, coalesce(support, 0)::BIGINT AS support, coalesce(claimed, 0)::BIGINT AS claimed, coalesce(hits, 0)::BIGINT AS hits
  FROM (SELECT DISTINCT {by} FROM {matrix}) g CROSS JOIN (SELECT DISTINCT category FROM routes) l
  LEFT JOIN {mark}support USING ({by}, category) LEFT JOIN {mark}claimed USING ({by}, category)
),
{mark}ratios AS (
  SELECT *, coalesce(hits / nullif(claimed, 0)::DOUBLE, 0) AS precision, coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall FROM {mark}counted
),
{mark}classes AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM {mark}ratios),
{mark}macros AS (
  SELECT {by}, total, correct, macro_precision, macro_recall, macro_f1, correct / total::DOUBLE AS accuracy
  FROM (SELECT {by}, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (actual = predicted), 0)::BIGINT AS correct FROM {matrix} GROUP BY ALL)
  JOIN (SELECT {by}, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1 FROM {mark}classes GROUP BY ALL) USING ({by})
)"""


_CLASSES = f"{_CONFUSION}, {_scores('matrix', 'approach')}"
_MACRO_COLUMNS = """approach, total, correct, round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
  round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy"""

_MAJORITY = """
counts AS (SELECT category AS label, count(*) AS records FROM labelled WHERE source_split = 'train' AND category IS NOT NULL GROUP BY ALL),
tied AS (SELECT label, records, label = min(label) OVER () AS chosen FROM counts WHERE records = (SELECT max(records) FROM counts))"""

_PAIRED = """
one AS (SELECT * FROM predictions WHERE approach = 'tfidf_logreg'),
two AS (SELECT * FROM predictions WHERE approach = 'tuned_adapter'),
paired AS (
  SELECT row_index, one.actual, coalesce(one.correct, false) AS a, coalesce(two.correct, false) AS b
  FROM one JOIN two USING (row_index)
)"""

_COMPARED = """
compared AS (
  SELECT a.category, a.f1 AS left_f1, b.f1 AS right_f1, a.f1 - b.f1 AS difference
  FROM classes a JOIN classes b ON a.category = b.category AND a.approach = 'tfidf_logreg' AND b.approach = 'tuned_adapter'
)"""


def _number(text: str) -> str:
    return f"cast(concat('0x', substr(md5({text}), 1, 13)) AS BIGINT)"


_SPLIT = f"""
counts AS (SELECT category, count(*) AS records FROM labelled WHERE source_split = 'train' AND category IS NOT NULL GROUP BY ALL),
parts AS (SELECT *, records * 1500 // 10000 AS low, records * 1500 % 10000 AS rest FROM counts),
missing AS (SELECT round_even(sum(records) * 1500 / 10000.0, 0)::BIGINT - sum(low)::BIGINT AS missing FROM parts),
quotas AS (
  SELECT category, records,
         (low + (row_number() OVER (ORDER BY rest DESC, {_number("concat('42:', category)")}, category) <= missing)::INT)::BIGINT AS quota
  FROM parts, missing
)"""

_BOOTSTRAP = f"""
{_CONFUSION},
aligned AS (
  SELECT actual, row_index, max(predicted) FILTER (approach = 'tfidf_logreg') AS p0, max(predicted) FILTER (approach = 'tuned_adapter') AS p1
  FROM shown GROUP BY actual, row_index HAVING p0 IS NOT NULL AND p1 IS NOT NULL
),
slots AS (
  SELECT *, row_number() OVER (PARTITION BY actual ORDER BY p0, p1, row_index) - 1 AS slot, count(*) OVER (PARTITION BY actual) AS support FROM aligned
),
draws AS (
  SELECT r.replicate, s.actual, {_number("concat('42:', r.replicate, ':', s.actual, ':', s.slot)")} % s.support AS slot
  FROM range({REPLICATES}) r(replicate) CROSS JOIN slots s
),
drawn AS (SELECT d.replicate, d.actual, s.p0, s.p1 FROM draws d JOIN slots s USING (actual, slot)),
sampled AS (
  SELECT replicate || '|tfidf_logreg' AS key, actual, p0 AS predicted, count(*) AS n FROM drawn GROUP BY ALL
  UNION ALL SELECT replicate || '|tuned_adapter', actual, p1, count(*) FROM drawn GROUP BY ALL
),
{_scores("sampled", "key")},
long AS (
  SELECT split_part(key, '|', 1) AS replicate, split_part(key, '|', 2) AS approach, 'accuracy' AS metric, accuracy AS value FROM macros
  UNION ALL SELECT split_part(key, '|', 1), split_part(key, '|', 2), 'macro_f1', macro_f1 FROM macros
)"""

_TERMS = f"""
train AS (SELECT record_id AS id, text FROM records WHERE source_split = 'train'),
train_words AS (SELECT id, {_words("text")} AS w FROM train WHERE text IS NOT NULL),
train_terms AS (
  SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM train_words
),
train_tf AS (SELECT id, term, count(*) AS tf FROM train_terms GROUP BY ALL),
idf AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM train)) / (1.0 + count(*))) + 1.0 AS idf FROM train_tf GROUP BY term HAVING count(*) >= 2
),
raw AS (SELECT id, term, (1.0 + ln(tf)) * idf AS raw FROM train_tf JOIN idf USING (term)),
weights AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


def _cosines(rows: str, mark: str = "") -> str:
    """``nearest``: the cosine of each ``id`` of the given rows; ``mark`` tells two sets of rows apart."""
    return f"""
own{mark} AS ({rows}),
own_words{mark} AS (SELECT id, {_words("text")} AS w FROM own{mark} WHERE text IS NOT NULL),
own_terms{mark} AS (
  SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM own_words{mark}
),
own_raw{mark} AS (
  SELECT id, term, (1.0 + ln(tf)) * idf AS raw FROM (SELECT id, term, count(*) AS tf FROM own_terms{mark} GROUP BY ALL) JOIN idf USING (term)
),
own_weights{mark} AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM own_raw{mark}),
dots{mark} AS (
  SELECT o.id, t.id AS other, sum(o.weight * t.weight) AS dot FROM own_weights{mark} o JOIN weights t USING (term) GROUP BY ALL
),
nearest{mark} AS (SELECT o.id, round(coalesce(max(dot), 0.0), 6) AS cosine FROM own{mark} o LEFT JOIN dots{mark} USING (id) GROUP BY o.id)"""


_VOTES = f"""
label_words AS (SELECT category, unnest(list_distinct(string_split(category, '_'))) AS word FROM routes),
probe_words AS (SELECT id, unnest(list_distinct({_words("text")})) AS word FROM robustness_probes),
votes AS (SELECT id, category, count(*) AS n FROM probe_words JOIN label_words USING (word) GROUP BY ALL),
voted AS (
  SELECT p.id, v.category AS predicted FROM robustness_probes p
  LEFT JOIN (SELECT id, category FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, category) = 1) v USING (id)
)"""

_SCOPE = f"""
{_TERMS}, {_cosines("SELECT id, text FROM robustness_probes")}, {_VOTES},
scope_rows AS (
  SELECT id, probe_group, CASE WHEN probe_group = 'out_of_scope' THEN 'out_of_scope' ELSE 'in_scope' END AS scope,
         cosine AS score, predicted IS NOT NULL AS label_valid,
         CASE WHEN row_number() OVER (PARTITION BY probe_group ORDER BY id) <= 100 THEN 'calibration' ELSE 'held_out' END AS part
  FROM robustness_probes JOIN nearest USING (id) JOIN voted USING (id)
),
calibration AS (SELECT * FROM scope_rows WHERE part = 'calibration'),
values_ AS (SELECT DISTINCT score AS value FROM calibration),
thresholds AS (
  SELECT min(value) - 1.0 AS threshold FROM values_
  UNION ALL SELECT coalesce((value + lead(value) OVER (ORDER BY value)) / 2, value + 1.0) FROM values_
),
candidates AS (
  SELECT threshold, count(*) FILTER (score < threshold AND label_valid AND scope = 'in_scope') AS known_below,
         count(*) FILTER (score < threshold AND label_valid AND scope = 'out_of_scope') AS unknown_below,
         count(*) FILTER (scope = 'in_scope') AS known, count(*) FILTER (scope = 'out_of_scope') AS unknown,
         count(*) FILTER (scope = 'in_scope' AND (NOT label_valid OR score < threshold)) AS known_rejected,
         count(*) FILTER (scope = 'out_of_scope' AND (NOT label_valid OR score < threshold)) AS unknown_rejected
  FROM thresholds CROSS JOIN calibration GROUP BY threshold
),
ranked AS (SELECT *, (unknown_rejected / unknown::DOUBLE + (known - known_rejected) / known::DOUBLE) / 2 AS balanced_accuracy FROM candidates),
best AS (SELECT * FROM ranked ORDER BY balanced_accuracy DESC, known_rejected, unknown_rejected DESC, threshold DESC LIMIT 1),
decided AS (
  SELECT s.*, (NOT s.label_valid OR s.score < b.threshold) AS rejected FROM scope_rows s CROSS JOIN best b WHERE s.part = 'held_out'
),
outcomes AS (
  SELECT *, (CASE WHEN scope = 'out_of_scope' THEN 'unknown_' ELSE 'known_' END) || (CASE WHEN rejected THEN 'rejected' ELSE 'accepted' END) AS outcome
  FROM decided
)"""

_PROBED = """
given AS (
  SELECT p.*, 'majority' AS approach, (SELECT label FROM tied WHERE chosen) AS predicted, true AS label_valid FROM robustness_probes p
  UNION ALL SELECT p.*, 'word_votes', v.predicted, v.predicted IS NOT NULL FROM robustness_probes p JOIN voted v USING (id)
),
probed AS (
  SELECT *, coalesce(lower(predicted) IN ('cannot_classify', 'out_of_scope', 'unknown', 'unsupported_request'), false) AS explicit_unknown,
         CASE WHEN probe_group IN ('short', 'long') THEN label_valid AND coalesce(predicted = expected_category, false)
              WHEN probe_group = 'ambiguous' THEN label_valid AND coalesce(list_contains(acceptable_categories, predicted), false)
              ELSE coalesce(lower(predicted) IN ('cannot_classify', 'out_of_scope', 'unknown', 'unsupported_request'), false) END AS success
  FROM given
)"""

FORMS = f"""
forms AS (
  SELECT record_id AS id, source_split AS split, trim(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '_') AS label, category AS stored, {_compared("text")} AS form
  FROM records WHERE text IS NOT NULL AND source_split IN ('train', 'validation', 'test')
),
classes AS (SELECT split, form, min(id) AS class_id, count(*) AS n FROM forms WHERE form <> '' GROUP BY ALL)"""

#: Texts at a Dice similarity of 0.9 share a piece among the rarest of each: all but 9/11 of its pieces, and one.
SIMILAR = f"""
sets AS MATERIALIZED (SELECT form, {_pieces("form")} AS pieces FROM (SELECT DISTINCT form FROM classes)),
posts AS (SELECT form, len(pieces) AS size, unnest(pieces) AS piece FROM sets),
rare AS MATERIALIZED (
  SELECT form, size, piece FROM posts JOIN (SELECT piece, count(*) AS df FROM posts GROUP BY piece) USING (piece)
  QUALIFY row_number() OVER (PARTITION BY form ORDER BY df, piece) <= size - ceil(size * 9 / 11.0) + 1
),
candidates AS MATERIALIZED (
  SELECT DISTINCT a.form AS f, b.form AS g FROM rare a JOIN rare b USING (piece) WHERE a.form < b.form AND 2.0 * least(a.size, b.size) / (a.size + b.size) >= 0.9
),
alike AS MATERIALIZED (
  SELECT f, g, 2.0::DOUBLE * len(list_intersect(a.pieces, b.pieces)) / (len(a.pieces) + len(b.pieces)) AS similarity
  FROM candidates JOIN sets a ON a.form = f JOIN sets b ON b.form = g
)"""

_NEAR = f"""
{FORMS}, {SIMILAR},
sides(split, place) AS (VALUES ('train', 1), ('validation', 2), ('test', 3)),
both_ways AS (SELECT f, g, similarity FROM alike UNION ALL SELECT g, f, similarity FROM alike),
pairs AS MATERIALIZED (
  SELECT a.split AS left_split, b.split AS right_split, a.class_id AS left_id, b.class_id AS right_id, a.n AS left_records, b.n AS right_records, f, g,
         round_even(similarity, 6) AS similarity
  FROM both_ways JOIN classes a ON a.form = f JOIN classes b ON b.form = g JOIN sides s ON s.split = a.split JOIN sides t ON t.split = b.split
  WHERE s.place < t.place AND similarity >= 0.9 AND 2.0::DOUBLE * least(length(f), length(g)) / (length(f) + length(g)) >= 0.9
)"""


def _aligned(rows: str) -> str:
    """Faults between the two approaches of ``rows``."""
    return f"""
one AS (SELECT * FROM {rows} WHERE approach = 'tfidf_logreg'),
two AS (SELECT * FROM {rows} WHERE approach = 'tuned_adapter'),
joined AS (
  SELECT coalesce(a.row_index, b.row_index) AS row_index, a.row_index IS NULL AS no_left, b.row_index IS NULL AS no_right,
         a.text IS DISTINCT FROM b.text AS text_differs, a.actual IS DISTINCT FROM b.actual AS actual_differs,
         a.correct IS DISTINCT FROM (coalesce(a.label_valid, true) AND coalesce(a.predicted = a.actual, false)) AS left_wrong,
         b.correct IS DISTINCT FROM (coalesce(b.label_valid, true) AND coalesce(b.predicted = b.actual, false)) AS right_wrong
  FROM one a FULL JOIN two b ON a.row_index = b.row_index
)
SELECT row_index, 'missing_left' AS rule FROM joined WHERE no_left
UNION SELECT row_index, 'missing_right' FROM joined WHERE no_right
UNION SELECT row_index, 'text' FROM joined WHERE NOT no_left AND NOT no_right AND text_differs
UNION SELECT row_index, 'actual' FROM joined WHERE NOT no_left AND NOT no_right AND actual_differs
UNION SELECT row_index, 'left_correct' FROM joined WHERE NOT no_left AND NOT no_right AND left_wrong
UNION SELECT row_index, 'right_correct' FROM joined WHERE NOT no_left AND NOT no_right AND right_wrong
UNION SELECT row_index, 'repeated' FROM {rows} WHERE approach IN ('tfidf_logreg', 'tuned_adapter') GROUP BY approach, row_index HAVING count(*) > 1"""


def _routed(routes: str) -> str:
    """Faults of ``routes`` against the labels of the records."""
    return f"""
wanted AS (SELECT DISTINCT category FROM labelled WHERE category IS NOT NULL),
counts AS (
  SELECT category, count(*) AS n, count_if(team IS NULL) AS teamless, count_if(coalesce(priority NOT IN ('urgent', 'standard', 'low'), true)) AS bad
  FROM {routes} GROUP BY category
)
SELECT category, 'no_route' AS rule FROM wanted WHERE category NOT IN (SELECT category FROM counts)
UNION SELECT category, 'unknown_category' FROM counts WHERE category NOT IN (SELECT category FROM wanted)
UNION SELECT category, 'several_routes' FROM counts WHERE n > 1
UNION SELECT category, 'no_team' FROM counts WHERE teamless > 0
UNION SELECT category, 'priority' FROM counts WHERE bad > 0"""


def _probe_faults(probes: str, per_group: int | None = None) -> str:
    sizes = f"UNION SELECT probe_group, 'group_size' FROM {probes} WHERE probe_group IN (SELECT g FROM groups) GROUP BY ALL HAVING count(*) <> {per_group}" if per_group else ""
    return f"""
groups(g) AS (VALUES ('short'), ('long'), ('ambiguous'), ('out_of_scope')),
known AS (SELECT list(category) AS allowed FROM routes),
asked AS (SELECT *, coalesce(acceptable_categories, []) AS acceptable FROM {probes}, known)
SELECT id, 'group' AS rule FROM asked WHERE coalesce(probe_group NOT IN (SELECT g FROM groups), true)
UNION SELECT id, 'source' FROM asked WHERE source IS DISTINCT FROM 'project_made_synthetic'
UNION SELECT id, 'blank_text' FROM asked WHERE coalesce({_STRIP} = '', true)
UNION SELECT id, 'unknown_acceptable' FROM asked WHERE NOT list_has_all(allowed, acceptable)
UNION SELECT id, 'inconsistent_expected' FROM asked
  WHERE expected_category IS NOT NULL AND NOT (list_contains(allowed, expected_category) AND list_distinct(acceptable) = [expected_category])
UNION SELECT id, 'expected_missing' FROM asked WHERE probe_group IN ('short', 'long') AND expected_category IS NULL
UNION SELECT id, 'ambiguous_target' FROM asked WHERE probe_group = 'ambiguous' AND (expected_category IS NOT NULL OR len(acceptable) = 0)
UNION SELECT id, 'scope_target' FROM asked WHERE probe_group = 'out_of_scope' AND (expected_category IS NOT NULL OR len(acceptable) > 0)
UNION SELECT id, 'repeated_id' FROM asked GROUP BY id HAVING count(*) > 1
UNION SELECT g, 'missing_group' FROM groups WHERE g NOT IN (SELECT probe_group FROM asked WHERE probe_group IS NOT NULL)
{sizes}"""


_STRICT = """
read_ AS (
  SELECT approach, row_index, raw_output, json_valid(raw_output) AS json_valid FROM predictions WHERE raw_output IS NOT NULL
),
shaped AS (
  SELECT *, CASE WHEN json_valid THEN coalesce(json_keys(raw_output) = ['category'] AND json_type(raw_output, '$.category') = 'VARCHAR', false)
            ELSE false END AS schema_valid
  FROM read_
),
parsed AS (SELECT *, CASE WHEN schema_valid THEN raw_output ->> '$.category' END AS predicted_category FROM shaped)"""

_SHOWN = """
candidates AS (
  SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'left_only' WHEN b THEN 'right_only' ELSE 'neither' END AS outcome, actual, row_index FROM paired
),
e1 AS (SELECT * FROM candidates WHERE outcome = 'both' ORDER BY row_index LIMIT 1),
e2 AS (SELECT * FROM candidates WHERE outcome = 'left_only' ORDER BY actual IN (SELECT actual FROM e1), row_index LIMIT 1),
u2 AS (SELECT actual FROM e1 UNION SELECT actual FROM e2),
e3 AS (SELECT * FROM candidates WHERE outcome = 'right_only' ORDER BY actual IN (SELECT actual FROM u2), row_index LIMIT 1),
u3 AS (SELECT actual FROM u2 UNION SELECT actual FROM e3),
e4 AS (SELECT * FROM candidates WHERE outcome = 'neither' ORDER BY actual IN (SELECT actual FROM u3), row_index LIMIT 1)"""

_RATES = ", ".join(f"count_if(coalesce({c}, false))::BIGINT AS {c}, round(1.0 - count_if(coalesce({c}, false)) / count(*)::DOUBLE, 6) AS {c}_invalid_rate" for c in ("json_valid", "schema_valid", "label_valid"))


ORACLE_SQL: dict[str, str] = {
    "class_summary": f"""WITH {_LABELLED}, counts AS (
        SELECT source_split, category, count(*) AS records FROM labelled WHERE category IS NOT NULL AND source_split IS NOT NULL GROUP BY ALL)
      SELECT source_split, category, records, count(*) OVER w AS classes, min(records) OVER w AS min_records, max(records) OVER w AS max_records
      FROM counts WINDOW w AS (PARTITION BY source_split)""",
    "majority_labels": f"WITH {_LABELLED}, {_MAJORITY} SELECT label, records, chosen FROM tied",
    "majority_baseline_metrics": f"""WITH {_LABELLED}, {_MAJORITY}, matrix AS (
        SELECT 'majority' AS approach, category AS actual, (SELECT label FROM tied WHERE chosen) AS predicted, count(*) AS n
        FROM labelled WHERE source_split = 'test' AND category IS NOT NULL GROUP BY ALL), {_scores("matrix", "approach")}
      SELECT {_MACRO_COLUMNS} FROM macros""",
    "canonical_categories": """SELECT category, trim(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '_') AS label, count(*) AS records
      FROM records GROUP BY category""",
    "stratified_split_allocation": f"WITH {_LABELLED}, {_SPLIT} SELECT category, records, quota FROM quotas",
    "stratified_split_assign": f"""WITH {_LABELLED}, {_SPLIT}, ordered AS (
        SELECT record_id, category, row_number() OVER (PARTITION BY category ORDER BY {_number("concat('42:', record_id)")}, record_id) AS place
        FROM labelled WHERE source_split = 'train' AND category IS NOT NULL)
      SELECT record_id, category, CASE WHEN place <= quota THEN 'validation' ELSE 'train' END AS part FROM ordered JOIN quotas USING (category)""",
    "confusion_long": f"WITH {_CONFUSION} SELECT approach, actual, predicted, n FROM matrix",
    "per_class_metrics": f"""WITH {_CLASSES} SELECT approach, category, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1, 6) AS f1, support, claimed, hits FROM classes""",
    "macro_metrics": f"WITH {_CLASSES} SELECT {_MACRO_COLUMNS} FROM macros",
    "top_confusions": f"""WITH {_CONFUSION} SELECT approach, actual, predicted, n,
      row_number() OVER (PARTITION BY approach ORDER BY n DESC, actual, predicted) AS rank FROM matrix WHERE actual <> predicted QUALIFY rank <= 20""",
    "error_examples": f"""WITH {_CONFUSION}, top AS (
        SELECT *, row_number() OVER (PARTITION BY approach ORDER BY n DESC, actual, predicted) AS rank FROM matrix WHERE actual <> predicted QUALIFY rank <= 15)
      SELECT approach, actual, predicted, row_index, text, rank, n, row_number() OVER (PARTITION BY approach, rank ORDER BY row_index) AS example
      FROM shown JOIN top USING (approach, actual, predicted) QUALIFY example <= 3""",
    "lowest_f1_classes": f"""WITH {_CLASSES} SELECT approach, category, round(f1, 6) AS f1, support,
      row_number() OVER (PARTITION BY approach ORDER BY round(f1, 6), category) AS rank FROM classes QUALIFY rank <= 10""",
    "error_totals": f"""WITH {_CLASSES}, errors AS (
        SELECT approach, count_if(NOT coalesce(correct, false))::BIGINT AS errors,
               count_if(NOT coalesce(correct, false) AND NOT coalesce(label_valid, true))::BIGINT AS invalid,
               count_if(NOT coalesce(correct, false) AND coalesce(label_valid, true))::BIGINT AS valid_label_errors FROM predictions GROUP BY approach),
      low AS (SELECT approach, count_if(f1 = 0)::BIGINT AS zero_f1, count_if(f1 < 0.5)::BIGINT AS below_half_f1 FROM classes GROUP BY approach)
      SELECT * FROM errors JOIN low USING (approach)""",
    "structured_output_rates": f"SELECT approach, count(*) AS records, {_RATES} FROM predictions WHERE json_valid IS NOT NULL GROUP BY approach",
    "structured_output_rows": f"""WITH {_STRICT} SELECT approach, row_index, json_valid, schema_valid,
      coalesce(predicted_category IN (SELECT category FROM routes), false) AS label_valid, predicted_category FROM parsed""",
    "prediction_counts": f"WITH {_CONFUSION} SELECT approach, predicted, count(*) AS n FROM shown GROUP BY ALL",
    "correctness_overlap": f"""WITH {_PAIRED} SELECT count(*) AS records, count_if(a AND b)::BIGINT AS both_correct,
      count_if(a AND NOT b)::BIGINT AS left_only_correct, count_if(NOT a AND b)::BIGINT AS right_only_correct,
      count_if(NOT a AND NOT b)::BIGINT AS both_incorrect, round(count_if(a) / count(*)::DOUBLE, 6) AS left_accuracy,
      round(count_if(b) / count(*)::DOUBLE, 6) AS right_accuracy FROM paired""",
    "outcome_examples": f"""WITH {_PAIRED} SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'left_only' WHEN b THEN 'right_only' ELSE 'neither' END AS outcome,
      actual, min(row_index) AS row_index FROM paired GROUP BY ALL""",
    "class_comparison": f"""WITH {_CLASSES}, {_COMPARED} SELECT category, round(left_f1, 6) AS left_f1, round(right_f1, 6) AS right_f1,
      round(round(left_f1, 6) - round(right_f1, 6), 6) AS difference,
      CASE WHEN round(left_f1, 6) - round(right_f1, 6) > 5e-7 THEN 'left' WHEN round(left_f1, 6) - round(right_f1, 6) < -5e-7 THEN 'right' ELSE 'tie' END AS better
      FROM compared""",
    "largest_advantages": f"""WITH {_CLASSES}, {_COMPARED}, sides AS (
        SELECT 'left' AS side, category, round(difference, 6) AS difference, round(difference, 6) AS gain FROM compared WHERE difference > 1e-12
        UNION ALL SELECT 'right', category, round(difference, 6), -round(difference, 6) FROM compared WHERE difference < -1e-12)
      SELECT side, row_number() OVER (PARTITION BY side ORDER BY gain DESC, category) AS rank, category, difference FROM sides QUALIFY rank <= 10""",
    "approach_ranking": f"""WITH {_CLASSES} SELECT approach, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy,
      row_number() OVER (ORDER BY round(macro_f1, 6) DESC, approach) AS rank FROM macros""",
    "bootstrap_ci": f"""WITH {_BOOTSTRAP} SELECT approach, metric, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high
      FROM long GROUP BY ALL""",
    "paired_difference_ci": f"""WITH {_BOOTSTRAP}, {_scores("matrix", "approach", "whole_")}, sides AS (
        SELECT replicate, metric, max(value) FILTER (approach = 'tfidf_logreg') - max(value) FILTER (approach = 'tuned_adapter') AS d FROM long GROUP BY ALL),
      ends AS (SELECT metric, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM sides GROUP BY metric)
      SELECT e.metric, round(CASE e.metric WHEN 'accuracy' THEN a.accuracy - b.accuracy ELSE a.macro_f1 - b.macro_f1 END, 6) AS difference,
        round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS excludes_zero
      FROM ends e, whole_macros a, whole_macros b WHERE a.approach = 'tfidf_logreg' AND b.approach = 'tuned_adapter'""",
    "route_requests": f"""WITH answered AS (
        SELECT p.approach, p.row_index, r.*, length({_STRIP}) AS n,
          CASE WHEN coalesce(n, 0) NOT BETWEEN 1 AND 2000 THEN 422 WHEN n > 120 THEN 413 WHEN r.category IS NOT NULL THEN 200 ELSE 422 END AS status_code
        FROM predictions p LEFT JOIN routes r ON p.predicted = r.category)
      SELECT approach, row_index, status_code, CASE WHEN status_code = 200 THEN category END AS category,
        CASE WHEN status_code = 200 THEN priority END AS priority, CASE WHEN status_code = 200 THEN team END AS team,
        CASE WHEN status_code = 200 THEN 'provisional_project_mapping' END AS routing_policy FROM answered""",
    "request_validation": f"""WITH asked AS (
        SELECT 'records' AS origin, length({_STRIP}) AS n FROM records UNION ALL SELECT 'documents', length({_STRIP}) FROM documents)
      SELECT origin, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN n > 2000 THEN 'too_long' ELSE 'accepted' END AS status, count(*) AS requests
      FROM asked GROUP BY ALL""",
    "agent_assist_status": f"""WITH asked AS (
        SELECT approach, length({_STRIP}) AS n, predicted IN (SELECT category FROM routes) AS known FROM predictions),
      marked AS (SELECT approach, CASE WHEN n > 2000 THEN 'input_too_long' WHEN known THEN 'available' ELSE 'invalid_model_output' END AS suggestion_status FROM asked)
      SELECT approach, suggestion_status, count(*) AS records, count_if(suggestion_status = 'available')::BIGINT AS suggested FROM marked GROUP BY ALL""",
    "sequence_length_summary": """WITH ordered AS (
        SELECT source_split, length(text) AS v, row_number() OVER (PARTITION BY source_split ORDER BY length(text)) AS k, count(*) OVER (PARTITION BY source_split) AS n
        FROM records WHERE text IS NOT NULL)
      SELECT source_split, max(n) AS rows, min(v)::INT AS min, (max(v) FILTER (k = n // 2 + 1))::INT AS median, (max(v) FILTER (k = ceil(n * 95 / 100.0)))::INT AS p95,
        (max(v) FILTER (k = ceil(n * 99 / 100.0)))::INT AS p99, max(v)::INT AS max FROM ordered GROUP BY source_split""",
    "latency_summary": """WITH delays AS (
        SELECT source, epoch_us(received_at) AS earlier, epoch_us(ingested_at) AS later, floor((later - earlier) / 1000000)::BIGINT AS s FROM records WHERE received_at IS NOT NULL AND ingested_at IS NOT NULL)
      SELECT source, count(*) AS rows, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95,
        round(count(*) / ((max(later) - min(earlier)) / 1000000.0::DOUBLE), 9) AS per_second FROM delays GROUP BY source""",
    "robustness_group_scores": f"""WITH {_LABELLED}, {_MAJORITY}, {_VOTES}, {_PROBED}
      SELECT probe_group, approach, count(*) AS records, count_if(success)::BIGINT AS successes, count_if(label_valid)::BIGINT AS forced,
        count_if(NOT label_valid)::BIGINT AS invalid, count_if(explicit_unknown)::BIGINT AS explicit_unknown,
        round(count_if(success) / count(*)::DOUBLE, 6) AS success_rate FROM probed GROUP BY ALL""",
    "failed_probes": f"WITH {_LABELLED}, {_MAJORITY}, {_VOTES}, {_PROBED} SELECT id, probe_group, approach, predicted FROM probed WHERE NOT success",
    "probe_correctness": f"""WITH {_VOTES} SELECT id, CASE WHEN probe_group = 'out_of_scope' THEN 'out_of_scope' ELSE 'in_scope' END AS scope,
      CASE WHEN probe_group <> 'out_of_scope' THEN coalesce(list_contains(acceptable_categories, predicted), false) END AS category_correct
      FROM robustness_probes JOIN voted USING (id)""",
    "tfidf_weights": f"WITH {_TERMS} SELECT id, term, round(weight, 6) AS weight FROM weights",
    "nearest_training_cosine": f"WITH {_TERMS}, {_cosines('SELECT id, text FROM robustness_probes')} SELECT id, cosine FROM nearest",
    "calibration_split": """SELECT id, probe_group, CASE WHEN row_number() OVER (PARTITION BY probe_group ORDER BY id) <= 100 THEN 'calibration' ELSE 'held_out' END AS part
      FROM robustness_probes""",
    "threshold_candidates": f"WITH {_SCOPE} SELECT round(threshold, 7) AS threshold, known_below, unknown_below FROM candidates",
    "threshold_search": f"""WITH {_SCOPE} SELECT round(threshold, 7) AS threshold, round(balanced_accuracy, 6) AS balanced_accuracy, known_rejected, unknown_rejected
      FROM best""",
    "decision_scores": f"""WITH {_SCOPE} SELECT probe_group, outcome, count(*) AS records FROM outcomes GROUP BY GROUPING SETS ((outcome), (probe_group, outcome))""",
    "decision_rates": f"""WITH {_SCOPE} SELECT round(count_if(outcome = 'unknown_rejected') / count_if(scope = 'out_of_scope')::DOUBLE, 6) AS unknown_rejection_rate,
      round(count_if(outcome = 'known_rejected') / count_if(scope = 'in_scope')::DOUBLE, 6) AS known_false_rejection_rate FROM outcomes""",
    "external_scope_by_group": f"""WITH {_SCOPE} SELECT probe_group, count_if(NOT rejected)::BIGINT AS accepted, count_if(rejected)::BIGINT AS rejected
      FROM decided GROUP BY probe_group""",
    "rejection_audit": f"""WITH {_SCOPE}, {_cosines("SELECT DISTINCT record_id AS id, text FROM predictions WHERE record_id % 100 = 0", "_2")},
      judged AS (
        SELECT approach, coalesce(correct, false) AS correct, NOT coalesce(label_valid, false) OR cosine < (SELECT threshold FROM best) AS rejected
        FROM predictions JOIN nearest_2 ON id = record_id)
      SELECT approach, count(*) AS records, count_if(rejected)::BIGINT AS rejected, count_if(NOT rejected)::BIGINT AS accepted,
        count_if(NOT rejected AND correct)::BIGINT AS accepted_correct, count_if(rejected AND correct)::BIGINT AS correct_rejected,
        round(count_if(rejected) / count(*)::DOUBLE, 6) AS rejected_rate,
        round(count_if(NOT rejected AND correct) / nullif(count_if(NOT rejected), 0)::DOUBLE, 6) AS accepted_accuracy FROM judged GROUP BY approach""",
    "canonical_texts": f"SELECT record_id, {_canonical('text')} AS canonical, {_compared('text')} AS comparison FROM records",
    "character_ngram_counts": f"""WITH forms AS (SELECT {_compared("text")} AS form FROM records WHERE text IS NOT NULL)
      SELECT piece, count(*) AS records FROM (SELECT unnest({_pieces("form")}) AS piece FROM forms) GROUP BY piece""",
    "duplicate_audit": f"""WITH {_LABELLED}, kept AS (
        SELECT text, source_split AS s, coalesce(category, '') AS c, {_canonical("text")} AS key, count(*) OVER (PARTITION BY text) AS copies
        FROM labelled WHERE text IS NOT NULL),
      raw AS (SELECT text, count(*) AS n, count(DISTINCT s) AS splits FROM kept GROUP BY text HAVING count(*) > 1),
      canonical AS (
        SELECT key, count(*) AS n, count(DISTINCT s) AS splits, count(DISTINCT c) AS labels, bool_and(copies > 1) AS all_raw FROM kept GROUP BY key HAVING count(*) > 1)
      SELECT (SELECT count(*) FROM raw) AS raw_duplicate_groups, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM raw) AS raw_duplicate_excess_records,
        (SELECT count(*) FROM raw WHERE splits > 1) AS raw_cross_source_split_groups,
        count_if(NOT all_raw)::BIGINT AS canonical_only_duplicate_groups, coalesce(sum(n - 1) FILTER (NOT all_raw), 0)::BIGINT AS canonical_only_duplicate_excess_records,
        count_if(splits > 1)::BIGINT AS canonical_cross_source_split_groups, count_if(labels > 1)::BIGINT AS conflicting_label_duplicate_groups FROM canonical""",
    "deduplicated_records": f"""WITH kept AS (SELECT *, {_canonical("text")} AS key FROM records WHERE source_split IN ('train', 'test')),
      ranked AS (
        SELECT *, bool_or(source_split = 'test') OVER (PARTITION BY key) AS reserved,
               row_number() OVER (PARTITION BY key, source_split ORDER BY source_index, record_id) AS place FROM kept)
      SELECT record_id, source_split, source_split = 'test' OR key IS NULL OR (NOT reserved AND place = 1) AS kept FROM ranked""",
    "near_duplicate_pairs": f"""WITH {_NEAR} SELECT left_split, right_split, left_id, right_id, left_records, right_records, similarity FROM pairs""",
    "near_duplicate_links": f"""WITH {_NEAR}, links AS (
        SELECT left_split AS split, left_id AS class_id, right_records AS n FROM pairs UNION ALL SELECT right_split, right_id, left_records FROM pairs),
      summed AS (SELECT split, class_id, sum(n)::BIGINT AS links FROM links GROUP BY ALL)
      SELECT id, split, class_id, coalesce(links, 0)::BIGINT AS links FROM forms JOIN classes USING (split, form) LEFT JOIN summed USING (split, class_id)""",
    "near_duplicate_rollup": f"""WITH {_NEAR}, labels AS (SELECT split, form, label, count(*) AS c FROM forms GROUP BY ALL),
      both_labels AS (
        SELECT left_split, right_split, f, g, a.label IS NOT DISTINCT FROM b.label AS same, a.c * b.c AS c
        FROM pairs JOIN labels a ON a.split = left_split AND a.form = f JOIN labels b ON b.split = right_split AND b.form = g),
      sums AS (
        SELECT left_split, right_split, sum(c)::BIGINT AS pairs, coalesce(sum(c) FILTER (same), 0)::BIGINT AS same_label,
          coalesce(sum(c) FILTER (NOT same), 0)::BIGINT AS other_label FROM both_labels GROUP BY ALL),
      lefts AS (
        SELECT left_split, right_split, sum(left_records)::BIGINT AS left_records
        FROM (SELECT DISTINCT left_split, right_split, left_id, left_records FROM pairs) GROUP BY ALL),
      rights AS (
        SELECT left_split, right_split, sum(right_records)::BIGINT AS right_records
        FROM (SELECT DISTINCT left_split, right_split, right_id, right_records FROM pairs) GROUP BY ALL)
      SELECT * FROM sums JOIN lefts USING (left_split, right_split) JOIN rights USING (left_split, right_split)""",
    "near_duplicate_records": f"""WITH {_NEAR}, sides_ AS (SELECT left_split AS source_split, f AS form FROM pairs UNION SELECT right_split, g FROM pairs)
      SELECT source_split, sum(n)::BIGINT AS records FROM sides_ JOIN classes ON split = source_split AND classes.form = sides_.form GROUP BY ALL""",
    "confusion_wide": f"""WITH {_CONFUSION}, padded AS (
        SELECT approach, actual, predicted, n FROM matrix UNION ALL SELECT NULL, NULL, category, 0 FROM routes UNION ALL SELECT NULL, NULL, '__invalid_output__', 0)
      SELECT * FROM (PIVOT padded ON predicted USING coalesce(sum(n), 0)::BIGINT GROUP BY approach, actual) WHERE approach IS NOT NULL""",
    "prediction_alignment_violations": f"WITH {_aligned('predictions')}",
    "planted_alignment_violations": f"""WITH shifted AS (
        SELECT approach, CASE WHEN approach = 'tuned_adapter' AND row_index % 11 = 1 THEN row_index + 1000000000 ELSE row_index END AS row_index,
          CASE WHEN approach = 'tuned_adapter' AND row_index % 11 = 3 THEN text || ' ' ELSE text END AS text,
          CASE WHEN approach = 'tuned_adapter' AND row_index % 11 = 2 THEN 'other' ELSE actual END AS actual, predicted, label_valid,
          CASE WHEN approach = 'tuned_adapter' AND row_index % 11 = 4 THEN NOT correct ELSE correct END AS correct FROM predictions),
      planted AS (FROM shifted UNION ALL FROM shifted WHERE approach = 'tuned_adapter' AND row_index % 11 = 5),
      {_aligned('planted')}""",
    "checkpoint_violations": f"""WITH {_LABELLED}, given AS (
        SELECT source_index AS row_index, text, category FROM labelled WHERE source_split = 'test'
        QUALIFY row_number() OVER (PARTITION BY source_index ORDER BY record_id) = 1),
      rows_ AS (SELECT p.approach, p.row_index, p.text, p.actual, g.row_index IS NOT NULL AS there, g.text AS given_text, g.category AS given_actual
        FROM predictions p LEFT JOIN given g USING (row_index))
      SELECT approach, row_index, 'gap' AS rule FROM predictions p
        WHERE row_index > 0 AND NOT EXISTS (SELECT 1 FROM predictions q WHERE q.approach = p.approach AND q.row_index = p.row_index - 1)
      UNION SELECT approach, row_index, 'repeated' FROM predictions GROUP BY ALL HAVING count(*) > 1
      UNION SELECT approach, row_index, 'unknown' FROM rows_ WHERE NOT there
      UNION SELECT approach, row_index, 'text' FROM rows_ WHERE there AND text IS DISTINCT FROM given_text
      UNION SELECT approach, row_index, 'actual' FROM rows_ WHERE there AND actual IS DISTINCT FROM given_actual""",
    "support_violations": """WITH counts AS (SELECT approach, actual, count(*) AS records FROM predictions GROUP BY ALL),
      often AS (SELECT approach, records AS wanted, count(*) AS labels FROM counts GROUP BY ALL),
      usual AS (SELECT approach, wanted FROM often QUALIFY row_number() OVER (PARTITION BY approach ORDER BY labels DESC, wanted DESC) = 1)
      SELECT approach, actual, records, wanted FROM counts JOIN usual USING (approach) WHERE records <> wanted""",
    "showcase_examples": f"WITH {_PAIRED}, {_SHOWN} FROM e1 UNION ALL FROM e2 UNION ALL FROM e3 UNION ALL FROM e4",
    "route_coverage_violations": f"WITH {_LABELLED}, {_routed('routes')}",
    "planted_route_violations": f"""WITH {_LABELLED}, spoilt AS (
        SELECT category, CASE WHEN category < 'b' THEN 'soon' ELSE priority END AS priority, CASE WHEN category >= 'c' THEN team END AS team
        FROM routes WHERE category < 'm'),
      planted AS (
        FROM spoilt UNION ALL FROM spoilt WHERE category < 'd' UNION ALL SELECT 'no_' || category, priority, team FROM spoilt WHERE category < 'c'),
      {_routed('planted')}""",
    "label_names": f"""WITH {_LABELLED}, every AS (
        SELECT DISTINCT category FROM labelled WHERE source_split IN ('train', 'validation') AND category IS NOT NULL)
      SELECT category, row_number() OVER (ORDER BY category)::INT AS place FROM every""",
    "prompt_render_hash": f"""WITH {_LABELLED}, names AS (SELECT list_sort(list(DISTINCT category)) AS names FROM labelled WHERE category IS NOT NULL),
      rendered AS (SELECT '{INSTRUCTION}' || array_to_string(names, ', ') AS prompt, len(names)::INT AS labels FROM names)
      SELECT prompt, labels, sha256(prompt) AS sha256 FROM rendered""",
    "probe_violations": f"WITH {_probe_faults('robustness_probes')}",
    "planted_probe_violations": f"""WITH numbered AS (SELECT *, right(id, 3)::INT % 9 AS k FROM robustness_probes),
      spoilt AS (
        SELECT id, k, CASE k WHEN 0 THEN 'medium' ELSE probe_group END AS probe_group, CASE k WHEN 1 THEN ' ' || chr(8195) ELSE text END AS text,
          CASE k WHEN 2 THEN 'web' ELSE source END AS source, CASE k WHEN 3 THEN NULL WHEN 4 THEN 'nothing' ELSE expected_category END AS expected_category,
          CASE k WHEN 5 THEN ['nothing'] WHEN 6 THEN [] ELSE acceptable_categories END AS acceptable_categories FROM numbered),
      planted AS (FROM spoilt UNION ALL FROM spoilt WHERE k = 7),
      {_probe_faults('planted', 200)}""",
    "external_sample": "SELECT probe_group, id, row_number() OVER (PARTITION BY probe_group ORDER BY id) AS place FROM robustness_probes QUALIFY place <= 2",
    "received_per_day": """SELECT date_trunc('day', received_at) AS window_start, source, count(*) AS records FROM records WHERE received_at IS NOT NULL GROUP BY ALL""",
    "report_consistency": f"""WITH {_CONFUSION}, rows_ AS (
        SELECT approach, count(*) AS records, count_if(coalesce(correct, false))::BIGINT AS correct,
               count_if(actual IN (SELECT category FROM routes))::BIGINT AS support_total FROM predictions GROUP BY approach),
      sums AS (SELECT approach, sum(n)::BIGINT AS matrix_total, coalesce(sum(n) FILTER (actual = predicted), 0)::BIGINT AS diagonal FROM matrix GROUP BY approach)
      SELECT approach, records, correct, matrix_total, diagonal, support_total,
        records = matrix_total AND records = support_total AND correct = diagonal AS consistent,
        NOT EXISTS (SELECT row_index, actual FROM predictions GROUP BY ALL HAVING count(*) <> (SELECT count(DISTINCT approach) FROM predictions)) AS same_rows
      FROM rows_ JOIN sums USING (approach)""",
}
