"""SQL for DuckDB that gives the same rows as the queries.

The others have none: SQL has neither a tokenizer nor the list of confusable letters, and the draws of samples
and mixes are their own. They are tested against brute force.
"""

from sievelight.plans.oracle import FORMS, SIMILAR

#: Equal texts and those at the threshold, each way.
_OVERLAPS = f"""
{FORMS}, {SIMILAR},
met AS (
  SELECT DISTINCT form AS f, form AS g, 1.0::DOUBLE AS similarity FROM classes
  UNION ALL SELECT f, g, similarity FROM alike WHERE similarity >= 0.9 UNION ALL SELECT g, f, similarity FROM alike WHERE similarity >= 0.9
),
pairs AS (
  SELECT a.id AS held, b.id AS train, a.split, a.label = b.label OR a.label IS NULL AND b.label IS NULL AS same, a.stored IS NOT DISTINCT FROM b.stored AS same_stored, similarity
  FROM met JOIN forms a ON a.form = f JOIN forms b ON b.form = g WHERE a.split <> 'train' AND b.split = 'train'
)"""

#: Strict objects; of a field named twice in any letter case the last holds.
_PAYLOADS = """
objects AS (
  SELECT raw_id, payload FROM raw_records
  WHERE json_valid(payload) AND ltrim(payload, ' \t\r\n' || chr(10) || chr(13) || chr(9)) LIKE '{%'
    AND NOT regexp_matches(payload, '[:,\\[]\\s*-?(NaN|Infinity|nan|inf)') AND NOT regexp_matches(payload, ',\\s*[}\\]]\\s*$')
),
fields AS (
  SELECT raw_id, lower(j.key) AS name, CASE WHEN j.type = 'NULL' THEN NULL WHEN j.type = 'VARCHAR' THEN j.value ->> '$' ELSE j.value::VARCHAR END AS value, j.rowid AS place
  FROM objects, json_each(payload) j
),
named AS (
  SELECT raw_id, max_by(coalesce(value, chr(0)), place) FILTER (name = 'text') AS text, max_by(coalesce(value, chr(0)), place) FILTER (name = 'category') AS category,
    coalesce(max_by(coalesce(value, ''), place) FILTER (name = 'source'), '') AS source
  FROM fields GROUP BY raw_id
),
keyed AS (
  SELECT raw_id, list_transform([text, category, source], lambda x: regexp_extract_all(replace(replace(lower(x), 'ß', 'ss'), 'ς', 'σ'), '[\\p{L}\\p{N}]+')) AS key
  FROM named WHERE text <> chr(0) AND category <> chr(0)
),
groups AS (SELECT raw_id, min(raw_id) OVER (PARTITION BY key) AS kept FROM keyed WHERE len(key[1]) > 0)"""

_WORDS = """
words AS (
  SELECT record_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM records
),
texts AS (SELECT count(text) AS n FROM records),
terms AS (
  SELECT term, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM words GROUP BY term
),
marked AS (
  SELECT term, occurrences, records,
         CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > n THEN 'common' END AS mark
  FROM terms CROSS JOIN texts
)"""

_GRAMS = """
split AS (SELECT record_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM records),
grams AS (
  SELECT record_id, n AS words, array_to_string(w[i:i + n - 1], ' ') AS term
  FROM split, range(1, 4) lengths(n), unnest(range(1, len(w) - n + 2)) places(i)
),
texts AS (SELECT count(text) AS n FROM records),
terms AS (
  SELECT term, words::INT AS words, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM grams GROUP BY ALL
)"""

_TARGETS = """
counts AS (
  SELECT source_split, trim(regexp_replace(lower(category), '[^a-z0-9]+', '_', 'g'), '_') AS category, count(*) AS n
  FROM records WHERE category IS NOT NULL GROUP BY ALL
),
targets AS (
  SELECT t.plan_id, t.source_split, t.category, t.target_bp,
         greatest(t.min_rows::BIGINT, t.sample_size::BIGINT * t.target_bp // 10000) AS needed,
         coalesce(c.n, 0)::BIGINT AS available
  FROM sample_targets t LEFT JOIN counts c USING (source_split, category)
)"""

#: What each target needs, and one more for the largest remainders while rows of the plan's size are missing.
_QUOTAS = f"""
{_TARGETS},
exact AS (
  SELECT p.*, s.sample_size, p.needed * 10000 - s.sample_size * p.target_bp AS short, short < 0 AS below
  FROM targets p JOIN (SELECT plan_id, max(sample_size) AS sample_size FROM sample_targets GROUP BY plan_id) s USING (plan_id)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY plan_id, below ORDER BY short, source_split, category) AS place,
         sample_size - sum(needed) OVER (PARTITION BY plan_id) AS missing
  FROM exact
),
drawn AS (SELECT *, least(needed + (below AND place <= missing)::INT, available)::BIGINT AS drawn FROM ranked)"""

ORACLE_SQL: dict[str, str] = {
    "p4_report": f"WITH {_QUOTAS} SELECT plan_id, source_split, category, target_bp, needed, available, drawn, drawn >= needed AS met FROM drawn",
    "p1_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(held, train) AS left_id, greatest(held, train) AS right_id FROM pairs",
    "p1_report": f"""WITH {_OVERLAPS} SELECT split AS source_split, source, count(DISTINCT held) AS flagged, count(*) AS pairs,
      count_if(similarity = 1)::BIGINT AS equal_pairs, count_if(similarity < 1)::BIGINT AS near_pairs,
      count_if(same_stored)::BIGINT AS same_category, count_if(NOT same_stored)::BIGINT AS other_category
      FROM pairs JOIN (SELECT record_id AS held, source FROM records) USING (held) GROUP BY ALL""",
    "p5_found": f"WITH {_PAYLOADS} SELECT kept AS kept_id, raw_id AS copy_id FROM groups WHERE raw_id <> kept",
    "p5_groups": f"WITH {_PAYLOADS} SELECT kept AS kept_id, count(*) AS copies FROM groups GROUP BY kept",
    "p2_found": f"WITH {_WORDS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
    "p2_terms": f"WITH {_WORDS} SELECT term, occurrences, records, mark FROM marked",
    "p2_ngrams": f"""WITH {_GRAMS} SELECT term, words, occurrences, records,
      CASE WHEN records <= 2 THEN 'rare' WHEN records * 10 > n THEN 'common' END AS mark FROM terms CROSS JOIN texts""",
    "p4_found": f"WITH {_TARGETS} SELECT DISTINCT plan_id, category FROM targets WHERE available < needed",
}
