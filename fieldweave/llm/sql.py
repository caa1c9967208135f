"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP9 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM w, unnest(range(1, len(w) - 1)) AS u(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, unnest([0, 1, 2]) AS u(k) WHERE n > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: length(trim(x, {SPACES})) > 0) AS l,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaim
  FROM w LEFT JOIN r USING (doc_id)
),
f AS (
  SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines FROM m
),
b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > len(l) THEN 8 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_upper > 3 * word_chars THEN 64 ELSE 0 END + CASE WHEN 2 * n_exclaim > n_words THEN 128 ELSE 0 END AS fail_bits
  FROM f
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits
FROM b
"""

_RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words", "upper_case", "exclamations")
_POLICIES = ", ".join(
    f"('{version}', '{rule}', {1 << k}::BIGINT, {mask}::BIGINT)" for version, n, mask in (("base-1", 2, 3), ("full-1", 8, 255)) for k, rule in enumerate(_RULES[:n])
)

ABLATIONS = f"""
WITH e AS ({OP9}), p(policy, rule, bit, mask) AS (VALUES {_POLICIES})
SELECT policy, rule, bit, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits & mask = bit) AS n_failed_alone,
  count(*) FILTER (WHERE fail_bits & mask & (255 - bit) = 0) AS n_kept_without
FROM e, p GROUP BY ALL
"""

KEY = f"translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
),
k AS (SELECT *, {KEY} AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, keep_doc IS NOT NULL AND keep_doc <> doc_id AS dropped FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)
),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
f AS (SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id, array_to_string(list_sort(list(s.gram)), chr(10)) AS grams
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.a = d.doc_id GROUP BY ALL)
SELECT doc_id, n_shingles::BIGINT AS n_shingles, component_id,
  CASE WHEN n_shingles > 0 THEN min(doc_id) OVER (PARTITION BY grams) ELSE doc_id END AS class_id
FROM f
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(5, len(w)) AS m, array_to_string(w[i:i + 4], ' ') AS gram FROM b, unnest(range(1, greatest(2, len(w) - 3))) AS u(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM q GROUP BY item_id),
s AS (
  SELECT DISTINCT doc_id, m, array_to_string(w[i:i + m - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT m FROM q) AS ms, unnest(range(1, len(w) - m + 2)) AS u(i)
)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM q JOIN s USING (m, gram) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * any_value(n_item)
"""

ORACLE = {"op10_decontamination": OP10, "op2_ngram_join": OP2, "op8_line_dedup": OP8, "op9_quality_rules": OP9, "quality_ablations": ABLATIONS}
