"""DuckDB SQL of the reference queries, written from the rules and not from the plans."""

from __future__ import annotations

from ..functions import vocabulary as V
from .samples import READINGS, SOURCE, TARGET


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    tables = list(dict.fromkeys(r[0] for r in rows))
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        seen[r[0]] = seen.get(r[0], -1) + 1
        out.append(f"({tables.index(r[0])}, {seen[r[0]]}, {', '.join(map(quoted, r))})")
    return ", ".join(out)


COLS = '(table_ord, field_ord, table_name, table_desc, name, "desc", type)'
DICT = f"src{COLS} AS (VALUES {_rows(SOURCE)}), tgt{COLS} AS (VALUES {_rows(TARGET)})"
READ = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in READINGS.items()) + "}"


def tokens(x: str) -> str:
    humps = rf"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return f"list_filter(string_split_regex(lower({humps}), '[^a-z0-9一-龥]+'), lambda x: x <> '')"


def full(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce({READ}[c], c)), '')"


def abbr(x: str) -> str:
    one = f"CASE WHEN c >= '一' AND c <= '龥' THEN upper(left({READ}[c], 1)) WHEN regexp_matches(c, '[a-zA-Z0-9]') THEN upper(c) ELSE '' END"
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: {one}), '')"


def features(side: str) -> str:
    return (
        f'SELECT *, lower(name) AS lname, lower("desc") AS ldesc, lower(type) AS ltype, {tokens("name")} AS tokens, '
        f'lower({full(chr(34) + "desc" + chr(34))}) AS full_py, lower({abbr(chr(34) + "desc" + chr(34))}) AS abbr_py, lower({abbr("name")}) AS name_abbr FROM {side}'
    )


#: Row-by-row longest-common-subsequence tables of the pairs in ``ip`` (a, b).
INDEL = """
ia(a, b, i, r) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT) FROM ip
  UNION ALL
  SELECT a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda cur, j: list_append(cur,
    CASE WHEN substr(b, j, 1) = substr(a, i + 1, 1) THEN r[j] + 1 ELSE greatest(r[j + 1], cur[j]) END), [0::BIGINT])
  FROM ia WHERE i < length(a)
),
indel AS (
  SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * r[length(b) + 1] / (length(a) + length(b)) END AS ratio
  FROM ia WHERE i = length(a)
)"""
#: Matching blocks of the pairs in ``gp`` (a, b): the longest common run of an interval, the
#: leftmost in a, then in b, and so on in the intervals before and after it.
GESTALT = """
runs AS (
  SELECT a, b, i, j, list_max(list_filter(range(0, least(length(a) - i, length(b) - j) + 2), lambda k: substr(a, i, k) = substr(b, j, k))) AS k
  FROM gp, unnest(range(1, length(a) + 1)) AS u(i), unnest(range(1, length(b) + 1)) AS v(j) WHERE substr(a, i, 1) = substr(b, j, 1)
),
walk(a, b, alo, ahi, blo, bhi) AS (
  SELECT a, b, 1, length(a) + 1, 1, length(b) + 1 FROM gp
  UNION ALL
  SELECT a, b, n.alo, n.ahi, n.blo, n.bhi FROM (
    SELECT a, b, unnest([{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}, {'alo': m.k - m.i, 'ahi': ahi, 'blo': m.k - m.j, 'bhi': bhi}]) AS n
    FROM (
      SELECT w.a, w.b, alo, ahi, blo, bhi, max({'k': least(r.k, ahi - r.i, bhi - r.j), 'i': -r.i, 'j': -r.j}) AS m
      FROM walk w JOIN runs r ON r.a = w.a AND r.b = w.b AND r.i >= alo AND r.i < ahi AND r.j >= blo AND r.j < bhi
      GROUP BY w.a, w.b, alo, ahi, blo, bhi
    )
  ) WHERE n.alo < n.ahi AND n.blo < n.bhi
),
hits AS (
  SELECT w.a, w.b, alo, ahi, blo, bhi, max(least(r.k, ahi - r.i, bhi - r.j)) AS k
  FROM walk w JOIN runs r ON r.a = w.a AND r.b = w.b AND r.i >= alo AND r.i < ahi AND r.j >= blo AND r.j < bhi
  GROUP BY w.a, w.b, alo, ahi, blo, bhi
),
gestalt AS (
  SELECT gp.a, gp.b, CASE WHEN length(gp.a) + length(gp.b) = 0 THEN 1.0 ELSE 2.0 * coalesce(sum(k), 0) / (length(gp.a) + length(gp.b)) END AS ratio
  FROM gp LEFT JOIN hits h ON h.a = gp.a AND h.b = gp.b GROUP BY gp.a, gp.b
)"""


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(w)})" for w in words) + ")"


def groups_hit(s: str, t: str, groups: dict[str, list[str]], keyed: bool = True) -> str:
    lists = [([k] if keyed else []) + ws for k, ws in groups.items()]
    return "(" + " OR ".join(f"({any_of(s, ws)} AND {any_of(t, ws)})" for ws in lists) + ")"


def members_hit(s: str, t: str, groups: dict[str, list[str]]) -> str:
    lists = [", ".join(map(quoted, ws)) for ws in groups.values()]
    return "(" + " OR ".join(f"({s} IN ({x}) AND {t} IN ({x}))" for x in lists) + ")"


def patterns_hit(s: str, t: str, patterns: dict[str, float]) -> str:
    return "greatest(0.0, " + ", ".join(f"CASE WHEN regexp_matches({s}, {quoted(p)}) AND regexp_matches({t}, {quoted(p)}) THEN {v} ELSE 0.0 END" for p, v in patterns.items()) + ")"


def relation(x: str, y: str) -> str:
    both = " OR ".join(f"({x} IN ({ws}) AND {y} IN ({ws}))" for ws in (", ".join(map(quoted, [k, *v])) for k, v in V.SYNONYMS.items()))
    short = " OR ".join(f"({a} = {quoted(k)} AND {b} IN ({', '.join(map(quoted, v))}))" for k, v in V.ABBREVIATIONS.items() for a, b in ((x, y), (y, x)))
    return f"CASE WHEN {both} THEN 0.8 WHEN {short} THEN 0.7 ELSE 0.0 END"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def affix(a: str, b: str) -> str:
    sizes = f"range(2, least(length({a}), length({b})) + 1)"
    hits = f"list_concat(list_filter({sizes}, lambda k: left({a}, k) = left({b}, k)), list_filter({sizes}, lambda k: right({a}, k) = right({b}, k)))"
    return f"CASE WHEN least(length({a}), length({b})) < 2 THEN 0.0 ELSE coalesce(list_max({hits}), 0) / greatest(length({a}), length({b})) END"


def in_desc(n: str, d: str, value: float) -> str:
    return f"CASE WHEN {n} <> '' AND {d} <> '' AND contains({d}, {n}) THEN {value} ELSE 0.0 END"


def token_in(tokens_: str, d: str) -> str:
    return f"CASE WHEN len(list_filter({tokens_}, lambda x: contains({d}, x))) > 0 THEN 0.6 ELSE 0.0 END"


#: Everything about the dictionary's pairs, up to the parts of both scores, in ``parts``.
PAIRS = f"""
WITH RECURSIVE {DICT},
s AS ({features("src")}), t AS ({features("tgt")}),
p AS (
  SELECT s.table_ord AS so, t.table_ord AS tt, s.field_ord AS sf, t.field_ord AS tf, s.table_name AS source_table, s.name AS source_field,
    t.table_name AS target_table, t.name AS target_field, s.lname AS sn, t.lname AS tn, s."desc" AS sd, t."desc" AS td, s.ldesc AS sl, t.ldesc AS tl,
    s.ltype AS sy, t.ltype AS ty, s.tokens AS sk, t.tokens AS tk, s.full_py AS sfp, t.full_py AS tfp, s.abbr_py AS sap, t.abbr_py AS tap, s.name_abbr AS sna, t.name_abbr AS tna,
    s.table_desc AS std, t.table_desc AS ttd, s.type AS s_type, t.type AS t_type
  FROM s, t
),
ip AS (SELECT sn AS a, tn AS b FROM p UNION SELECT sfp, tn FROM p UNION SELECT sap, tn FROM p UNION SELECT tfp, sn FROM p UNION SELECT tap, sn FROM p),
gp AS (SELECT sn AS a, tn AS b FROM p UNION SELECT sd, td FROM p UNION SELECT sl, tl FROM p UNION SELECT sy, ty FROM p UNION SELECT lower(source_table), lower(target_table) FROM p UNION SELECT lower(std), lower(ttd) FROM p),
{INDEL},
{GESTALT},
q AS (
  SELECT p.*, i1.ratio AS r1, g1.ratio AS r2, g2.ratio AS rd, g3.ratio AS rl, g4.ratio AS rt, greatest(i2.ratio, i3.ratio) AS pinyin_st, greatest(i4.ratio, i5.ratio) AS pinyin_ts
  FROM p JOIN indel i1 ON i1.a = sn AND i1.b = tn JOIN gestalt g1 ON g1.a = sn AND g1.b = tn JOIN gestalt g2 ON g2.a = sd AND g2.b = td
    JOIN gestalt g3 ON g3.a = sl AND g3.b = tl JOIN gestalt g4 ON g4.a = sy AND g4.b = ty JOIN indel i2 ON i2.a = sfp AND i2.b = tn JOIN indel i3 ON i3.a = sap AND i3.b = tn
    JOIN indel i4 ON i4.a = tfp AND i4.b = sn JOIN indel i5 ON i5.a = tap AND i5.b = sn
),
one AS (
  SELECT *, 0.3 * r1 + 0.2 * r2 + 0.2 * {jaccard("sk", "tk")} + 0.3 * greatest(pinyin_st, pinyin_ts) AS base_char,
    0.4 * rd + 0.3 * ({in_desc("sn", "tl", 0.5)} + {in_desc("tn", "sl", 0.5)}) + 0.3 * CASE WHEN {groups_hit("sn", "tn", V.BASE_KEYWORDS)} THEN 1.0 ELSE 0.0 END AS base_semantic,
    0.6 * CASE WHEN {members_hit("sy", "ty", V.BASE_TYPES)} THEN 1.0 ELSE 0.0 END + 0.4 * {patterns_hit("sn", "tn", V.BASE_PATTERNS)} AS base_struct,
    CASE WHEN sn = tn THEN 1.0 ELSE 0.25 * r1 + 0.2 * r2 + 0.2 * {jaccard("sk", "tk")} + 0.15 * CASE WHEN contains(sn, tn) OR contains(tn, sn) THEN 0.8 ELSE 0.0 END + 0.1 * {affix("sn", "tn")} END AS enh_char,
    greatest({in_desc("sn", "tl", 0.8)}, {in_desc("tn", "sl", 0.8)}, {token_in("sk", "tl")}, {token_in("tk", "sl")}) AS name_to_desc,
    CASE WHEN {groups_hit("sn", "tn", V.SYNONYMS)} THEN 1.0 ELSE 0.0 END AS keyword,
    CASE WHEN {groups_hit("sn || ' ' || sl", "tn || ' ' || tl", V.CONCEPTS, False)} THEN 0.8 ELSE 0.0 END AS concept,
    CASE WHEN {groups_hit("sy", "ty", V.ENHANCED_TYPES, False)} THEN 1.0 ELSE rt END AS type_score, {patterns_hit("sn", "tn", V.ENHANCED_PATTERNS)} AS pattern_score,
    greatest(CASE WHEN sna = tn THEN 0.9 ELSE 0.0 END, CASE WHEN tna = sn THEN 0.9 ELSE 0.0 END, CASE WHEN sap = tn THEN 0.95 ELSE 0.0 END, CASE WHEN tap = sn THEN 0.95 ELSE 0.0 END) AS abbreviation,
    greatest({relation("sn", "tn")}, {relation("sl", "tl")}) AS synonym
  FROM q
),
two AS (
  SELECT *, 0.4 * base_char + 0.5 * base_semantic + 0.1 * base_struct AS base, 0.3 * rl + 0.25 * name_to_desc + 0.25 * keyword + 0.2 * concept AS enh_semantic,
    0.5 * type_score + 0.3 * pattern_score + 0.2 * 0.5 AS enh_struct,
    CASE WHEN greatest(pinyin_st, pinyin_ts, abbreviation) > 0.7 THEN least(0.3, (greatest(pinyin_st, pinyin_ts, abbreviation) - 0.7) * 0.3 * 1.5) ELSE 0.0 END AS pinyin_bonus,
    CASE WHEN synonym > 0.5 THEN least(0.2, (synonym - 0.5) * 0.2) ELSE 0.0 END AS synonym_bonus
  FROM one
),
parts AS (SELECT *, least(1.0, 0.3 * enh_char + 0.6 * enh_semantic + 0.1 * enh_struct + pinyin_bonus + synonym_bonus) AS enh FROM two)"""
PAIR = "source_table, source_field, target_table, target_field"


def of_parts(**named: str) -> str:
    return f"{PAIRS} SELECT {PAIR}, " + ", ".join(f'round({x}, 6)::DOUBLE AS "{k}"' for k, x in named.items()) + " FROM parts"


TABLES = f"""
WITH RECURSIVE {DICT},
st AS (SELECT table_ord AS so, table_name AS source_table, max(table_desc) AS sd, count(*) AS sn FROM src GROUP BY ALL),
tt AS (SELECT table_ord AS tord, table_name AS target_table, max(table_desc) AS td, count(*) AS tn FROM tgt GROUP BY ALL),
gp AS (SELECT lower(source_table) AS a, lower(target_table) AS b FROM st, tt UNION SELECT lower(sd), lower(td) FROM st, tt),
{GESTALT},
tp AS (
  SELECT so, tord, source_table, target_table, sn, tn, 0.7 * g1.ratio + 0.3 * CASE WHEN sd <> '' AND td <> '' THEN g2.ratio ELSE 0 END AS similarity
  FROM st, tt JOIN gestalt g1 ON g1.a = lower(source_table) AND g1.b = lower(target_table) JOIN gestalt g2 ON g2.a = lower(sd) AND g2.b = lower(td)
)"""
NAMES = """
na AS (SELECT DISTINCT lower(p_name) AS a FROM part),
nb AS (SELECT lower(n_name) AS b FROM nation UNION SELECT lower(c_mktsegment) FROM customer)"""

#: Candidates in order, taken one by one while both ends are free; ``c`` has ord, s, t.
TAKE = """
seq AS (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM {edges}),
take(k, us, ut, ok) AS (
  SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false
  UNION ALL
  SELECT nk, CASE WHEN f THEN list_append(us, s) ELSE us END, CASE WHEN f THEN list_append(ut, t) ELSE ut END, f
  FROM (SELECT us, ut, seq.k AS nk, seq.s AS s, seq.t AS t, NOT list_contains(us, seq.s) AND NOT list_contains(ut, seq.t) AS f FROM take JOIN seq ON seq.k = take.k + 1)
)"""
RULED = f"""{PAIRS},
cand AS (SELECT *, base AS similarity, sn = tn AS exact FROM parts WHERE base >= 0.3),
rest AS (
  SELECT *, source_field AS s, target_field AS t FROM cand WHERE NOT exact
    AND source_field NOT IN (SELECT source_field FROM cand WHERE exact) AND target_field NOT IN (SELECT target_field FROM cand WHERE exact)
),
{TAKE.format(order="similarity DESC, so, tt, sf, tf", edges="rest")},
ruled AS (
  SELECT {PAIR}, similarity, exact, so, tt, sf, tf FROM cand WHERE exact
  UNION ALL SELECT {PAIR}, similarity, exact, so, tt, sf, tf FROM seq JOIN take USING (k) WHERE ok
)"""
EDGES = """
e AS (
  SELECT p_brand AS source_table, 'f_' || (l_partkey % 97) AS source_field, p_type AS target_table, 'F_' || (l_suppkey % 89) AS target_field,
    round(max(l_discount * 5 + l_tax * 5 + l_quantity / 1000), 6) AS similarity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
)"""
EDGE_ORDER = "source_table, target_table, source_field, target_field"

def best_pairs(threshold: float, most: int) -> str:
    return f"""tp AS (
  SELECT DISTINCT so, tt, source_table, target_table, 0.7 * g1.ratio + 0.3 * CASE WHEN std <> '' AND ttd <> '' THEN g2.ratio ELSE 0 END AS ts
  FROM p JOIN gestalt g1 ON g1.a = lower(source_table) AND g1.b = lower(target_table) JOIN gestalt g2 ON g2.a = lower(std) AND g2.b = lower(ttd)
),
best AS (SELECT source_table, target_table, row_number() OVER (ORDER BY ts DESC, so, tt) - 1 AS pair_ord FROM tp WHERE ts >= {threshold} ORDER BY ts DESC, so, tt LIMIT {most})"""


def piped(score: str, pair_threshold: float, most: int, cap: int) -> str:
    """Candidates of the best table pairs at 0.5, through the rule and the cap, in ``top``."""
    return f"""{PAIRS},
{best_pairs(pair_threshold, most)},
cand AS (SELECT parts.*, pair_ord, {score} AS similarity, sn = tn AS exact FROM parts JOIN best USING (source_table, target_table) WHERE {score} >= 0.5),
rest AS (
  SELECT *, source_field AS s, target_field AS t FROM cand WHERE NOT exact
    AND source_field NOT IN (SELECT source_field FROM cand WHERE exact) AND target_field NOT IN (SELECT target_field FROM cand WHERE exact)
),
{TAKE.format(order="similarity DESC, pair_ord, so, tt, sf, tf", edges="rest")},
top AS (
  SELECT {PAIR}, similarity, sn, tn, sl, tl FROM (SELECT * FROM cand WHERE exact UNION ALL SELECT * EXCLUDE (s, t, k, us, ut, ok) FROM seq JOIN take USING (k) WHERE ok)
  ORDER BY exact DESC, similarity DESC, pair_ord, so, tt, sf, tf LIMIT {cap}
)"""


CONFIGURED = "least(1.0, 0.4 * enh_char + 0.5 * enh_semantic + 0.1 * enh_struct + pinyin_bonus + synonym_bonus)"
ASK = "请按以下格式回答：' || chr(10) || '判断：是或否' || chr(10) || '置信度：0到1的小数' || chr(10) || '理由：一句话"
BOTH = "'源字段: ' || source_field || '，描述: ' || sd || '，类型: ' || s_type || chr(10) || '目标字段: ' || target_field || '，描述: ' || td || '，类型: ' || t_type || chr(10) || '" + ASK + "'"
LEAD = "CASE WHEN base >= 0.7 THEN '这两个字段特征相似度很高，请确认是否语义等价。' WHEN base >= 0.4 THEN '这两个字段特征相似度中等，请仔细判断是否语义等价。' ELSE '这两个字段特征相似度较低，请考虑缩写和拼音后判断是否语义等价。' END"

CALLS = """
c AS (
  SELECT event_id, user_id, event_type = 'error' AS bad, round(least(1.0, value / 500), 3) AS sim, 'c_' || event_type AS sn,
    'c_' || CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'name' END AS tn, CASE WHEN event_id % 2 = 0 THEN '客户编号' ELSE '时间' END AS sd,
    CASE WHEN event_id % 5 = 0 THEN '编号' ELSE '日期' END AS td
  FROM events
)"""


def shares(groups: dict[str, list[str]]) -> str:
    return "(" + " OR ".join(f"(({any_of('sn', ws)} OR {any_of('sd', ws)}) AND ({any_of('tn', ws)} OR {any_of('td', ws)}))" for ws in groups.values()) + ")"


HELD = "(contains(sn, tn) OR contains(tn, sn) OR contains(sd, td) OR contains(td, sd))"
RULES = {
    "fixed": [("sn = tn", "true", "0.95"), ("sim > 0.8", "true", "0.8"), ("sim > 0.6", "true", "0.7")],
    "enhanced": [("sn = tn", "true", "0.95"), ("sim >= 0.8", "true", "0.8"), ("sim >= 0.6", "true", "0.7"), ("sim >= 0.4", "true", "0.6")],
    "enhanced_strict": [("sn = tn", "true", "0.95"), ("sim >= 0.8", "true", "0.8"), ("sim >= 0.6", "true", "0.7")],
    "robust": [
        ("sn = tn", "true", "0.95"), (f"sim >= 0.8 AND {shares(V.ROBUST_CONCEPTS)}", "true", "least(0.85, sim + 0.1)"), ("sim >= 0.6", "true", "least(0.75, sim + 0.05)"),
        (f"sim >= 0.4 AND {HELD}", "true", "least(0.7, sim + 0.1)"), ("true", "false", "sim * 0.8"),
    ],
    "ultra": [
        ("sn = tn", "true", "0.95"), (f"sim >= 0.8 AND {shares(V.ULTRA_CONCEPTS)}", "true", "least(0.85, sim + 0.05)"), ("sim >= 0.8", "true", "least(0.8, sim)"),
        ("sim >= 0.6", "true", "least(0.75, sim + 0.05)"), (f"sim >= 0.4 AND {HELD}", "true", "least(0.7, sim + 0.1)"),
    ],
    "similarity": [("sim >= 0.5", "true", "least(0.8, sim + 0.2)"), ("sim >= 0.3", "true", "least(0.7, sim + 0.3)")],
    "similarity_conservative": [("sim >= 0.7", "true", "sim")],
    "pipeline": [("sim > 0.8", "true", "sim")],
    "pipeline_07": [("sim > 0.7", "true", "sim")],
    "pipeline_aggressive": [("sim > CASE WHEN sim > 0.8 THEN 0.6 ELSE 0.4 END", "true", "least(0.8, sim + 0.1)"), ("true", "false", "least(0.8, sim + 0.1)")],
}


def ruled(name: str) -> tuple[str, str]:
    yes = "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b, _ in RULES[name]) + " ELSE false END"
    sure = "CASE " + " ".join(f"WHEN {a} THEN {c}" for a, _, c in RULES[name]) + " ELSE sim END"
    return yes, f"({sure})::DOUBLE"


def fallback(name: str) -> str:
    yes, sure = ruled(name)
    return f'WITH {CALLS} SELECT event_id, {yes} AS "match", round({sure}, 6) AS confidence FROM c'


NL = "chr(10)"
ANSWERS = f"""{CALLS},
a AS (
  SELECT *, CASE event_id % 9 WHEN 0 THEN '判断：是' || {NL} || '置信度：' || sim || {NL} || '理由：语义等价' WHEN 1 THEN '判断：否' || {NL} || '置信度：' || sim || {NL} || '理由：不匹配'
    WHEN 2 THEN '判断: 是' || {NL} || '理由: ok' WHEN 3 THEN '判断：[是]' || {NL} || '置信度：[0.9]' || {NL} || '理由：x' WHEN 4 THEN '错误：429'
    WHEN 5 THEN '判断：是' || {NL} || '置信度：0.9.' || {NL} || '理由：y' WHEN 6 THEN '判断：是' || {NL} || '置信度：0' || {NL} || '理由：z'
    WHEN 7 THEN '结论：是' || {NL} || '置信度：95' || {NL} || '理由：w' ELSE '判断：否' || {NL} || '置信度：0.3' END AS r
  FROM c
),
b AS (
  SELECT *, coalesce(try_cast(nullif(regexp_extract(r, '置信度：([0-9.]+)', 1), '') AS DOUBLE), try_cast(nullif(regexp_extract(r, '置信度:([0-9.]+)', 1), '') AS DOUBLE),
      try_cast(nullif(regexp_extract(r, '置信度: ([0-9.]+)', 1), '') AS DOUBLE), 0.0) AS num,
    contains(r, '判断：是') OR contains(r, '判断:是') OR contains(r, '判断: 是') AS yes,
    trim(coalesce(nullif(regexp_extract(r, '理由：([^\\n]*)', 1), ''), nullif(regexp_extract(r, '理由:([^\\n]*)', 1), ''), '')) AS why
  FROM a
)"""
PARSED = {
    "base": (
        "CASE WHEN starts_with(r, '错误：') THEN false ELSE yes END", "CASE WHEN starts_with(r, '错误：') THEN 0.0 WHEN yes AND num < 0.1 THEN 0.8 ELSE num END",
        "CASE WHEN starts_with(r, '错误：') OR why = '' THEN r ELSE why END",
    ),
    "strict": (
        "yes", "CASE WHEN num <> 0 THEN num WHEN yes THEN greatest(0.7, sim + 0.1) ELSE least(0.4, sim) END",
        "CASE WHEN why <> '' THEN why WHEN length(r) > 100 THEN left(r, 100) || '...' ELSE r END",
    ),
    "lenient": ("y", "CASE WHEN y AND g < 0.5 THEN greatest(0.6, g + 0.2) ELSE g END", "left(CASE WHEN why = '' THEN r ELSE why END, 200)"),
}


def parsed(name: str) -> str:
    inner = "b"
    if name == "lenient":
        y = "(yes OR contains(r, '结论：是') OR regexp_matches(r, '匹配|等价|相同|一致|对应|相似'))"
        g = f"greatest(0.1, least(1.0, CASE WHEN num <> 0 THEN num WHEN {y} THEN greatest(0.7, sim + 0.2) ELSE greatest(0.3, sim) END))"
        inner = f"(SELECT *, {y} AS y, {g} AS g FROM b)"
    m, c, w = PARSED[name]
    return f'WITH {ANSWERS} SELECT event_id, {m} AS "match", round(({c})::DOUBLE, 6) AS confidence, {w} AS reason FROM {inner}'


JUDGED = f"""{CALLS},
j AS (
  SELECT event_id, sim, {ruled("ultra")[0]} AS yes, {ruled("ultra")[1]} AS sure, bad AS by_rule, event_id % 10 = 0 AS cached, sn, tn, sd, td,
    's' || (user_id % 7) AS source_table, 't' || (user_id % 5) AS target_table, 'f' || (user_id % 31) AS source_field, 'g' || (user_id % 29) AS target_field
  FROM c
)"""
TIER = "CASE WHEN sure >= 0.8 THEN 'high' WHEN sure >= 0.6 THEN 'medium' WHEN sure >= 0.4 THEN 'low' ELSE 'potential' END"
BUCKET = "CASE WHEN sure >= 0.9 THEN '0.9-1.0' WHEN sure >= 0.8 THEN '0.8-0.9' WHEN sure >= 0.7 THEN '0.7-0.8' WHEN sure >= 0.6 THEN '0.6-0.7' WHEN sure >= 0.5 THEN '0.5-0.6' ELSE '0.0-0.5' END"
PCT = "printf('%.2f', 100.0 * {a} / {b}) || '%'"
SAID = "printf('%.2f', sim)"
WHY = (
    "CASE WHEN sn = tn THEN '字段名完全匹配 (智能回退)' "
    f"WHEN sim >= 0.8 AND {shares(V.ULTRA_CONCEPTS)} THEN '高相似度(' || {SAID} || ')+业务概念匹配 (智能回退)' WHEN sim >= 0.8 THEN '高相似度(' || {SAID} || ')匹配 (智能回退)' "
    f"WHEN sim >= 0.6 THEN '中等相似度(' || {SAID} || ')匹配 (智能回退)' WHEN sim >= 0.4 AND {HELD} THEN '字段包含关系+相似度(' || {SAID} || ') (智能回退)' "
    f"WHEN sim >= 0.4 THEN '相似度较低(' || {SAID} || ')，判断为不匹配 (智能回退)' ELSE '相似度过低(' || {SAID} || ')，判断为不匹配 (智能回退)' END"
)
KEPT = "c AS (SELECT *, sn || '_' || tn || '_' || (user_id % 50) AS cache_key FROM c0), h AS (SELECT cache_key, min(event_id) AS first_id FROM c WHERE event_id % 4 = 0 AND sim > 0 GROUP BY cache_key)"
CACHED = CALLS.replace("c AS (", "c0 AS (", 1) + ", " + KEPT
FIXED_RULE = "CASE WHEN lower(source_field) = lower(target_field) THEN 0.95 WHEN similarity > 0.8 THEN 0.8 WHEN similarity > 0.6 THEN 0.7 ELSE similarity END"
FIXED_YES = "(lower(source_field) = lower(target_field) OR similarity > 0.6)"

ORACLE: dict[str, str] = {
    "dict_fields": f"WITH {DICT} SELECT 'source' AS side, * FROM src UNION ALL SELECT 'target', * FROM tgt",
    "dict_tables": f"WITH {DICT}, x AS (SELECT 'source' AS side, * FROM src UNION ALL SELECT 'target', * FROM tgt) SELECT side, table_ord, table_name, max(table_desc) AS table_desc, count(*) AS n_fields FROM x GROUP BY side, table_ord, table_name",
    "dict_counts": f"WITH {DICT}, x AS (SELECT 'source' AS side, * FROM src UNION ALL SELECT 'target', * FROM tgt) SELECT side, count(DISTINCT table_name) AS n_tables, count(*) AS n_fields FROM x GROUP BY side",
    "name_tokens": f"SELECT DISTINCT p_name, array_to_string({tokens('p_name')}, '|') AS tokens FROM part",
    "last_table_wins": "SELECT p_brand AS table_name, arg_max(p_type, p_partkey) AS table_desc, max(p_partkey) AS row_ord FROM part GROUP BY p_brand",
    "pinyin_forms": f'WITH {DICT}, x AS (SELECT "desc" AS d FROM src UNION SELECT "desc" FROM tgt) SELECT d AS "desc", {full("d")} AS "full", {abbr("d")} AS abbr FROM x',
    "indel_ratio_pairs": f"WITH RECURSIVE {NAMES}, ip AS (SELECT a, b FROM na, nb), {INDEL} SELECT a, b, round(ratio, 6)::DOUBLE AS ratio FROM indel",
    "gestalt_ratio_pairs": f"WITH RECURSIVE {NAMES}, gp AS (SELECT a, b FROM na, nb), {GESTALT} SELECT a, b, round(ratio, 6)::DOUBLE AS ratio FROM gestalt",
    "token_jaccard_pairs": f"WITH a AS (SELECT DISTINCT p_name AS a, {tokens('p_name')} AS x FROM part), b AS (SELECT b, {tokens('b')} AS y FROM (SELECT DISTINCT p_name || '_' || p_type AS b FROM part)) SELECT a, b, round({jaccard('x', 'y')}, 6)::DOUBLE AS jaccard FROM a, b WHERE len(list_intersect(x, y)) > 0",
    "containment_affix_pairs": f"WITH {NAMES} SELECT a, b, CASE WHEN contains(a, b) OR contains(b, a) THEN 0.8 ELSE 0.0 END::DOUBLE AS contained, round({affix('a', 'b')}, 6)::DOUBLE AS affix FROM na, nb",
    "pinyin_similarity": of_parts(pinyin_st="pinyin_st", pinyin_ts="pinyin_ts"),
    "base_char": of_parts(char="base_char"),
    "base_semantic": of_parts(semantic="base_semantic"),
    "base_struct": of_parts(struct="base_struct"),
    "base_similarity": of_parts(similarity="base"),
    "enhanced_char": of_parts(char="enh_char"),
    "enhanced_semantic": of_parts(semantic="enh_semantic", name_to_desc="name_to_desc", keyword="keyword", concept="concept"),
    "enhanced_struct": of_parts(struct="enh_struct", type="type_score", pattern="pattern_score"),
    "enhanced_bonuses": of_parts(pinyin_bonus="pinyin_bonus", synonym_bonus="synonym_bonus", abbreviation="abbreviation"),
    "enhanced_similarity": of_parts(similarity="enh"),
    "synonym_words": "WITH w(w) AS (VALUES ('id'), ('编号'), ('user name'), ('std no'), ('student'), ('dept'), ('department'), ('time'), ('登录 时间'), ('x')), "
    f"r AS (SELECT a.w AS a, b.w AS b, list_filter(flatten(list_transform(string_split(a.w, ' '), lambda p: list_transform(string_split(b.w, ' '), lambda q: ({relation('p', 'q')})))), lambda v: v > 0) AS l FROM w a, w b) "
    "SELECT a, b, coalesce(l[1], 0)::DOUBLE AS score FROM r",
    "table_similarity": f"{TABLES} SELECT source_table, target_table, round(similarity, 6)::DOUBLE AS similarity FROM tp",
    "table_pairs_topk": f"{TABLES} SELECT row_number() OVER (ORDER BY similarity DESC, so, tord) - 1 AS pair_ord, source_table, target_table, round(similarity, 6)::DOUBLE AS similarity FROM tp WHERE similarity >= 0.2 ORDER BY similarity DESC, so, tord LIMIT 5",
    "first_n_table_pairs": f"{TABLES} SELECT so * 2 + tord AS pair_ord, source_table, target_table FROM tp WHERE so < 2 AND tord < 2",
    "chosen_table_pairs": "SELECT i * 2 + j AS pair_ord, s AS source_table, t AS target_table FROM (VALUES (1, 'orders'), (2, 'part')) a(i, s), (VALUES (1, 'nation'), (2, 'lineitem')) b(j, t)",
    "pair_counts": f"{TABLES} SELECT sum(sn * tn)::BIGINT AS n_pairs FROM tp",
    "candidates_threshold": f"{PAIRS} SELECT {PAIR}, round(base, 6)::DOUBLE AS similarity FROM parts WHERE base >= 0.5",
    "exact_and_rest": f"WITH {EDGES} SELECT lower(source_field) = lower(target_field) AS exact, count(*) AS n FROM e GROUP BY ALL",
    "greedy_candidates": f"{RULED} SELECT {PAIR}, round(similarity, 6)::DOUBLE AS similarity, exact FROM ruled",
    "judge_cap": f"{RULED} SELECT {PAIR}, round(similarity, 6)::DOUBLE AS similarity, exact FROM ruled ORDER BY exact DESC, ruled.similarity DESC, so, tt, sf, tf LIMIT 4",
    **{f"fallback_{k}": fallback(k) for k in RULES},
    **{f"parse_{k}": parsed(k) for k in PARSED},
    "cache_keys": f"{PAIRS}, x AS (SELECT *, source_table || '_' || source_field || '_' || target_table || '_' || target_field AS k FROM parts WHERE base >= 0.5) "
    f"SELECT {PAIR}, k AS key_base, 'fixed_' || k AS key_fixed, 'robust_' || k AS key_robust, 'enhanced_' || k AS key_enhanced, source_field || '_' || target_field || '_' || printf('%.3f', base) AS key_fields FROM x",
    "response_content": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type WHEN event_id % 3 = 0 THEN 't' END AS content FROM events",
    "status_messages": "SELECT CASE event_id % 7 WHEN 0 THEN 'API密钥无效' WHEN 1 THEN '访问被拒绝' WHEN 2 THEN '请求频率过高' WHEN 3 THEN '服务器内部错误' WHEN 4 THEN '网关错误' WHEN 5 THEN '服务不可用' ELSE 'HTTP错误 418' END AS message, count(*) AS n FROM events GROUP BY 1",
    "cache_hits": f"WITH {CACHED} SELECT event_id, cache_key, first_id FROM c JOIN h USING (cache_key)",
    "cache_misses": f"WITH {CACHED} SELECT event_id, cache_key FROM c WHERE cache_key NOT IN (SELECT cache_key FROM h)",
    "candidates_above": f"WITH {EDGES} SELECT {PAIR}, similarity FROM e WHERE similarity > 0.5",
    "judged_through_cache": f"WITH {CALLS}, k AS (SELECT *, 'fixed_s' || (user_id % 7) || '_' || sn || '_t' || (user_id % 5) || '_' || tn AS cache_key, user_id % 7 IN (1, 4) AS cached FROM c) "
    "SELECT event_id, cache_key, cached, CASE WHEN cached THEN true ELSE lower(sn) = lower(tn) OR sim > 0.6 END AS \"match\", "
    "round(CASE WHEN cached THEN 0.9 WHEN lower(sn) = lower(tn) THEN 0.95 WHEN sim > 0.8 THEN 0.8 WHEN sim > 0.6 THEN 0.7 ELSE sim END, 6)::DOUBLE AS confidence FROM k",
    "layer_counts": f"WITH {CALLS} SELECT CASE WHEN sim >= 0.7 THEN 'high' WHEN sim >= 0.4 THEN 'medium' ELSE 'low' END AS layer, count(*) AS n FROM c GROUP BY 1",
    "tier_assign": f"WITH {JUDGED} SELECT event_id, {TIER} AS confidence_category FROM j WHERE yes",
    "tier_counts": f"WITH {JUDGED}, x AS (SELECT {TIER} AS confidence_category FROM j WHERE yes) SELECT v.c AS confidence_category, count(x.confidence_category) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('potential')) v(c) LEFT JOIN x ON x.confidence_category = v.c GROUP BY 1",
    "tier_first_k": f"WITH {JUDGED}, x AS (SELECT {TIER} AS confidence_category, row_number() OVER (PARTITION BY {TIER} ORDER BY sure DESC, event_id) AS place, event_id FROM j WHERE yes) SELECT * FROM x WHERE place <= 3",
    "accepted_results": f"WITH {JUDGED} SELECT event_id, round(sure, 6) AS confidence FROM j WHERE yes AND sure >= 0.7",
    "confidence_histogram": f"WITH {JUDGED}, x AS (SELECT {BUCKET} AS b FROM j) SELECT v.b AS bucket, count(x.b) AS n FROM (VALUES ('0.9-1.0'), ('0.8-0.9'), ('0.7-0.8'), ('0.6-0.7'), ('0.5-0.6'), ('0.0-0.5')) v(b) LEFT JOIN x ON x.b = v.b GROUP BY 1",
    "table_pair_match_counts": f"WITH {JUDGED} SELECT source_table || ' <-> ' || target_table AS table_pair, count(*) AS n FROM j WHERE yes AND sure >= 0.7 GROUP BY 1",
    "match_statistics": f"WITH {JUDGED}, {DICT}, d AS (SELECT (SELECT count(DISTINCT table_name) FROM src) AS source_tables, (SELECT count(DISTINCT table_name) FROM tgt) AS target_tables, (SELECT count(*) FROM src) AS source_fields, (SELECT count(*) FROM tgt) AS target_fields), "
    "k AS (SELECT count(DISTINCT source_table) AS participating_source_tables, count(DISTINCT (source_table, source_field)) AS participating_source_fields, count(DISTINCT target_table) AS participating_target_tables, "
    "count(DISTINCT (target_table, target_field)) AS participating_target_fields, count(*) AS candidates, count(*) FILTER (WHERE yes) AS matched, count(*) FILTER (WHERE yes AND sure >= 0.7) AS high_confidence FROM j) "
    "SELECT d.*, k.*, source_fields * target_fields AS possible_pairs, round((1 - candidates / (source_fields * target_fields)) * 100, 6) AS pruned_percent, "
    f"regexp_replace({PCT.format(a='high_confidence', b='source_fields')}, '(\\d)(\\d{{3}})\\.', '\\1,\\2.') AS source_match_rate, regexp_replace({PCT.format(a='high_confidence', b='target_fields')}, '(\\d)(\\d{{3}})\\.', '\\1,\\2.') AS target_match_rate, "
    f"{PCT.format(a='high_confidence', b='candidates')} AS candidate_match_rate FROM d, k",
    "judge_counters": f"WITH {JUDGED} SELECT count(*) AS n, count(*) FILTER (WHERE NOT by_rule) AS succeeded, count(*) FILTER (WHERE by_rule) AS fell_back, 0::BIGINT AS failed, count(*) FILTER (WHERE cached) AS from_cache, "
    "round(100.0 * count(*) FILTER (WHERE NOT by_rule) / count(*), 6) AS success_rate, round(100.0 * count(*) FILTER (WHERE cached) / count(*), 6) AS cache_rate FROM j",
    "fallback_split": f"WITH {JUDGED} SELECT CASE WHEN by_rule THEN 'rule' ELSE 'endpoint' END AS \"by\", event_id FROM j WHERE yes",
    "matching_bases": f"WITH {JUDGED} SELECT event_id, ({WHY}) || '；特征相似度: ' || printf('%.2f', sim) || '；LLM置信度: ' || printf('%.2f', sure) AS basis FROM j",
    "batch_numbers": "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 5 AS batch FROM events",
    "running_success_rate": "WITH x AS (SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS n, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (ORDER BY event_id)::BIGINT AS n_ok FROM events) SELECT *, round(n_ok / n, 6) AS rate FROM x WHERE n % 5 = 0",
    "retry_schedule": "SELECT (n - 1)::INT AS attempt, 2.0 * pow(2, n - 1) AS seconds FROM range(1, 4) t(n)",
    "rate_control_fold": "WITH RECURSIVE l AS (SELECT user_id % 20 AS endpoint, event_type <> 'error' AS ok, event_id % 2 = 0 AS limited, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events), "
    "f(endpoint, k, delay, streak) AS (SELECT DISTINCT endpoint, 0::BIGINT, 3.0::DOUBLE, 0 FROM l UNION ALL SELECT f.endpoint, l.k, CASE WHEN ok AND streak + 1 >= 5 THEN greatest(1.0, 0.8 * delay) WHEN NOT ok AND limited THEN least(30.0, 2 * delay) ELSE delay END, "
    "CASE WHEN ok AND streak + 1 < 5 THEN streak + 1 ELSE 0 END FROM f JOIN l ON l.endpoint = f.endpoint AND l.k = f.k + 1) SELECT endpoint, round(arg_max(delay, k), 6) AS delay, arg_max(streak, k) AS streak, max(k) AS n FROM f GROUP BY endpoint",
    "results_union": f"WITH {JUDGED} SELECT source_table AS t, source_field AS f FROM j WHERE yes UNION SELECT target_table, target_field FROM j WHERE yes",
    "flagship": f"{RULED.replace('base >= 0.3', 'base >= 0.5')} SELECT {PAIR}, round(similarity, 6)::DOUBLE AS similarity, {FIXED_YES} AS \"match\", round({FIXED_RULE}, 6)::DOUBLE AS confidence FROM ruled",
}

ORACLE |= {
    "candidates_of_best_pairs": f"{PAIRS}, {best_pairs(0.2, 5)} SELECT pair_ord, {PAIR}, round(base, 6)::DOUBLE AS similarity FROM parts JOIN best USING (source_table, target_table) WHERE base >= 0.3",
    "prompts": f"{PAIRS} SELECT {PAIR}, '判断两个数据库字段是否语义等价。' || chr(10) || {BOTH} AS short, {LEAD} || chr(10) || {BOTH} AS adaptive FROM parts WHERE base >= 0.5",
    "pipeline_pruned": f'{piped("base", 0.3, 50, 100)} SELECT {PAIR}, round(similarity, 6)::DOUBLE AS similarity, similarity > 0.8 AS "match", round(similarity, 6)::DOUBLE AS confidence FROM top',
    "pipeline_stable": f"{piped(CONFIGURED, 0.2, 15, 30)}, c AS (SELECT {PAIR}, similarity AS sim, sn, tn, sl AS sd, tl AS td FROM top), "
    f"j AS (SELECT *, {ruled('ultra')[0]} AS yes, {ruled('ultra')[1]} AS sure FROM c) SELECT {PAIR}, round(sim, 6)::DOUBLE AS similarity, round(sure, 6)::DOUBLE AS confidence, {TIER} AS confidence_category FROM j WHERE yes",
    "enriched_results": f"""{RULED.replace("base >= 0.3", "base >= 0.5").replace("seq AS", "seq1 AS").replace("seq.", "seq1.").replace("JOIN seq ", "JOIN seq1 ").replace("FROM seq ", "FROM seq1 ").replace("take", "take1")},
x AS (
  SELECT ruled.*, sd, td, s_type, t_type, {FIXED_RULE.replace("similarity", "ruled.similarity").replace("source_field", "ruled.source_field").replace("target_field", "ruled.target_field")} AS sure,
    ruled.source_table || '.' || ruled.source_field AS s, ruled.target_table || '.' || ruled.target_field AS t
  FROM ruled JOIN p USING ({PAIR})
),
y AS (SELECT * FROM x WHERE sure >= 0.7 AND (similarity > 0.6 OR lower(source_field) = lower(target_field))),
{TAKE.format(order="sure DESC, exact DESC, similarity DESC", edges="y")}
SELECT {PAIR}, sd AS source_field_desc, s_type AS source_field_type, td AS target_field_desc, t_type AS target_field_type, round(similarity, 6)::DOUBLE AS similarity, round(sure, 6)::DOUBLE AS confidence,
  'LLM调用失败，基于相似度' || printf('%.2f', similarity) || '的回退判断。错误：；特征相似度: ' || printf('%.2f', similarity) || '；LLM置信度: ' || printf('%.2f', sure) AS matching_basis
FROM seq JOIN take USING (k) WHERE ok""",
}
