"""Similarity of field pairs, in the base and the enhanced family.

Whatever depends on one field only (lower case, pinyin, which word groups and patterns hit)
is computed once for the field; a rule of the form "some group hits both" is then one AND
of two bit masks. The rest of a pair's score is arithmetic on columns, with one Arrow call
for the string ratios.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratios
from ..functions import vocabulary as V
from ..functions.pinyin import pinyin, pinyin_initials

FIELD = ["table_ord", "field_ord", "table_name", "table_desc", "name", "desc", "type", "tokens", "name_pinyin_abbr", "desc_pinyin_abbr"]


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _mask(hits: Iterable[Column]) -> Column:
    """Bit k set where the k-th test holds."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(h, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, h in enumerate(hits)])


def group_mask(text: Column, groups: dict[str, list[str]], keyed: bool = True) -> Column:
    """Groups of which a member (or the key, if ``keyed``) is a substring of ``text``."""
    return _mask(_any(text.contains(w) for w in ([k] if keyed else []) + ws) for k, ws in groups.items())


def pattern_mask(text: Column, patterns: dict[str, float]) -> Column:
    return _mask(text.rlike(p) for p in patterns)


def member_mask(text: Column, groups: dict[str, list[str]]) -> Column:
    """Groups that list ``text`` itself."""
    return _mask(text.isin(*ws) for ws in groups.values())


def both(s: Column, t: Column) -> Column:
    return s.bitwiseAND(t) != 0


def best_pattern(s: Column, t: Column, patterns: dict[str, float]) -> Column:
    hit = s.bitwiseAND(t)
    return F.greatest(*[F.when(hit.bitwiseAND(F.lit(1 << k)) != 0, F.lit(v)).otherwise(F.lit(0.0)) for k, v in enumerate(patterns.values())], F.lit(0.0))


def with_features(fields: DataFrame) -> DataFrame:
    """Each field's own share of the scores."""
    name, desc, kind = F.lower("name"), F.lower("desc"), F.lower("type")
    return fields.select(
        *FIELD,
        name.alias("lname"), desc.alias("ldesc"), kind.alias("ltype"),
        F.lower(pinyin(F.col("desc"))).alias("full"), F.lower(pinyin_initials(F.col("desc"))).alias("abbr"),
        group_mask(name, V.BASE_KEYWORDS).alias("m_keyword"), member_mask(kind, V.BASE_TYPES).alias("m_type"),
        pattern_mask(name, V.BASE_PATTERNS).alias("m_pattern"),
        group_mask(name, V.SYNONYMS).alias("m_synonym"), group_mask(F.lower(F.concat_ws(" ", "name", "desc")), V.CONCEPTS, keyed=False).alias("m_concept"),
        group_mask(kind, V.ENHANCED_TYPES, keyed=False).alias("m_type_in"), pattern_mask(name, V.ENHANCED_PATTERNS).alias("m_pattern_in"),
    )


def paired(source: DataFrame, target: DataFrame, table_pairs: DataFrame | None = None, chosen_rows: int | None = None) -> DataFrame:
    """Structs ``s`` and ``t`` of every field pair, or of those in ``table_pairs``
    (source_table, target_table, pair_ord). Target dictionaries are metadata; the smaller
    side is broadcast by Spark's own size check, not by a hint."""
    s = source.select(F.struct(*source.columns).alias("s"))
    t = target.select(F.struct(*target.columns).alias("t"))
    if table_pairs is None:
        return s.crossJoin(t).withColumn("pair_ord", F.lit(0).cast("long"))
    chosen = table_pairs.select("source_table", "target_table", "pair_ord")
    return (
        s.join(chosen, F.col("s.table_name") == F.col("source_table")).join(t, F.col("t.table_name") == F.col("target_table"))
        .select("s", "t", "pair_ord")
    )


def _col(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def with_ratios(pairs: DataFrame) -> DataFrame:
    args = [_col(x, c) for c in ("lname", "desc", "ltype") for x in "st"] + [_col("s", "full"), _col("s", "abbr"), _col("t", "full"), _col("t", "abbr")]
    return pairs.withColumn("r", ratios.pair_ratios(*args))


def with_bounds(pairs: DataFrame) -> DataFrame:
    """``r`` as ``with_ratios`` names it, holding what no ratio of these lengths exceeds."""
    bound = ratios.length_bound

    def filled(a: Column, b: Column) -> Column:
        return F.when((a != "") & (b != ""), bound(a, b)).otherwise(F.lit(0.0))

    def near(a: str, b: str) -> Column:
        return F.greatest(*[filled(_col(a, x), _col(b, "lname")) for x in ("full", "abbr")])

    name, desc, lower = (bound(_col("s", "lname"), _col("t", "lname")), *(filled(_col("s", c), _col("t", c)) for c in ("desc", "ldesc")))
    bounds = {
        "indel_name": name, "gestalt_name": name, "gestalt_desc": desc, "gestalt_desc_lower": lower, "gestalt_type": bound(_col("s", "ltype"), _col("t", "ltype")),
        "pinyin_st": near("s", "t"), "pinyin_ts": near("t", "s"),
    }
    return pairs.withColumn("r", F.struct(*[v.alias(k) for k, v in bounds.items()]))


Part = Callable[[], Column]


def base_char() -> Column:
    near = F.greatest(_col("r", "pinyin_st"), _col("r", "pinyin_ts"))
    return 0.3 * _col("r", "indel_name") + 0.2 * _col("r", "gestalt_name") + 0.2 * ratios.token_jaccard(_col("s", "tokens"), _col("t", "tokens")) + 0.3 * near


def name_in_desc() -> Column:
    def half(a: str, b: str) -> Column:
        n, d = _col(a, "lname"), _col(b, "ldesc")
        return F.when((n != "") & (d != "") & d.contains(n), F.lit(0.5)).otherwise(F.lit(0.0))

    return half("s", "t") + half("t", "s")


def one_if(test: Column, value: float = 1.0) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def base_semantic() -> Column:
    return 0.4 * _col("r", "gestalt_desc") + 0.3 * name_in_desc() + 0.3 * one_if(both(_col("s", "m_keyword"), _col("t", "m_keyword")))


def base_struct() -> Column:
    return 0.6 * one_if(both(_col("s", "m_type"), _col("t", "m_type"))) + 0.4 * best_pattern(_col("s", "m_pattern"), _col("t", "m_pattern"), V.BASE_PATTERNS)


def checked_weights(weights: tuple[float, float, float]) -> tuple[float, float, float]:
    """The base family refuses weights that do not add up to one."""
    if not 0.99 <= sum(weights) <= 1.01:
        raise ValueError(f"weights must add up to 1, not {sum(weights)}")
    return weights


def scaled_weights(weights: tuple[float, float, float]) -> tuple[float, float, float]:
    """The enhanced family scales them."""
    total = sum(weights)
    return weights if 0.99 <= total <= 1.01 else tuple(w / total for w in weights)


def base_similarity(weights: tuple[float, float, float] = V.BASE_WEIGHTS) -> Column:
    c, s, t = checked_weights(weights)
    return c * base_char() + s * base_semantic() + t * base_struct()


def enhanced_char() -> Column:
    a, b = _col("s", "lname"), _col("t", "lname")
    mixed = (
        0.25 * _col("r", "indel_name") + 0.2 * _col("r", "gestalt_name") + 0.2 * ratios.token_jaccard(_col("s", "tokens"), _col("t", "tokens"))
        + 0.15 * ratios.containment(a, b) + 0.1 * ratios.affix_ratio(a, b)
    )
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(mixed)


def name_to_desc() -> Column:
    def whole(a: str, b: str) -> Column:
        n, d = _col(a, "lname"), _col(b, "ldesc")
        return one_if((n != "") & (d != "") & d.contains(n), 0.8)

    def token(a: str, b: str) -> Column:
        return one_if(F.exists(_col(a, "tokens"), lambda x: _col(b, "ldesc").contains(F.lower(x))), 0.6)

    return F.greatest(whole("s", "t"), whole("t", "s"), token("s", "t"), token("t", "s"))


def keyword_hit() -> Column:
    return one_if(both(_col("s", "m_synonym"), _col("t", "m_synonym")))


def concept_hit() -> Column:
    return one_if(both(_col("s", "m_concept"), _col("t", "m_concept")), 0.8)


def enhanced_semantic() -> Column:
    """A weighted mean in which the description counts only if both sides have one."""
    rest = 0.25 * name_to_desc() + 0.25 * keyword_hit() + 0.2 * concept_hit()
    has = (_col("s", "desc") != "") & (_col("t", "desc") != "")
    return F.when(has, (0.3 * _col("r", "gestalt_desc_lower") + rest) / F.lit(0.3 + 0.25 + 0.25 + 0.2)).otherwise(rest / F.lit(0.25 + 0.25 + 0.2))


def enhanced_type() -> Column:
    a, b = _col("s", "ltype"), _col("t", "ltype")
    return (
        F.when((a == "") | (b == ""), F.lit(0.3)).when(both(_col("s", "m_type_in"), _col("t", "m_type_in")), F.lit(1.0))
        .otherwise(_col("r", "gestalt_type"))
    )


def enhanced_pattern() -> Column:
    return best_pattern(_col("s", "m_pattern_in"), _col("t", "m_pattern_in"), V.ENHANCED_PATTERNS)


def enhanced_struct() -> Column:
    return 0.5 * enhanced_type() + 0.3 * enhanced_pattern() + 0.2 * F.lit(0.5)


def abbreviation_match() -> Column:
    """A side's pinyin initials equal to the other's name."""
    def of(a: str, b: str) -> list[Column]:
        n = _col(b, "lname")
        return [one_if((_col(a, c) != "") & (n != "") & (F.lower(_col(a, c)) == n), v) for c, v in (("name_pinyin_abbr", 0.9), ("desc_pinyin_abbr", 0.95))]

    return F.greatest(*of("s", "t"), *of("t", "s"))


def pinyin_bonus(boost: float = V.PINYIN_BOOST) -> Column:
    near = F.greatest(_col("r", "pinyin_st"), _col("r", "pinyin_ts"), abbreviation_match())
    return F.when(near > 0.7, F.least(F.lit(0.3), (near - 0.7) * 0.3 * boost)).otherwise(F.lit(0.0))


def _word_relation(a: Column, b: Column) -> Column:
    """0.8 for two words of one synonym group, else 0.7 for an abbreviation and its word."""
    same = _any(a.isin(k, *ws) & b.isin(k, *ws) for k, ws in V.SYNONYMS.items())
    short = _any(((a == k) & b.isin(*ws)) | ((b == k) & a.isin(*ws)) for k, ws in V.ABBREVIATIONS.items())
    return F.when(same, F.lit(0.8)).when(short, F.lit(0.7)).otherwise(F.lit(0.0))


def synonym_match(a: Column, b: Column) -> Column:
    """The relation of the first related words, in the order of the words of ``a``, then ``b``."""
    split = lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")
    scores = F.flatten(F.transform(split(a), lambda x: F.transform(split(b), lambda y: _word_relation(x, y))))
    return F.coalesce(F.get(F.filter(scores, lambda v: v > 0), 0), F.lit(0.0))


def synonym_bonus() -> Column:
    has = (_col("s", "ldesc") != "") & (_col("t", "ldesc") != "")
    best = F.greatest(synonym_match(_col("s", "lname"), _col("t", "lname")), F.when(has, synonym_match(_col("s", "ldesc"), _col("t", "ldesc"))).otherwise(F.lit(0.0)))
    return F.when(best > 0.5, F.least(F.lit(0.2), (best - 0.5) * 0.2)).otherwise(F.lit(0.0))


def enhanced_similarity(weights: tuple[float, float, float] = V.ENHANCED_WEIGHTS, boost: float = V.PINYIN_BOOST) -> Column:
    c, s, t = scaled_weights(weights)
    return F.least(F.lit(1.0), c * enhanced_char() + s * enhanced_semantic() + t * enhanced_struct() + pinyin_bonus(boost) + synonym_bonus())


def similarity(family: str, weights: tuple[float, float, float] | None = None, boost: float = V.PINYIN_BOOST) -> Column:
    if family == "base":
        return base_similarity(weights or V.BASE_WEIGHTS)
    if family == "enhanced":
        return enhanced_similarity(weights or V.ENHANCED_WEIGHTS, boost)
    raise ValueError(f"no family {family!r}")


PAIR = ["pair_ord", "source_table_ord", "target_table_ord", "source_ord", "target_ord", "source_table", "source_field", "target_table", "target_field"]


def pair_keys() -> list[Column]:
    return [
        F.col("pair_ord"), _col("s", "table_ord").alias("source_table_ord"), _col("t", "table_ord").alias("target_table_ord"),
        _col("s", "field_ord").alias("source_ord"), _col("t", "field_ord").alias("target_ord"),
        _col("s", "table_name").alias("source_table"), _col("s", "name").alias("source_field"),
        _col("t", "table_name").alias("target_table"), _col("t", "name").alias("target_field"),
    ]


def similarity_pairs(
    source: DataFrame, target: DataFrame, family: str = "base", weights: tuple[float, float, float] | None = None,
    boost: float = V.PINYIN_BOOST, table_pairs: DataFrame | None = None, threshold: float | None = None,
) -> DataFrame:
    """The similarity matrix in long form: PAIR columns and ``similarity``; with a
    ``threshold`` only pairs that reach it."""
    pairs = paired(with_features(source), with_features(target), table_pairs)
    if threshold is not None:
        # Similarities grow with each ratio, so pairs whose bounds fall short never get to Python.
        pairs = with_bounds(pairs).where(similarity(family, weights, boost) >= F.lit(threshold - 1e-9)).drop("r")
    scored = with_ratios(pairs).select(*pair_keys(), similarity(family, weights, boost).alias("similarity"))
    return scored if threshold is None else scored.where(F.col("similarity") >= threshold)
