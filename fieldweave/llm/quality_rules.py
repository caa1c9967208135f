"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once for each document. The ledger stores the measurements and
one bit for each rule that failed; a policy is a mask over those bits, so applying another
version, or asking what a rule alone costs, reads the ledger and never the texts.

Defined results: a null text measures as an empty one and fails ``few_words``; repeated
rows are measured each by itself; an empty table gives an empty ledger; other columns of
the input are not read and do not clash, as the ledger holds its own columns only.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .text import SPACE_CHARS, UPPER, let, lines, n_of, without, words

SYMBOLS = "#*$%&|<>"
#: Positions take the low bits of a sort key, a hash the rest.
POSITION_BITS = 24


def _covered(starts: Column) -> Column:
    """Words inside the 3-word windows that begin at the ascending ``starts``."""
    after = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.lit(1 << 40).cast("long")))
    total = F.aggregate(F.zip_with(starts, after, lambda a, b: F.least(b - a, F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(starts) > 0, total).otherwise(F.lit(0).cast("long"))


def _repeat_starts(w: Column) -> Column:
    """Starts of the windows that occur twice or more, by sorting packed longs.

    The sort key is 40 bits of the window's hash above 24 bits of its start; neighbours
    with equal hash bits are compared word by word. Null if two different windows share
    their hash bits (or the text is too long for 24 bits): the caller then sorts the words.
    """
    low = F.lit((1 << POSITION_BITS) - 1)
    at = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    keys = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long")),
    )

    def pairs(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(
            F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda p: F.shiftright(p["a"], POSITION_BITS) == F.shiftright(p["b"], POSITION_BITS),
        )
        return F.transform(same, lambda p: F.struct(p["a"].bitwiseAND(low).alias("a"), p["b"].bitwiseAND(low).alias("b")))

    def starts(p: Column) -> Column:
        clash = F.exists(p, lambda x: at(x["a"].cast("int")) != at(x["b"].cast("int")))
        both = F.concat(F.transform(p, lambda x: x["a"]), F.transform(p, lambda x: x["b"]))
        return F.when(~clash, F.sort_array(F.array_distinct(both)))

    return F.when(F.size(w) < (1 << POSITION_BITS), let(let(F.sort_array(keys), pairs), starts))


def _repeat_starts_by_words(w: Column) -> Column:
    """The same starts from a sort of the windows' words themselves."""
    keys = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.get(w, i).alias("x"), F.get(w, i + 1).alias("y"), F.get(w, i + 2).alias("z"), i.cast("long").alias("i")),
    )

    def starts(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(
            F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda p: (p["a"]["x"] == p["b"]["x"]) & (p["a"]["y"] == p["b"]["y"]) & (p["a"]["z"] == p["b"]["z"]),
        )
        both = F.concat(F.transform(same, lambda p: p["a"]["i"]), F.transform(same, lambda p: p["b"]["i"]))
        return F.sort_array(F.array_distinct(both))

    return let(F.sort_array(keys), starts)


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that are found twice or more in the word array ``w``."""

    def of(w: Column) -> Column:
        quick = let(_repeat_starts(w), lambda s: F.when(s.isNotNull(), _covered(s)).otherwise(let(_repeat_starts_by_words(w), _covered)))
        return F.when(F.size(w) >= 4, quick).otherwise(F.lit(0).cast("long"))

    return let(w, of)


def measure(docs: DataFrame, text: str = "text", id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """One row of measurements for each document; ``whole`` carries its input row in ``_row``."""
    carried = [F.struct(*docs.columns).alias("_row")] if whole else []
    t = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(lines(F.col(text)), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        let(words(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r"))).alias("_w"),
        let(worded, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("_l"),
        F.length(without(t, SPACE_CHARS)).cast("long").alias("word_chars"),
        n_of(t, SYMBOLS).cast("long").alias("n_symbols"),
        n_of(t, UPPER).cast("long").alias("n_upper"),
        n_of(t, "!").cast("long").alias("n_exclaim"),
        *carried,
    ).select(
        "doc_id",
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.d").alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"),
        "n_upper",
        "n_exclaim",
        *(["_row"] if whole else []),
    )


#: Rule k fails where the expression over the measurements holds; k is its bit for good.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("upper_case", "10 * n_upper > 3 * word_chars"),
    ("exclamations", "2 * n_exclaim > n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE_POLICY = Policy("base-1", BASE)
POLICY = Policy("full-1", tuple(BIT))


def ledger(docs: DataFrame, text: str = "text", id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """Measurements with ``fail_bits``, bit k set where rule k failed."""
    bits = None
    for name, fails in RULES:
        bit = F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, text, id_col, whole).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """Adds ``kept``: no rule of the policy failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def filter_documents(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The rows of ``docs`` that the policy keeps."""
    return apply_policy(ledger(docs, whole=True), policy).where("kept").select("_row.*")


def ablations(entries: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone (those a policy
    without it would keep besides), and what that policy keeps. The ledger is first counted
    by its masked bits, at most 2^rules rows, and the bits of those rows are then summed."""
    n = F.col("n")
    counts = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    each = counts.withColumn("r", F.explode(rules)).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(hit, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, n).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when((F.col("bits") == 0) | alone, n).otherwise(0)).alias("n_kept_without"),
    )


def store_ledger(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The ledger, written once to the shared folder: policies and ablations read it there."""
    return (scratch or Scratch(docs.sparkSession, "ledger")).keep(ledger(docs), "ledger")


def compare_policies(entries: DataFrame, policies: tuple[Policy, ...] = (BASE_POLICY, POLICY)) -> DataFrame:
    """The ablations of several policy versions over one stored ledger, by ``policy``."""
    each = [ablations(entries, p).withColumn("policy", F.lit(p.version)) for p in policies]
    return functools.reduce(DataFrame.unionByName, each)


def digest(docs: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """The stored ledger's entry of each document with the base verdict and the policy's."""
    entries = apply_policy(store_ledger(docs), policy)
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE_POLICY.mask)) != 0).alias("base_failed"),
        "kept", "fail_bits",
    )
