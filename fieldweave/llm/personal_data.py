r"""Personal data: expressions propose spans, checksums confirm them, context scores them.

Base kinds (email, ip, card, phone) follow their fixed expressions, leftmost and without
overlap for each kind; a match that fails its validator is dropped and the scan goes on
after it. Further kinds (iban by country length and mod-97, ssn by its number ranges, secret
by a mix of characters as random as keys are) stay only if validator and context lift their
score to ``min_score``. Base spans are kept at any score.

The executors see only texts that hold a digit or an @, the others are settled by the scan.
Scans are linear in the text: each one starts at a character that must be in a match.
Defined results: a null text is an empty one and has no spans; offsets count code points,
the end is exclusive; repeated rows are scanned each by itself; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import collections
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
N_BASE = 4
#: Score of a confirmed span before its context; what a context word adds.
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.5, "ssn": 0.4, "secret": 0.4}
#: What a checksum adds to a kind that has one and is not of the base.
PROOF_BONUS = 0.3
CONTEXT_BONUS, CONTEXT_CHARS = 0.2, 48
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
    "secret": ("token", "secret", "passw", "api key", "api_key", "apikey", "private", "credential", "auth", "bearer", "access"),
}
#: Lengths of the IBANs of each country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

SPANS = T.ArrayType(
    T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()), T.StructField("text", T.StringType()),
    ])
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails from its first digit fails from every later one, so only its first digit starts a scan.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in sorted(set(IBAN_LENGTH.values()))}
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ in turn, with the run of local characters before it, if a domain follows."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST[IBAN_LENGTH[m[1]]].match(text, m.end()) if m[1] in IBAN_LENGTH else None
        if rest and mod97(text[m.start() : rest.end()]):
            yield m.start(), rest.end()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def random_looking(word: str) -> bool:
    """Whether digits and letters are mixed as in random keys: both make up a tenth at least,
    they take turns often, and the characters are many (3 bits of entropy each)."""
    digits, letters, n = sum(map(str.isdigit, word)), sum(map(str.isalpha, word)), len(word)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(word, word[1:]))
    entropy = -sum(k / n * math.log2(k / n) for k in collections.Counter(word).values())
    return 10 * digits >= n and 10 * letters >= n and 5 * turns >= n and entropy >= 3.0


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _SECRET.finditer(text):
        if random_looking(m[0]):
            yield m.span()


_FINDERS = (emails, _ips, _cards, _phones, _ibans, _ssns, _secrets)
_PROVEN = ("iban",)


def find_spans(text: str | None, min_score: float = 0.55) -> list[tuple[int, int, int, float]]:
    """(start, kind's number, end, score) in the order of start, then kind."""
    text = text or ""
    out = []
    for k, finder in enumerate(_FINDERS):
        for start, end in finder(text):
            near = (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()
            score = BASE_SCORE[KINDS[k]] + CONTEXT_BONUS * any(w in near for w in CONTEXT[KINDS[k]]) + PROOF_BONUS * (KINDS[k] in _PROVEN)
            if k < N_BASE or score >= min_score:
                out.append((start, k, end, min(1.0, score)))
    return sorted(out)


@F.pandas_udf(SPANS)
def spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"kind": KINDS[k], "start": s, "end": e, "score": c, "text": t[s:e]} for s, k, e, c in find_spans(t)] if t else [])


def _candidate(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike("[0-9@]"), text)


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (kind, start, end, score, text)."""
    return docs.select("doc_id", spans_udf(_candidate(F.col("text"))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    found = docs.select("doc_id", spans_udf(_candidate(F.col("text"))).alias("s"))
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("s", lambda x: x["kind"].isin(*KINDS[:N_BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:N_BASE]]
    lowest = F.array_min(F.transform("s", lambda x: x["score"])).alias("min_score")
    return found.select(
        "doc_id", *counts, F.size("s").cast("long").alias("n_found"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"), lowest
    )


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if not text:
            return text
        kept, at = [], 0
        for start, k, end, _ in find_spans(text):
            if end > at:
                kept += [text[at : max(at, start)], f"<{KINDS[k]}>" * (start >= at)]
                at = end
        return "".join([*kept, text[at:]])

    return texts.map(one)


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind; of spans that overlap, the
    first is named and all are taken out."""
    return docs.withColumn("text", F.when(_candidate(F.col("text")).isNotNull(), _masked(_candidate(F.col("text")))).otherwise(F.col("text")))


def brute_sha(spans: list[tuple[int, int, int, float]]) -> str:
    base = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans if k < N_BASE]
    return hashlib.sha256(",".join(base).encode()).hexdigest()
