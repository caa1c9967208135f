"""Language of words in code-switched text, by a linear-chain conditional random field.

Every word's label has an emission score, the sum of weights of its byte n-grams of two to
four (those with the bounding spaces are its affixes) and, if it is in the learned lexicon,
of the word itself; transitions between labels are learned. Marginals come from the
forward-backward recursions, run for all texts of a batch as one chain that restarts at
each text, in blocks: products of a block's matrices first, then the blocks' boundary
vectors, then the words in all blocks at once. No Python code runs for a word.

Training takes a bounded sample of labelled rows: of each label the ``DOCS_PER_LABEL``
distinct texts that come first by a hash of the text, of a text longer than
``SEGMENT_CHARS`` a stretch of that length from a place drawn by the same hash, and of a
label's words random segments of at most ``WORDS_PER_LABEL`` words in all. Words are
labelled by their text's label; the segments are dealt into mixed sequences, so that labels
switch. Every label is learned. A document's label is the one with the largest expected
share of its words, which is also its score; ``word_runs`` gives the labels of the words.

Defined results: a null text or one without a letter is `und` with score 0; with no labelled
text to learn from every text is `und`; ties go to the label first in the alphabet; repeated
rows are labelled each by itself; an empty table gives an empty result; further columns,
the table's own labels among them, never reach a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shingles import WIDE, chunks, mix, stream, word_hashes

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
#: The sample: texts of each label, characters of a text, words of a label.
DOCS_PER_LABEL, SEGMENT_CHARS, WORDS_PER_LABEL = 120, 50_000, 100_000
LEXICON = 1500
EPOCHS, RATE, DECAY = 30, 0.15, 1e-4
BLOCK = 256

_U = np.uint64
_KEYS = stream(31, max(ORDERS))
_MAYBE_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Model:
    labels: list[str]
    grams: np.ndarray  # (orders * BUCKETS, labels)
    lexicon: np.ndarray  # ascending word hashes
    words: np.ndarray  # (lexicon, labels)
    transitions: np.ndarray  # (labels, labels), log
    start: np.ndarray  # (labels,), log


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; numerals such as ² or Ⅷ are not."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram buckets of the joined words, and where each word's begin. A word stands between
    spaces, so its first and last n-grams differ from those inside."""
    buffer = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    space = np.flatnonzero(buffer == 32)
    begin, sizes = space[:-1], np.diff(space) + 1
    wide, parts = buffer.astype(_U), []
    for o, n in enumerate(ORDERS):
        per = np.maximum(sizes - n + 1, 0)
        pos = np.repeat(begin - (np.cumsum(per) - per), per) + np.arange(per.sum())
        with np.errstate(over="ignore"):
            h = np.zeros(len(pos), _U)
            for j in range(n):
                h = h + wide[pos + j] * _KEYS[j]
            parts.append((np.repeat(np.arange(len(words)), per), (mix(h) & _U(BUCKETS - 1)).astype(np.int64) + o * BUCKETS))
    of, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(of, kind="stable")
    return grams[order], np.searchsorted(of[order], np.arange(len(words)))


def encode(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's first word (one more at the end), each word's number among the distinct
    ones, and of those the hashes, n-gram buckets, and where each one's begin."""
    hashes, at = word_hashes(raws)
    distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    words = b" ".join(raws).split()
    grams, offset = spelled([words[i] for i in first]) if len(words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return at, number, distinct, grams, offset


def emissions(model: Model, hashes: np.ndarray, grams: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """(words, labels) log potentials."""
    if not len(hashes):
        return np.zeros((0, len(model.labels)))
    out = np.add.reduceat(model.grams[grams], offset, axis=0)
    if len(model.lexicon):
        at = np.searchsorted(model.lexicon, hashes)
        at[at == len(model.lexicon)] = 0
        hit = model.lexicon[at] == hashes
        out[hit] += model.words[at[hit]]
    return out


def forward_backward(scores: np.ndarray, fresh: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = BLOCK):
    """Marginals of each word, and the expected label pairs of neighbouring words. The chain
    restarts from ``start`` where ``fresh``; ``fresh[0]`` is set."""
    n, m = scores.shape
    if not n:
        return np.zeros((0, m)), np.zeros((m, m))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    step, first = np.exp(transitions), np.exp(start)
    first = first / first.sum()
    nb = -(-n // block)
    padded = np.ones((nb * block, m))
    padded[:n] = e
    e = padded.reshape(nb, block, m)
    restart = np.ones(nb * block, bool)  # what fills the last block is apart from the words
    restart[:n] = fresh
    restart = restart.reshape(nb, block)

    # Products of each block's matrices.
    product = np.broadcast_to(np.eye(m), (nb, m, m)).copy()
    for t in range(block):
        moved = product @ step
        at = restart[:, t]
        if at.any():
            moved[at] = product[at].sum(axis=2, keepdims=True) * first
        product = moved * e[:, t, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)

    into = np.empty((nb, m))  # forward vector before each block
    out_of = np.empty((nb, m))  # backward vector after each block
    v = first
    for b in range(nb):
        into[b] = v
        v = v @ product[b]
        v = v / v.sum()
    v = np.ones(m)
    for b in range(nb - 1, -1, -1):
        out_of[b] = v
        v = product[b] @ v
        v = v / v.sum()

    alpha = np.empty((nb, block, m))
    a = into
    for t in range(block):
        moved = a @ step
        at = restart[:, t]
        if at.any():
            moved[at] = first
        a = moved * e[:, t]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    gamma = np.empty((nb, block, m))
    pairs = np.zeros((m, m))
    b_next = out_of
    for t in range(block - 1, -1, -1):
        g = alpha[:, t] * b_next
        gamma[:, t] = g / g.sum(axis=1, keepdims=True)
        weighed = e[:, t] * b_next
        before = alpha[:, t - 1] if t else into
        live = ~restart[:, t] & (np.arange(nb) * block + t < n)
        if live.any():
            joint = before[live][:, :, None] * step * weighed[live][:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        moved = weighed @ step.T
        at = restart[:, t]
        if at.any():
            moved[at] = (weighed[at] @ first)[:, None]
        b_next = moved / moved.sum(axis=1, keepdims=True)
    return gamma.reshape(-1, m)[:n], pairs


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model of (text, label) pairs, by Adam on the chain's likelihood."""
    labels = sorted({label for _, label in samples})
    m = len(labels)
    empty = Model(labels, np.zeros((len(ORDERS) * BUCKETS, m)), np.zeros(0, _U), np.zeros((0, m)), np.zeros((m, m)), np.zeros(m))
    rng = np.random.default_rng(seed)
    raws = [lowered(text) for text, _ in samples]
    gold = [labels.index(label) for _, label in samples]
    at, number, values, g, offset = encode(raws)
    if not len(number) or m < 2:
        return empty
    y = np.repeat(gold, np.diff(at))
    # Segments of 5 to 60 words in random order: labels switch between them.
    cuts = np.cumsum(rng.integers(5, 61, size=len(y) // 5 + 1))
    segments = np.split(np.arange(len(y)), cuts[cuts < len(y)])
    drawn, taken = [], np.zeros(m, np.int64)
    for k in rng.permutation(len(segments)):
        label = y[segments[k][0]]
        if taken[label] < WORDS_PER_LABEL:
            taken[label] += len(segments[k])
            drawn.append(segments[k])
    order = np.concatenate(drawn)
    number, y, n_words = number[order], y[order], len(order)
    fresh = np.zeros(n_words, bool)
    fresh[::500] = True

    share = np.stack([np.bincount(number, weights=y == k, minlength=len(values)) for k in range(m)], axis=1)
    best = np.sort(np.unique(np.concatenate([np.argsort(-share[:, k], kind="stable")[:LEXICON] for k in range(m)])))
    model = Model(labels, empty.grams, values[best], np.zeros((len(best), m)), empty.transitions, empty.start)

    onehot = np.eye(m)[y]
    pair_gold = np.zeros((m, m))
    live = ~fresh[1:]
    np.add.at(pair_gold, (y[:-1][live], y[1:][live]), 1)
    weights = [model.grams, model.words, model.transitions, model.start]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    of_gram = np.repeat(np.arange(len(values)), np.diff(np.append(offset, len(g))))
    for epoch in range(1, EPOCHS + 1):
        marginal, pairs = forward_backward(emissions(model, values, g, offset)[number], fresh, model.transitions, model.start)
        diff = onehot - marginal
        of_word = np.stack([np.bincount(number, weights=diff[:, k], minlength=len(values)) for k in range(m)], axis=1)
        d_grams = np.stack([np.bincount(g, weights=of_word[of_gram, k], minlength=len(model.grams)) for k in range(m)], axis=1)
        d_words = of_word[best]
        for w, d, (mean, square) in zip(weights, (d_grams, d_words, pair_gold - pairs, diff[fresh].sum(axis=0)), state, strict=True):
            d = d / n_words - DECAY * w
            mean += 0.1 * (d - mean)
            square += 0.01 * (d * d - square)
            w += RATE * (mean / (1 - 0.9**epoch)) / (np.sqrt(square / (1 - 0.99**epoch)) + 1e-8)
    return model


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def label_texts(model: Model, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first index, marginals of the words, each text's first word) for runs of texts."""
    for first, raws in chunks([t and t.lower() for t in texts], WIDE):
        at, number, distinct, grams, offset = encode(raws)
        fresh = np.zeros(len(number), bool)
        fresh[at[:-1][np.diff(at) > 0]] = True
        marginal, _ = forward_backward(emissions(model, distinct, grams, offset)[number], fresh, model.transitions, model.start)
        yield first, marginal, at


def _predict(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in batches:
            texts = batch["text"].tolist()
            label, score = ["und"] * len(texts), np.zeros(len(texts))
            if model.labels:
                for first, marginal, at in label_texts(model, texts):
                    sums = np.concatenate([np.zeros((1, len(model.labels))), np.cumsum(marginal, axis=0)])
                    for k in range(len(at) - 1):
                        n = at[k + 1] - at[k]
                        if n and has_letter(texts[first + k]):
                            share = (sums[at[k + 1]] - sums[at[k]]) / n
                            best = int(share.argmax())
                            label[first + k], score[first + k] = model.labels[best], min(1.0, max(0.0, float(share[best])))
            yield batch.drop(columns="text").assign(lang_pred=label, score=score)

    return run


def sample(labelled: DataFrame, text: str = "text", label: str = "lang") -> list[tuple[str, str]]:
    """The training rows; the same whatever the order of the table or the number of copies."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(label).alias("label"), F.xxhash64(F.lit("draw"), F.col(text)).alias("h")
    )
    # Each task keeps the first of its own rows of a label before anything is shuffled.
    first = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    drawn = rows.select("label", "h").distinct().withColumn("r", first).where(F.col("r") <= DOCS_PER_LABEL).select("label", "h")
    start = F.pmod(F.xxhash64(F.lit("start"), F.col("text")), F.length("text") - SEGMENT_CHARS + 1).cast("int")
    part = F.when(F.length("text") > SEGMENT_CHARS, F.substring("text", start + 1, F.lit(SEGMENT_CHARS))).otherwise(F.col("text"))
    texts = rows.join(F.broadcast(drawn), ["label", "h"], "left_semi").groupBy("label", "h").agg(F.min(part).alias("text"))
    return sorted((r.text, r.label) for r in texts.select("text", "label").collect())


def predict(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``."""
    rows = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])
    parts = (model.labels, model.grams, model.lexicon, model.words, model.transitions, model.start)
    return rows.mapInPandas(_predict(docs.sparkSession.sparkContext.broadcast(parts)), schema)


def _runs(shared: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["doc_id"].to_numpy()
            for first, marginal, at in label_texts(model, texts) if model.labels else ():
                best = marginal.argmax(axis=1)
                new = np.concatenate([[True], best[1:] != best[:-1]])
                new[at[:-1][np.diff(at) > 0]] = True
                starts = np.flatnonzero(new)
                text = np.searchsorted(at, starts, "right") - 1
                ends = np.append(starts[1:], len(best))
                score = np.add.reduceat(marginal[np.arange(len(best)), best], starts) / (ends - starts) if len(starts) else starts
                yield pd.DataFrame({
                    "doc_id": ids[first + text], "start": starts - at[text], "end": ends - at[text],
                    "lang_pred": [model.labels[k] for k in best[starts]], "score": np.minimum(score, 1.0),
                })

    return run


def word_runs(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, start, end, lang_pred, score): the runs of words of one language in each
    text, by the words' marginals; ``score`` is their mean."""
    parts = (model.labels, model.grams, model.lexicon, model.words, model.transitions, model.start)
    named = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    return named.mapInPandas(_runs(docs.sparkSession.sparkContext.broadcast(parts)), "doc_id long, start long, end long, lang_pred string, score double")


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def digest(docs: DataFrame) -> DataFrame:
    """Each document's prediction by a model of the documents that are not held out."""
    held = F.coalesce(held_out(), F.lit(False))
    model = train(sample(docs.where(~held)))
    return predict(docs.select("doc_id", "text"), model, ["doc_id", held.alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")
