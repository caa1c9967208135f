"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are runs of bytes outside the ASCII white space of the contracts, A-Z lowered. The
bytes of a batch stand in one buffer; a word's hash is a difference of prefix sums of
byte codes times powers of an odd base, mixed; a shingle's is a mixed combination of its
words' hashes. No Python code runs for a word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

K = 5
#: Bytes that are hashed together at most, but for longer single texts; a worker holds some
#: 60 times as many. WIDE is for operators with more work for each run of texts.
CHUNK, WIDE = 1 << 19, 1 << 21

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two multiply-xorshift rounds), a bijection."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_BYTE = stream(1, 256)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = stream(2, 64)
_LENGTH = stream(3, 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK + 4096), base, dtype=_U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=_U)
    return _powers[base][:n]


def chunks(texts: Sequence[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of encoded, lower-cased texts of about ``most`` bytes, each with its first index."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and size + len(raw) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield first, held


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more at the end)."""
    buffer = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(r) + 1 for r in raws), dtype=np.int64, count=len(raws))
    at = np.concatenate([[0], np.cumsum(sizes)])
    with np.errstate(over="ignore"):
        solid = (buffer != 32) & (buffer - np.uint8(9) > 4)
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if solid[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.empty(len(buffer) + 1, _U)
        sums[0] = 0
        codes = _BYTE.take(buffer, mode="clip", out=sums[1:])
        codes *= _power(_BASE, len(buffer))
        np.cumsum(codes, out=codes)
        words = mix((sums[end] - sums[start]) * _power(_INVERSE, len(buffer))[start])
    return words, np.searchsorted(start, at)


def shingle_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of ``k`` words; fewer words are one run, none give none."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        m = min(n, k)
        total = np.zeros(n - m + 1, _U) + _LENGTH[m]
        for j in range(m):
            total = total + words[j : n - m + 1 + j] * _PLACE[j]
        return mix(total)


def shingle_runs(texts: Sequence[str | None], k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of the text's shingles in order) of every text."""
    for first, raws in chunks(texts):
        words, at = word_hashes(raws)
        joint = shingle_hashes(words, k)
        for j in range(len(raws)):
            a, b = at[j], at[j + 1]
            yield first + j, joint[a : b - k + 1] if b - a >= k else shingle_hashes(words[a:b], k)


def shingle_sets(texts: Sequence[str | None], k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """(index, ascending distinct shingle hashes) of every text."""
    for i, run in shingle_runs(texts, k):
        yield i, np.unique(run)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a)) if len(b) else 0
