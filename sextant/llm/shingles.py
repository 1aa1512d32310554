"""Sets of hashed five-word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
ODD = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
#: A random number for each byte; A-Z count as a-z.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
_inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        for k, base in enumerate((ODD, _inverse)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Hash of each span of ``raw``, from prefix sums of a polynomial; ``byte`` has a number for each byte."""
    _grow(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte[raw] * _powers[0][: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and how many words each text has. Words end at ASCII white space."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return span_hashes(raw, starts, ends, BYTE), np.diff(np.searchsorted(starts, offsets))


def chunks(sizes: list[int], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of texts of about ``most`` bytes at most, one text at least."""
    begin = 0
    while begin < len(sizes):
        end, size = begin, 0
        while end < len(sizes) and (end == begin or size + sizes[end] < most):
            size += sizes[end] + 1
            end += 1
        yield begin, end
        begin = end


def sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; a text of one to four words has its whole sequence as one, an empty one none."""
    for i, j in chunks([len(t) for t in texts]):
        yield from _sets(texts[i:j])


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    hashed, counts = word_hashes(texts)
    n = len(hashed)
    rolled = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = rolled * ODD + hashed[k : k + len(rolled)]
    rolled = mix(rolled)
    at = 0
    for c in counts.tolist():
        if c >= WORDS:
            s = np.sort(rolled[at : at + c - WORDS + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif c:
            whole = np.uint64(c)
            for h in hashed[at : at + c]:
                whole = np.uint64((int(whole) * int(ODD) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            yield mix(np.array([whole]) ^ np.uint64(0xABCD))
        else:
            yield np.zeros(0, np.uint64)
        at += c


def set_hash(s: np.ndarray) -> int:
    """Of a set, as a signed 64-bit number: equal sets have equal ones."""
    return int(np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64)) if len(s) else 0
