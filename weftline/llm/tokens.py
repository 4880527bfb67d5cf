"""Words of many texts at once, as arrays of hashes and positions.

Works on the UTF-8 bytes of an Arrow column. A word's hash is a polynomial of
its bytes modulo 2^64, taken from running sums, then scrambled; equal words have
equal hashes wherever they stand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from weftline.llm.common import odd_constants, splitmix

BASE = 0x100000001B3  # odd, so that it has an inverse modulo 2^64
BLOCK = 1 << 20

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32

#: Which bytes separate words, for the word rules in use.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False


@dataclass
class Words:
    """Words in text order; ``first[d]:first[d + 1]`` are those of text d."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray
    heads: list[np.ndarray]


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order and don't overlap."""
    return head_hashes(data, starts, ends, ())[0]


def head_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the spans, and for each of ``heads`` of the spans' first so many bytes."""
    out = [np.empty(len(starts), np.uint64) for _ in range(1 + len(heads))]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(max(BLOCK, high - low) + 2)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        begun, scale = sums[s], inverse[s]
        for k, made in enumerate(out):
            stop = np.minimum(e, s + heads[k - 1]) if k else e
            made[i:j] = (sums[stop] - begun) * scale + (stop - s).astype(np.uint64)
        i = j
    return [splitmix(x) for x in out]


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross from one text into the next."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(inside)]
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    before[edges] = False
    edges = edges[edges > 0]
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray = LOWER, heads: tuple[int, ...] = ()) -> Words:
    """Maximal runs of bytes that aren't separators, after ``fold`` has mapped each byte."""
    folded = fold[data]
    starts, ends = spans(~separators[folded], offsets)
    first = np.searchsorted(starts, offsets, side="left")
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes, *of_heads = head_hashes(folded, starts, ends, heads)
    return Words(hashes, starts, ends, text, first, of_heads)


def runs_of(w: Words, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n consecutive words within a text, and the index of their first words."""
    total = len(w.hashes)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mult = odd_constants(n, seed)
    h = np.zeros(total - n + 1, np.uint64)
    for i in range(n):
        h += (w.hashes[i : total - n + 1 + i] ^ (mult[i] >> np.uint64(7))) * mult[i]
    at = np.flatnonzero(w.text[: total - n + 1] == w.text[n - 1 :])
    return splitmix(h[at]), at


def first_of_each(keys: np.ndarray) -> np.ndarray:
    """True where a value stands for the first time."""
    fresh = np.zeros(len(keys), bool)
    if len(keys):
        fresh[np.unique(keys, return_index=True)[1]] = True
    return fresh


def lengths_in_characters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return leads[offsets[1:]] - leads[offsets[:-1]]
