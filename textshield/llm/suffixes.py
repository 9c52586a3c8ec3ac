"""Sampled suffixes of texts and exact repeats of long byte strings, with numpy.

Of all suffixes those are sampled that start at a local minimum: in every string of ``length``
bytes, the place whose first ``PREFIX`` bytes have the smallest fingerprint. The choice depends on
the string alone, so equal strings choose the same place and two of them can only be found where
two sampled suffixes agree in their prefix.
"""

from __future__ import annotations

import numpy as np

from textshield.llm.blocks import TABLE, mix, ragged

PREFIX = 100
CHUNK = 1 << 18
PLACE_BITS = np.uint64(20)
PLACE_MASK = np.uint64((1 << 20) - 1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        factor = BASE if name == "up" else INVERSE
        steps = np.full(max(n, CHUNK + 4096), factor)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def fingerprints(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``length`` bytes from each place on."""
    n = len(data) - length + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * _power("up", len(data)), out=sums[1:])
    return mix((sums[length:] - sums[:n]) * _power("down", n))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of ``width`` values from each place on."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def sampled(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Sampled suffixes: text, place, prefix fingerprint, and the first and last start they stand for.

    A start is the place of a string of ``length`` bytes inside a text; each is stood for by the
    suffix that its string chooses. In a run of one byte, or of a short period, suffixes with one
    prefix follow each other at every period; they are joined, see ``_joined``.
    """
    out = []
    width = length - PREFIX + 1
    for begin in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[begin : begin + CHUNK + length - 1]
        marks = fingerprints(part, PREFIX)
        keyed = (marks & ~PLACE_MASK) | np.arange(len(marks), dtype=np.uint64)
        chosen = (sliding_minimum(keyed, width) & PLACE_MASK).astype(np.int64)
        starts = begin + np.arange(len(chosen))
        text = np.searchsorted(offsets, starts, "right") - 1
        inside = starts + length <= offsets[text + 1]
        fresh = inside.copy()
        fresh[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1] | (text[1:] != text[:-1])
        first = np.flatnonzero(fresh)
        if not len(first):
            continue
        stop = inside.copy()
        stop[:-1] &= fresh[1:] | ~inside[1:]
        last = np.flatnonzero(stop)
        where = text[first]
        out.append((where, begin + chosen[first] - offsets[where], marks[chosen[first]], begin + first - offsets[where], begin + last - offsets[where]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none, none
    return _joined(*(np.concatenate(c) for c in zip(*out)), width)


def _joined(text: np.ndarray, place: np.ndarray, prefix: np.ndarray, first: np.ndarray, last: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Suffixes of one prefix whose starts follow each other, joined up to twice ``width`` starts.

    The first of such a run stays by itself, so that a run has two suffixes of its prefix at least.
    How a run is cut depends on its text alone.
    """
    follows = np.zeros(len(text), bool)
    follows[1:] = (text[1:] == text[:-1]) & (prefix[1:] == prefix[:-1]) & (first[1:] == last[:-1] + 1)
    same = follows.copy()
    same[1:] &= place[1:] == place[:-1]
    # the input is cut into chunks, so a suffix can come in two parts
    begin, end = np.flatnonzero(~same), np.flatnonzero(np.append(~same[1:], True))
    text, place, prefix, first, last, follows = text[begin], place[begin], prefix[begin], first[begin], last[end], follows[begin]
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(len(text))))
    step = (first - first[head]) // width
    fresh = ~follows
    fresh[1:] |= ~follows[:-1] | (step[1:] != step[:-1])
    begin, end = np.flatnonzero(fresh), np.flatnonzero(np.append(fresh[1:], True))
    return text[begin], place[begin], prefix[begin], first[begin], last[end]


def starts_in(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For contexts of at least ``length`` bytes: context, place in it and fingerprint of every string."""
    size = np.array([len(c) for c in contexts], np.int64)
    edges = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    context, place = ragged(size - length + 1)
    marks = np.empty(len(context), np.uint64)
    at = edges[context] + place
    for begin in range(0, len(data), CHUNK):
        low, high = np.searchsorted(at, [begin, begin + CHUNK])
        if low < high:
            marks[low:high] = fingerprints(data[begin : begin + CHUNK + length - 1], length)[at[low:high] - begin]
    return context, place, marks


def repeated(marks: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(marks)
    ordered = marks[order]
    same = np.zeros(len(marks) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(marks), bool)
    out[order] = same[1:] | same[:-1]
    return out
