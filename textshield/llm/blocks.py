"""Texts of an Arrow batch as one array of bytes, and the words in it.

All functions work on whole batches with numpy. Memory follows the size of a batch, which Spark
bounds by ``spark.sql.execution.arrow.maxBytesPerBatch``, or of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
SPAN = 1 << 16


def flags(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over the 256 byte values that is true inside the given ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Bytes of words that white space separates.
SOLID = ~flags((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of digits, letters and everything outside ASCII.
ALNUM = flags((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Lower-cases A-Z and leaves all other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _mixed(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


TABLE = _mixed(256, 71)
POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(SPAN - 1, _mixed(1, 72)[0] | np.uint64(1))]))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``most`` units together, or one larger text alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; no word crosses the edge of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = solid[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; equal bytes give equal hashes in every task."""
    out = np.empty(len(starts), np.uint64)
    edges = np.concatenate([[0], np.cumsum(ends - starts)])
    for first, last in pieces(edges, CHUNK):
        length = (ends - starts)[first:last]
        begin = edges[first:last] - edges[first]
        place = np.arange(int(length.sum())) - np.repeat(begin, length)
        values = TABLE[data[np.repeat(starts[first:last], length) + place]]
        values *= POWERS[place & (SPAN - 1)]
        out[first:last] = np.add.reduceat(values, begin) + length.astype(np.uint64)
    return mix(out)


def hashed_words(column: pa.Array, solid: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, the n + 1 offsets of texts in them, and the words' start offsets.

    Letters A-Z are lower-cased first.
    """
    data, offsets = text_bytes(column)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last in pieces(offsets, 2 * CHUNK):
        part = LOWER[data[offsets[first] : offsets[last]]]
        local = offsets[first : last + 1] - offsets[first]
        starts, ends = word_spans(part, local, solid)
        hashes.append(word_hashes(part, starts, ends))
        counts[first:last] = np.diff(np.searchsorted(starts, local))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return words, np.concatenate([[0], np.cumsum(counts)]), counts


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths, the run and the place in it of each element."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def batches(stream: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut and join record batches so that the texts of one have about ``most`` bytes."""
    held, size = [], 0
    for batch in stream:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        for first, last in pieces(offsets, most):
            part = int(offsets[last] - offsets[first])
            if held and size + part > most:
                yield joined(held)
                held, size = [], 0
            held.append(batch.slice(first, last - first))
            size += part
    if held:
        yield joined(held)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)
