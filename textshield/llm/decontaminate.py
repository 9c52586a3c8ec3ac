"""Benchmark decontamination with an FM-index per shard of the corpus.

The items of a benchmark are the stated query set. Each batch of documents is a shard: its words
become numbers of the benchmark's vocabulary, runs of known words at least as long as the shortest
phrase enter the shard's index (no other place can match), and all phrases are searched backward
in it at once. Spans that overlap or touch are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textshield.llm.blocks import ALNUM, LOWER, batches, hashed_words, ragged, text_bytes, word_spans
from textshield.llm.fm_index import FMIndex
from textshield.llm.shipping import ship
from textshield.session import write_once

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Texts that are cut at a time.
CUT_BYTES = 1 << 20
BLOCK_BYTES = 64 << 20
STATE = "key {key}, text string, n_words long, starts array<long>, ends array<long>, items array<string>"


class Phrases:
    """The distinct phrases of one block of items as numbers of the block's own vocabulary."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        words, edges, counts = hashed_words(texts, ALNUM)
        self.vocabulary = np.sort(np.array(list(set(words.tolist())), np.uint64))
        numbers = np.searchsorted(self.vocabulary, words)
        self.ids, self.groups = [None if i is None else str(i) for i in ids], []
        size = np.minimum(counts, window)
        for length in sorted(set(size[size > 0].tolist())):
            items = np.flatnonzero(size == length)
            item, place = ragged(counts[items] - length + 1)
            rows = numbers[(edges[items][item] + place)[:, None] + np.arange(length)]
            distinct, which = np.unique(rows, axis=0, return_inverse=True)
            which = which.reshape(-1)
            order = np.argsort(which, kind="stable")
            owners = np.bincount(which, minlength=len(distinct))
            self.groups.append((length, distinct, items[item][order], np.cumsum(owners) - owners, owners))
        self.shortest = min((g[0] for g in self.groups), default=0)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def search(self, words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (first word, words, item) of occurrences in the texts of a shard."""
        empty = np.zeros(0, np.int64)
        if not self.groups or not len(words):
            return empty, empty, empty
        numbers = self.numbers(words)
        known = numbers >= 0
        cut = np.zeros(len(words) + 1, bool)
        cut[edges], cut[-1], cut[0] = True, True, True
        cut[1:-1] |= known[1:] != known[:-1]
        borders = np.flatnonzero(cut)
        keep = known[borders[:-1]] & (np.diff(borders) >= self.shortest)
        begin, length = borders[:-1][keep], np.diff(borders)[keep]
        if not len(begin):
            return empty, empty, empty
        run, place = ragged(length)
        source = begin[run] + place
        index = FMIndex(numbers[source], length, len(self.vocabulary))
        found = []
        for size, phrases, items, first, owners in self.groups:
            phrase, at = index.locate(*index.search(phrases))
            hit, nth = ragged(owners[phrase])
            found.append((source[at][hit], np.full(len(hit), size), items[first[phrase][hit] + nth]))
        return tuple(np.concatenate(c) for c in zip(*found))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans that overlap or touch, made one."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    fresh = np.concatenate([[True], starts[1:] > reach[:-1]]) if len(starts) else np.zeros(0, bool)
    last = np.concatenate([fresh[1:], [True]]) if len(starts) else fresh
    return starts[fresh], reach[last]


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``key, text, n_words``, merged spans of words ``starts, ends`` and ``items``.

    A word is a run of digits, letters and anything outside ASCII, A-Z lower-cased. A phrase is
    ``window`` consecutive words of an item, or all of an item with fewer. ``items`` are ids as
    strings, sorted, each once. Null or empty texts and items have no words; repeated documents are
    searched on their own, repeated items count under each id (a null id counts for words, not in
    ``items``), extra columns are ignored, without items nothing is hit. Items are sent to the tasks
    in blocks of at most ``BLOCK_BYTES`` of text (or one item); every block is searched in every
    document, in a pass of its own over the stored result of the pass before.
    """
    chosen = items.select(F.col(item).alias("id"), F.col(item_text).cast("string").alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    state = docs.select(
        F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<long>").alias("starts"), F.array().cast("array<long>").alias("ends"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = STATE.format(key=state.schema["key"].dataType.simpleString())
    for number in range(blocks):
        block = chosen.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number).toArrow()
        phrases = Phrases(block.column(0).to_pylist(), block.column(1).combine_chunks(), window)
        state = state.mapInArrow(_pass(ship(docs.sparkSession, phrases)), schema)
        if number + 1 < blocks:
            state = write_once(state, "decontamination")
    return state


def _pass(load):
    def searched(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = load()
        for batch in batches(stream, "text", SHARD_BYTES):
            words, edges, counts = hashed_words(batch.column(1), ALNUM)
            first, size, item = phrases.search(words, edges)
            doc = np.searchsorted(edges, first, "right") - 1
            order = np.lexsort((first, doc))
            first, size, item, doc = first[order], size[order], item[order], doc[order]
            starts, ends, names = (batch.column(i).to_pylist() for i in (3, 4, 5))
            border = np.flatnonzero(np.diff(doc)) + 1
            for d, f, s, i in zip(*(np.split(x, border) for x in (doc, first, size, item))):
                if not len(d):
                    continue
                d = int(d[0])
                f = f - edges[d]
                low, high = _merged(np.concatenate([f, starts[d]]).astype(np.int64), np.concatenate([f + s, ends[d]]).astype(np.int64))
                starts[d], ends[d] = low.tolist(), high.tolist()
                names[d] = sorted({*names[d], *(phrases.ids[k] for k in set(i.tolist()) if phrases.ids[k] is not None)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(starts, pa.list_(pa.int64())),
                 pa.array(ends, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
                ["key", "text", "n_words", "starts", "ends", "items"],
            )

    return searched


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Per document: ``key, n_words, n_hit, n_items, items_sha256, contaminated``; see ``find_items``."""
    found = find_items(docs, items, key, **options)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


def remove_items(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with every merged span cut out of ``text``.

    A span is cut from the start of its first word to the end of its last. Documents that are left
    without a word by it go; all others stay as they are, also those that had no word before.
    """
    kept = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(c) for c in kept]).alias("key"), F.col(text).alias("text"))
    found = find_items(packed, items, "key", "text", **options)
    schema = "key " + found.schema["key"].dataType.simpleString() + ", text string, starts array<long>, ends array<long>"

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text", CUT_BYTES):
            texts, starts, ends = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i in range(len(texts)):
                if starts[i]:
                    texts[i] = without(texts[i], starts[i], ends[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], batch.schema.names)

    clean = found.select("key", "text", "starts", "ends", "n_words").filter(
        (F.size("starts") == 0) | (F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x) < F.col("n_words"))
    )
    out = clean.select("key", "text", "starts", "ends").mapInArrow(cut, schema)
    return out.select(*[F.col("text") if c == text else F.col("key").getField(c).alias(c) for c in docs.columns])


def without(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the given spans of words."""
    data, offsets = text_bytes(pa.array([text]))
    low, high = word_spans(LOWER[data], offsets, ALNUM)
    raw, out, at = data.tobytes(), [], 0
    for s, e in zip(starts, ends):
        out.append(raw[at : low[s]])
        at = int(high[e - 1])
    return b"".join([*out, raw[at:]]).decode()

