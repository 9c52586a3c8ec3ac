"""Phrase collocations by marginalising counts of the longest windows.

Every word heads one window: itself and the words that follow it in its piece, padded at the end.
Only these windows are counted; ROLLUP sums them over shorter and shorter prefixes, which gives the
count of every phrase, since each occurrence of a phrase begins exactly one window.

A window is cut where two or three words follow each other too seldom for any phrase of the support
to hold them. That is told from first counts of pairs, and of triples of such pairs, in a fixed
number of buckets: the count of a bucket is no less than that of any run in it, so no occurrence of
a phrase with enough occurrences is lost, and the broadcast bit maps have the same size for every
corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from textshield.llm.blocks import LOWER, batches, flags, mix, text_bytes, word_hashes, word_spans
from textshield.llm.shipping import ship
from textshield.session import write_once

LONGEST, SUPPORT, TOP = 5, 100, 2_000
#: Runs of words that are sifted; each length has a bit map of two to this power bits, 8 MB.
SIFTED = (2, 3)
BITS = 26
BLOCK_BITS = 16
TEXT_BYTES = 1 << 20
#: Names and word counts of languages that are broadcast.
TOTAL_BYTES = 8 << 20
NO_LANGUAGE = "und"
PAD = ""

BREAK = flags((0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D))
SOLID = ~(BREAK | flags((0x20, 0x20), (0x09, 0x09)))
TURN = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a batch of texts: where they lie, their text, and whether the next word follows in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(0))
        self.data = LOWER[data]
        self.starts, self.ends = word_spans(self.data, offsets, SOLID)
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        breaks = np.flatnonzero(BREAK[self.data])
        self.followed = np.zeros(len(self.starts), bool)
        self.followed[:-1] = (self.text[1:] == self.text[:-1]) & (np.searchsorted(breaks, self.starts[1:]) == np.searchsorted(breaks, self.ends[:-1]))
        self.languages = batch.column(1).dictionary_encode()
        self.language = self.languages.indices.to_numpy()[self.text]
        self.hashes = word_hashes(self.data, self.starts, self.ends)

    def buckets(self, first: np.ndarray, size: int) -> np.ndarray:
        """The buckets of the runs of ``size`` words from the given ones on."""
        names = [b":" + x.encode() for x in self.languages.dictionary.to_pylist()]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)
        keys = word_hashes(np.frombuffer(b"".join(names), np.uint8), edges[:-1], edges[1:])[self.language[first]]
        for k in range(size):
            keys = mix(keys * TURN + self.hashes[first + k])
        return (keys >> np.uint64(64 - BITS)).astype(np.int64)

    def sifted(self, maps: list[np.ndarray]) -> list[np.ndarray]:
        """For each length of runs from 2 on, where one begins that the bit maps know; the last, longer by one, is not yet looked up."""
        on = [self.followed]
        for size, bits in enumerate(maps, 2):
            first = np.flatnonzero(on[-1])
            buckets = self.buckets(first, size)
            known = on[-1].copy()
            known[first] = (bits[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1
            following = np.zeros_like(known)
            following[:-1] = known[:-1] & known[1:]
            on[-1:] = [known, following]
        return on

    def strings(self) -> pa.DictionaryArray:
        size = self.ends - self.starts
        edges = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(edges[-1]) + np.repeat(self.starts - edges[:-1], size)
        kind = pa.large_string()
        words = pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(self.data[at])])
        return words.dictionary_encode()


def _run_counts(load, size: int):
    def counts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = load()
        for batch in batches(stream, "text", TEXT_BYTES):
            words = Words(batch)
            found, n = np.unique(words.buckets(np.flatnonzero(words.sifted(maps)[-1]), size), return_counts=True)
            # nothing of this batch is held while the next one is read
            del words, batch
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["bucket", "n"])

    return counts


def _bits(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for block, places in zip(batch.column(0).to_pylist(), batch.column(1)):
            table = np.zeros(1 << BLOCK_BITS, bool)
            table[places.values.to_numpy()] = True
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(table).tobytes()])], ["block", "bits"])


def frequent_runs(texts: DataFrame, support: int, longest: int) -> list[np.ndarray]:
    """For each length of sifted runs, the packed bits of the buckets whose runs occur ``support`` times together."""
    maps: list[np.ndarray] = []
    for size in SIFTED:
        if size > longest:
            break
        counts = texts.mapInArrow(_run_counts(ship(texts.sparkSession, maps), size), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        places = F.collect_list(F.col("bucket").bitwiseAND((1 << BLOCK_BITS) - 1)).alias("places")
        blocks = counts.filter(F.col("n") >= support).groupBy(F.shiftright("bucket", BLOCK_BITS).alias("block")).agg(places)
        table = np.zeros((1 << BITS - BLOCK_BITS, 1 << BLOCK_BITS - 3), np.uint8)
        for row in blocks.mapInArrow(_bits, "block int, bits binary").collect():
            table[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        maps.append(table.reshape(-1))
    return maps


def _windows(load, longest: int):
    def windows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = load()
        names = ["lang", *[f"w{k}" for k in range(1, longest + 1)], "n"]
        for batch in batches(stream, "text", TEXT_BYTES):
            words = Words(batch)
            if not len(words.starts):
                continue
            *on, last = (np.concatenate([known, np.zeros(longest, bool)]) for known in words.sifted(maps))
            pairs, runs = (on or [last])[0], (on or [last])[-1]
            strings = words.strings()
            # the pad comes after the words of the batch
            code = np.concatenate([strings.indices.to_numpy(), np.zeros(longest, np.int32)])
            kinds = pa.concat_arrays([strings.dictionary, pa.array([PAD], strings.dictionary.type)])
            alone = np.flatnonzero(~pairs[: len(words.starts)])
            single, n = np.unique(words.language[alone].astype(np.int64) * len(kinds) + code[alone], return_counts=True)
            head = np.flatnonzero(pairs)
            columns, inside = [np.concatenate([single % len(kinds), code[head]])], np.ones(len(head), bool)
            for k in range(1, longest):
                inside &= on[k - 1][head] if k <= len(on) else runs[head + k - len(on)]
                following = np.where(inside, code[head + k], len(kinds) - 1)
                columns.append(np.concatenate([np.full(len(single), len(kinds) - 1), following]))
            language = np.concatenate([single // len(kinds), words.language[head]])
            taken = [pc.take(kinds, pa.array(c)).cast(pa.string()) for c in columns]
            total = np.concatenate([n, np.ones(len(head), np.int64)])
            out = pa.RecordBatch.from_arrays([words.languages.dictionary.take(pa.array(language)), *taken, pa.array(total, pa.int64())], names)
            del words, strings, kinds, taken, columns, on, last, pairs, runs, batch
            yield out

    return windows


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT) -> DataFrame:
    """``lang, size, words, f``: phrases with at least ``support`` occurrences, and with ``size`` 0 the words of each language in all."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"))
    load = ship(docs.sparkSession, frequent_runs(texts, support, longest))
    names = [f"w{k}" for k in range(1, longest + 1)]
    schema = ", ".join(["lang string", *[f"{name} string" for name in names], "n long"])
    windows = texts.mapInArrow(_windows(load, longest), schema).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    # the grouping id has one bit for each column that is summed over
    level = F.lit(longest) - F.expr("bit_count(grouping_id())")
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), level.alias("size"))
    words = F.array(*[F.col(name) for name in names])
    last = F.get(words, F.col("size").cast("int") - 1)
    full = (F.col("size") == 0) | ((last != PAD) & (F.col("f") >= support))
    return sums.filter((F.col("size") >= 0) & full).select("lang", F.col("size").cast("int").alias("size"), F.slice(words, 1, F.greatest("size", F.lit(0)).cast("int")).alias("words"), "f")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the phrases of each language that stick together most.

    Letters A-Z are lower-cased, texts are cut at ``.,;:!?`` and line ends into pieces, and these at
    blanks and tabs into words. Phrases of 2 to ``longest`` words with ``a >= support`` occurrences
    are candidates; the score is the least of ``floor(1000 a n / (l r))`` over all cuts in two parts
    with ``l`` and ``r`` occurrences, the first cut on ties; ``n`` is the number of words of the
    language. A candidate inside a longer one that occurs as often is left out. The ``top`` by score,
    ``a`` (both falling) and phrase (rising, by bytes) stay. Arithmetic is exact.

    A null text has no words, a null language is ``und``; no other column is read, so clashing names
    do no harm. Repeated rows count as often as they occur. An empty table gives an empty result.
    """
    counts = write_once(phrase_counts(docs, text, lang, longest, support), "phrases")
    known = counts.filter("size > 0").select("lang", "size", F.array_join("words", " ").alias("phrase"), "words", "f")
    total = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    # one row a language, so a frequent language need not meet its total in one task
    size = total.agg(F.sum(F.octet_length("lang") + 16)).first()[0] or 0
    total = F.broadcast(total) if size <= TOTAL_BYTES else total
    part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    candidates = known.filter("size > 1")
    cut = lambda low, n: F.array_join(F.slice("words", low, n), " ")
    cuts = candidates.select("lang", "size", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(total, "lang")
    cuts = cuts.withColumns({"p": 1000 * _exact("a") * _exact("n"), "q": _exact("l") * _exact("r")}).withColumn("score", F.expr("p div q"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    inner = candidates.filter("size > 2").select("lang", "size", "words", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "words", "longer", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    covered = inner.groupBy("lang", cut(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer"))
    kept = best.join(covered, ["lang", "phrase"], "left").filter(F.coalesce(100 * _exact("longer") < 100 * _exact("a"), F.lit(True)))
    return ranked(docs.sparkSession, kept, top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def ranked(spark: SparkSession, rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; parts of a language are cut to ``top`` before they meet in one task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
