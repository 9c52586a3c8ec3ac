"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

Documents arrive in batches. The sampled suffixes of a batch, in the order of their prefixes, are a
new suffix array; it is merge-scanned against the arrays that exist, and arrays of equal size merge
as digits of a binary counter do. A scan gives the suffixes that share their prefix with another.
Only there the exact strings are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from textshield.llm.blocks import batches, text_bytes
from textshield.llm.suffixes import repeated, sampled, starts_in
from textshield.session import write_once

LENGTH = 400
BATCHES = 4
TEXT_BYTES = 8 << 20
#: Contexts that one task compares; suffixes with more are split by text and place.
CONTEXTS = 1 << 13
#: Bytes of contexts in one Arrow batch.
CONTEXT_BYTES = 32 << 20
#: Hashes of texts that may be broadcast, 8 bytes each.
BROADCAST_ROWS = 1 << 20


def _suffixes(length: int):
    def found(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text", TEXT_BYTES):
            data, offsets = text_bytes(batch.column(1))
            text, place, prefix, _, _ = sampled(data, offsets, length)
            r = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(r[text]), pa.array(place)], ["prefix", "t1", "place"])

    return found


def _scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order without repetitions, and whether another row has the prefix."""
    held, before = None, None
    for batch in stream:
        rows = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        rows = rows if held is None else np.concatenate([held, rows])
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])]
        done, held = rows[:-1], rows[-1:]
        if len(done):
            yield _flagged(done, before, int(held[0, 0]))
            before = int(done[-1, 0])
    if held is not None:
        yield _flagged(held, before, None)


def _flagged(rows: np.ndarray, before: int | None, after: int | None) -> pa.RecordBatch:
    same = np.zeros(len(rows) + 1, bool)
    same[1:-1] = rows[1:, 0] == rows[:-1, 0]
    same[0], same[-1] = before == rows[0, 0], after == rows[-1, 0]
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)), pa.array(same[1:] | same[:-1])], ["prefix", "t1", "place", "shared"])


class SuffixFamily:
    """Suffix arrays of geometrically growing size; ``levels[k]`` holds 2^k batches or nothing."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels, self.found = length, [], []

    def add(self, texts: DataFrame) -> None:
        """Add a batch of ``t1, text``: scan it against every level, and merge equal levels."""
        new = texts.filter(F.octet_length("text") >= self.length).select("t1", "text").mapInArrow(_suffixes(self.length), "prefix long, t1 long, place long")
        carry = 0
        while carry < len(self.levels) and self.levels[carry] is not None:
            carry += 1
        # levels below the carry merge with the batch, in which scan they take part; those above are scanned
        array = self._ordered([new, *self.levels[:carry]], "suffixes")
        self.levels[:carry] = [None] * carry
        if carry == len(self.levels):
            self.levels.append(None)
        self.levels[carry] = array
        self.found.append(array.filter("shared").drop("shared"))
        for level in self.levels[carry + 1 :]:
            if level is not None:
                both = [array.select("prefix", "t1", "place"), level.select("prefix", "t1", "place")]
                self.found.append(self._ordered(both, "scan", "shared").drop("shared"))

    @staticmethod
    def _ordered(parts: list[DataFrame], name: str, where: str = "true") -> DataFrame:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.union(part.select("prefix", "t1", "place"))
        merged = rows.repartition("prefix").sortWithinPartitions("prefix", "t1", "place")
        return write_once(merged.mapInArrow(_scan, "prefix long, t1 long, place long, shared boolean").filter(where), name)

    def matches(self) -> DataFrame:
        """The suffixes whose prefix another suffix has: ``prefix, t1, place``."""
        out = self.found[0]
        for part in self.found[1:]:
            out = out.union(part)
        return out.distinct()


def _contexts(length: int):
    def found(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream, "text", TEXT_BYTES):
            data, offsets = text_bytes(batch.column(2))
            raw = data.tobytes()
            text, place, prefix, first, last = sampled(data, offsets, length)
            wanted = batch.column(3).to_pylist()
            edges, keep = np.searchsorted(text, np.arange(len(offsets))), np.zeros(len(text), bool)
            for i, places in enumerate(wanted):
                keep[edges[i] : edges[i + 1]] = np.isin(place[edges[i] : edges[i + 1]], places)
            text, prefix, first, last = text[keep], prefix[keep], first[keep], last[keep]
            low, high = offsets[text] + first, offsets[text] + last + length
            step = np.cumsum(high - low) // CONTEXT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
            for a, b in zip(cuts, cuts[1:]):
                of = pa.array(text[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix[a:b].view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array(first[a:b]),
                     pa.array([raw[x:y] for x, y in zip(low[a:b].tolist(), high[a:b].tolist())], pa.binary())],
                    ["prefix", "t1", "t2", "first", "context"],
                )

    return found


SPANS = "t1 long, t2 long, start long, stop long, mark long, single boolean"


def _compare(length: int):
    """Runs of strings that occur twice in a task; of split suffixes also every string by itself."""

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        context, place, marks = starts_in(list(group["context"]), length)
        twice = repeated(marks)
        t1, t2, first, split = (group[c].to_numpy() for c in ("t1", "t2", "first", "split"))
        at = np.flatnonzero(twice)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(context[at]) != 0)
        begin = at[fresh]
        end = at[np.concatenate([fresh[1:], [True]])] if len(at) else at
        c = context[begin]
        spans = pd.DataFrame({"t1": t1[c], "t2": t2[c], "start": first[c] + place[begin], "stop": first[c] + place[end] + length, "mark": 0, "single": False})
        some = np.flatnonzero(split[context])
        if not len(some):
            return spans
        # one row for each string of a split suffix; a string that has been found twice needs one row only
        once = some[~twice[some]]
        known = some[twice[some]]
        _, one = np.unique(marks[known], return_index=True)
        some = np.concatenate([once, known[one]])
        c = context[some]
        more = pd.DataFrame({"t1": t1[c], "t2": t2[c], "start": first[c] + place[some], "stop": first[c] + place[some] + length, "mark": marks[some].view(np.int64), "single": True})
        return pd.concat([spans, more])

    return compared


def _runs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        runs = [[{"start": a, "stop": b} for a, b in merged([(s["start"], s["stop"]) for s in spans])] for spans in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, batch.column(2).type)], ["t1", "t2", "spans"])


@F.arrow_udf(BinaryType())
def _left(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The bytes of texts outside the spans; null for a null text."""
    out = []
    for t, runs in zip(text.to_pylist(), spans.to_pylist()):
        raw, parts, at = (t or "").encode(), [], 0
        for run in runs or []:
            parts.append(raw[at : run["start"]])
            at = run["stop"]
        out.append(None if t is None else b"".join([*parts, raw[at:]]))
    return pa.array(out, pa.binary())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(s) for s in out]


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, n_batches: int = BATCHES) -> DataFrame:
    """Spans of bytes of texts that occur once, ``t1, t2, start, stop``, which may overlap; see ``cut_repeats``."""
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(full).alias("t1"), F.xxhash64(F.lit("second"), full).alias("t2"), full.alias("text"))
    family = SuffixFamily(length)
    for number in range(n_batches):
        family.add(texts.filter(F.pmod(F.shiftright("t1", 8), F.lit(n_batches)) == number))
    matches = write_once(family.matches(), "matches")
    total = matches.count()
    common = write_once(matches.groupBy("prefix").count().filter(F.col("count") > CONTEXTS), "common")
    wanted = write_once(matches.groupBy("t1").agg(F.collect_list("place").alias("places")), "places")
    some = wanted.select("t1")
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    chosen = texts.join(some, "t1", "left_semi").dropDuplicates(["t1", "t2"]).join(wanted, "t1")
    contexts = chosen.select("t1", "t2", "text", "places").mapInArrow(_contexts(length), "prefix long, t1 long, t2 long, first long, context binary")
    contexts = contexts.join(F.broadcast(common) if total <= BROADCAST_ROWS * CONTEXTS else common, "prefix", "left")
    salt = F.when(F.col("count").isNull(), 0).otherwise(F.pmod(F.xxhash64("t1", "first"), F.ceil(F.col("count") / CONTEXTS)))
    groups = max(1, -(-total // CONTEXTS))
    contexts = contexts.select("t1", "t2", "first", "context", F.col("count").isNotNull().alias("split"), F.pmod(F.xxhash64("prefix", salt), F.lit(groups)).alias("part"))
    found = write_once(contexts.groupBy("part").applyInPandas(_compare(length), SPANS), "spans")
    single = found.filter("single")
    again = single.groupBy("mark").agg(F.count("*").alias("n")).filter("n > 1")
    across = single.join(again, "mark", "left_semi")
    span = ["t1", "t2", "start", "stop"]
    return found.filter("NOT single").select(*span).union(across.select(*span))


def _cut(docs: DataFrame, key: str, text: str, length: int, n_batches: int) -> DataFrame:
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    all_rows = docs.select(F.col(key).alias("key"), F.octet_length(full).cast("long").alias("n_bytes"), full.alias("text"))
    rows = all_rows.filter(F.col("n_bytes") >= length).select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "key", "n_bytes", "text")
    copies = write_once(rows.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.max("n_bytes").alias("stop")).filter("n > 1"), "copies")
    spans = repeated_spans(docs, text, length, n_batches).join(copies, ["t1", "t2"], "left_anti")
    spans = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.mapInArrow(_runs, "t1 long, t2 long, spans array<struct<start:long,stop:long>>")
    whole = copies.select("t1", "t2", F.array(F.struct(F.lit(0).cast("long").alias("start"), "stop")).alias("spans"))
    cuts = write_once(spans.union(whole), "cuts")
    # very common texts leave their bytes behind before they meet in one task
    common = copies.filter(F.col("n") > CONTEXTS).select("t1", "t2", F.lit(True).alias("common"))
    common = F.broadcast(common) if common.count() <= BROADCAST_ROWS else common
    rows = rows.join(common, ["t1", "t2"], "left").select("t1", "t2", "key", "n_bytes", F.when(F.col("common").isNull(), F.col("text")).alias("text"))
    rows = rows.join(cuts, ["t1", "t2"], "left")
    first = F.get("spans", F.lit(0))
    gone = F.coalesce(first["stop"] - first["start"] == F.col("n_bytes"), F.lit(False))
    cut = F.when(F.col("spans").isNotNull() & ~gone, F.col("text"))
    left = F.when(gone, F.lit(b"")).otherwise(F.coalesce(_left(cut, F.when(~gone, F.col("spans"))), F.col("text").cast("binary")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    rows = rows.select("key", "n_bytes", F.coalesce("spans", none).alias("spans"), left.alias("kept"))
    short = all_rows.filter(F.col("n_bytes") < length).select("key", "n_bytes", none.alias("spans"), F.col("text").cast("binary").alias("kept"))
    return rows.union(short)


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, n_batches: int = BATCHES) -> DataFrame:
    """Per row: ``key, n_bytes, spans, kept``, the removed runs and the bytes that are left.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes that covers it
    also starts anywhere else, in the same text or another; strings never cross texts and are judged
    on the input. Of equal texts of at least ``length`` bytes nothing is left, equal rows included,
    however many there are. Shorter texts stay whole. ``spans`` has ``start, stop`` in bytes, in
    order. A null key stays null, extra columns are ignored, an empty table gives an empty result.
    Strings count as equal by 64-bit fingerprints within one task, texts by 128 bits.
    """
    return _cut(docs, key, text, length, n_batches).select(F.col("key").alias(key), "n_bytes", "spans", "kept")


def digests() -> list[Column]:
    """``n_bytes, n_removed, n_spans, kept_sha256`` of what ``cut_repeats`` returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return [F.col("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, n_batches: int = BATCHES) -> DataFrame:
    """Per row: ``key, n_bytes, n_removed, n_spans, kept_sha256``, the digests of ``cut_repeats``."""
    return _cut(docs, key, text, length, n_batches).select(F.col("key").alias(key), *digests())
