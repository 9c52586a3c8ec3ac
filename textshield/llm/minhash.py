"""Near-duplicate documents: banded MinHash, sequential Bayesian verification, exact links.

Documents with the same set of shingles are one class from the start. Classes that share a band of
their signatures are candidates. Candidates are compared inside tasks of bounded weight: the
signatures batch by batch, leaving a pair as soon as the posterior probability of a link falls
under the chosen miss probability, and survivors on their full sets. A task only returns links that
join what it has not joined yet, so no group is ever written out as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textshield.llm.blocks import batches, hashed_words, mix, pieces, ragged
from textshield.llm.components import components
from textshield.session import write_once

SHINGLE = 5
BANDS, ROWS = 32, 7
STEP = 32
MISS = 1e-6
PERCENT = 85
TEXT_BYTES = 1 << 20
#: Shingles that numpy hashes at a time, so that they stay in the cache of a core.
CACHED = 1 << 15
#: A class weighs its shingles and this; a task compares classes of about twice the weight below.
BASE_WEIGHT, TASK_WEIGHT = 4096, 1 << 20

_random = np.random.default_rng(2024)
XOR = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
ODD = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
PLACE = _random.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
SIZES = _random.integers(0, 1 << 64, SHINGLE + 1, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts in a row, as 64-bit hashes, and the n + 1 offsets."""
    words, edges, counts = hashed_words(column)
    number = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    run, place = ragged(number)
    first, size = edges[:-1][run] + place, np.minimum(counts, SHINGLE)[run]
    values = SIZES[size].copy()
    for k in range(SHINGLE):
        has = size > k
        if has.all():
            values += words[first + k] * PLACE[k]
        else:
            values[has] += words[first[has] + k] * PLACE[k]
    values = mix(values)
    starts = np.concatenate([[0], np.cumsum(number)])
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[starts[:-1][number > 0]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[starts]


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of minima per text; all ones for an empty set."""
    out = np.full((len(offsets) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    for first, last in pieces(offsets, CACHED):
        full = first + np.flatnonzero(np.diff(offsets[first : last + 1]))
        if not len(full):
            continue
        starts = offsets[full] - offsets[first]
        part = (shingles[offsets[first] : offsets[last]] >> np.uint64(32)).astype(np.uint32)
        for k in range(BANDS * ROWS):
            out[full, k] = np.minimum.reduceat((part ^ XOR[k]) * ODD[k], starts)
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), parts.shape[:2])
    for k in range(ROWS):
        key = mix(key ^ parts[:, :, k])
    return key


def class_ids(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over the hashes of each set; equal sets have equal ids."""
    sums = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(seed)), dtype=np.uint64)])
        sums.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    return np.stack(sums, axis=1)


def _profiles(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream, "text", TEXT_BYTES):
        shingles, offsets = shingle_sets(batch.column(batch.schema.get_field_index("text")))
        number = np.diff(offsets)
        full = number > 0
        ids = class_ids(shingles, offsets)
        keys = band_keys(signatures(shingles, offsets)).view(np.int64)
        edges = np.concatenate([[0], np.cumsum(np.where(full, BANDS, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(number),
             pa.array([i.tobytes() if f else None for i, f in zip(ids, full)], pa.binary()), pa.array(ids[:, 0].view(np.int64)),
             pa.ListArray.from_arrays(pa.array(edges), pa.array(keys[full].reshape(-1)))],
            ["key", "r1", "r2", "n", "cid", "low", "bands"],
        )


def _full_sets(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream, "text", TEXT_BYTES):
        shingles, offsets = shingle_sets(batch.column(0))
        rows = signatures(shingles, offsets)
        found = {}
        for i, cid in enumerate(class_ids(shingles, offsets)):
            found[cid.tobytes()] = i
        wanted = batch.column(1).to_pylist()
        some = [found[c] for c in dict.fromkeys(wanted) if c in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([class_of.tobytes() for class_of in class_ids(shingles, offsets)[some]], pa.binary()),
             pa.array([rows[i].tobytes() for i in some], pa.binary()),
             pa.array([shingles[offsets[i] : offsets[i + 1]].tobytes() for i in some], pa.binary())],
            ["cid", "signature", "shingles"],
        )


def matches_needed(compared: int, threshold: float, miss: float) -> int:
    """The fewest equal minima of so many with which a link is still possible enough.

    With a uniform prior the similarity has a beta posterior, whose upper tail is a binomial sum.
    """
    tail = 0.0
    for m in range(compared + 1):
        tail += comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if tail >= miss:
            return m
    return compared


def linked(cids: list[bytes], rows: np.ndarray, sets: list[np.ndarray], side: np.ndarray, needed: list[tuple[int, int]],
           percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join the classes of a task; with two sides, only classes of different sides are compared."""
    size = np.array([len(s) for s in sets], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    numbers = np.empty(len(every), np.int64)
    numbers[order] = np.cumsum(np.concatenate([[0], np.diff(every[order]) != 0]))
    inside = np.zeros(len(every) + 1, bool)
    root = np.arange(len(cids))
    two, out = len(set(side.tolist())) > 1, []
    for x in range(len(cids) - 1):
        others = np.arange(x + 1, len(cids))
        fits = root[others] != root[x]
        fits &= 100 * np.minimum(size[others], size[x]) >= percent * np.maximum(size[others], size[x])
        if two:
            fits &= side[others] != side[x]
        others = others[fits]
        same, done = np.zeros(len(others), np.int64), 0
        for compared, least in needed:
            if not len(others):
                break
            same += (rows[others, done:compared] == rows[x, done:compared]).sum(1)
            stay = same >= least
            others, same, done = others[stay], same[stay], compared
        if not len(others):
            continue
        own = numbers[offsets[x] : offsets[x + 1]]
        inside[own] = True
        run, place = ragged(size[others])
        common = np.bincount(run, inside[numbers[offsets[others][run] + place]], len(others)).astype(np.int64)
        inside[own] = False
        for y in others[100 * common >= percent * (size[x] + size[others] - common)].tolist():
            if root[y] != root[x]:
                out.append((cids[x], cids[y]))
                root[root == root[y]] = root[x]
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """Per row: ``key, n_shingles, component_id, kept`` and the row's identity ``r1, r2, chosen``.

    Words are runs of anything but white space, A-Z lower-cased; shingles are five words, or all
    words of a shorter text. Rows are linked if the shared shingles are at least ``percent`` of the
    united ones, and components are what links reach. Null and empty texts have no shingles and are
    linked with nothing. ``component_id`` is the smallest key of a component (nulls come last);
    ``kept`` marks rows with that key, ``chosen`` one text of a component: the one with the smallest
    key, and of rows with equal keys the one with the smallest hash. Rows equal in key and text get equal results. Extra
    columns are ignored. Shingles count as equal by 64-bit hashes, sets by 128 bits.
    """
    if not 0 < percent <= 100:
        raise ValueError("percent must be in 1..100")
    words = docs.select(
        F.col(key).alias("key"), F.xxhash64(key, text).alias("r1"), F.xxhash64(text, key).alias("r2"),
        F.col(text).cast("string").alias("text"),
    )
    kind = words.schema["key"].dataType.simpleString()
    profile = f"key {kind}, r1 long, r2 long, n long, cid binary, low long, bands array<long>"
    table = write_once(words.mapInArrow(_profiles, profile), "profiles")
    full = table.filter("n > 0")

    banded = full.select("cid", "low", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("low").alias("x"), F.max("low").alias("y")).filter("x < y").select("band")
    members = write_once(banded.join(shared, "band").select("band", "cid").distinct(), "members")
    hubs = members.groupBy("band").agg(F.min("cid").alias("b"))
    candidate = write_once(components(members.join(hubs, "band").select(F.col("cid").alias("a"), "b")), "candidates")

    weights = full.select("cid", "n").join(candidate.select(F.col("node").alias("cid")), "cid", "left_semi").distinct()
    weights = weights.select("cid", (F.col("n") + BASE_WEIGHT).alias("weight"))
    grouped = candidate.select(F.col("node").alias("cid"), "root").join(weights, "cid")
    total = grouped.groupBy("root").agg(F.sum("weight").alias("total"))
    sized = write_once(grouped.join(total, "root"), "groups")
    whole = sized.filter(F.col("total") <= 2 * TASK_WEIGHT).select(F.hex("root").alias("gid"), "cid", "total")
    large = members.join(sized.filter(F.col("total") > 2 * TASK_WEIGHT).select("cid", "weight"), "cid")
    by_band = large.groupBy("band").agg(F.sum("weight").alias("total"))
    parts = whole.union(large.join(by_band, "band").select(F.col("band").cast("string").alias("gid"), "cid", "total"))
    blocks = F.when(F.col("total") <= 2 * TASK_WEIGHT, 1).otherwise(F.ceil(F.col("total") / TASK_WEIGHT)).cast("int")
    parts = parts.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") < F.col("other")).cast("int").alias("side"), "cid")

    found_by = full.join(candidate.select(F.col("node").alias("cid")), "cid", "left_semi").groupBy("cid").agg(F.min_by("r1", F.struct("r1", "r2")).alias("r1"))
    texts = words.select("r1", "text").join(found_by, "r1").select("text", "cid")
    sets = texts.mapInArrow(_full_sets, "cid binary, signature binary, shingles binary").dropDuplicates(["cid"])

    steps = [min(c, BANDS * ROWS) for c in range(STEP, BANDS * ROWS + STEP, STEP)]
    needed = [(c, matches_needed(c, percent / 100, miss)) for c in steps]

    def links(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack([np.frombuffer(s, np.uint32) for s in group["signature"]])
        shingles = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        return pd.DataFrame(linked(list(group["cid"]), rows, shingles, group["side"].to_numpy(), needed, percent), columns=["a", "b"])

    found = parts.join(sets, "cid").groupBy("gid", "i", "j").applyInPandas(links, "a binary, b binary")
    joined = components(found)

    smallest = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "r1", "r2")).alias("least")
    classes = full.groupBy("cid").agg(smallest)
    tops = classes.join(joined.withColumnRenamed("node", "cid"), "cid").groupBy("root").agg(F.min("least").alias("top"))
    tops = joined.join(tops, "root").select(F.col("node").alias("cid"), "top")
    top = classes.join(tops, "cid", "left").select("cid", F.coalesce("top", "least").alias("top"))
    shown = full.select("key", "r1", "r2", "n", "cid").join(top, "cid").select("key", "r1", "r2", "n", F.col("top.key").alias("component_id"), ((F.col("top.r1") == F.col("r1")) & (F.col("top.r2") == F.col("r2"))).alias("chosen"))
    alone = table.filter("n = 0").select("key", "r1", "r2", "n", F.col("key").alias("component_id"), F.lit(True).alias("chosen"))
    return shown.union(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"),
        "r1", "r2", "chosen",
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, with one row of each component; see ``near_duplicates``.

    Every row without words stays, apart from repetitions of one key and text, of which one stays; a
    null key is a key like others. Columns keep their values whatever their names. An empty table
    gives an empty result.
    """
    chosen = near_duplicates(docs, key, text, **options).filter("chosen").select("r1", "r2").distinct()
    # the row goes along as one column, so its names meet no other ones
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(key, text).alias("r1"), F.xxhash64(text, key).alias("r2"))
    return marked.join(chosen, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("row.*")
