"""Nearest chunks of queries, exactly or by hyperplane buckets, and what is built from them."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textshield.fixed_values import ENRICH_K
from textshield.functions.prompts import context_entry, enriched_prompt
from textshield.functions.vectors import metric_name
from textshield.operators.models import model_of
from textshield.operators.nearest import Nearest, Planes, ProbedNearest, Rows, ids_of, vectors_of
from textshield.schemas import INDEX_SETTINGS
from textshield.session import shared_dir, write_once

QUERY_BYTES = 64 << 20  # largest query matrix that a task measures at once
PASS_BYTES = 64 << 20  # query blocks together that one pass over the chunks sends to every task
HIT_ROWS = 500_000  # largest hit list joined by broadcast
HIT_BITS = 1 << 27  # bits of the map of chunks that a larger one has hit, 16 MB
POPULAR_HITS = 100_000  # hits of one chunk that one task joins
TASK_GROUPS = 1024  # groups of tasks whose hits are merged before those of all tasks
BUCKET_ROWS = 256  # chunks that a bucket of an index should have
MOST_BITS = 10
SAMPLE_ROWS, SAMPLE_QUERIES = 4_000, 200  # chunks and queries that the number of probes is measured on
RECALL = 0.92


def require_one_model(queries: DataFrame, query_vector: str, chunks: DataFrame, chunk_vector: str) -> None:
    """Refuse queries that another model has embedded than the chunks. A vector that names no model passes."""
    asked, stored = model_of(queries, query_vector), model_of(chunks, chunk_vector)
    if asked and stored and asked != stored:
        raise ValueError(f"chunks were embedded by {stored}, queries by {asked}")


def _side(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), F.col(vector).alias("vector")).where("vector is not null")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    kind = df.schema[name].dataType.typeName()
    return {"string": pa.string(), "long": pa.int64(), "integer": pa.int32()}[kind]


def _hit_schema(q: DataFrame, c: DataFrame) -> tuple[str, pa.Schema]:
    ddl = f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id {c.schema['chunk_id'].dataType.simpleString()}, distance double"
    arrow = pa.schema(
        [("query_id", _arrow_type(q, "query_id")), ("chunk_id", _arrow_type(c, "chunk_id")), ("distance", pa.float64())]
    )
    return ddl, arrow


def _ranked(hits: DataFrame, k: int, *within: str) -> DataFrame:
    """The k best hits of each query: of each task, of each group of tasks, and of all.

    Each level passes on k rows of a query at most, and a partial limit runs before each shuffle, so
    the hits of a query never meet in one task, however many tasks have searched.
    """
    best = lambda *keys: F.row_number().over(Window.partitionBy("query_id", *within, *keys).orderBy("distance", "chunk_id"))
    grouped = hits.withColumn("tasks", F.spark_partition_id() % TASK_GROUPS)
    merged = grouped.withColumn("rank", best("tasks")).where(F.col("rank") <= k)
    return merged.withColumn("rank", best()).where(F.col("rank") <= k).select("query_id", "rank", "chunk_id", "distance")


def query_size(queries: DataFrame) -> tuple[int, int]:
    """Number of queries and the bytes of their matrix and ids, as tasks hold them."""
    text = queries.schema["query_id"].dataType.typeName() == "string"
    width = F.max(F.length("query_id")) * 4 if text else F.lit(8)
    seen = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), width.alias("width")).first()
    return seen["n"], seen["n"] * ((seen["dim"] or 0) * 8 + (seen["width"] or 0))


def _scan(table: pa.Table, c: DataFrame, ddl: str, arrow: pa.Schema, make, name: str) -> DataFrame:
    """One pass over the chunks with a query side of checked size in every task, measured block by block."""
    block = table["block"].to_numpy() if "block" in table.column_names else np.zeros(len(table), np.int32)
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    shared = c.sparkSession.sparkContext.broadcast((ids_of(table["query_id"]), vectors_of(table["vector"]), block))

    def search(batches):
        ids, vectors, block = shared.value
        blocks = [make(ids[a:b], vectors[a:b]) for a, b in zip(edges, edges[1:])]
        for batch in batches:
            rows = Rows(ids_of(batch.column("chunk_id")), vectors_of(batch.column("vector")), name)
            for nearest in blocks:
                nearest.add_rows(rows)
        for a, nearest in zip(edges, blocks):
            found = nearest.table(arrow)
            number = pa.array(np.full(found.num_rows, block[a] if len(block) else 0, np.int32))
            yield pa.RecordBatch.from_arrays([*found.columns, number], names=[*arrow.names, "block"])

    return c.mapInArrow(search, f"{ddl}, block int")


def _search(q: DataFrame, c: DataFrame, k: int, query_bytes: int, pass_bytes: int, make, name: str) -> tuple[DataFrame, int]:
    """Ranked hits of a stored query side, and the number of queries.

    ``make`` gives the running result of a task for ids and vectors.
    """
    ddl, arrow = _hit_schema(q, c)
    n, size = query_size(q)
    n_blocks = math.ceil(size / query_bytes) if query_bytes and size > query_bytes else 1
    if n_blocks == 1:
        return _ranked(_scan(q.toArrow(), c, ddl, arrow, make, name), k), n
    # chunks stay where they are; blocks of queries pass over them, as many at once as fit a pass, and their hits are final
    spark, folder = q.sparkSession, f"{shared_dir(q.sparkSession)}/hits-{uuid.uuid4().hex}"
    q.repartition(n_blocks).withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{folder}/queries")
    blocks, at_once = spark.read.parquet(f"{folder}/queries"), max(1, pass_bytes // query_bytes)
    if n_blocks > at_once:
        c = write_once(c, "vectors")
    for first in range(0, n_blocks, at_once):
        part = blocks.where(F.col("block").between(first, first + at_once - 1)).select("query_id", "vector", "block")
        hits = _ranked(_scan(part.toArrow().sort_by("block"), c, ddl, arrow, make, name), k, "block")
        hits.write.mode("overwrite").parquet(f"{folder}/hits/first={first}")
    return spark.read.schema(hits.schema).parquet(f"{folder}/hits").select(*hits.columns), n


def _searched(queries: DataFrame, chunks: DataFrame, k: int, metric: str | None, *, query_id: str = "query_id", chunk_id: str = "chunk_id",
              vector: str = "embedding", exclude_self: bool = False, query_bytes: int = QUERY_BYTES,
              pass_bytes: int = PASS_BYTES) -> tuple[DataFrame, int]:
    require_one_model(queries, vector, chunks, vector)
    name = metric_name(metric)
    make = lambda ids, vectors: Nearest(ids, vectors, k, name, exclude_self)
    q = write_once(_side(queries, query_id, vector, "query_id"), "queries")
    return _search(q, _side(chunks, chunk_id, vector, "chunk_id"), k, query_bytes, pass_bytes, make, name)


def topk(queries: DataFrame, chunks: DataFrame, k: int = ENRICH_K, metric: str | None = None, *,
         relevance: Callable[[Column], Column] | None = None, **options) -> DataFrame:
    """The k nearest chunks of every query: ``query_id, rank, chunk_id, distance``.

    The query side is computed once and measured. Up to ``query_bytes`` its matrix goes to every task
    of one scan over the chunks, and a task returns at most k rows per query. A larger query side is
    cut into blocks of that size, of which as many as ``pass_bytes`` holds pass over the chunks
    together; for several passes the chunks are computed once too, and never moved or copied. No pair
    of rows is ever written out.

    Options name the columns (``query_id``, ``chunk_id``, ``vector``), leave out the hit of a row
    on itself (``exclude_self``) and set the limits (``query_bytes``, ``pass_bytes``). ``relevance`` turns the distance
    into an extra ``score`` column.
    """
    ranked, _ = _searched(queries, chunks, k, metric, **options)
    return ranked.withColumn("score", relevance(F.col("distance"))) if relevance else ranked


def hyperplanes(bits: int, dim: int) -> np.ndarray:
    """Normal vectors of the bucket planes, drawn from a digest so that they never change."""

    def draw(b: int, i: int) -> float:
        return int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) / 2.0**32 - 0.5

    return np.array([[draw(b, i) for i in range(dim)] for b in range(bits)]).reshape(bits, dim)


class Index(NamedTuple):
    """Chunks (``chunk_id, vector``, stored ones with their ``bucket``), the planes of the buckets and the probes of a query."""

    rows: DataFrame
    planes: Planes
    probes: int
    metric: str


def index_bits(n: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """So many planes that a bucket has about ``bucket_rows`` of n chunks, 10 at most."""
    return max(0, min(MOST_BITS, math.ceil(math.log2(max(n, 1) / bucket_rows)) if n else 0))


def probes_for(sample: np.ndarray, planes: Planes, metric: str, k: int, recall: float) -> int:
    """The least number of probes that finds ``recall`` of the k nearest rows within a sample.

    Neighbours in a sample lie further apart than in all rows, and further buckets take more probes,
    so a sample asks for rather more probes than are needed.
    """
    queries = sample[: SAMPLE_QUERIES]
    nearest = Nearest(np.arange(len(queries)), queries, k, metric, True)
    nearest.add(np.arange(len(sample)), sample)
    if not len(nearest.q):
        return 1
    costs = planes.costs(planes.margins(queries))
    own = costs[nearest.q, planes.buckets(sample)[nearest.ids]]
    needed = np.sort((costs[nearest.q] < own[:, None]).sum(axis=1) + 1)
    return int(needed[max(0, math.ceil(recall * len(needed)) - 1)])


def build_index(chunks: DataFrame, metric: str | None = "cosine", *, chunk_id: str = "chunk_id", vector: str = "embedding", k: int = ENRICH_K,
                recall: float = RECALL, probes: int | float | None = None, bucket_rows: int = BUCKET_ROWS) -> Index:
    """Cut the chunks into buckets, the more the more chunks there are.

    How many buckets a query probes is measured on at most 4,000 chunks, those with the smallest
    hashes of their ids, unless ``probes`` is given, as a number or a share of all buckets. For ``l2``
    the planes pass through the mean of these chunks; inner products have no such index. All chunks
    are indexed; nothing is shuffled.
    """
    name = metric_name(metric)
    if name == "ip":
        raise ValueError("an index needs the metric cosine or l2")
    c = _side(chunks, chunk_id, vector, "chunk_id")
    seen = c.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    rows = np.zeros((0, seen["dim"] or 1))
    if seen["n"] and (probes is None or name == "l2"):
        rows = vectors_of(c.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"])
        rows = rows[np.isfinite(rows).all(axis=1)]
    normals = hyperplanes(index_bits(seen["n"], bucket_rows), rows.shape[1])
    offsets = normals @ rows.mean(axis=0) if name == "l2" and len(rows) else np.zeros(len(normals))
    planes = Planes(normals, offsets)
    buckets = 1 << planes.bits
    chosen = probes_for(rows, planes, name, k, recall) if probes is None else math.ceil(probes * buckets) if isinstance(probes, float) else probes
    return Index(c, planes, max(1, min(chosen, buckets)), name)


def _with_buckets(c: DataFrame, planes: Planes) -> DataFrame:
    def assign(batches):
        for batch in batches:
            bucket = planes.buckets(vectors_of(batch.column("vector"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket, pa.int32())], names=[*batch.schema.names, "bucket"])

    return c.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema) + ", bucket int")


def write_index(index: Index, path: str) -> Index:
    """Store an index: chunks ordered by bucket, so that a scan skips buckets that no query probes.

    Ranges of buckets are cut by chunk id as well, so a bucket with a third of all chunks spreads over
    many files.
    """
    spark = index.rows.sparkSession
    _with_buckets(index.rows.select("chunk_id", "vector"), index.planes).repartitionByRange("bucket", "chunk_id").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{path}/rows")
    settings = [(index.planes.normals.tolist(), index.planes.offsets.tolist(), index.probes, index.metric)]
    spark.createDataFrame(settings, INDEX_SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    settings = spark.read.schema(INDEX_SETTINGS).parquet(f"{path}/settings").first()
    normals = np.array(settings["normals"], dtype=np.float64)
    planes = Planes(normals.reshape(len(settings["offsets"]), -1), np.array(settings["offsets"], dtype=np.float64))
    return Index(spark.read.parquet(f"{path}/rows"), planes, settings["probes"], settings["metric"])


def search_index(queries: DataFrame, index: Index, k: int = ENRICH_K, *, query_id: str = "query_id", vector: str = "embedding",
                 exclude_self: bool = False, query_bytes: int = QUERY_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The nearest chunks of every query among those in the buckets it probes, as of :func:`topk`.

    Chunks stay in place, as in an exact search; a task measures a bucket only against the queries
    that probe it, and buckets that none of them probes are not read.
    """
    require_one_model(queries, vector, index.rows, "vector")
    planes, probes, name = index.planes, index.probes, index.metric
    q = write_once(_side(queries, query_id, vector, "query_id"), "queries")
    rows = index.rows
    if "bucket" in rows.columns and probes < 1 << planes.bits:
        rows = rows.where(F.col("bucket").isin(_probed(q, planes, probes)))
    make = lambda ids, vectors: ProbedNearest(ids, vectors, k, name, exclude_self, planes, probes)
    return _search(q, rows.select("chunk_id", "vector"), k, query_bytes, pass_bytes, make, name)[0]


def _probed(q: DataFrame, planes: Planes, probes: int) -> list[int]:
    """Buckets that any query probes: 1,024 numbers at most."""

    def probed(batches):
        hit = np.zeros(1 << planes.bits, bool)
        for batch in batches:
            side = planes.margins(vectors_of(batch.column("vector")))
            reach = planes.reach(side, probes) if len(side) else np.zeros(0)
            for bucket in np.flatnonzero(~hit):
                hit[bucket] = (planes.cost(side, bucket) <= reach).any()
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(hit), pa.int32())], names=["bucket"])

    return sorted(r["bucket"] for r in q.select("vector").mapInArrow(probed, "bucket int").distinct().collect())


def approx_topk(queries: DataFrame, chunks: DataFrame, k: int = ENRICH_K, metric: str | None = "cosine", *, query_id: str = "query_id",
                chunk_id: str = "chunk_id", vector: str = "embedding", exclude_self: bool = False, query_bytes: int = QUERY_BYTES,
                **options) -> DataFrame:
    """The same by an index that is built on the way (see :func:`build_index` for the options) and not stored."""
    index = build_index(chunks, metric, chunk_id=chunk_id, vector=vector, k=k, **options)
    return search_index(queries, index, k, query_id=query_id, vector=vector, exclude_self=exclude_self, query_bytes=query_bytes)


def with_chunks(hits: DataFrame, chunks: DataFrame, chunk_id: str, columns: Sequence[str], hit_rows: int | None) -> DataFrame:
    """Add chunk columns to hits.

    A hit list of known, small size goes to the chunks, not the reverse. Of a larger one a bit map of
    fixed size goes to them, so that chunks which no query has hit are set aside where they are read,
    and only the others are shuffled. A chunk that very many queries have hit is copied for shares of
    them, so that its hits do not meet in one task.
    """
    wanted = chunks.select(F.col(chunk_id).alias("chunk_id"), *columns)
    if hit_rows is not None and hit_rows <= HIT_ROWS:
        return wanted.join(F.broadcast(hits), "chunk_id")
    hits = write_once(hits, "hits")
    popular = hits.groupBy("chunk_id").agg(F.ceil(F.count("*") / POPULAR_HITS).cast("int").alias("_shares")).where("_shares > 1")
    # one popular chunk for so many hits at most
    few = hits.count() // POPULAR_HITS <= HIT_ROWS
    popular = F.broadcast(popular) if few else popular
    share = F.coalesce(F.pmod(F.xxhash64("query_id"), F.col("_shares")), F.lit(0))
    left = hits.join(popular, "chunk_id", "left").withColumn("_share", share.cast("int")).drop("_shares")
    right = _hit_chunks(wanted, hits).join(popular, "chunk_id", "left")
    right = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1))).drop("_shares")
    return left.join(right, ["chunk_id", "_share"]).drop("_share")


def _hit_chunks(wanted: DataFrame, hits: DataFrame) -> DataFrame:
    """Chunks whose id is among those of the hits, and a few others that share a bit with them."""
    bit = F.pmod(F.xxhash64("chunk_id"), F.lit(HIT_BITS))
    maps = hits.select(F.bitmap_bucket_number(bit).alias("_map"), F.bitmap_bit_position(bit).alias("at"))
    maps = maps.groupBy("_map").agg(F.bitmap_construct_agg("at").alias("_bits"))
    # HIT_BITS / 8 bytes in all, however many hits there are
    placed = wanted.withColumns({"_map": F.bitmap_bucket_number(bit), "_at": F.bitmap_bit_position(bit)}).join(F.broadcast(maps), "_map")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.expr("shiftright(_byte, CAST(_at % 8 AS INT))").bitwiseAND(1) == 1
    return placed.withColumn("_byte", byte).where(known).drop("_map", "_at", "_bits", "_byte")


def assemble_context(hits: DataFrame, *, text: str = "text") -> DataFrame:
    """``query_id, documents, context, n_docs``; a query has at most k hits, so a group stays small."""
    best_first = F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("text"))))
    return (
        hits.groupBy("query_id")
        .agg(best_first.alias("hits"))
        .select(
            "query_id",
            F.col("hits.text").alias("documents"),
            F.concat_ws("\n", F.transform("hits", lambda h: context_entry(h["rank"], h["text"]))).alias("context"),
            F.size("hits").alias("n_docs"),
        )
    )


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = ENRICH_K, metric: str | None = None, *,
             query_id: str = "query_id", chunk_id: str = "chunk_id", text: str = "text",
             vector: str = "embedding", texts: DataFrame | None = None, **options) -> DataFrame:
    """Context of every query. Queries without a hit (empty collection) have no row.

    ``texts`` supplies the texts by chunk id when ``chunks`` are vectors computed on the way, so that
    they are not computed again; a stored collection needs none.
    """
    hits, n = _searched(queries, chunks, k, metric, query_id=query_id, chunk_id=chunk_id, vector=vector, **options)
    return assemble_context(with_chunks(hits, chunks if texts is None else texts, chunk_id, [text], n * k), text=text)


def enrich(prompts: DataFrame, chunks: DataFrame, k: int = ENRICH_K, metric: str | None = None, *,
           prompt_id: str = "prompt_id", prompt: str = "prompt", vector: str = "embedding",
           chunk_id: str = "chunk_id", text: str = "text", **options) -> DataFrame:
    """Add ``documents`` and ``enriched_prompt``; both stay null where nothing was retrieved. The prompts are computed once."""
    prompts = write_once(prompts, "prompts")
    found = retrieve(prompts, chunks, k, metric, query_id=prompt_id, chunk_id=chunk_id, text=text, vector=vector, **options)
    joined = prompts.join(found.select(F.col("query_id").alias(prompt_id), "documents"), prompt_id, "left")
    built = F.when(F.size("documents") > 0, enriched_prompt(F.col("documents"), F.col(prompt)))
    return joined.withColumn("enriched_prompt", built)


COMPARISONS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v, "in": lambda c, v: c.isin(*v), "prefix": lambda c, v: c.startswith(v), "null": lambda c, v: c.isNull() if v else c.isNotNull(),
}


def metadata_filter(chunks: DataFrame, **wanted) -> DataFrame:
    """Keep chunks by conditions on their columns before ranking.

    A condition is a value, a list of values, or comparisons such as ``{"ge": 3, "lt": 9}`` (``eq, ne,
    gt, ge, lt, le, in, prefix, null``), all of which must hold. Conditions on plain columns reach the
    Parquet scan, those on entries of a map do not: :func:`shred_metadata` makes columns of them.
    """
    for name, value in wanted.items():
        if name not in chunks.columns:
            raise ValueError(f"chunks have no column {name}, known are {chunks.columns}")
        conditions = value if isinstance(value, dict) else {"in": value} if isinstance(value, (list, tuple, set)) else {"eq": value}
        for comparison, bound in conditions.items():
            if comparison not in COMPARISONS:
                raise ValueError(f"unknown comparison {comparison!r}, known are {sorted(COMPARISONS)}")
            chunks = chunks.where(COMPARISONS[comparison](F.col(name), bound))
    return chunks


def shred_metadata(chunks: DataFrame, types: dict[str, str], metadata: str = "metadata") -> DataFrame:
    """Add a typed column for each wanted entry of the metadata map; one that is missing or of another type is null.

    Store chunks with these columns, ordered or partitioned by the most selective, and filter by them.
    """
    return chunks.withColumns({name: F.try_element_at(metadata, F.lit(name)).try_cast(kind) for name, kind in types.items()})
