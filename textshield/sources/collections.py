"""Chunk collections: Parquet partitioned by document, and their settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textshield.operators.models import named_model
from textshield.schemas import CHUNKS, SETTINGS
from textshield.session import write_once

PARTS = 64  # partitions of a collection; a change rewrites those of its documents
PART = "part"


def _place(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _part() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")


def _overwrite(chunks: DataFrame, root: str, name: str, mode: str) -> None:
    """Compute the chunks first, so that they may derive from what they replace, and then write them."""
    staged = write_once(chunks.withColumn(PART, _part()), name)
    writer = staged.repartition(PART, F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy(PART)
    writer.option("partitionOverwriteMode", mode).parquet(f"{_place(root, name)}/chunks")


def write_collection(chunks: DataFrame, root: str, name: str) -> None:
    """Replace a collection. It has one writer at a time, and is not to be read while it is replaced."""
    _overwrite(chunks, root, name, "static")


def write_changes(changes: DataFrame, root: str, name: str) -> None:
    """Insert documents or replace all their chunks.

    Only partitions that hold a changed document are read and written again: their other documents by
    an anti-join, and the changes. The same changes written twice make no difference. A document that
    has no chunk among the changes stays as it was.
    """
    spark = changes.sparkSession
    changes = write_once(changes, "changes")
    # at most as many numbers as there are partitions
    touched = [r[0] for r in changes.select(_part()).distinct().collect()]
    if not touched:
        return
    current = _read(spark, root, name, changes.schema).where(F.col(PART).isin(touched))
    replaced = changes.select(F.col("doc_id").alias("_doc")).distinct()
    kept = current.join(replaced, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_anti").select(*changes.columns)
    _overwrite(kept.unionByName(changes), root, name, "dynamic")


def _read(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    try:
        return spark.read.parquet(f"{_place(root, name)}/chunks")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema).withColumn(PART, F.lit(0))
        raise


def load_collection(spark: SparkSession, root: str, name: str, schema=CHUNKS) -> DataFrame:
    """The chunks of a collection; an absent one is empty. Their vectors name the model of the settings.

    Columns beyond those of ``CHUNKS``, such as shredded metadata, are kept.
    """
    chunks = _read(spark, root, name, schema).drop(PART)
    settings = read_settings(spark, root, name)
    return named_model(chunks, "embedding", settings["model_id"] if settings and "embedding" in chunks.columns else None)


def collection_count(chunks: DataFrame, collection: str | None = None) -> DataFrame:
    """Number of chunks, by collection where a column names it."""
    counted = F.count("*").alias("n_chunks")
    return chunks.groupBy(collection).agg(counted) if collection else chunks.agg(counted)


def write_settings(spark: SparkSession, root: str, name: str, *, model_id: str, tokenizer_id: str | None = None,
                   batch_size: int = 1, max_batch_size: int = 1) -> None:
    row = [(model_id, tokenizer_id, batch_size, max_batch_size)]
    spark.createDataFrame(row, SETTINGS).coalesce(1).write.mode("overwrite").json(f"{_place(root, name)}/settings")


def read_settings(spark: SparkSession, root: str, name: str):
    """The settings row of a collection, or None when it has none."""
    try:
        return spark.read.schema(SETTINGS).json(f"{_place(root, name)}/settings").first()
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def require_model(spark: SparkSession, root: str, name: str, model_id: str) -> None:
    """Refuse a collection that another model has embedded, before anything is written to it."""
    settings = read_settings(spark, root, name)
    if settings is not None and settings["model_id"] != model_id:
        raise ValueError(f"collection {name} was embedded by {settings['model_id']}, not {model_id}")
