"""From documents to a searchable collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE
from textshield.operators.chunking import assign_ids, chunk_recursive
from textshield.operators.embedding import HASH_DIMS, embed
from textshield.operators.models import Model, model_of, named_model
from textshield.sources.collections import write_collection, write_settings

HASH_MODEL = f"word-hash-{HASH_DIMS}"


def collection_chunks(docs: DataFrame, name: str, *, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                      language: str = "", chunked: bool = True, embedder: Model | None = None,
                      user_id: str | None = None) -> DataFrame:
    """Rows of a collection for documents ``doc_id, text`` (and ``metadata``): chunk, name and embed.

    One lazy plan without a shuffle: each document is handled where it is read.
    """
    if "metadata" not in docs.columns:
        docs = docs.withColumn("metadata", F.create_map().cast("map<string,string>"))
    keep = docs.select("doc_id", "text", "metadata", *([user_id] if user_id else []))
    if chunked:
        parts = chunk_recursive(keep, size, overlap, language=language).withColumnRenamed("chunk", "text")
    else:
        parts = keep.withColumn("chunk_ix", F.lit(0))
    named = assign_ids(parts, name, user_id=None if chunked else user_id)
    vectors = embed(named, embedder)
    chunks = vectors.select("chunk_id", F.col("doc_id").cast("string").alias("doc_id"), "chunk_ix", "text", "metadata",
                            F.col("embedding").cast("array<float>").alias("embedding"))
    return named_model(chunks, "embedding", model_of(vectors, "embedding"))


def build_collection(docs: DataFrame, root: str, name: str, *, model_id: str = HASH_MODEL, **options) -> None:
    """Chunk, embed and store documents, replacing what the collection held."""
    write_collection(collection_chunks(docs, name, **options), root, name)
    write_settings(docs.sparkSession, root, name, model_id=model_id, tokenizer_id=model_id)
