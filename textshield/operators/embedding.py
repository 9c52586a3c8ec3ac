"""Texts to vectors, and token vectors to one vector."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import DEFAULT_EMBEDDING_MODEL, MODEL_POOLING
from textshield.functions.text import word_split
from textshield.functions.vectors import l2_normalize
from textshield.operators.models import Model, named_model, with_vectors
from textshield.operators.slices import sliced

HASH_DIMS = 64
WORDS = 1 << 16  # words that a task counts at once, or those of one longer text


def hash_embed(df: DataFrame, *, text: str = "text", dims: int = HASH_DIMS, out: str = "embedding") -> DataFrame:
    """Add a unit vector of word counts; a word counts in component ``first md5 byte % dims``.

    The default embedder: an offline stand-in that only sees shared words, not a trained model. It
    sees whole texts and needs no shuffle. Words are cut in the JVM; some ten thousand of them at a time
    are encoded as a dictionary, so each distinct word is hashed once in these. Being an operator and not an
    expression, the vector is computed once, wherever later filters mention it.
    """
    if 256 % dims:
        raise ValueError("dims must divide 256")
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out], f"`{out}` array<double>"])
    kept = [f.name for f in df.schema if f.name != out]

    def count(batches):
        for batch in sliced(batches, "_words", WORDS):
            found, rows = batch.column("_words"), batch.num_rows
            coded = found.flatten().dictionary_encode()
            bucket = np.array([hashlib.md5(w.encode()).digest()[0] % dims if w else dims for w in coded.dictionary.to_pylist()], dtype=np.int64)
            owner = np.repeat(np.arange(rows), found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            place = owner * (dims + 1) + bucket[coded.indices.to_numpy(zero_copy_only=False)]
            counts = np.bincount(place, minlength=rows * (dims + 1)).reshape(rows, dims + 1)[:, :dims].astype(np.float64)
            unit = counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-12)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * dims), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], vectors], names=[*kept, out])

    vectors = df.select(*kept, word_split(F.col(text)).alias("_words")).mapInArrow(count, ddl)
    return named_model(vectors, out, f"word-hash-{dims}")


def embed(df: DataFrame, embedder: Model | None = None, *, text: str = "text", out: str = "embedding",
          max_chars: int | None = None, model_id: str | None = None) -> DataFrame:
    """Add the vector of every text by a model; without one by :func:`hash_embed`.

    ``model_id`` names the model, so that a search refuses vectors of another one.

    ``max_chars`` is the input limit of a model. By default whole texts are embedded.
    """
    source = df if max_chars is None else df.withColumn("_input", F.substring(text, 1, max_chars))
    read = text if max_chars is None else "_input"
    if embedder is None:
        added = hash_embed(source, text=read, out=out)
    else:
        added = named_model(with_vectors(source, embedder, text=read, out=out), out, model_id)
    return added.drop("_input")


def embed_queries(queries: DataFrame, embedder: Model | None = None, *, text: str = "query", model_id: str | None = None) -> DataFrame:
    """Queries are embedded as documents are."""
    return embed(queries, embedder, text=text, model_id=model_id)


def _masked_sum(tokens: DataFrame) -> DataFrame:
    """Sum of the attended vectors and their number, combined before the shuffle."""
    weighted = F.transform("vec", lambda x: x.cast("double") * F.col("mask"))
    return tokens.groupBy("item_id").agg(
        vector_to_array(Summarizer.sum(array_to_vector(weighted))).alias("total"),
        F.sum("mask").cast("double").alias("attended"),
    )


def pool_mean(tokens: DataFrame) -> DataFrame:
    """Unit-length masked mean of ``item_id, pos, mask, vec``; an item without attended tokens is the zero vector."""
    least = F.greatest("attended", F.lit(1e-9))
    mean = F.transform("total", lambda x: x / least)
    return _masked_sum(tokens).select("item_id", l2_normalize(mean).alias("embedding"))


def pool_average(tokens: DataFrame) -> DataFrame:
    """The same without a lower bound on the number of tokens: no attended token, no vector (null)."""
    mean = F.transform("total", lambda x: x / F.col("attended"))
    return _masked_sum(tokens).select(
        "item_id", F.when(F.col("attended") > 0, l2_normalize(mean)).alias("embedding"))


def pool_last(tokens: DataFrame) -> DataFrame:
    """Unit-length vector of the last attended token, or of the last token when none is attended."""
    last = tokens.groupBy("item_id").agg(
        F.max_by(F.when(F.col("mask") == 1, F.col("vec")), F.when(F.col("mask") == 1, F.col("pos"))).alias("attended"),
        F.max_by("vec", "pos").alias("final"),
    )
    return last.select("item_id", l2_normalize(F.coalesce("attended", "final")).alias("embedding"))


def pool_none(items: DataFrame) -> DataFrame:
    """Vectors of a model that already gives one per item, unchanged."""
    return items.select("item_id", F.col("vec").alias("embedding"))


POOLING = {"mean": pool_mean, "average": pool_average, "last": pool_last, "none": pool_none}


def pooling_for(model_id: str) -> Callable[[DataFrame], DataFrame]:
    """How a model's token vectors are pooled; unknown models as the default model."""
    return POOLING[MODEL_POOLING.get(model_id, MODEL_POOLING[DEFAULT_EMBEDDING_MODEL])]
