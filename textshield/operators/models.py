"""Running a model over texts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

# A model is a factory, called once per task. What it makes turns a list of texts into one vector each.
Model = Callable[[], Callable[[list], list]]


MODEL = "embedding_model"  # key of a vector column's metadata


def named_model(df: DataFrame, vector: str, model_id: str | None) -> DataFrame:
    """Note in the schema which model a vector column comes from; selections, filters and joins keep the note."""
    return df if model_id is None else df.withMetadata(vector, {MODEL: model_id})


def model_of(df: DataFrame, vector: str) -> str | None:
    return df.schema[vector].metadata.get(MODEL) if vector in df.columns else None


def with_vectors(df: DataFrame, model: Model, *, text: str, out: str) -> DataFrame:
    """Add the vector a model gives for each text, in Arrow batches."""
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"`{out}` array<float>"])

    def run(batches):
        apply = model()
        for batch in batches:
            vectors = [list(map(float, v)) for v in apply(batch.column(text).to_pylist())]
            added = pa.array(vectors, type=pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, out])

    return df.mapInArrow(run, ddl)
