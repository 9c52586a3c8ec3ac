"""Changing rows of a table by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of ``base`` whose id is not in ``updates``, and all ``updates``. Ids are unique on both sides."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def update(base: DataFrame, updates: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Replace rows that exist; updates with unknown ids are ignored.

    One left join marks the replaced rows, so a null in an update replaces a value too.
    """
    new = updates.select(key, F.struct(*[c for c in base.columns if c != key]).alias("_new"))
    joined = base.join(new, key, "left")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[F.col(c) if c == key else pick(c) for c in base.columns])


def fill_metadata(texts: DataFrame, metadatas: DataFrame, position: str = "pos") -> DataFrame:
    """Add ``metadata`` by position; texts without any get an empty map."""
    found = texts.join(metadatas.select(position, "metadata"), position, "left")
    return found.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
