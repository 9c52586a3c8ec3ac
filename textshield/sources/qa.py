"""Question files and evaluation output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textshield.schemas import QA_FILE


def read_qa(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``path, pos, idx, prompt, response`` of JSON arrays; the first ``limit`` by file and position when a limit is given.

    A file that is no JSON is an error.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.from_json("value", f"array<struct<{QA_FILE}>>", {"mode": "FAILFAST"}).alias("rows"))
    rows = files.select("path", F.posexplode("rows").alias("pos", "row")).select("path", "pos", "row.*")
    return rows.orderBy("path", "pos").limit(limit) if limit else rows


def write_eval(results: DataFrame, metrics: DataFrame, path: str) -> None:
    """Write ``detailed_results`` and ``aggregate_metrics`` as JSON datasets below a folder."""
    results.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/detailed_results")
    metrics.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/aggregate_metrics")


def read_eval(spark: SparkSession, path: str, results_schema, metrics_schema) -> tuple[DataFrame, DataFrame]:
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    return read("detailed_results", results_schema), read("aggregate_metrics", metrics_schema)


def qa_from_pairs(pairs: DataFrame) -> DataFrame:
    """Questions from conversation pairs that have a reply: ``conv_id, turn, idx, prompt, response``.

    ``idx`` is ``conv_id:turn``, so no two turns share one however long a conversation is.
    """
    return pairs.where(F.col("reply").isNotNull()).select(
        "conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("idx"),
        F.col("message").alias("prompt"), F.col("reply").alias("response"))
