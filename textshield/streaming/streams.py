"""Scanning and corpus building over streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textshield.operators.generation import Provider, masking_provider
from textshield.operators.requests import answer_requests
from textshield.operators.scanning import CORRUPT, scan_batch, split_requests
from textshield.plans.corpus import HASH_MODEL, collection_chunks
from textshield.schemas import REQUESTS
from textshield.sources.collections import require_model, write_changes, write_settings
from textshield.sources.xml import xml_documents


def request_stream(spark: SparkSession, folder: str, schema: str = REQUESTS, files_per_trigger: int | None = None) -> DataFrame:
    """Requests of JSON lines; a line that cannot be read is kept in ``_corrupt_record``."""
    reader = spark.readStream.schema(f"{schema}, {CORRUPT} string")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def scan_stream(requests: DataFrame, out: str, checkpoint: str, topics=(), **options):
    """Answer a stream of requests. Invalid ones go to their own folder with the error.

    Both outputs are append-only file sinks with a checkpoint each, so every request is answered
    exactly once, also across restarts. Returns the two running queries.
    """
    valid, invalid = split_requests(requests)
    write = lambda df, name: (
        df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{checkpoint}/{name}")
        .option("path", f"{out}/{name}").trigger(availableNow=True).start())
    return write(scan_batch(valid, topics, **options), "answers"), write(invalid, "rejected")


def answer_stream(requests: DataFrame, out: str, checkpoint: str, provider: Provider = masking_provider, **options):
    """Answer a stream of requests with replies of a provider and context from a collection.

    Each batch looks up its requests in the chunks as they are then (``chunks`` of
    :func:`answer_requests`), keeps its context and attempts in the checkpoint folder and writes its
    own folder of answers. A batch that is repeated after a failure uses what it kept and writes the
    same folder again, so a request is sent once and answered once.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        valid, invalid = split_requests(batch)
        answers = answer_requests(valid, provider, folder=f"{checkpoint}/work/{batch_id:08d}", **options)
        answers.write.mode("overwrite").parquet(f"{out}/answers/batch={batch_id}")
        invalid.write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")

    return requests.writeStream.foreachBatch(answer).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def xml_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml"))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = xml_documents(reader.load(folder))
    return files.selectExpr("path AS doc_id", "text")


def build_incremental(docs: DataFrame, root: str, name: str, checkpoint: str, *, model_id: str = HASH_MODEL, **options):
    """Add documents to a collection batch by batch, resuming after the last finished batch.

    A batch replaces its documents, so one that is repeated after a failure makes no difference; a
    batch that fails stops the query. A collection of another model is refused.
    """
    spark = docs.sparkSession
    require_model(spark, root, name, model_id)
    write_settings(spark, root, name, model_id=model_id, tokenizer_id=model_id)

    def add(batch: DataFrame, batch_id: int) -> None:
        write_changes(collection_chunks(batch, name, **options), root, name)

    return (
        docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
