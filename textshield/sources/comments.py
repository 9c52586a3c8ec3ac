"""Comment files, comment payloads and page records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textshield.fixed_values import UNKNOWN
from textshield.functions.text import strip_html
from textshield.schemas import COMMENT_FILE, COMMENT_PAYLOAD, PAGE_RECORD


def _listed(df: DataFrame, *keep: str) -> DataFrame:
    """One row per entry of ``results`` with its position; ids repeat, so the position is the key."""
    entries = F.coalesce(F.col("results"), F.slice(F.col("results"), 1, 0))
    return df.select(*keep, F.posexplode(entries).alias("pos", "comment"))


def _files(spark: SparkSession, path: str, schema: str, mode: str) -> DataFrame:
    """One row a file with its ``path``. A file that is no JSON is an error, or has no content in mode ``PERMISSIVE``."""
    reader = spark.read.schema(schema).options(multiLine=True, mode=mode, recursiveFileLookup=True)
    return reader.json(path).select(F.col("_metadata.file_path").alias("path"), "*")


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of the files that are no JSON, which mode ``PERMISSIVE`` reads as empty."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("json")).where("json IS NULL").select("path")


def read_comments(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """``path, pos, id, status, body`` of comment files; file and position are the key. A missing file is an error."""
    return comments(_files(spark, path, COMMENT_FILE, mode), "path")


def comments(df: DataFrame, *keep: str) -> DataFrame:
    return _listed(df, *keep).select(*keep, "pos", "comment.id", "comment.status", "comment.body")


def read_comment_payload(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """The same of payload files, whose bodies are nested and have markup."""
    return flatten_comment_payload(_files(spark, path, COMMENT_PAYLOAD, mode), "path")


def flatten_comment_payload(df: DataFrame, *keep: str) -> DataFrame:
    """Comments of nested payloads, with the markup of their bodies removed."""
    body = strip_html(F.coalesce(F.col("comment.body.storage.value"), F.lit("")))
    return _listed(df, *keep).select(*keep, "pos", "comment.id", "comment.status", body.alias("body"))


def read_pages(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """``path, title, space_name, version, html`` of files with one page record each."""
    return page_record(_files(spark, path, PAGE_RECORD, mode), "path")


def page_record(df: DataFrame, *keep: str) -> DataFrame:
    """``title, space_name, version, html`` with defaults for what a page record leaves out."""
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))
    return df.select(
        *keep,
        known("title").alias("title"),
        known("space.name").alias("space_name"),
        known("version.number").alias("version"),
        F.coalesce(F.col("body.storage.value"), F.lit("")).alias("html"),
    )


def passages(df: DataFrame) -> DataFrame:
    """``pos, passage``: the listing of comments, one row each. Write it ordered by position."""
    from textshield.functions.prompts import passage

    named = F.coalesce(F.col("id"), F.lit(UNKNOWN))
    return df.select("pos", passage(named, F.coalesce(F.col("body"), F.lit(""))).alias("passage"))
