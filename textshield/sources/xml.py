"""XML files as documents."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textshield.fixed_values import DOCUMENT_FORMAT
from textshield.operators.slices import mapped


def _parts(content) -> list[str]:
    """Stripped texts of all elements, each followed by what comes after the element's end tag."""
    elements = ElementTree.fromstring(content).iter()
    return [part.strip() for e in elements for part in (e.text, e.tail) if part and part.strip()]


@F.arrow_udf(StringType())
def _element_text(contents: pa.Array) -> pa.Array:
    def read(content):
        try:
            return " ".join(_parts(content))
        except (ElementTree.ParseError, LookupError, ValueError, TypeError):
            return None

    return mapped(contents, read, pa.string())


def xml_text(content: Column, file_name: Column, order: str = "element") -> Column:
    """Text of an XML document under a line that names it; null when it cannot be parsed.

    With ``order="element"`` the text after an element comes right behind the element's own text,
    before that of its children. ``order="document"`` keeps the order of the document and stays
    inside the JVM.
    """
    if order == "document":
        parts = F.transform(F.xpath(content.cast("string"), F.lit("//text()")), lambda p: F.trim(p))
        text = F.concat_ws(" ", F.filter(parts, lambda p: p != ""))
    else:
        text = _element_text(content)
    return F.when(text.isNotNull(), F.format_string(DOCUMENT_FORMAT, file_name, text))


def xml_documents(files: DataFrame) -> DataFrame:
    """``path, file_name, text`` of rows with ``path`` and ``content``; what cannot be parsed is dropped."""
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")
    read = named.select("path", "file_name", xml_text(F.col("content"), F.col("file_name")).alias("text"))
    return read.where(F.col("text").isNotNull())


def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*.xml`` files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml")
    return reader.load(folder).select("path", "content")


def read_xml_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return xml_documents(xml_files(spark, folder))
