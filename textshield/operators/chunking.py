"""Documents to chunks."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE, GENERIC_SEPARATORS, LANGUAGE_SEPARATORS
from textshield.functions.vectors import let
from textshield.operators.slices import mapped


def chunk_window(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, *, text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the one before.

    The text is first cut into strides in one pass; a chunk joins the strides it covers. That stays
    linear in the length of the text, which repeated substrings from the start would not.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    stride = size - overlap
    covered = -(-size // stride)
    text_col = F.col(text)
    last = F.floor(F.greatest(F.length(text_col) - F.lit(overlap + 1), F.lit(0)) / stride).cast("int")
    strides = F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    window = lambda cut, i: F.substring(F.concat_ws("", F.slice(cut, i + 1, F.lit(covered))), 1, size)
    parts = let(strides, lambda cut: F.transform(F.sequence(F.lit(0), last), lambda i: window(cut, i)))
    others = [c for c in df.columns if c != text]
    return _exploded(df.where(F.length(text_col) > 0), others, parts)


def _exploded(df: DataFrame, others: list[str], parts: Column) -> DataFrame:
    """One row per part. The outer form keeps Spark from computing the parts twice, once to test for emptiness."""
    return df.select(*others, F.posexplode_outer(parts).alias("chunk_ix", "chunk")).where(F.col("chunk_ix").isNotNull())


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text, each beginning with the separator that opened it."""
    if not separator:
        return list(text)
    starts = [m.start() for m in re.finditer(separator, text) if m.end() > m.start()]
    edges = sorted({0, *starts, len(text)})
    return [text[a:b] for a, b in zip(edges, edges[1:])]


def _runs(text: str, separators: list[str], size: int) -> Iterator[list[str]]:
    """Runs of neighbouring short pieces. A long piece is cut by the finer separators and ends a run."""
    usable = [i for i, s in enumerate(separators) if not s or re.search(s, text)]
    at = usable[0] if usable else len(separators) - 1
    finer = separators[at + 1 :]
    run: list[str] = []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            run.append(piece)
            continue
        if run:
            yield run
            run = []
        if finer:
            yield from _runs(piece, finer, size)
        else:
            yield [piece]
    if run:
        yield run


def _filled(run: Iterable[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces as long as they fit; the next chunk starts with a tail of at most ``overlap``."""
    held: deque[str] = deque()
    total = 0
    for piece in run:
        if held and total + len(piece) > size:
            yield "".join(held).strip()
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    yield "".join(held).strip()


def split_text(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    chunks = (c for run in _runs(text, separators, size) for c in _filled(run, size, overlap))
    return [c for c in chunks if c]


def separators_for(language: str = "") -> list[str]:
    """Separators from coarse to fine; an unknown or empty language means plain text."""
    return LANGUAGE_SEPARATORS.get(language) or [re.escape(s) for s in GENERIC_SEPARATORS]


def recursive_chunks(text: Column, size: int, overlap: int, language: str = "") -> Column:
    separators = separators_for(language)

    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        return mapped(texts, lambda t: split_text(t, separators, size, overlap) if t else [], pa.list_(pa.string()))

    return split(text)


def chunk_recursive(df: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, *, language: str = "",
                    text: str = "text") -> DataFrame:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that fits.

    Texts are cut at blank lines, then lines, then words, then characters; a language brings its
    own separators instead. Documents without text have no chunk.
    """
    others = [c for c in df.columns if c != text]
    return _exploded(df, others, recursive_chunks(F.col(text), size, overlap, language))


def chunk_language(df: DataFrame, language: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, *,
                   text: str = "text") -> DataFrame:
    return chunk_recursive(df, size, overlap, language=language, text=text)


def assign_ids(chunks: DataFrame, collection: str, *, doc_id: str = "doc_id", user_id: str | None = None) -> DataFrame:
    """Add ``chunk_id``. It follows from collection, document and position, so a repeated task gives
    the same id; an id the user supplied is kept."""
    made = F.sha2(F.to_json(F.array(F.lit(collection), F.col(doc_id).cast("string"), F.col("chunk_ix").cast("string"))), 256)
    return chunks.withColumn("chunk_id", F.coalesce(F.col(user_id), made) if user_id else made)


def corpus_stats(docs: DataFrame, chunks: DataFrame, *, text: str = "text") -> DataFrame:
    """Documents, their characters, chunks and the chunks' characters, as one row."""
    counted = lambda df, col, kind: df.select(
        F.lit(kind).alias("kind"), F.length(F.coalesce(F.col(col), F.lit(""))).cast("long").alias("chars"))
    both = counted(docs, text, "doc").unionByName(counted(chunks, "chunk", "chunk"))
    of = lambda kind: F.col("kind") == kind
    return both.agg(
        F.count_if(of("doc")).alias("n_docs"),
        F.coalesce(F.sum(F.when(of("doc"), F.col("chars"))), F.lit(0)).alias("total_chars"),
        F.count_if(of("chunk")).alias("n_chunks"),
        F.coalesce(F.sum(F.when(of("chunk"), F.col("chars"))), F.lit(0)).alias("chunk_chars"),
    )
