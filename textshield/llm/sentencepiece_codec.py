"""SentencePiece encoding and decoding as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from textshield.llm.blocks import batches
from textshield.llm.pieces import MARKER, Encoder, Vocabulary
from textshield.llm.shipping import ship

TEXT_BYTES = 2 << 20


def read_vocabulary(path: str) -> Vocabulary:
    """The pieces of a ``.model`` file with byte fallback; called on the driver."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.vocab_size())
    fallback = [i for i in every if model.is_byte(i)]
    if len(fallback) != 256 or fallback != list(range(fallback[0], fallback[0] + 256)):
        raise ValueError("the model has no byte fallback")
    special = [model.is_control(i) or model.is_unknown(i) for i in every]
    return Vocabulary([model.id_to_piece(i) for i in every], [model.get_score(i) for i in every], special, fallback[0])


def _added(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _lists(encoder: Encoder, texts: pa.Array) -> pa.Array:
    found, counts = encoder.encode([t or "" for t in texts.to_pylist()])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(found))


def _texts(vocabulary: Vocabulary, ids: pa.Array) -> pa.Array:
    values = ids.flatten().to_numpy(zero_copy_only=False)
    counts = np.array([0 if n is None else n for n in ids.value_lengths().to_pylist()], np.int64)
    if len(values) and not 0 <= values.min() <= values.max() < len(vocabulary.text):
        raise ValueError("an id is not in the vocabulary")
    raw, size = vocabulary.joined(values)
    edges = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return pa.array([raw[a:b].decode(errors="replace").removeprefix(" ") for a, b in zip(edges[:-1], edges[1:])], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids``, the pieces of the best unigram segmentation of each whole text.

    A space goes before the text and spaces count as the marker letter; a letter without a piece
    becomes its UTF-8 bytes. A null or empty text has an empty list. Rows are encoded on their own,
    so repeated rows give repeated results and an empty table an empty result; an existing column
    named ``ids`` is replaced. The vocabulary bounds what tasks are sent.
    """
    load = ship(docs.sparkSession, vocabulary)
    rest = [c for c in docs.columns if c != ids]

    def encoded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load())
        for batch in batches(stream, text, TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(encoder, batch.column(rest.index(text)))], [*rest, ids])

    return docs.select(*rest).mapInArrow(encoded, _added(docs, ids, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns and ``out``, the text of each list of ids.

    Pieces are joined, markers become spaces, the space before the text goes, byte pieces are read
    as UTF-8 (what is no UTF-8 becomes U+FFFD). A null or empty list gives an empty text; ids outside
    the vocabulary are an error. An existing column named ``out`` is replaced.
    """
    load = ship(encoded.sparkSession, vocabulary)
    rest = [c for c in encoded.columns if c != out]

    def decoded(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load()
        for batch in stream:
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(vocabulary, batch.column(rest.index(ids)))], [*rest, out])

    return encoded.select(*rest).mapInArrow(decoded, _added(encoded, out, T.StringType()))


def encode_and_check(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``ids``, ``n_tokens``, ``n_byte_tokens`` and ``round_trip``, whether decoding gives the text.

    A text is encoded and decoded in the same pass over the rows, as ``encode`` and ``decode`` do, so
    that a task keeps one vocabulary and only ids leave it.
    """
    vocabulary = read_vocabulary(path)
    load = ship(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, round_trip boolean"

    def checked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load())
        for batch in batches(stream, "text", TEXT_BYTES):
            texts = pc.fill_null(batch.column(1), "")
            lists = _lists(encoder, texts)
            same = pc.equal(_texts(encoder.vocabulary, lists), pc.replace_substring(texts, MARKER, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, same], ["key", "ids", "round_trip"])

    is_byte = lambda i: i.between(vocabulary.bytes_from, vocabulary.bytes_from + 255)
    return rows.mapInArrow(checked, schema).select(
        F.col("key").alias(key), "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.size(F.filter("ids", is_byte)).cast("long").alias("n_byte_tokens"), "round_trip",
    )


def tokenizer_path(name: str) -> str:
    """Where the installed package of public tokenizers keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
