import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textshield.operators import embedding as emb
from textshield.operators.chunking import (
    assign_ids,
    chunk_language,
    chunk_recursive,
    chunk_window,
    corpus_stats,
    separators_for,
    split_text,
)
from textshield.operators.upserts import fill_metadata, update, upsert
from textshield.plans.corpus import build_collection, collection_chunks
from textshield.sources import collections as col
from textshield.sources.xml import read_xml_corpus, xml_text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=200), st.integers(2, 30), st.integers(0, 10))
def test_recursive_chunks_cover_the_text(text, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = split_text(text, separators_for(), size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    solid = lambda t: re.sub(r"\s", "", t)
    at = 0
    for c in chunks:
        found = [i for i in range(max(0, at - overlap - size), at + 1) if solid(text)[i:i + len(solid(c))] == solid(c)]
        assert found
        at = max(at, max(found) + len(solid(c)))
    assert at == len(solid(text))


@pytest.mark.parametrize("text, size, overlap, want", [
    ("one two three four", 9, 0, ["one two", "three", "four"]),
    ("one two three four", 9, 4, ["one two", "three", "four"]),
    ("aa bb cc dd", 5, 3, ["aa bb", "cc", "dd"]),
    ("aa bb cc dd", 6, 3, ["aa bb", "bb cc", "cc dd"]),
    ("para one\n\npara two is longer", 12, 0, ["para one", "para two is", "longer"]),
    ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
    ("  \n\n ", 4, 1, []),
])
def test_recursive_chunks(text, size, overlap, want):
    assert split_text(text, separators_for(), size, overlap) == want


def test_language_chunks(spark):
    code = "import x\n\nclass A:\n    pass\n\ndef f():\n    return 1\n"
    df = spark.createDataFrame([(1, code)], "doc_id long, text string")
    rows = chunk_language(df, "python", 30, 0).orderBy("chunk_ix").collect()
    assert [r.chunk for r in rows] == ["import x", "class A:\n    pass", "def f():\n    return 1"]
    generic = [r.chunk for r in chunk_recursive(df, 30, 0).orderBy("chunk_ix").collect()]
    assert [r.chunk for r in chunk_language(df, "klingon", 30, 0).orderBy("chunk_ix").collect()] == generic
    for language in ("markdown", "latex", "html", "rst", "cobol"):
        assert all(re.compile(s) for s in separators_for(language))


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (10, 7), (7, 6), (100, 20)])
def test_window_chunks(spark, size, overlap):
    texts = ["", "a", "abcdefghij", "añ😀" * 11, "x\n\r y" * 13, "0123456789" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in chunk_window(df, size, overlap).orderBy("doc_id", "chunk_ix").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    step = size - overlap
    want = {i: [t[s:s + size] for s in range(0, max(len(t) - overlap - 1, 0) + 1, step)] for i, t in enumerate(texts) if t}
    assert got == want


def test_ids_and_stats(spark):
    df = spark.createDataFrame([(1, "a" * 30), (2, None)], "doc_id long, text string")
    chunks = chunk_window(df, 20, 5)
    ids = [r.chunk_id for r in assign_ids(chunks, "c").collect()]
    assert ids == [r.chunk_id for r in assign_ids(chunks.repartition(3), "c").orderBy("chunk_ix").collect()] and len(set(ids)) == 2
    kept = assign_ids(chunks.withColumn("mine", F.when(F.col("chunk_ix") == 0, "own")), "c", user_id="mine")
    assert {r.chunk_id for r in kept.collect()} == {"own", ids[1]}
    assert corpus_stats(df, chunks).first().asDict() == {"n_docs": 2, "total_chars": 30, "n_chunks": 2, "chunk_chars": 35}


def tokens(spark):
    rows = [(1, 0, 1, [1.0, 0.0]), (1, 1, 1, [0.0, 3.0]), (1, 2, 0, [9.0, 9.0]), (2, 0, 0, [5.0, 0.0]), (2, 1, 0, [0.0, 2.0]), (3, 0, 0, [7.0, 7.0]), (3, 1, 1, [0.0, 4.0])]
    return spark.createDataFrame(rows, "item_id long, pos long, mask int, vec array<float>")


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_pooling(spark, partitions):
    t = tokens(spark).repartition(partitions)
    get = lambda df: {r.item_id: r.embedding for r in df.collect()}
    mean, average, last = get(emb.pool_mean(t)), get(emb.pool_average(t)), get(emb.pool_last(t))
    assert mean[1] == pytest.approx([1 / np.sqrt(10), 3 / np.sqrt(10)]) and mean[2] == [0.0, 0.0]
    assert average[1] == pytest.approx(mean[1]) and average[2] is None
    assert last == {1: [0.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    assert emb.pooling_for("unknown") is emb.pool_mean and emb.pooling_for("thenlper/gte-large") is emb.pool_average


def test_embedders(spark):
    df = spark.createDataFrame([(1, "Red red blue"), (2, ""), (3, None), (4, "blue, red; RED!")], "id long, text string")
    vectors = {r.id: r.embedding for r in emb.hash_embed(df).collect()}
    assert sorted(x for x in vectors[1] if x)[-1] == pytest.approx(2 / np.sqrt(5)) and vectors[1] == vectors[4]
    assert set(vectors[2]) == set(vectors[3]) == {0.0}

    def length_model():
        return lambda texts: [[float(len(t or ""))] for t in texts]

    assert {r.id: r.embedding for r in emb.embed(df, length_model).collect()} == {1: [12.0], 2: [0.0], 3: [0.0], 4: [15.0]}
    assert [r.embedding for r in emb.embed(df.where("id = 1"), length_model, max_chars=5).collect()] == [[5.0]]


def test_upsert_and_update(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, text string")
    new = spark.createDataFrame([("b", None), ("c", "3")], "chunk_id string, text string")
    rows = lambda df: sorted((r.chunk_id, r.text or "") for r in df.collect())
    once = upsert(base, new)
    assert rows(once) == rows(upsert(once, new)) == [("a", "1"), ("b", ""), ("c", "3")]
    assert rows(update(base, new)) == [("a", "1"), ("b", "")]
    texts = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, text string")
    metadata = spark.createDataFrame([(0, {"k": "v"})], "pos int, metadata map<string,string>")
    assert {r.pos: r.metadata for r in fill_metadata(texts, metadata).collect()} == {0: {"k": "v"}, 1: {}}


def test_collections(spark, tmp_path):
    root = str(tmp_path)
    assert col.load_collection(spark, root, "c").count() == 0 and col.read_settings(spark, root, "c") is None
    docs = spark.createDataFrame([(i, f"text number {i} " * 60) for i in range(5)], "doc_id long, text string")
    build_collection(docs, root, "c")
    first = col.load_collection(spark, root, "c")
    n = first.count()
    assert n == collection_chunks(docs, "c").count() > 5
    assert col.collection_count(first).first().n_chunks == n
    build_collection(docs.where("doc_id < 2"), root, "c")
    small = col.load_collection(spark, root, "c")
    assert {r.doc_id for r in small.collect()} == {"0", "1"}
    changed = collection_chunks(docs.where("doc_id in (1, 4)").withColumn("text", F.concat(F.lit("new "), "text")), "c")
    for _ in range(2):
        col.write_changes(changed, root, "c")
    merged = col.load_collection(spark, root, "c")
    assert merged.count() == merged.select("chunk_id").distinct().count()
    assert {r.doc_id for r in merged.where("text like 'new %'").collect()} == {"1", "4"}
    # a collection may be replaced by what derives from it
    col.write_collection(merged.where("doc_id <> '0'"), root, "c")
    assert {r.doc_id for r in col.load_collection(spark, root, "c").collect()} == {"1", "4"}
    assert col.read_settings(spark, root, "c").model_id == "word-hash-64"
    col.require_model(spark, root, "c", "word-hash-64")
    with pytest.raises(ValueError):
        col.require_model(spark, root, "c", "other")


def test_whole_documents_keep_user_ids(spark):
    docs = spark.createDataFrame([(1, "a", "mine"), (2, "b", None)], "doc_id long, text string, uid string")
    rows = {r.doc_id: r.chunk_id for r in collection_chunks(docs, "c", chunked=False, user_id="uid").collect()}
    assert rows["1"] == "mine" and len(rows["2"]) == 64


def test_xml_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_text("<r><a>x<b>y</b>z</a>w</r>")
    (tmp_path / "sub" / "b.xml").write_text('<?xml version="1.0" encoding="ISO-8859-1"?><r>\xe9 &amp; </r>', encoding="latin-1")
    (tmp_path / "bad.xml").write_text("<r>")
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "none.xml").write_text("<r/>")
    (tmp_path / "other.txt").write_text("<r>no</r>")
    rows = {r.file_name: r.text for r in read_xml_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a.xml": "Document: a.xml\n\nx w y z", "b.xml": "Document: b.xml\n\né &", "none.xml": "Document: none.xml\n\n"}
    df = spark.createDataFrame([("<r><a>x<b>y</b>z</a>w</r>",)], "x string")
    assert df.select(xml_text(F.col("x"), F.lit("f"), "document").alias("t")).first().t == "Document: f\n\nx y z w"
