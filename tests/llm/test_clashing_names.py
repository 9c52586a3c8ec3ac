"""Extra columns named like helpers and results keep their values; empty tables and very long texts work."""

import time

import pytest
from pyspark.sql import functions as F

from corpus_pipeline import STAGES
from textshield.llm import decontaminate, line_dedup, minhash, pii, sentencepiece_codec, token_counts, toxicity

HELPERS = "_r1 _r2 _lines _spans _cuts _row _key _text r1 r2 cid chosen kept row label part measured score w1 w2 start stop band component_id n_shingles hit key none".split()


@pytest.fixture(scope="module")
def clashing(spark):
    lines = "\n".join(f"line {i} of a passage that stands in two texts" for i in range(5))
    rows = [(1, f"alone one\n{lines}"), (2, f"alone two\n{lines}"), (3, "a short text"), (4, None), (5, ""), (3, "a short text"), (6, "word " * 40), (7, "word " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return lambda upper: frame.withColumns({(n.upper() if upper else n): F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) for n in HELPERS})


@pytest.mark.parametrize("upper", [False, True])
@pytest.mark.parametrize("name", ["lines", "near", "items", "toxic"])
def test_columns_keep_their_values(spark, clashing, name, upper):
    docs = clashing(upper)
    if name == "lines":
        out = line_dedup.remove_repeated_lines(docs)
        assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {1: 0, 2: 5, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}
        assert {r["text"] for r in out.filter("doc_id = 2").collect()} == {"alone two"} and out.count() == docs.count()
    elif name == "near":
        out = minhash.drop_near_duplicates(docs)
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5, 6]
    elif name == "items":
        out = decontaminate.remove_items(docs, spark.createDataFrame([(1, "a short text")], "item_id long, text string"))
        assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 4, 5, 6, 7]
    else:
        labels = spark.createDataFrame([], "doc_id long, toxic int")
        out = toxicity.drop_toxic(docs, toxicity.learn(docs, labels))
        assert out.count() == docs.count()
    assert out.columns[: len(docs.columns)] == docs.columns
    names = [n.upper() if upper else n for n in HELPERS]
    assert all(r[n] == f"{n.lower()} {r['doc_id']}" for r in out.collect() for n in names)


def test_names_of_results_are_replaced_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a", "x", 7)], "doc_id long, text string, N_LINES string, n_Removed int")
    assert line_dedup.remove_repeated_lines(docs).columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_empty_tables_of_the_other_operators(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept string")
    path = sentencepiece_codec.tokenizer_path("piece_bpe_32k.model")
    with open(sentencepiece_codec.tokenizer_path("byte_bpe_50k.json"), encoding="utf8") as file:
        counted = token_counts.count_tokens(none, file.read())
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (counted, pii.sanitised(none), minhash.drop_near_duplicates(none), decontaminate.remove_items(none, items),
               toxicity.drop_toxic(none, toxicity.learn(none, labels)), sentencepiece_codec.encode_and_check(none, path)):
        assert df.count() == 0


def test_pipeline_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


def test_many_addresses_in_one_text(spark):
    """The work for one text grows with the number of its matches, not with its square."""
    n = 100_000
    text = " ".join(f"u{i}@mail{i % 90}.org" for i in range(n))
    spans = pii.base_spans(F.col("text"))
    start = time.monotonic()
    row = spark.createDataFrame([(1, text)], "doc_id long, text string").select(spans.alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    assert row["n"] == n and (row["last"]["start"], row["last"]["stop"]) == (text.rindex("u"), len(text))
    assert time.monotonic() - start < 60


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 600])
def test_spans_across_blocks(spark, n):
    text = "é x" + "".join(f" {i}😀a{i}@b.cd" for i in range(n))
    got = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).first()["s"]
    want, at = [], 0
    for i in range(n):
        at = text.index(f"a{i}@b.cd", at)
        want.append((at, at + len(f"a{i}@b.cd"), f"a{i}@b.cd"))
    assert [(s["start"], s["stop"], s["match"]) for s in got] == want
