"""The registered queries against SQL, and the pipeline's stages on each other's output."""

import pytest

from corpus_pipeline import STAGES, run
from oracle import difference
from textshield.llm.katz import katz_scores
from textshield.llm.queries import QUERIES, SQL, remainder

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert difference(spark, FOLDER, QUERIES[name], SQL[name]) is None


def test_lm_scoring_uses_trigrams(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scores = lambda df: {r["doc_id"]: round(r["score"], 6) for r in df.collect()}
    assert scores(QUERIES["op2_lm_scoring"](spark, FOLDER)) == scores(katz_scores(documents, remainder("doc_id", 7, 2), order=3))


def test_suffix_dedup_returns_the_text_that_is_left(spark, tmp_path):
    """A passage of two texts is in neither result, a text without one comes back whole, also where a character is cut through."""
    passage = " ".join(f"word{i}" for i in range(60))
    texts = [f"before {passage}\nafter", f"other {passage}\nend", "clean é\ntext", f"1é{passage}ñ", f"2é{passage}ò", None, "copy " * 90, "copy " * 90]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op5_suffix_dedup"](spark, str(tmp_path))
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert {r["doc_id"]: r["text"] for r in rows.collect()} == {0: "beforeafter", 1: "otherend", 2: "clean é\ntext", 3: "1\ufffd", 4: "2\ufffd", 5: "", 6: "", 7: ""}


def test_pipeline(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = run(spark, FOLDER)
    assert 0 < rows.count() <= documents.count() and rows.filter("NOT round_trip").count() == 0
    assert [s[0] for s in STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert all(stage(spark, documents, FOLDER).columns == documents.columns for _, stage in STAGES[:-1])
