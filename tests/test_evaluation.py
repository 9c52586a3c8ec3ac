import json
import sys

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from textshield.operators import evaluation as ev
from textshield.sources.qa import read_qa, write_eval

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import test modules


def results(spark, rows):
    full = [(i, f"q{i}", n, s, "r", e) for i, (s, n, e) in enumerate(rows)]
    return spark.createDataFrame(full, "idx long, question string, retrieved_docs_count int, llm_score double, llm_reasoning string, error string")


def test_read_qa(spark, tmp_path):
    path = tmp_path / "qa.json"
    path.write_text(json.dumps([{"idx": i, "prompt": f"p{i}", "response": "r"} for i in range(5)]))
    assert read_qa(spark, str(path)).count() == read_qa(spark, str(path), 0).count() == 5
    assert [r.idx for r in read_qa(spark, str(path), 2).collect()] == [0, 1]


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_metrics(spark, partitions):
    df = results(spark, [(80.0, 5, None), (60.0, 5, None), (90.0, 3, None), (70.0, 5, None), (-1.0, 5, None), (0.0, 0, "failed")]).repartition(partitions)
    m = ev.aggregate_metrics(df, 12.5).first()
    assert m.total_questions == 6 and m.avg_llm_score == 75.0 and m.median_llm_score == 80.0
    assert m.avg_retrieval_count == pytest.approx(23 / 6) and m.questions_with_errors == 1 and m.total_eval_time_seconds == 12.5


def test_metrics_without_valid_scores(spark):
    m = ev.aggregate_metrics(results(spark, [(-1.0, 2, None), (50.0, 0, "x")])).first()
    assert (m.avg_llm_score, m.median_llm_score, m.total_questions) == (0.0, 0.0, 2)
    m = ev.aggregate_metrics(results(spark, [(1.0, 2, None)]).where("idx < 0")).first()
    assert (m.avg_llm_score, m.median_llm_score, m.avg_retrieval_count, m.total_questions) == (0.0, 0.0, 0.0, 0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(0, 130), st.sampled_from([0.0, 50.0, 100.0, 99.999])), min_size=1, max_size=60))
def test_upper_median(spark, scores):
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert ev.upper_median(df, "s").first()[0] == sorted(scores)[len(scores) // 2]


def test_histogram(spark):
    df = results(spark, [(s, 1, e) for s, e in [(100.0, None), (90.0, None), (89.9, None), (70.0, None), (50.0, None), (30.0, None), (29.0, None),
                                                (0.0, "failed"), (-1.0, None), (101.0, None)]])
    assert [(r.band, r.n) for r in ev.score_histogram(df).orderBy("position").collect()] == [
        ("Excellent (90-100)", 2), ("Good (70-89)", 2), ("Fair (50-69)", 1), ("Poor (30-49)", 1), ("Very Poor (0-29)", 2)]


@pytest.mark.parametrize("partitions", [1, 37])
def test_top_bottom(spark, partitions):
    df = results(spark, [(50.0, 1, None), (90.0, 1, None), (50.0, 1, None), (-1.0, 1, None), (50.0, 1, None), (10.0, 1, "x")]).repartition(partitions)
    rows = ev.top_bottom(df).orderBy(F.desc("side"), "place").collect()
    assert [(r.side, r.place, r.idx) for r in rows] == [("top", 1, 1), ("top", 2, 0), ("top", 3, 2), ("bottom", 1, 2), ("bottom", 2, 4), ("bottom", 3, 5)]


def test_judge(spark):
    df = spark.createDataFrame([(1, "answer", '{"score": 77, "reasoning": "fine"}'), (2, " \n", "x"), (3, "I am not sure.", "x"), (4, "answer", "broken"),
                                (5, None, "x"), (6, "answer", None)], "idx long, response string, reply string")
    rows = {r.idx: (r.llm_score, r.judge_failed) for r in ev.judge(df, F.col("reply")).collect()}
    assert rows == {1: (77.0, False), 2: (-1.0, False), 3: (-1.0, False), 4: (0.0, True), 5: (-1.0, False), 6: (0.0, True)}
    assert {r.llm_reasoning for r in ev.judge(df, F.col("reply"), enabled=False).collect()} == {"Skipped: No reference answer available"}
    asked = ev.judge_requests(df.withColumns({"prompt": F.lit("q"), "context": F.lit("c")})).collect()
    assert {r.item_id for r in asked} == {1, 4, 6} and all("REFERENCE ANSWER:\nanswer" in r.user for r in asked)
    stored = df.select(F.col("idx").alias("item_id"), "reply").where("idx < 3")
    rows = {r.idx: r.llm_score for r in ev.judge_with_replies(df.drop("reply"), stored).collect()}
    assert rows == {1: 77.0, 2: -1.0, 3: -1.0, 4: 0.0, 5: -1.0, 6: 0.0}


def test_evaluate_and_write(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "red fish", [1.0, 0.0]), (2, "blue bird" + "x" * 600, [0.0, 1.0])], "chunk_id long, text string, embedding array<float>")
    qa = spark.createDataFrame([(1, "which fish", "red fish", [1.0, 0.1]), (2, "lost", "a", None), (3, "unsure", "I am not sure.", [0.0, 1.0])],
                               "idx long, prompt string, response string, embedding array<float>")
    done = ev.evaluate(qa, chunks, 1)
    rows = {r.idx: r for r in done.collect()}
    assert rows[1].llm_score == 100.0 and rows[1].retrieved_context == "[Document 1]\nred fish\n" and rows[1].error is None
    assert (rows[2].llm_score, rows[2].retrieved_docs_count, rows[2].llm_reasoning, rows[2].retrieved_context) == (0.0, 0, "", "")
    assert rows[2].error == "the question has no vector"
    assert rows[3].llm_score == -1.0 and len(rows[3].retrieved_context) == 500
    write_eval(done, ev.aggregate_metrics(done), str(tmp_path / "out"))
    stored = spark.read.schema(done.schema).json(str(tmp_path / "out" / "detailed_results"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.values()))
    assert spark.read.json(str(tmp_path / "out" / "aggregate_metrics")).first().total_questions == 3
    empty = ev.evaluate(qa, chunks.where("chunk_id < 0"), 1).where("idx = 1").first()
    assert (empty.retrieved_docs_count, empty.llm_score, empty.error) == (0, 0.0, None)


def test_evaluate_with_a_model(spark, tmp_path):
    """The judge sees whole contexts, is not asked about failed or skipped questions, and not again in a second run."""
    log = str(tmp_path / "log")

    def judge():
        def complete(conversations, temperature, max_tokens):
            with open(log, "a", encoding="utf8") as out:
                for messages in conversations:
                    out.write(json.dumps([messages[0]["role"], messages[-1]["content"], temperature, max_tokens]) + "\n")
            return [("stop", "```json\n{\"score\": 61, \"reasoning\": \"so so\"}\n```" if "which" in m[-1]["content"] else "") for m in conversations]

        return complete

    long = "blue bird" + "x" * 600
    chunks = spark.createDataFrame([(1, "red fish", [1.0, 0.0]), (2, long, [0.0, 1.0])], "chunk_id long, text string, embedding array<float>")
    qa = spark.createDataFrame([(1, "which bird", "red fish", [0.0, 1.0]), (2, "lost which", "a", None), (3, "unsure which", "I am not sure.", [0.0, 1.0]),
                                (4, "silent", "answer", [1.0, 0.0])], "idx long, prompt string, response string, embedding array<float>")
    for _ in range(2):
        done = ev.evaluate_with_provider(qa, chunks, judge, 1, folder=str(tmp_path / "kept"), generation={"pause": 0.0})
        rows = {r.idx: (r.llm_score, r.llm_reasoning, r.retrieved_docs_count, r.error, r.judge_failed) for r in done.collect()}
        assert rows == {1: (61.0, "so so", 1, None, False), 2: (0.0, "", 0, "the question has no vector", True),
                        3: (-1.0, "Skipped: No reference answer available", 1, None, False), 4: (0.0, "Error during evaluation: no reply", 1, None, True)}
        asked = [json.loads(line) for line in open(log, encoding="utf8")]
        assert [a[0] for a in asked] == ["system"] * 4 and {(a[2], a[3]) for a in asked} == {(0.0, 1024)}
        assert len([a for a in asked if long in a[1]]) == 1 and len([a for a in asked if "silent" in a[1]]) == 3
    skipped = ev.evaluate_with_provider(qa, chunks, judge, 1, use_judge=False)
    assert {r.llm_score for r in skipped.where("error IS NULL").collect()} == {-1.0}


def test_rank_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 11), (1, 4, 12), (2, 1, 20)], "query_id long, rank int, doc_id long")
    truth = spark.createDataFrame([(1, 11), (1, 11), (1, 99), (2, 21), (3, 1)], "query_id long, doc_id long")
    totals = truth.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    per_query = ev.rank_metrics(ev.judged_hits(hits, truth), totals, 2)
    assert {r.query_id: tuple(r)[1:] for r in per_query.collect()} == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert ev.mean_rank_metrics(per_query).first().mrr == pytest.approx(0.5 / 3)


def test_citations_and_failures(spark):
    got = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (4, "z")], "query_id long, source string")
    want = spark.createDataFrame([(1, "a"), (1, "c"), (2, "y"), (3, "y"), (4, "z")], "query_id long, source string")
    rows = ev.citation_recall(got, want)
    modes = rows.withColumn("mode", ev.failure_mode(F.col("n_found"), F.col("n_truth"), F.col("n_retrieved"))).collect()
    assert {r.query_id: (r.citation_recall, r.mode) for r in modes} == {
        1: (0.5, "incomplete retrieval"), 2: (0.0, "irrelevant retrieval"), 3: (0.0, "retrieval failure"), 4: (1.0, "complete")}


def test_ngrams(spark, one):
    assert one(ev.ngrams(F.lit("The cat, the CAT"), 2)) == ["the cat", "cat the", "the cat"] and one(ev.ngrams(F.lit("one"), 2)) == []
    df = spark.createDataFrame([(1, "the cat the cat", "the cat sat"), (2, "", "x y"), (3, "a", "a")], "idx long, candidate string, reference string")
    rows = {r.idx: r for r in ev.ngram_overlap(df, 1).collect()}
    assert (rows[1].overlap, rows[1].precision, rows[1].recall) == (2, 0.5, 2 / 3) and rows[3].f1 == 1.0
    assert (rows[2].overlap, rows[2].precision, rows[2].f1) == (0, 0.0, 0.0)
    assert one(ev.hybrid_score(F.lit(1.0), F.lit(0.5), F.lit(0.25))) == pytest.approx(0.7)
