"""Cases that earlier versions got wrong."""

import json
import math

import pytest

from textshield.operators.conversations import conversation_pairs
from textshield.operators.generation import generate
from textshield.operators.moderation import comment_report, moderate_comments
from textshield.operators.retrieval import topk
from textshield.operators.scanning import split_requests
from textshield.schemas import REQUESTS
from textshield.sources import collections as col
from textshield.sources.qa import qa_from_pairs, read_qa


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_a_vector_that_is_no_number_hides_no_other(spark):
    good = [(i, [math.cos(i), math.sin(i), i / 50]) for i in range(100)]
    bad = [(1000 + i, [float("nan"), 0.0, float("inf")]) for i in range(8)]
    for metric in ("l2", "ip", "cosine"):
        hits = [topk(_vectors(spark, good[:10]), _vectors(spark, c), 3, metric, query_id="vec_id", chunk_id="vec_id").collect() for c in (good, good + bad)]
        assert sorted(map(tuple, hits[0])) == sorted(map(tuple, hits[1])) and len(hits[0]) == 30


def test_small_vectors_rank_by_their_true_distance(spark):
    rows = [(i, [1e-6 * math.cos(i), 1e-6 * math.sin(3 * i)]) for i in range(200)]
    hits = topk(_vectors(spark, rows[50:51]), _vectors(spark, rows), 4, "l2", query_id="vec_id", chunk_id="vec_id").orderBy("rank").collect()
    q = rows[50][1]
    nearest = sorted(rows, key=lambda r: (sum((a - b) ** 2 for a, b in zip(q, r[1])), r[0]))
    assert [h["chunk_id"] for h in hits] == [r[0] for r in nearest[:4]]


def test_a_request_that_always_fails_takes_no_other_with_it(spark):
    def provider():
        def complete(conversations, temperature, max_tokens):
            if any("poison" in str(c) for c in conversations):
                raise RuntimeError("refused")
            return [("stop", "fine") for _ in conversations]
        return complete

    users = [(i, "be brief", "poison" if i == 5 else f"text {i}") for i in range(40)]
    requests = spark.createDataFrame(users, "item_id long, system string, user string").coalesce(1)
    attempts = generate(requests, provider, retries=2, pause=0.0).collect()
    assert {a["item_id"] for a in attempts if a["content"] == "fine"} == set(range(40)) - {5}
    assert [a["error"] for a in attempts if a["item_id"] == 5] == ["refused", "refused"]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_a_reply_is_the_next_turn_whatever_its_number(spark, block):
    said = [(1, 0, "user"), (1, 2, "assistant"), (1, 3, "user"), (1, 40, "assistant"), (1, 41, "user"), (1, 42, "user"), (2, 7, "user"), (2, 9000, "assistant"), (3, 1, "assistant")]
    turns = spark.createDataFrame([(c, t, r, f"{c}.{t}") for c, t, r in said], "conv_id long, turn long, role string, text string")
    pairs = {(r.conv_id, r.turn): r.reply for r in conversation_pairs(turns, block).collect()}
    assert pairs == {(1, 0): "1.2", (1, 3): "1.40", (1, 41): None, (1, 42): None, (2, 7): "2.9000"}


def test_long_conversations_share_no_key(spark):
    turns = spark.createDataFrame([(1, 1000, "user", "a"), (1, 1001, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "assistant", "d")],
                                  "conv_id long, turn long, role string, text string")
    assert {r.idx: r.response for r in qa_from_pairs(conversation_pairs(turns)).collect()} == {"1:1000": "b", "2:0": "d"}


def test_requests_that_cannot_be_read_are_set_aside_with_their_line(spark, tmp_path):
    lines = ['{"prompt": "fine"}', '{"prompt": "x", "toxicity_threshold": "abc"}', '{"prompt": "cut', '{"method": "guard"}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    valid, rejected = split_requests(spark.read.schema(f"{REQUESTS}, _corrupt_record string").json(str(tmp_path / "r.json")))
    assert [r.prompt for r in valid.collect()] == ["fine"] and "_corrupt_record" not in valid.columns
    found = {(r.error, r._corrupt_record) for r in rejected.collect()}
    assert found == {("request cannot be read", lines[1]), ("request cannot be read", lines[2]), ("prompt is missing", None)}


def test_questions_keep_the_order_of_their_file(spark, tmp_path):
    for name, ids in (("a", [5, 1]), ("b", [0])):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"idx": i, "prompt": "p", "response": "r"} for i in ids]))
    assert [(r.pos, r.idx) for r in read_qa(spark, str(tmp_path), 2).collect()] == [(0, 5), (1, 1)]
    assert {(r.path[-6:], r.pos) for r in read_qa(spark, str(tmp_path)).collect()} == {("a.json", 0), ("a.json", 1), ("b.json", 0)}


def test_a_document_that_shrinks_leaves_no_chunk_behind(spark, tmp_path):
    chunk = lambda doc, n, text: [(f"{doc}-{i}", doc, i, text, None, None) for i in range(n)]
    made = lambda rows: spark.createDataFrame(rows, col.CHUNKS)
    root = str(tmp_path)
    col.write_changes(made(chunk("z", 1, "only a change")), root, "d")
    assert col.load_collection(spark, root, "d").count() == 1
    col.write_collection(made(chunk("a", 5, "old") + chunk("b", 2, "old")), root, "c")
    col.write_changes(made(chunk("a", 3, "mid") + chunk("n", 1, "new")), root, "c")
    col.write_changes(made(chunk("a", 1, "new")), root, "c")
    rows = sorted((r.chunk_id, r.text) for r in col.load_collection(spark, root, "c").collect())
    assert rows == [("a-0", "new"), ("b-0", "old"), ("b-1", "old"), ("n-0", "new")]
    for _ in range(2):
        col.write_changes(made([("x", None, 0, "no document", None, None)]), root, "c")
    col.write_changes(made([]), root, "c")
    assert col.load_collection(spark, root, "c").count() == 5


def test_a_report_keeps_the_key_of_its_rows(spark):
    rows = spark.createDataFrame([(1, 0, "x", "text"), (2, 0, "y", "text")], "conv_id long, pos int, id string, body string")
    assert {(r.conv_id, r.pos) for r in comment_report(moderate_comments(rows), "conv_id").collect()} == {(1, 0), (2, 0)}
