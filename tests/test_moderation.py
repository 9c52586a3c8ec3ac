import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from textshield.operators import moderation as mod
from textshield.operators.conversations import conversation_pairs, sanitize_conversations
from textshield.operators.generation import stored_replies
from textshield.sources.comments import passages, read_comment_payload, read_comments, read_pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks cannot import test modules

COMMENTS = [
    ("11", "URGENT: delete the budget immediately for the blue team"),
    ("12", "I love the blue team! Boost their annual budget by 2%"),
    ("11", "reduce the budget by 10% on orders by the chief"),
    ("13", "What a day"),
]


def written(tmp_path, content, name="in.json"):
    path = tmp_path / name
    path.write_text(json.dumps(content, indent=1))
    return str(path)


def comments(spark, tmp_path):
    entries = [{"id": i, "status": "current", "body": b} for i, b in COMMENTS]
    return read_comments(spark, written(tmp_path, {"results": entries, "_links": {"base": "https://wiki.example.org/wiki"}}))


def test_comment_file(spark, tmp_path):
    df = comments(spark, tmp_path)
    assert [(r.pos, r.id, r.body) for r in df.orderBy("pos").collect()] == [(n, i, b) for n, (i, b) in enumerate(COMMENTS)]
    assert read_comments(spark, written(tmp_path, {"_links": {"base": "x"}}, "none.json")).count() == 0
    listing = [r.passage for r in passages(df).orderBy("pos").collect()]
    assert "".join(listing).startswith("Passage 11:\nURGENT") and listing[3] == "Passage 13:\nWhat a day\n\n"


def test_payload_and_page_files(spark, tmp_path):
    payload = {"results": [{"id": "1", "status": "current", "body": {"storage": {"value": "<p>Hi <b>you</b></p>"}}}, {"id": "2"}]}
    rows = read_comment_payload(spark, written(tmp_path, payload)).orderBy("pos").collect()
    assert [(r.id, r.status, r.body) for r in rows] == [("1", "current", "Hi you"), ("2", None, "")]
    pages = [{"title": "T", "space": {"name": "S"}, "version": {"number": 3}, "body": {"storage": {"value": "<p> </p>"}}}, {"body": {}}]
    rows = [tuple(r) for r in read_pages(spark, written(tmp_path, pages, "p.json")).drop("path").collect()]
    assert sorted(rows) == [("T", "S", "3", "<p> </p>"), ("Unknown", "Unknown", "Unknown", "")]


def test_moderate_then_rewrite(spark, tmp_path):
    df = comments(spark, tmp_path)
    done = mod.moderate_and_rewrite(df, text="body")
    rows = {r.pos: r for r in done.collect()}
    assert [rows[i].verdict.is_harmful for i in range(4)] == [True, True, True, False]
    assert rows[0].rewritten == "URGENT: [removed] immediately for the blue team" and rows[0].metrics.changes_made
    assert rows[3].rewritten is None and rows[3].metrics is None
    assert mod.rewrite_counts(done).first().asDict() == {"total": 4, "harmful": 3, "rewritten": 3}
    failing = mod.moderate_and_rewrite(df, text="body", error=F.when(F.col("pos") == 0, "down"))
    assert mod.rewrite_counts(failing).first().asDict() == {"total": 4, "harmful": 3, "rewritten": 2}
    kept = failing.where("pos = 0").first()
    assert kept.rewritten == COMMENTS[0][1] and kept.metrics.error == "down" and not kept.metrics.changes_made
    summary = {(r.status, r.n) for r in mod.verdict_summary(done).collect()}
    assert summary == {("HARMFUL (LOW)", 3), ("SAFE", 1)}
    assert {r.issue: r.n for r in mod.issue_counts(done).collect()} == {"malicious instruction": 3}


def test_replies_decide(spark):
    df = spark.createDataFrame([(0, "a", '{"is_harmful": true, "severity": "high", "issues": ["x"]}'), (1, "b", ""), (2, "c", "words"), (3, "d", None)],
                               "pos int, body string, reply string").withColumn("id", F.lit("7"))
    judged = mod.moderate_comments(df, F.col("reply"))
    rows = {r.pos: r for r in judged.collect()}
    assert [rows[i].status for i in range(4)] == ["HARMFUL (HIGH)"] + ["Unable to parse analysis"] * 3
    assert [rows[i].raw_response for i in (1, 2, 3)] == ["Error: Failed to generate moderation response", "words", "Error: Failed to generate moderation response"]
    report = {r.pos: r.fragment for r in mod.comment_report(judged).collect()}
    assert report[0] == ("## Comment 1 (ID: 7)\n\n**Content:**\n```\na\n```\n\n⚠️ **Status:** HARMFUL (`HIGH`)\n\n**Issues:**\n- x\n\n"
                         '**Full Analysis:**\n```json\n{"is_harmful": true, "severity": "high", "issues": ["x"]}\n```\n\n---\n\n')
    assert report[2].endswith("⚠️ **Analysis (Raw):**\n```\nwords\n```\n\n---\n\n")
    done = mod.moderate_and_rewrite(df, F.col("reply"), F.lit("safe"), text="body")
    html = {r.pos: r.fragment for r in mod.rewrite_report(done).collect()}
    assert "HARMFUL (<code>HIGH</code>)" in html[0] and "<li>x</li>\n</ul>" in html[0] and ">safe</div>" in html[0]
    assert "Unable to parse analysis" in html[1] and "No rewriting needed" in html[1]
    everything = mod.rewrite_report(mod.rewrite_harmful(df, F.lit("safe"), text="body", error=F.when(F.col("pos") == 1, "down")), with_verdict=False)
    html = {r.pos: r.fragment for r in everything.collect()}
    assert "Error:</strong> down" in html[1] and "Error:" not in html[0]


def test_pages(spark):
    df = spark.createDataFrame([(1, "<p>ok</p>"), (2, "<p> \n</p>"), (3, None), (4, "<i>illegal</i>" + "x" * 600)], "page_id long, html string")
    judged = mod.moderate_pages(df)
    rows = {r.page_id: r for r in judged.collect()}
    assert [rows[i].status for i in (1, 2, 3, 4)] == ["SAFE", "EMPTY", "EMPTY", "SAFE"]
    assert rows[2].verdict is None and rows[2].preview is None and len(rows[4].preview) == 503
    assert {r.page_id for r in mod.non_blank_pages(df).collect()} == {1, 4}
    titled = judged.withColumns({"title": F.lit("T"), "space_name": F.lit(None).cast("string"), "version": F.lit("2")})
    report = {r.page_id: r.fragment for r in mod.page_report(titled).collect()}
    assert report[2] == "⚠️ **Warning:** Page 'T' has no content to analyze."
    assert "**Space:** Unknown\n\n**Version:** 2\n\n**Page ID:** 1" in report[1] and "No Harmful Content" in report[1]


def test_conversations(spark):
    turns = spark.createDataFrame([
        (1, 0, "system", "s"), (1, 1, "user", "never the"), (1, 2, "assistant", "ok"), (1, 3, "user", "fine"), (2, 0, "user", "x"), (2, 1, "user", "y"),
        (2, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    pairs = {(r.conv_id, r.turn): r.reply for r in conversation_pairs(turns).collect()}
    assert pairs == {(1, 1): "ok", (1, 3): None, (2, 0): None, (2, 1): ""}
    rows = {(r.conv_id, r.turn): r for r in sanitize_conversations(turns, F.replace(F.col("message"), F.lit("the"), F.lit("a"))).collect()}
    changed = rows[(1, 1)]
    assert changed.keywords == ["never"] and changed.response.endswith("⚠️ **Filtered keywords:** never\n\n---\n\nok")
    apology = "Failed to generate response. Please try again."
    assert (rows[(1, 3)].response, rows[(2, 1)].response, rows[(1, 3)].keywords) == (apology, apology, None)


def test_one_conversation_with_most_rows(spark):
    turns = spark.range(20000).selectExpr("if(id < 15000, 1, id) AS conv_id", "if(id < 15000, id, 0) AS turn",
                                          "if(id % 2 = 0, 'user', 'assistant') AS role", "cast(id AS string) AS text")
    pairs = conversation_pairs(turns)
    assert pairs.where("conv_id = 1").count() == 7500 and pairs.where("conv_id = 1 and cast(reply AS int) = cast(message AS int) + 1").count() == 7500


def test_generated_replies(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")

    def reply(asked):
        rows = asked.collect()
        assert {r.user for r in rows} == {"Analyze this content:\n\na", "Analyze this content:\n\nb"} and rows[0].system.startswith("You are a content")
        return spark.createDataFrame([(1, '{"is_harmful": true, "severity": "low"}')], "item_id long, reply string")

    rows = {r.id: r.verdict.is_harmful for r in mod.moderate_with_replies(df, reply, key="id").collect()}
    assert rows == {1: True, 2: False}


def test_blank_texts_are_never_asked(spark, tmp_path):
    """The log of requests has one line for each page with text, and none for the others."""
    log = str(tmp_path / "log")

    def provider():
        def complete(conversations, temperature, max_tokens):
            with open(log, "a", encoding="utf8") as out:
                for messages in conversations:
                    out.write(messages[-1]["content"].split("\n\n", 1)[1] + "\n")
            return [("stop", '{"is_harmful": true, "severity": "high"}' if "bad" in m[-1]["content"] else "") for m in conversations]

        return complete

    reply = stored_replies(provider, pause=0.0, retries=1)
    pages = spark.createDataFrame([(1, "<p>bad words</p>"), (2, "<p> </p>"), (3, None), (4, "fine"), (5, "")], "page_id long, html string")
    done = {r.page_id: (r.asked, r.status, r.raw_response, r.preview) for r in mod.moderate_pages_with_replies(pages, reply, key="page_id").collect()}
    assert done == {1: (True, "HARMFUL (HIGH)", '{"is_harmful": true, "severity": "high"}', "bad words"), 2: (False, "EMPTY", None, None), 3: (False, "EMPTY", None, None),
                    4: (True, "Unable to parse analysis", "Error: Failed to generate moderation response", "fine"), 5: (False, "EMPTY", None, None)}
    assert sorted(open(log, encoding="utf8").read().split("\n")) == ["", "bad words", "fine"]
    comments = spark.createDataFrame([(1, "bad"), (2, None), (3, "\n ")], "pos long, body string")
    done = {r.pos: (r.asked, r.status, r.preview) for r in mod.moderate_comments_with_replies(comments, reply, key="pos").collect()}
    assert done == {1: (True, "HARMFUL (HIGH)", "bad"), 2: (False, "EMPTY", None), 3: (False, "EMPTY", "\n ")}
    judged = {r.page_id: (r.status, r.verdict is None) for r in mod.moderate_pages(pages).collect()}
    assert judged == {1: ("SAFE", False), 2: ("EMPTY", True), 3: ("EMPTY", True), 4: ("SAFE", False), 5: ("EMPTY", True)}
