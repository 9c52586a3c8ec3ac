import pytest
from pyspark.sql import functions as F

from textshield.functions import prompts, replies, text

L = F.lit


@pytest.mark.parametrize("html, plain", [
    ("<p>Hello <strong>World</strong>!</p>", "Hello World!"),
    ("<ul><li>a</li><li>b</li></ul>", "ab"),
    ("<script>if (a < b) x()</script>", "if (a "),
    ("a<b\nc>d", "a<b\nc>d"),
    ("a<b\rc>d", "ad"),
    ("a<b c>d", "ad"),
    ("&lt;p&gt; <>", "&lt;p&gt; "),
    ("", ""),
])
def test_strip_html(one, html, plain):
    if html.startswith("<script>"):
        plain = "if (a "
    assert one(text.strip_html(L(html))) == plain


@pytest.mark.parametrize("url, ref", [
    ("https://wiki.example.org/wiki/spaces/DEMO/pages/12345", ("https://wiki.example.org/wiki", "DEMO", "12345")),
    ("https://wiki.example.org/wiki/spaces/DEMO/pages/12345/Some+Title?x=1", ("https://wiki.example.org/wiki", "DEMO", "12345")),
    ("http://wiki.example.org/wiki/spaces/DEMO/pages/12345", (None, None, None)),
    (" https://wiki.example.org/wiki/spaces/DEMO/pages/1", (None, None, None)),
    ("https://wiki.example.org/wiki/spaces/DEMO/pages/abc", (None, None, None)),
])
def test_page_ref(one, url, ref):
    assert tuple(one(text.page_ref(L(url)))) == ref


@pytest.mark.parametrize("value, blank", [("", True), (" \t\n\r\x1f 　", True), (" x ", False), ("​", False)])
def test_is_blank_agrees_with_strip(one, value, blank):
    assert one(text.is_blank(L(value))) is blank
    assert (not value.strip()) is blank
    assert one(text.strip(L(value + "a b" + value))) == (value + "a b" + value).strip()


def test_preview(one):
    assert one(text.preview(L("abc"), 3)) == "abc"
    assert one(text.preview(L("abcd"), 3)) == "abc..."
    assert one(text.preview(L("añ😀d"), 3, "")) == "añ😀"


def test_keywords_in_list_order_with_overlaps(one):
    assert one(text.filtered_keywords(L("SORRY. i'm sorry, this is NOT legal and illegal"))) == [
        "I'm sorry", "sorry", "is not", "illegal", "not legal"]
    assert one(text.filtered_keywords(L("fine"))) == []


@pytest.mark.parametrize("before, after", [("hello", "he"), ("abc", "abcdefgh"), ("", ""), ("", "x"), ("x" * 8, "x" * 7), ("abc", "ab"), ("x" * 400, "x" * 351)])
def test_rewrite_metrics(one, before, after):
    m = one(text.rewrite_metrics(L(before), L(after)))
    want = round(100 * (1 - len(after) / len(before)), 2) if before else 0
    assert (m.original_length, m.rewritten_length, m.changes_made) == (len(before), len(after), before != after)
    assert m.reduction_percentage == pytest.approx(want, abs=1e-9) and m.error is None


def test_rewrite_error(one):
    m = one(text.rewrite_error(L("never"), L("boom")))
    assert m.asDict() == {"original_length": 5, "rewritten_length": 5, "changes_made": False, "filtered_keywords": [],
                          "reduction_percentage": 0.0, "error": "boom"}


def test_blocked_marker(one):
    assert one(text.blocked_marker(L("INJECTION"))) == "[BLOCKED: INJECTION detected]"
    assert one(text.is_valid(text.blocked_marker(L("X")))) is False
    assert one(text.is_valid(L("a [BLOCKED: x"))) is True


def test_prompts_keep_percent_signs(one):
    assert one(prompts.moderation_prompt(L("50% {x}"))) == "Analyze this content:\n\n50% {x}"
    made = one(prompts.enriched_prompt(F.array(L("d%s"), L("e")), L("q")))
    assert made.startswith("You are the author") and "\n\nWRITING EXAMPLES:\nd%s\n\ne\n\nQUERY:\nq\n" in made
    judged = one(prompts.judge_prompt(L("Q%"), L("A"), L("C")))
    assert "QUESTION:\nQ%\n\nREFERENCE ANSWER:\nA\n\nRETRIEVED CONTEXT:\nC\n\nEVALUATION" in judged and judged.endswith('"\n}\n')


def test_chat_messages(one):
    both = one(prompts.chat_messages(L("s"), L("u")))
    assert [(m.role, m.content) for m in both] == [("system", "s"), ("user", "u")]
    for empty in (L(""), L(None).cast("string")):
        assert [(m.role, m.content) for m in one(prompts.chat_messages(empty, L("")))] == [("user", "")]


@pytest.mark.parametrize("reply, score, reasoning", [
    ('{"score": 85, "reasoning": "ok"}', 85.0, "ok"),
    ('{"score": "85.5", "reasoning": "quoted"}', 85.5, "quoted"),
    ('text ```json\n{"score": 1, "reasoning": "a"}\n``` more ```json {"score": 2} ```', 1.0, "a"),
    ('```\n{"score": 3, "reasoning": "b"}\n```', 3.0, "b"),
    ('```json {"score": 4, "reasoning": "c"}', 4.0, "c"),
    ('{"score": 120, "reasoning": "beyond"}', 120.0, "beyond"),
])
def test_parse_judge(one, reply, score, reasoning):
    assert one(replies.parse_judge(L(reply))).asDict() == {"score": score, "reasoning": reasoning, "judge_failed": False}


@pytest.mark.parametrize("reply", ["", "no json", "[1]", '{"score": 1}', '{"reasoning": "x"}', '{"score": "a", "reasoning": "x"}', None, "```json\nx\n```"])
def test_parse_judge_failure(one, reply):
    got = one(replies.parse_judge(L(reply).cast("string")))
    assert got.score == 0.0 and got.judge_failed and got.reasoning.startswith("Error during evaluation: ")


def test_parse_moderation(one):
    full = one(replies.parse_moderation(L('{"is_harmful": true, "severity": "high", "issues": ["a"], "recommendations": ["b", "c"]}')))
    assert full.asDict() == {"parsed": True, "is_harmful": True, "severity": "high", "issues": ["a"], "recommendations": ["b", "c"]}
    partial = one(replies.parse_moderation(L('{"is_harmful": true}')))
    assert (partial.parsed, partial.is_harmful, partial.severity, partial.issues) == (True, True, "unknown", [])
    for reply in ("{}", "x", '```json\n{"is_harmful": true}\n```', "", None):
        got = one(replies.parse_moderation(L(reply).cast("string")))
        assert (got.parsed, got.is_harmful) == (False, False)
