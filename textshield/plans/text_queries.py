"""Registered queries: markup, addresses, previews, keywords, prompts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from textshield.fixed_values import (
    FILTER_KEYWORDS,
    JUDGE_FAILED_PREFIX,
    JUDGE_PROMPT,
    MODERATION_PROMPT_HEAD,
    MODERATION_SYSTEM_PROMPT,
    SPACE,
    UNKNOWN,
)
from textshield.functions.prompts import chat_messages, judge_prompt, moderation_prompt
from textshield.functions.replies import parse_judge, parse_moderation
from textshield.functions.text import filtered_keywords, page_ref, preview, strip_html, words
from textshield.operators.moderation import non_blank_pages, rewrite_harmful
from textshield.plans import fragments as sql
from textshield.plans.registry import Tables, query
from textshield.schemas import COMMENT_PAYLOAD, PAGE_RECORD
from textshield.sources.comments import flatten_comment_payload, page_record
from textshield.sources.xml import xml_documents

PLAIN = "regexp_replace(html, '<.*?>', '', 'g')"
PAGE_URL = r"^(https?://[^/]+)/([^/]+)/(\p{Nd}+)"
KEYWORDS = [*FILTER_KEYWORDS, "the", "nation", "tion", "licensed under"]


@query("strip_html", f"SELECT page_id, {PLAIN} AS plain_text FROM pages")
def plain_pages(t: Tables):
    return t.pages.select("page_id", strip_html(F.col("html")).alias("plain_text"))


@query("page_ref", f"""SELECT page_id,
  CASE WHEN regexp_matches(url, '{PAGE_URL}') THEN regexp_extract(url, '{PAGE_URL}', 1) END AS base_url,
  CASE WHEN regexp_matches(url, '{PAGE_URL}') THEN regexp_extract(url, '{PAGE_URL}', 2) END AS space_key,
  CASE WHEN regexp_matches(url, '{PAGE_URL}') THEN regexp_extract(url, '{PAGE_URL}', 3) END AS page_no FROM pages""")
def page_refs(t: Tables):
    ref = t.pages.select("page_id", page_ref(F.col("url"), PAGE_URL).alias("r"))
    return ref.select("page_id", "r.base_url", "r.space_key", F.col("r.page_id").alias("page_no"))


@query("non_blank_pages", f"SELECT page_id FROM pages WHERE regexp_matches({PLAIN}, '[^{SPACE}]')")
def with_text(t: Tables):
    return non_blank_pages(t.pages).select("page_id")


def _sql_preview(column: str, n: int) -> str:
    return f"CASE WHEN length({column}) > {n} THEN substr({column}, 1, {n}) || '...' ELSE {column} END"


@query("page_preview", f"""WITH p AS (SELECT page_id, {PLAIN} AS t FROM pages)
SELECT page_id, {_sql_preview('t', 500)} AS page_preview, {_sql_preview('t', 300)} AS comment_preview, substr(t, 1, 200) AS head FROM p""")
def previews(t: Tables):
    plain = t.pages.select("page_id", strip_html(F.col("html")).alias("t"))
    return plain.select("page_id", preview(F.col("t"), 500).alias("page_preview"),
                        preview(F.col("t"), 300).alias("comment_preview"), preview(F.col("t"), 200, "").alias("head"))


KEYWORD_LIST = "list_filter([" + ", ".join(sql.text(k) for k in KEYWORDS) + "], lambda k: contains(lower(text), lower(k)))"


@query("keyword_hits", f"SELECT doc_id, array_to_string({KEYWORD_LIST}, '|') AS keywords, len({KEYWORD_LIST})::INT AS n FROM documents")
def keyword_hits(t: Tables):
    found = t.documents.select("doc_id", filtered_keywords(F.col("text"), KEYWORDS).alias("k"))
    return found.select("doc_id", F.array_join("k", "|").alias("keywords"), F.size("k").alias("n"))


@query("keyword_summary", f"SELECT keyword, count(*) AS n FROM (SELECT unnest({KEYWORD_LIST}) AS keyword FROM documents) GROUP BY keyword")
def keyword_summary(t: Tables):
    found = t.documents.select(F.explode_outer(filtered_keywords(F.col("text"), KEYWORDS)).alias("keyword"))
    return found.where(F.col("keyword").isNotNull()).groupBy("keyword").agg(F.count("*").alias("n"))


DEFAULT_LIST = "list_filter([" + ", ".join(sql.text(k) for k in FILTER_KEYWORDS) + "], lambda k: contains(lower(text), lower(k)))"


@query("rewrite_metrics", f"""WITH m AS (SELECT d.doc_id, text, {sql.masked('text')} AS masked, CASE WHEN l.toxic = 1 THEN 'rewriter gave up' END AS error
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
r AS (SELECT doc_id, text, error, CASE WHEN error IS NULL AND masked <> '' THEN masked ELSE text END AS rewritten FROM m)
SELECT doc_id, rewritten, length(text)::INT AS original_length, length(rewritten)::INT AS rewritten_length, text <> rewritten AS changes_made,
  CASE WHEN error IS NULL AND length(text) > 0 THEN
    round_even((100.0::DOUBLE * (1.0 - length(rewritten)::DOUBLE / length(text)::DOUBLE)) * 100.0::DOUBLE, 0) / 100.0 + 0.0 ELSE 0.0 END::DOUBLE AS reduction_percentage,
  CASE WHEN error IS NULL THEN array_to_string({DEFAULT_LIST}, '|') ELSE '' END AS filtered_keywords, error FROM r""")
def rewritten_documents(t: Tables):
    labelled = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    done = rewrite_harmful(labelled, error=F.when(F.col("toxic") == 1, "rewriter gave up"))
    m = F.col("metrics")
    return done.select("doc_id", "rewritten", m["original_length"].alias("original_length"), m["rewritten_length"].alias("rewritten_length"),
                       m["changes_made"].alias("changes_made"), (m["reduction_percentage"] + 0.0).alias("reduction_percentage"),
                       F.array_join(m["filtered_keywords"], "|").alias("filtered_keywords"), m["error"].alias("error"))


@query("moderation_prompt", f"SELECT doc_id, {sql.text(MODERATION_PROMPT_HEAD)} || text AS prompt FROM documents")
def moderation_prompts(t: Tables):
    return t.documents.select("doc_id", moderation_prompt(F.col("text")).alias("prompt"))


@query("chat_messages", f"""SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'user:' || text
  ELSE 'system:' || {sql.text(MODERATION_SYSTEM_PROMPT)} || E'\\nuser:' || text END AS messages FROM conversations""")
def messages(t: Tables):
    system = F.when(F.col("role") == "system", "").otherwise(MODERATION_SYSTEM_PROMPT)
    made = t.conversations.withColumn("m", chat_messages(system, F.col("text")))
    joined = F.array_join(F.transform("m", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return made.select("conv_id", "turn", "role", joined.alias("messages"))


PAIRS = """pairs AS (SELECT u.conv_id, u.turn, u.text AS message, a.text AS reply FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


@query("judge_prompt", f"""WITH {PAIRS} SELECT conv_id, turn, {sql.text(JUDGE_PROMPT[0])} || message || {sql.text(JUDGE_PROMPT[1])} || reply
  || {sql.text(JUDGE_PROMPT[2])} || message || E'\\n' || reply || {sql.text(JUDGE_PROMPT[3])} AS prompt FROM pairs WHERE reply IS NOT NULL""")
def judge_prompts(t: Tables):
    from textshield.operators.conversations import conversation_pairs

    pairs = conversation_pairs(t.conversations).where("reply is not null")
    context = F.concat(F.col("message"), F.lit("\n"), F.col("reply"))
    return pairs.select("conv_id", "turn", judge_prompt(F.col("message"), F.col("reply"), context).alias("prompt"))


# Replies as a moderator might give them: plain, fenced, cut off, empty and with fields missing.
MODERATION_REPLIES = """r AS (SELECT doc_id, quality, toxic, CASE (doc_id * 3 + quality + toxic) % 6
  WHEN 0 THEN '{"is_harmful": ' || CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END || ', "severity": "s' || quality || '", "issues": ["i' || doc_id || '", "x"], "recommendations": []}'
  WHEN 1 THEN '```json' || chr(10) || '{"is_harmful": true}' || chr(10) || '```'
  WHEN 2 THEN '{"is_harmful": true, "severity": "high"'
  WHEN 3 THEN '{}'
  WHEN 4 THEN '{"is_harmful": true}'
  ELSE 'I cannot judge text ' || doc_id END AS reply FROM labels)"""


@query("parse_moderation", f"""WITH {MODERATION_REPLIES}, p AS (SELECT doc_id, TRY_CAST(reply AS JSON) AS j FROM r),
o AS (SELECT doc_id, CASE WHEN json_type(j) = 'OBJECT' AND len(json_keys(j)) > 0 THEN j END AS j FROM p)
SELECT doc_id, j IS NOT NULL AS parsed, coalesce((j->>'$.is_harmful')::BOOLEAN, false) AS is_harmful, coalesce(j->>'$.severity', 'unknown') AS severity,
  coalesce(array_to_string((j->'$.issues')::VARCHAR[], '|'), '') AS issues, coalesce(array_to_string((j->'$.recommendations')::VARCHAR[], '|'), '') AS recommendations FROM o""")
def moderation_replies(t: Tables):
    kind = (F.col("doc_id") * 3 + F.col("quality") + F.col("toxic")) % 6
    full = F.concat(F.lit('{"is_harmful": '), F.when(F.col("toxic") == 1, "true").otherwise("false"), F.lit(', "severity": "s'),
                    F.col("quality").cast("string"), F.lit('", "issues": ["i'), F.col("doc_id").cast("string"), F.lit('", "x"], "recommendations": []}'))
    reply = (F.when(kind == 0, full).when(kind == 1, '```json\n{"is_harmful": true}\n```').when(kind == 2, '{"is_harmful": true, "severity": "high"')
             .when(kind == 3, "{}").when(kind == 4, '{"is_harmful": true}').otherwise(F.concat(F.lit("I cannot judge text "), F.col("doc_id").cast("string"))))
    v = t.labels.withColumn("v", parse_moderation(reply)).select("doc_id", "v.*")
    return v.select("doc_id", "parsed", "is_harmful", "severity", F.array_join("issues", "|").alias("issues"),
                    F.array_join("recommendations", "|").alias("recommendations"))


JUDGE_REPLIES = """r AS (SELECT doc_id, n_chars, CASE (doc_id + n_chars) % 6
  WHEN 0 THEN '{"score": ' || n_chars % 101 || ', "reasoning": "' || source || '"}'
  WHEN 1 THEN 'Here: ```json' || chr(10) || '{"score": "' || n_chars % 101 || '.5", "reasoning": "' || lang || '"}' || chr(10) || '``` done ```json {} ```'
  WHEN 2 THEN '```' || chr(10) || '{"score": ' || n_chars % 101 || ', "reasoning": "bare"}' || chr(10) || '```'
  WHEN 3 THEN '{"score": "many", "reasoning": "none"}'
  WHEN 4 THEN '{"score": 70}'
  ELSE 'score: ' || n_chars END AS reply FROM documents)"""


@query("parse_judge", f"""WITH {JUDGE_REPLIES},
u AS (SELECT doc_id, TRY_CAST(trim(CASE WHEN contains(reply, '```json') THEN split_part(split_part(reply, '```json', 2), '```', 1)
  WHEN contains(reply, '```') THEN split_part(reply, '```', 2) ELSE reply END, E' \\n') AS JSON) AS j FROM r),
s AS (SELECT doc_id, CASE WHEN json_type(j) = 'OBJECT' THEN j END AS j FROM u),
f AS (SELECT doc_id, j, TRY_CAST(j->>'$.score' AS DOUBLE) AS score, j->>'$.reasoning' AS reasoning FROM s),
w AS (SELECT *, CASE WHEN j IS NULL THEN 'reply is not a JSON object' WHEN score IS NULL THEN 'score is missing or not a number' WHEN reasoning IS NULL THEN 'reasoning is missing' END AS why FROM f)
SELECT doc_id, CASE WHEN why IS NULL THEN score ELSE 0.0 END AS score, CASE WHEN why IS NULL THEN reasoning ELSE '{JUDGE_FAILED_PREFIX}' || why END AS reasoning, why IS NOT NULL AS judge_failed FROM w""")
def judge_replies(t: Tables):
    kind = (F.col("doc_id") + F.col("n_chars")) % 6
    n = (F.col("n_chars") % 101).cast("string")
    reply = (F.when(kind == 0, F.concat(F.lit('{"score": '), n, F.lit(', "reasoning": "'), F.col("source"), F.lit('"}')))
             .when(kind == 1, F.concat(F.lit('Here: ```json\n{"score": "'), n, F.lit('.5", "reasoning": "'), F.col("lang"), F.lit('"}\n``` done ```json {} ```')))
             .when(kind == 2, F.concat(F.lit('```\n{"score": '), n, F.lit(', "reasoning": "bare"}\n```')))
             .when(kind == 3, '{"score": "many", "reasoning": "none"}').when(kind == 4, '{"score": 70}')
             .otherwise(F.concat(F.lit("score: "), F.col("n_chars").cast("string"))))
    return t.documents.withColumn("j", parse_judge(reply)).select("doc_id", "j.*")


@query("comment_payload", f"""SELECT page_id, 0 AS pos, 'c' || page_id AS id, 'current' AS status, {PLAIN} AS body FROM pages
UNION ALL SELECT page_id, 1, 'c' || page_id, 'old', '' FROM pages""")
def comment_payload(t: Tables):
    """Nested comment payloads as an export holds them, one per page, read back with the schema."""
    comment = lambda status, body: F.struct(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("id"),
                                            F.lit(status).alias("status"), body)
    body = F.col("html")
    payload = F.to_json(F.struct(F.array(
        comment("current", F.struct(F.struct(body.alias("value")).alias("storage")).alias("body")),
        comment("old", F.struct(F.struct(F.lit(None).cast("string").alias("value")).alias("storage")).alias("body")),
    ).alias("results")))
    return flatten_comment_payload(
        t.pages.select("page_id", F.from_json(payload, COMMENT_PAYLOAD).alias("p")).select("page_id", "p.*"), "page_id")


@query("page_record", f"""SELECT page_id, CASE WHEN contains(url, '#') THEN '{UNKNOWN}' ELSE url END AS title,
  CASE WHEN starts_with(url, 'https') THEN split_part(url, '/', 3) ELSE '{UNKNOWN}' END AS space_name, '{UNKNOWN}' AS version, html FROM pages""")
def page_records(t: Tables):
    """Page records as an export holds them, with fields left out."""
    secure = F.startswith(F.col("url"), F.lit("https"))
    record = F.to_json(F.struct(
        F.when(~F.contains(F.col("url"), F.lit("#")), F.col("url")).alias("title"),
        F.when(secure, F.struct(F.split_part("url", F.lit("/"), F.lit(3)).alias("name"))).alias("space"),
        F.struct(F.struct(F.col("html").alias("value")).alias("storage")).alias("body")))
    return page_record(t.pages.select("page_id", F.from_json(record, PAGE_RECORD).alias("p")).select("page_id", "p.*"), "page_id")


@query("passage_text", "SELECT conv_id, turn AS pos, 'Passage ' || conv_id || E':\\n' || text || E'\\n\\n' AS passage FROM conversations")
def passage_listing(t: Tables):
    from textshield.functions.prompts import passage

    return t.conversations.select("conv_id", F.col("turn").alias("pos"), passage(F.col("conv_id").cast("string"), F.col("text")).alias("passage"))


STRIPPED = rf"regexp_replace(text, '\A[{SPACE}]+|[{SPACE}]+\z', '', 'g')"


@query("xml_text", f"""SELECT 'd' || doc_id || '.xml' AS file_name, 'Document: d' || doc_id || '.xml' || E'\\n\\n' || source || ' '
  || CASE WHEN {STRIPPED} = '' THEN '' ELSE {STRIPPED} || ' ' END || 'end ' || lang AS text FROM documents WHERE source <> 'src3'""")
def xml_texts(t: Tables):
    """Documents wrapped in XML, those of one source cut off so that they cannot be parsed."""
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    whole = F.concat(F.lit("<doc><source> "), F.col("source"), F.lit("</source><body>"), escaped, F.lit("<lang>"), F.col("lang"),
                     F.lit("</lang></body>end</doc>"))
    content = F.when(F.col("source") == "src3", F.concat(F.lit("<doc>"), escaped)).otherwise(whole)
    path = F.concat(F.lit("/corpus/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".xml"))
    return xml_documents(t.documents.select(path.alias("path"), content.cast("binary").alias("content"))).select("file_name", "text")


@query("document_words", f"SELECT doc_id, len({sql.words('text')})::INT AS n_words FROM documents")
def word_counts(t: Tables):
    return t.documents.select("doc_id", F.size(words(F.col("text"))).alias("n_words"))
