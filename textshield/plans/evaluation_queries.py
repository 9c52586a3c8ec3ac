"""Registered queries: judged answers, reports and ranking metrics."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from textshield.fixed_values import EVAL_K, JUDGE_FAILED_PREFIX, JUDGE_PROMPT, JUDGE_SKIPPED, SPACE
from textshield.operators import evaluation as ev
from textshield.operators.conversations import conversation_pairs
from textshield.operators.embedding import hash_embed
from textshield.operators.retrieval import topk
from textshield.plans import fragments as sql
from textshield.plans.registry import Tables, query
from textshield.plans.retrieval_queries import PLAIN, SCALED, scaled
from textshield.sources.qa import qa_from_pairs

# Questions are user turns with the reply as reference answer. A question of fewer than 3 words gets no vector.
QA = f"""q AS (SELECT u.conv_id || ':' || u.turn AS idx, u.text AS prompt, CASE WHEN u.conv_id % 10 = 0 THEN 'I am not sure.' ELSE a.text END AS response
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
qw AS (SELECT *, len({sql.words('prompt')}) >= 3 AS searchable FROM q),
qs AS (SELECT * FROM qw WHERE searchable),
{sql.hashed('qs', 'idx', 'prompt', 'qv')},
{sql.hashed('documents', 'doc_id', 'text', 'dv')},
h AS ({sql.ranked('cosine', EVAL_K, 'qv', 'dv')}),
x AS (SELECT query_id, count(*)::INT AS n, string_agg('[Document ' || rank || E']\\n' || d.text || E'\\n', E'\\n' ORDER BY rank) AS context
  FROM h JOIN documents d ON d.doc_id = h.chunk_id GROUP BY 1),
j AS (SELECT qw.*, coalesce(x.n, 0) AS n, coalesce(x.context, '') AS context, list_distinct({sql.words('response')}) AS wanted,
  list_distinct({sql.words("coalesce(x.context, '')")}) AS got FROM qw LEFT JOIN x ON x.query_id = qw.idx),
f AS (SELECT *, len(wanted)::INT AS n_wanted, len(list_intersect(wanted, got))::INT AS n_found FROM j),
r AS (SELECT idx, prompt AS question, n AS retrieved_docs_count,
  CASE WHEN NOT searchable THEN 0.0 WHEN response = 'I am not sure.' THEN -1.0 WHEN n_wanted = 0 THEN 0.0
    ELSE round_even(1000.0::DOUBLE * n_found / n_wanted, 0) / 10.0 END::DOUBLE AS llm_score,
  CASE WHEN NOT searchable THEN '' WHEN response = 'I am not sure.' THEN '{JUDGE_SKIPPED}' ELSE n_found || ' of ' || n_wanted || ' words found' END AS llm_reasoning,
  substr(response, 1, 500) AS reference_answer, substr(context, 1, 500) AS retrieved_context,
  CASE WHEN NOT searchable THEN 'the question has no vector' END AS error FROM f)"""


def questions(t: Tables):
    qa = qa_from_pairs(conversation_pairs(t.conversations))
    unsure = F.when(F.col("conv_id") % 10 == 0, "I am not sure.").otherwise(F.col("response"))
    embedded = hash_embed(qa.withColumn("response", unsure), text="prompt")
    enough = F.size(ev.ngrams(F.col("prompt"), 3)) >= 1
    return embedded.withColumn("embedding", F.when(enough, F.col("embedding")))


def results(t: Tables):
    docs = t.documents.select("doc_id", "text")
    return ev.evaluate(questions(t), hash_embed(docs), chunk_id="doc_id", texts=docs)


@query("eval_results", f"WITH {QA} SELECT * FROM r")
def eval_results(t: Tables):
    return results(t).drop("eval_time_seconds", "judge_failed")


@query("eval_metrics", f"""WITH {QA}, v AS (SELECT llm_score AS s FROM r WHERE llm_score >= 0 AND error IS NULL),
o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM v)
SELECT (SELECT count(*) FROM r) AS total_questions, round((SELECT avg(s) FROM v), 6) + 0.0 AS avg_llm_score, (SELECT s FROM o WHERE i = n // 2) AS median_llm_score,
  round((SELECT avg(retrieved_docs_count) FROM r), 6) + 0.0 AS avg_retrieval_count, (SELECT count(*) FROM r WHERE error IS NOT NULL) AS questions_with_errors""")
def eval_metrics(t: Tables):
    m = ev.aggregate_metrics(results(t))
    return m.select("total_questions", (F.round("avg_llm_score", 6) + 0.0).alias("avg_llm_score"), "median_llm_score",
                    (F.round("avg_retrieval_count", 6) + 0.0).alias("avg_retrieval_count"), "questions_with_errors")


def fingerprint_judge():
    """A judge whose replies follow from the whole prompt it is sent; some are fenced, some no JSON, some empty."""

    def complete(conversations, temperature, max_tokens):
        replies = []
        for messages in conversations:
            number = int(hashlib.md5(messages[-1]["content"].encode()).hexdigest()[:8], 16)
            text = json.dumps({"score": number % 101, "reasoning": f"number {number}"})
            text = f"```json\n{text}\n```" if number % 13 == 0 else "sorry" if number % 17 == 0 else "" if number % 19 == 0 else text
            replies.append(("stop", text))
        return replies

    return complete


@query("eval_model_judge", f"""WITH {QA.replace("r AS (SELECT idx", "unused AS (SELECT idx")},
p AS (SELECT *, ('0x' || substr(md5({sql.text(JUDGE_PROMPT[0])} || prompt || {sql.text(JUDGE_PROMPT[1])} || response || {sql.text(JUDGE_PROMPT[2])} || context || {sql.text(JUDGE_PROMPT[3])}), 1, 8))::BIGINT AS f FROM j),
s AS (SELECT *, NOT regexp_matches(response, '[^{SPACE}]') OR response = 'I am not sure.' AS skipped, f % 13 <> 0 AND f % 17 = 0 AS odd, f % 13 <> 0 AND f % 17 <> 0 AND f % 19 = 0 AS silent FROM p)
SELECT idx, prompt AS question, n AS retrieved_docs_count, CASE WHEN NOT searchable THEN 0.0 WHEN skipped THEN -1.0 WHEN odd OR silent THEN 0.0 ELSE f % 101 END::DOUBLE AS llm_score,
  CASE WHEN NOT searchable THEN '' WHEN skipped THEN '{JUDGE_SKIPPED}' WHEN odd THEN '{JUDGE_FAILED_PREFIX}reply is not a JSON object' WHEN silent THEN '{JUDGE_FAILED_PREFIX}no reply' ELSE 'number ' || f END AS llm_reasoning,
  substr(response, 1, 500) AS reference_answer, substr(context, 1, 500) AS retrieved_context, CASE WHEN NOT searchable THEN 'the question has no vector' END AS error FROM s""")
def eval_model_judge(t: Tables):
    """A model as judge: contexts stored whole, then asked about, then joined."""
    docs = t.documents.select("doc_id", "text")
    done = ev.evaluate_with_provider(questions(t), hash_embed(docs), fingerprint_judge, chunk_id="doc_id", texts=docs, generation={"pause": 0.0})
    return done.drop("eval_time_seconds", "judge_failed")


# Scores spread over all bands, for the reports on results.
SPREAD = """r AS (SELECT doc_id AS idx, source AS question, lang AS llm_reasoning, CASE WHEN n_chars % 110 = 109 THEN -1.0 ELSE (n_chars % 110) + 0.5 END::DOUBLE AS llm_score,
  CASE WHEN source = 'src5' THEN 'failed' END AS error, (n_chars % 6)::INT AS retrieved_docs_count FROM documents)"""


def spread(t: Tables):
    n = F.col("n_chars") % 110
    return t.documents.select(
        F.col("doc_id").alias("idx"), F.col("source").alias("question"), F.col("lang").alias("llm_reasoning"),
        F.when(n == 109, -1.0).otherwise(n + 0.5).alias("llm_score"), F.when(F.col("source") == "src5", "failed").alias("error"),
        (F.col("n_chars") % 6).cast("int").alias("retrieved_docs_count"))


@query("eval_median", f"""WITH {SPREAD}, o AS (SELECT llm_score AS s, row_number() OVER (ORDER BY llm_score) - 1 AS i, count(*) OVER () AS n FROM r WHERE llm_score >= 0 AND error IS NULL)
SELECT s AS median FROM o WHERE i = n // 2""")
def eval_median(t: Tables):
    valid = spread(t).where("llm_score >= 0 and error is null").select("llm_score")
    return ev.upper_median(valid, "llm_score")


BANDS = "(0, 'Excellent (90-100)', 90, 100.000001), (1, 'Good (70-89)', 70, 90), (2, 'Fair (50-69)', 50, 70), (3, 'Poor (30-49)', 30, 50), (4, 'Very Poor (0-29)', 0, 30)"


@query("eval_histogram", f"""WITH {SPREAD} SELECT position, band, count(idx) AS n FROM (VALUES {BANDS}) b(position, band, lo, hi)
LEFT JOIN r ON llm_score >= lo AND llm_score < hi GROUP BY position, band""")
def eval_histogram(t: Tables):
    return ev.score_histogram(spread(t))


@query("eval_top_bottom", f"""WITH {SPREAD}, o AS (SELECT *, row_number() OVER (ORDER BY llm_score DESC, idx) AS i, count(*) OVER () AS n FROM r WHERE llm_score >= 0)
SELECT 'top' AS side, i::INT AS place, idx, llm_score, question, llm_reasoning FROM o WHERE i <= 3
UNION ALL SELECT 'bottom', (i - greatest(n - 3, 0))::INT, idx, llm_score, question, llm_reasoning FROM o WHERE i > n - 3""")
def eval_top_bottom(t: Tables):
    return ev.top_bottom(spread(t))


# A vector is relevant to a query when both have the same label.
HITS = f"h AS ({sql.ranked('cosine', EVAL_K, 'v', 'v', 'q.k <> c.k')})"
PER_QUERY = f"""{SCALED}, {HITS}, m AS (SELECT query_id, rank, q.label = c.label AS relevant FROM h JOIN v q ON q.k = query_id JOIN v c ON c.k = chunk_id),
n AS (SELECT k AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM v),
a AS (SELECT query_id, count(*) FILTER (relevant) AS found, min(rank) FILTER (relevant) AS first FROM m GROUP BY 1),
p AS (SELECT n.query_id, coalesce(found, 0) AS found, n_relevant, coalesce(found, 0) / {EVAL_K}.0::DOUBLE AS precision_at_k,
  CASE WHEN n_relevant > 0 THEN coalesce(found, 0) / n_relevant ELSE 0.0 END AS recall_at_k, coalesce(1.0::DOUBLE / first, 0.0) AS reciprocal_rank FROM n LEFT JOIN a USING (query_id))"""


def label_hits(t: Tables):
    """Hits with their relevance, and the number of relevant vectors of each query."""
    v = scaled(t)
    hits = topk(v, v, EVAL_K, "cosine", query_id="vec_id", chunk_id="vec_id", exclude_self=True)
    label = lambda key, name: t.embeddings.select(F.col("vec_id").alias(key), F.col("label").alias(name))
    marked = hits.join(label("query_id", "wanted"), "query_id").join(label("chunk_id", "got"), "chunk_id")
    per_label = t.embeddings.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    totals = t.embeddings.join(per_label, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    return marked.withColumn("relevant", F.col("wanted") == F.col("got")), totals


@query("rank_metrics", f"""WITH {PER_QUERY} SELECT query_id, round(precision_at_k, 6) + 0.0 AS precision_at_k, round(recall_at_k, 6) + 0.0 AS recall_at_k,
  round(reciprocal_rank, 6) + 0.0 AS reciprocal_rank FROM p""")
def rank_metrics(t: Tables):
    per_query = ev.rank_metrics(*label_hits(t), EVAL_K)
    return per_query.select("query_id", *[(F.round(c, 6) + 0.0).alias(c) for c in per_query.columns[1:]])


@query("precision_recall_mrr", f"""WITH {PER_QUERY} SELECT count(*) AS n_queries, round(avg(precision_at_k), 6) + 0.0 AS precision_at_k,
  round(avg(recall_at_k), 6) + 0.0 AS recall_at_k, round(avg(reciprocal_rank), 6) + 0.0 AS mrr FROM p""")
def precision_recall_mrr(t: Tables):
    means = ev.mean_rank_metrics(ev.rank_metrics(*label_hits(t), EVAL_K))
    return means.select("n_queries", *[(F.round(c, 6) + 0.0).alias(c) for c in means.columns[1:]])


# Sources retrieved by one metric, against those that another metric would cite.
CITED = f"""{SCALED}, got AS ({sql.ranked('l2', EVAL_K, 'v', 'v', 'q.k <> c.k')}), want AS ({sql.ranked('ip', 3, 'v', 'v', 'q.k <> c.k')}),
g AS (SELECT DISTINCT query_id, source FROM got JOIN documents ON doc_id = chunk_id), w AS (SELECT DISTINCT query_id, source FROM want JOIN documents ON doc_id = chunk_id),
c AS (SELECT query_id, count(g.source) AS n_retrieved, count(w.source) AS n_truth, count(CASE WHEN g.source = w.source THEN 1 END) AS n_found
  FROM g FULL JOIN w USING (query_id, source) GROUP BY query_id)"""


def cited(t: Tables):
    v = scaled(t)
    names = t.documents.select(F.col("doc_id").alias("chunk_id"), "source")
    found = lambda metric, k: topk(v, v, k, metric, query_id="vec_id", chunk_id="vec_id", exclude_self=True).join(names, "chunk_id")
    return ev.citation_recall(found("l2", EVAL_K), found("ip", 3))


@query("citation_recall", f"WITH {CITED} SELECT query_id, n_retrieved, n_truth, n_found, round(n_found / n_truth, 6) + 0.0 AS citation_recall FROM c WHERE n_truth > 0")
def citations(t: Tables):
    return cited(t).withColumn("citation_recall", F.round("citation_recall", 6) + 0.0)


@query("failure_mode", f"""WITH {CITED} SELECT CASE WHEN n_retrieved = 0 THEN 'retrieval failure' WHEN n_found = 0 THEN 'irrelevant retrieval'
  WHEN n_found < n_truth THEN 'incomplete retrieval' ELSE 'complete' END AS mode, count(*) AS n FROM c WHERE n_truth > 0 GROUP BY 1""")
def failure_modes(t: Tables):
    mode = ev.failure_mode(F.col("n_found"), F.col("n_truth"), F.col("n_retrieved"))
    return cited(t).groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))


@query("hybrid_score", f"""WITH {PER_QUERY}, r AS (SELECT doc_id, (n_chars % 101) / 100.0::DOUBLE AS judged FROM documents)
SELECT query_id, round(judged * 0.5 + precision_at_k * 0.3 + reciprocal_rank * 0.2, 6) + 0.0 AS score FROM p JOIN r ON doc_id = query_id""")
def hybrid(t: Tables):
    judged = t.documents.select(F.col("doc_id").alias("query_id"), ((F.col("n_chars") % 101) / 100.0).alias("judged"))
    per_query = ev.rank_metrics(*label_hits(t), EVAL_K).join(judged, "query_id")
    score = ev.hybrid_score(F.col("judged"), F.col("precision_at_k"), F.col("reciprocal_rank"))
    return per_query.select("query_id", (F.round(score, 6) + 0.0).alias("score"))


def _grams(column: str, n: int = 2) -> str:
    w = sql.words(column)
    return f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), ' ')) ELSE [] END"


@query("ngram_overlap", f"""WITH p AS (SELECT u.conv_id || ':' || u.turn AS idx, u.text AS reference, a.text AS candidate FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
g AS (SELECT idx, unnest({_grams('candidate')}) AS gram, 1 AS c, 0 AS r FROM p UNION ALL SELECT idx, unnest({_grams('reference')}), 0, 1 FROM p),
n AS (SELECT idx, gram, sum(c) AS c, sum(r) AS r FROM g GROUP BY ALL),
s AS (SELECT idx, sum(least(c, r))::DOUBLE AS o, sum(c)::DOUBLE AS c, sum(r)::DOUBLE AS r FROM n GROUP BY 1),
f AS (SELECT p.idx, coalesce(o, 0) AS o, coalesce(c, 0) AS c, coalesce(r, 0) AS r FROM p LEFT JOIN s USING (idx)),
m AS (SELECT *, CASE WHEN c > 0 THEN o / c ELSE 0.0 END AS p, CASE WHEN r > 0 THEN o / r ELSE 0.0 END AS q FROM f)
SELECT idx, o::BIGINT AS overlap, round(p, 6) + 0.0 AS precision, round(q, 6) + 0.0 AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) + 0.0 AS f1 FROM m""")
def bigram_overlap(t: Tables):
    pairs = qa_from_pairs(conversation_pairs(t.conversations))
    scored = ev.ngram_overlap(pairs, candidate="response", reference="prompt")
    return scored.select("idx", "overlap", *[(F.round(c, 6) + 0.0).alias(c) for c in ("precision", "recall", "f1")])
