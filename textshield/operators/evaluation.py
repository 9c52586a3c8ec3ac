"""Quality of retrieval: judged answers, reports and ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textshield.fixed_values import EVAL_K, JUDGE_MAX_TOKENS, JUDGE_SKIPPED, JUDGE_SYSTEM_PROMPT, JUDGE_TEMPERATURE, SCORE_BANDS, UNSURE_ANSWER
from textshield.functions.prompts import judge_prompt
from textshield.functions.replies import parse_judge
from textshield.functions.text import is_blank, preview, words
from textshield.functions.vectors import let
from textshield.operators.generation import Provider, stored_replies
from textshield.operators.retrieval import retrieve
from textshield.schemas import EVAL_RESULT
from textshield.session import write_at, write_once

REPORT_CHARS = 500
MEDIAN_STEPS = 10_000  # steps of the range of the values, used to find the part that holds the median

Reply = Callable[[Column, Column, Column], Column]


def overlap_reply(question: Column, answer: Column, context: Column) -> Column:
    """Offline stand-in for a judge: the percentage of the answer's words found in the context, as JSON."""
    wanted = F.array_distinct(words(answer))
    found = F.size(F.array_intersect(wanted, words(context)))
    share = F.when(F.size(wanted) > 0, F.rint(1000.0 * found / F.size(wanted)) / 10.0).otherwise(0.0)
    reason = F.concat(found.cast("string"), F.lit(" of "), F.size(wanted).cast("string"), F.lit(" words found"))
    return F.to_json(F.struct(share.alias("score"), reason.alias("reasoning")))


def judge(df: DataFrame, reply: Column, *, answer: str = "response", enabled: bool = True) -> DataFrame:
    """Add ``llm_score, llm_reasoning, judge_failed``. Without a usable reference answer the score is -1.

    ``reply`` is evaluated only for rows that are judged.
    """
    judged = F.lit(enabled) & ~is_blank(F.col(answer)) & (F.col(answer) != UNSURE_ANSWER)
    skipped = F.struct(F.lit(-1.0).alias("score"), F.lit(JUDGE_SKIPPED).alias("reasoning"), F.lit(False).alias("judge_failed"))
    asked = df.withColumn("_judged", F.coalesce(judged, F.lit(False))).withColumn("_reply", F.when(F.col("_judged"), reply))
    result = asked.withColumn("_result", F.when(F.col("_judged"), parse_judge(F.col("_reply"))).otherwise(skipped))
    return result.withColumns({
        "llm_score": F.col("_result.score"),
        "llm_reasoning": F.col("_result.reasoning"),
        "judge_failed": F.col("_result.judge_failed"),
    }).drop("_judged", "_reply", "_result")


def judge_requests(df: DataFrame, *, key: str = "idx", question: str = "prompt", answer: str = "response",
                   context: str = "context") -> DataFrame:
    """``item_id, system, user`` for a text generator; rows that are not judged are not asked."""
    asked = df.where(~is_blank(F.col(answer)) & (F.col(answer) != UNSURE_ANSWER))
    user = judge_prompt(F.col(question), F.col(answer), F.col(context))
    return asked.select(F.col(key).alias("item_id"), F.lit(JUDGE_SYSTEM_PROMPT).alias("system"), user.alias("user"))


def judge_with_replies(df: DataFrame, replies: DataFrame, *, key: str = "idx", **options) -> DataFrame:
    """The same with stored replies ``item_id, reply``; a judged row without one has failed."""
    joined = df.join(replies.select(F.col("item_id").alias(key), F.col("reply").alias("_stored")), key, "left")
    return judge(joined, F.col("_stored"), **options).drop("_stored")


def retrieved(qa: DataFrame, chunks: DataFrame, k: int = EVAL_K, metric: str | None = "cosine", *, chunk_id: str = "chunk_id",
              text: str = "text", **options) -> DataFrame:
    """``idx, prompt, response, context, n_docs, error`` of every question ``idx, prompt, response, embedding``.

    The context is whole. A question without a vector cannot be searched: no documents, and the error.
    The questions are computed once.
    """
    qa = write_once(qa, "questions")
    found = retrieve(qa, chunks, k, metric, query_id="idx", chunk_id=chunk_id, text=text, **options)
    found = found.select(F.col("query_id").alias("idx"), "context", "n_docs")
    joined = qa.select("idx", "prompt", "response", F.col("embedding").isNull().alias("_lost")).join(found, "idx", "left")
    return joined.select("idx", "prompt", "response", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
                         F.when(F.col("_lost"), "the question has no vector").alias("error"))


def eval_results(scored: DataFrame) -> DataFrame:
    """The result table of judged questions. Time per question means nothing in a joint job and stays null."""
    failed = F.col("error").isNotNull()
    cut = lambda c: preview(F.col(c), REPORT_CHARS, "")
    columns = {
        "question": F.col("prompt"),
        "retrieved_docs_count": F.col("n_docs"),
        "llm_score": F.when(failed, 0.0).otherwise(F.col("llm_score")),
        "llm_reasoning": F.when(failed, "").otherwise(F.col("llm_reasoning")),
        "reference_answer": cut("response"),
        "retrieved_context": cut("context"),
        "eval_time_seconds": F.lit(None).cast("double"),
    }
    return scored.withColumns(columns).select(*EVAL_RESULT, "judge_failed")


def evaluate(qa: DataFrame, chunks: DataFrame, k: int = EVAL_K, metric: str | None = "cosine", *,
             reply: Reply = overlap_reply, use_judge: bool = True, **options) -> DataFrame:
    """Result of every question, also of those that fail, with a judge that is a column expression.

    Options are those of :func:`retrieved`.
    """
    asked = retrieved(qa, chunks, k, metric, **options)
    return eval_results(judge(asked, reply(F.col("prompt"), F.col("response"), F.col("context")), enabled=use_judge))


def evaluate_with_provider(qa: DataFrame, chunks: DataFrame, provider: Provider, k: int = EVAL_K, metric: str | None = "cosine", *,
                           use_judge: bool = True, folder: str | None = None, generation: dict | None = None, **options) -> DataFrame:
    """The same with a model as judge, in two stages.

    First all questions are looked up, and their whole contexts are stored. Then the provider is
    asked about the questions that have a usable answer and no error; its attempts are stored, and
    the replies are joined by ``idx``, which must be unique. A question that is judged but gets no good
    reply scores 0. With a ``folder``, what an earlier run finished there is not looked up or asked
    again. ``generation`` are options of :func:`generate`.
    """
    looked_up = retrieved(qa, chunks, k, metric, **options)
    stored = write_once(looked_up, "retrieved") if folder is None else write_at(looked_up, f"{folder}/retrieved")
    if not use_judge:
        return eval_results(judge(stored, F.lit(None).cast("string"), enabled=False))
    settings = {"temperature": JUDGE_TEMPERATURE, "max_tokens": JUDGE_MAX_TOKENS} | (generation or {})
    replies = stored_replies(provider, folder, **settings)(judge_requests(stored.where("error IS NULL")))
    return eval_results(judge_with_replies(stored, replies))


def upper_median(values: DataFrame, column: str) -> DataFrame:
    """One row ``median``: the value at position n // 2 in ascending order, null when there is none.

    Equal values are counted first. A running count over fixed steps of the range of the values finds
    the step that holds the median, and only the values of that step are put in order. The values are
    read three times, so they should be stored.
    """
    edges = values.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    width = ((edges["high"] or 0) - (edges["low"] or 0)) / MEDIAN_STEPS or 1.0
    step = lambda value: F.floor((F.col(value) - F.lit(edges["low"])) / F.lit(float(width))).alias("step")
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).select("value", "n", step("value"))
    # at most MEDIAN_STEPS + 1 rows, so one task may order them
    steps = values.where(F.col(column).isNotNull()).groupBy(step(column)).agg(F.count("*").alias("n"))
    ordered = Window.orderBy("step")
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.floor(F.sum("n").over(Window.partitionBy()) / 2)
    placed = steps.withColumns({"before": before, "target": target})
    holding = placed.where("before <= target and target < before + n").select("step", "before", "target")
    inside = counts.join(F.broadcast(holding), "step")
    reached = F.col("before") + F.sum("n").over(Window.partitionBy("step").orderBy("value"))
    return inside.withColumn("reached", reached).where("reached > target").agg(F.min("value").alias("median"))


def aggregate_metrics(results: DataFrame, total_time: float | None = None) -> DataFrame:
    """One row: questions, mean and upper median of valid scores, mean documents, errors, time.

    A score is valid when it is at least 0 and the question had no error; the documents are
    averaged over all questions. What is needed of the results is computed once and stored.
    """
    results = write_once(results.select("llm_score", "error", "retrieved_docs_count"), "scores")
    valid = (F.col("llm_score") >= 0) & F.col("error").isNull()
    row = results.agg(
        F.count("*").alias("total_questions"),
        F.coalesce(F.avg(F.when(valid, F.col("llm_score"))), F.lit(0.0)).alias("avg_llm_score"),
        F.coalesce(F.avg("retrieved_docs_count"), F.lit(0.0)).alias("avg_retrieval_count"),
        F.count_if(F.col("error").isNotNull()).alias("questions_with_errors"),
        F.lit(total_time).cast("double").alias("total_eval_time_seconds"),
    )
    median = upper_median(results.where(valid).select("llm_score"), "llm_score")
    return row.withColumn("median_llm_score", F.coalesce(median.scalar(), F.lit(0.0)))


def score_histogram(results: DataFrame) -> DataFrame:
    """``band, n`` for all bands, also empty ones. Scores below 0 or above 100 are in none."""
    score = F.col("llm_score")
    inside = lambda lo, hi, closed: (score >= lo) & ((score <= hi) if closed else (score < hi))
    counts = results.agg(*[F.count_if(inside(lo, hi, closed)).alias(f"b{i}") for i, (_, lo, hi, closed) in enumerate(SCORE_BANDS)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(b[0]).alias("band"), F.col(f"b{i}").alias("n"))
                     for i, b in enumerate(SCORE_BANDS)])
    return counts.select(F.inline(rows))


def top_bottom(results: DataFrame, n: int = 3) -> DataFrame:
    """``side, place, idx, llm_score, question, llm_reasoning`` of the n best and n worst, best first on both sides.

    Equal scores keep the order of idx, and with fewer than 2n questions the sides overlap.
    """
    columns = ["idx", "llm_score", "question", "llm_reasoning"]
    rated = results.where(F.col("llm_score") >= 0).select(*columns)
    best = rated.orderBy(F.desc("llm_score"), "idx").limit(n).withColumn("side", F.lit("top"))
    worst = rated.orderBy("llm_score", F.desc("idx")).limit(n).withColumn("side", F.lit("bottom"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("llm_score"), "idx"))
    return best.unionByName(worst).withColumn("place", place).select("side", "place", *columns)


def judged_hits(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Hits ``query_id, rank, doc_id`` with ``relevant`` from citations ``query_id, doc_id``.

    Several chunks of a document count once, at their best rank.
    """
    documents = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    known = truth.select("query_id", "doc_id").distinct().withColumn("relevant", F.lit(True))
    return documents.join(known, ["query_id", "doc_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def rank_metrics(hits: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """``query_id, precision_at_k, recall_at_k, reciprocal_rank`` for every query in ``totals``.

    ``hits`` has ``query_id, rank, relevant`` and ``totals`` the number ``n_relevant`` of each query.
    """
    best = hits.groupBy("query_id").agg(
        F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("found"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
    )
    found = F.coalesce(F.col("found"), F.lit(0))
    return totals.join(best, "query_id", "left").select(
        "query_id",
        (found / F.lit(float(k))).alias("precision_at_k"),
        F.when(F.col("n_relevant") > 0, found / F.col("n_relevant")).otherwise(0.0).alias("recall_at_k"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def mean_rank_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.avg("precision_at_k").alias("precision_at_k"),
        F.avg("recall_at_k").alias("recall_at_k"),
        F.avg("reciprocal_rank").alias("mrr"),
    )


def citation_recall(retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """``query_id, n_retrieved, n_truth, n_found, citation_recall`` over distinct sources ``query_id, source``."""
    tagged = lambda df, tag: df.select("query_id", "source", F.lit(tag).alias("tag"))
    both = tagged(retrieved, 1).unionByName(tagged(truth, 2))
    sides = both.groupBy("query_id", "source").agg(F.bit_or("tag").alias("sides"))
    counted = sides.groupBy("query_id").agg(
        F.count_if(F.col("sides") != 2).alias("n_retrieved"),
        F.count_if(F.col("sides") != 1).alias("n_truth"),
        F.count_if(F.col("sides") == 3).alias("n_found"),
    )
    return counted.where("n_truth > 0").withColumn("citation_recall", F.col("n_found") / F.col("n_truth"))


def hybrid_score(judged: Column, precision: Column, third: Column, weights=(0.5, 0.3, 0.2)) -> Column:
    """Weighted sum of three metrics on one scale."""
    return judged * weights[0] + precision * weights[1] + third * weights[2]


def failure_mode(n_found: Column, n_truth: Column, n_retrieved: Column) -> Column:
    """Nothing retrieved, only wrong documents, some of the right ones, or all of them."""
    return (
        F.when(n_retrieved == 0, "retrieval failure")
        .when(n_found == 0, "irrelevant retrieval")
        .when(n_found < n_truth, "incomplete retrieval")
        .otherwise("complete")
    )


def ngrams(text: Column, n: int) -> Column:
    """The n-grams of a text's words, in order."""
    starts = lambda tokens: F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))),
                                     lambda i: i <= F.size(tokens) - (n - 1))
    return let(words(text), lambda tokens: F.transform(starts(tokens), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")))


def ngram_overlap(pairs: DataFrame, n: int = 2, *, key: str = "idx", candidate: str = "candidate",
                  reference: str = "reference") -> DataFrame:
    """Clipped n-gram precision, recall and F1 of each pair.

    N-grams of both sides are counted together by pair and n-gram, with partial counts before the
    shuffle, so a long text is spread over tasks and no join is needed.
    """
    tagged = F.array(
        F.struct(F.lit(1).alias("c"), F.lit(0).alias("r"), ngrams(F.col(candidate), n).alias("grams")),
        F.struct(F.lit(0).alias("c"), F.lit(1).alias("r"), ngrams(F.col(reference), n).alias("grams")))
    sides = pairs.select(key, F.inline(tagged))
    # a side without n-grams keeps one row with a null n-gram, so its pair is not lost
    grams = sides.select(key, "c", "r", F.explode_outer("grams").alias("gram"))
    found = lambda side: F.sum(F.when(F.col("gram").isNotNull(), F.col(side)).otherwise(0)).alias(side)
    counts = grams.groupBy(key, "gram").agg(found("c"), found("r"))
    full = counts.groupBy(key).agg(
        F.sum(F.least("c", "r")).alias("overlap"), F.sum("c").alias("n_candidate"), F.sum("r").alias("n_reference"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    scored = full.withColumns({"precision": ratio("overlap", "n_candidate"), "recall": ratio("overlap", "n_reference")})
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", F.when(both > 0, 2.0 * F.col("precision") * F.col("recall") / both).otherwise(0.0))
