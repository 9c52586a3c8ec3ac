"""Verdicts on texts, rewrites of the harmful ones and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import MODERATION_FAILED, MODERATION_SYSTEM_PROMPT, REWRITE_BLOCK_MODE, UNKNOWN
from textshield.fixed_values import REPORT_TEXTS as R
from textshield.functions.detection import detection_details
from textshield.functions.prompts import moderation_prompt
from textshield.functions.replies import parse_moderation
from textshield.functions.rules import mask, rule_flags, rule_logits, rule_reply, rule_verdict
from textshield.functions.text import is_blank, preview, rewrite_error, rewrite_metrics, strip_html
from textshield.operators.sanitize import sanitize

COMMENT_PREVIEW, PAGE_PREVIEW = 300, 500


def moderate(df: DataFrame, reply: Column | None = None, *, text: str = "text", flags: Column | None = None) -> DataFrame:
    """Add ``raw_response`` and ``verdict`` (parsed, is_harmful, severity, issues, recommendations).

    ``reply`` is the moderator's answer; a missing or empty one leaves the text unparsed and so
    not harmful. Without it the rule-based moderator answers, from ``flags`` if the rules have run.
    """
    if reply is None:
        flagged = df.withColumn("rule_flags", rule_flags(F.col(text)) if flags is None else flags)
        verdict = rule_verdict(F.col("rule_flags"))
        judged = F.struct(F.lit(True).alias("parsed"), *[verdict[n].alias(n) for n in
                          ("is_harmful", "severity", "issues", "recommendations")])
        return flagged.withColumns({"raw_response": rule_reply(F.col("rule_flags")), "verdict": judged}).drop("rule_flags")
    answered = F.nullif(reply, F.lit(""))
    return df.withColumn("raw_response", F.coalesce(answered, F.lit(MODERATION_FAILED))).withColumn(
        "verdict", parse_moderation(answered)
    )


def moderate_with_replies(df: DataFrame, reply: Callable[[DataFrame], DataFrame], *, key: str, text: str = "text") -> DataFrame:
    """The same with replies from a text generator, which gets ``item_id, system, user``.

    Only texts with something to read are sent, and ``asked`` tells which. Null and blank texts
    have no verdict and no response. ``key`` names a unique column.
    """
    blank = F.coalesce(is_blank(F.col(text)), F.lit(True))
    full = df.where(~blank)
    requests = full.select(F.col(key).alias("item_id"), F.lit(MODERATION_SYSTEM_PROMPT).alias("system"), moderation_prompt(F.col(text)).alias("user"))
    answers = reply(requests).select(F.col("item_id").alias(key), F.col("reply").alias("_reply"))
    judged = moderate(full.join(answers, key, "left"), F.col("_reply"), text=text).drop("_reply").withColumn("asked", F.lit(True))
    rest = df.where(blank)
    for name in ("raw_response", "verdict"):
        rest = rest.withColumn(name, F.lit(None).cast(judged.schema[name].dataType))
    return judged.unionByName(rest.withColumn("asked", F.lit(False)))


def status(verdict: Column) -> Column:
    """HARMFUL (SEVERITY), SAFE, or that the analysis could not be read."""
    harmful = F.concat(F.lit("HARMFUL ("), F.upper(verdict["severity"]), F.lit(")"))
    return F.when(~verdict["parsed"], "Unable to parse analysis").when(verdict["is_harmful"], harmful).otherwise("SAFE")


def _plain_pages(pages: DataFrame, html: str) -> DataFrame:
    return pages.withColumn("plain_text", strip_html(F.coalesce(F.col(html), F.lit("")))).withColumn("blank", is_blank(F.col("plain_text")))


def _shown_pages(judged: DataFrame) -> DataFrame:
    return judged.withColumns({
        "preview": F.when(~F.col("blank"), preview(F.col("plain_text"), PAGE_PREVIEW)),
        "status": F.when(F.col("blank"), "EMPTY").otherwise(status(F.col("verdict"))),
    })


def moderate_pages(pages: DataFrame, reply: Column | None = None, *, html: str = "html") -> DataFrame:
    """Pages with plain text, preview and verdict. Blank pages get status ``EMPTY`` and no verdict, and are not judged."""
    plain = _plain_pages(pages, html)
    text = F.when(~F.col("blank"), F.col("plain_text"))
    judged = moderate(plain.withColumn("_text", text), reply if reply is None else F.when(~F.col("blank"), reply), text="_text").drop("_text")
    return _shown_pages(judged.withColumns({name: F.when(~F.col("blank"), F.col(name)) for name in ("verdict", "raw_response")}))


def moderate_pages_with_replies(pages: DataFrame, reply: Callable[[DataFrame], DataFrame], *, key: str, html: str = "html") -> DataFrame:
    """The same with replies from a text generator (see :func:`moderate_with_replies`); blank pages are never sent."""
    return _shown_pages(moderate_with_replies(_plain_pages(pages, html), reply, key=key, text="plain_text"))


def non_blank_pages(pages: DataFrame, *, html: str = "html") -> DataFrame:
    return pages.where(~is_blank(strip_html(F.coalesce(F.col(html), F.lit("")))))


def moderate_comments(comments: DataFrame, reply: Column | None = None, *, body: str = "body") -> DataFrame:
    """Comments with preview, verdict and status; their position stays the key."""
    judged = moderate(comments, reply, text=body)
    return judged.withColumns({
        "preview": preview(F.col(body), COMMENT_PREVIEW),
        "status": status(F.col("verdict")),
    })


def moderate_comments_with_replies(comments: DataFrame, reply: Callable[[DataFrame], DataFrame], *, key: str, body: str = "body") -> DataFrame:
    """The same with replies from a text generator; a comment without text is not sent and gets status ``EMPTY``."""
    judged = moderate_with_replies(comments, reply, key=key, text=body)
    return judged.withColumns({"preview": preview(F.col(body), COMMENT_PREVIEW), "status": F.when(F.col("asked"), status(F.col("verdict"))).otherwise("EMPTY")})


def rewrite_harmful(df: DataFrame, rewrite: Column | None = None, *, text: str = "text", error: Column | None = None,
                    mode: str | Column = REWRITE_BLOCK_MODE, detect: bool = True,
                    context_rewrite: Column | None = None) -> DataFrame:
    """Rewrite every text and add ``rewritten`` and its ``metrics``; a failed rewrite leaves the text as it is."""
    flags = None
    if detect:
        df = df.withColumn("rule_flags", rule_flags(F.col(text)))
        df = df.withColumn("detection", detection_details(rule_logits(F.col("rule_flags"))))
        flags = F.col("rule_flags")
    answer = mask(F.col(text), flags=flags) if rewrite is None else rewrite
    done = sanitize(df, text=text, mode=mode, rewrite=answer, context_rewrite=context_rewrite,
                    detection="detection" if detect else None)
    failed = error if error is not None else F.lit(None).cast("string")
    kept = done.withColumn("rewritten", F.when(failed.isNotNull(), F.col(text)).otherwise(F.col("sanitized")))
    metrics = F.when(failed.isNotNull(), rewrite_error(F.col(text), failed)).otherwise(
        rewrite_metrics(F.col(text), F.col("rewritten")))
    return kept.withColumn("metrics", metrics).drop("sanitized", "route", "blocked", "detection", "rule_flags")


def moderate_and_rewrite(df: DataFrame, reply: Column | None = None, rewrite: Column | None = None, *,
                         text: str = "text", error: Column | None = None) -> DataFrame:
    """Verdict on every text, rewrite of the harmful ones only (others have null metrics)."""
    judged = moderate(df.withColumn("_flags", rule_flags(F.col(text))), reply, text=text, flags=F.col("_flags"))
    harmful = F.col("verdict")["is_harmful"]
    answer = F.when(harmful, mask(F.col(text), flags=F.col("_flags")) if rewrite is None else rewrite)
    done = rewrite_harmful(judged, answer, text=text, error=error, detect=False)
    return done.withColumns({
        "rewritten": F.when(harmful, F.col("rewritten")),
        "metrics": F.when(harmful, F.col("metrics")),
    }).drop("_flags")


def rewrite_counts(df: DataFrame) -> DataFrame:
    """Passages, harmful ones and rewrites that succeeded."""
    harmful = F.col("verdict")["is_harmful"]
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(harmful).alias("harmful"),
        F.count_if(harmful & F.col("metrics")["error"].isNull()).alias("rewritten"),
    )


def verdict_summary(df: DataFrame) -> DataFrame:
    """Number of texts by status and severity."""
    verdict = F.col("verdict")
    return df.groupBy(status(verdict).alias("status"), F.upper(verdict["severity"]).alias("severity")).agg(
        F.count("*").alias("n"))


def issue_counts(df: DataFrame) -> DataFrame:
    """Number of texts by issue. Equal issue lists are counted before they are taken apart."""
    lists = df.groupBy(F.col("verdict.issues").alias("issues")).agg(F.count("*").alias("n"))
    issues = lists.select("n", F.explode_outer("issues").alias("issue")).where(F.col("issue").isNotNull())
    return issues.groupBy("issue").agg(F.sum("n").alias("n"))


def _bullets(title: str, items: Column) -> Column:
    """A titled list, nothing when it is empty."""
    lines = F.concat_ws("", F.transform(items, lambda i: F.format_string(R["bullet"], i)))
    return F.when(F.size(items) > 0, F.concat(F.lit(title), lines, F.lit("\n"))).otherwise("")


def _known(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))


def comment_report(df: DataFrame, *keep: str, position: str = "pos", comment_id: str = "id") -> DataFrame:
    """Markdown block of each moderated comment: the columns to keep, ``pos, fragment``. Write it ordered by position."""
    verdict, raw = F.col("verdict"), F.col("raw_response")
    harmful = F.concat(F.format_string(R["comment_harmful"], F.upper(verdict["severity"])),
                       _bullets(R["comment_issues"], verdict["issues"]), _bullets(R["comment_advice"], verdict["recommendations"]))
    analysed = F.concat(F.when(verdict["is_harmful"], harmful).otherwise(R["comment_safe"]), F.format_string(R["analysis"], raw))
    head = F.format_string(R["comment_head"], F.col(position) + 1, _known(comment_id), F.col("preview"))
    judged = F.when(verdict["parsed"], analysed).otherwise(F.format_string(R["comment_raw"], raw))
    return df.select(*keep, F.col(position).alias("pos"), F.concat(head, judged, F.lit(R["rule"])).alias("fragment"))


def page_report(df: DataFrame, *, page_id: str = "page_id", title: str = "title", space: str = "space_name",
                version: str = "version") -> DataFrame:
    """Markdown report of each moderated page; blank pages get a warning instead."""
    verdict, raw = F.col("verdict"), F.col("raw_response")
    found = F.format_string(R["page_harmful"], F.upper(verdict["severity"]))
    analysed = F.concat(F.when(verdict["is_harmful"], found).otherwise(R["page_safe"]),
                        _bullets(R["page_issues"], verdict["issues"]), _bullets(R["page_advice"], verdict["recommendations"]),
                        F.format_string(R["analysis"], raw))
    head = F.format_string(R["page_head"], *[_known(c) for c in (title, space, version, page_id)], F.col("preview"))
    report = F.concat(head, F.when(verdict["parsed"], analysed).otherwise(F.format_string(R["page_raw"], raw)))
    return df.select(page_id, F.when(F.col("blank"), F.format_string(R["page_empty"], _known(title))).otherwise(report).alias("fragment"))


def rewrite_report(df: DataFrame, *keep: str, position: str = "pos", comment_id: str = "id", body: str = "body",
                   with_verdict: bool = True) -> DataFrame:
    """HTML block of each passage with its verdict and rewrite: the columns to keep, ``pos, fragment``."""
    head = F.format_string(R["passage_head"], F.col(position) + 1, _known(comment_id), F.col(body))
    rewritten = F.format_string(R["passage_rewritten"], F.col("rewritten"))
    pos, rule = F.col(position).alias("pos"), F.lit(R["rule"])
    if not with_verdict:
        error = F.col("metrics")["error"]
        failed = F.when(error.isNotNull(), F.format_string(R["passage_error"], error)).otherwise("")
        return df.select(*keep, pos, F.concat(head, rewritten, failed, rule).alias("fragment"))
    verdict = F.col("verdict")
    items = F.concat_ws("", F.transform(verdict["issues"], lambda i: F.format_string(R["passage_issue"], i)))
    issues = F.when(F.size(verdict["issues"]) > 0, F.format_string(R["passage_issues"], items)).otherwise("")
    harmful = F.concat(F.format_string(R["passage_harmful"], F.upper(verdict["severity"])), issues)
    judged = F.when(~verdict["parsed"], R["passage_unread"]).when(verdict["is_harmful"], harmful).otherwise(R["passage_safe"])
    tail = F.when(verdict["is_harmful"], rewritten).otherwise(R["passage_kept"])
    return df.select(*keep, pos, F.concat(head, F.lit(R["passage_analysis"]), judged, tail, rule).alias("fragment"))
