"""Reading the JSON replies of judges and moderators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textshield.fixed_values import JUDGE_FAILED_PREFIX
from textshield.functions.text import strip
from textshield.functions.vectors import let

VERDICT = "is_harmful boolean, severity string, issues array<string>, recommendations array<string>"
_FENCE = "```"


def unfenced(reply: Column) -> Column:
    """The text inside the first json fence, else inside the first fence, else the reply."""
    json_fence = _FENCE + "json"
    inside = lambda opening: strip(F.split_part(F.split_part(reply, F.lit(opening), F.lit(2)), F.lit(_FENCE), F.lit(1)))
    return (
        F.when(F.contains(reply, F.lit(json_fence)), inside(json_fence))
        .when(F.contains(reply, F.lit(_FENCE)), inside(_FENCE))
        .otherwise(reply)
    )


def _parsed(text: Column) -> Column:
    """The text as JSON, null when it cannot be read."""
    return F.try_parse_json(text)


def _is_object(parsed: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))


def parse_judge(reply: Column) -> Column:
    """``struct<score, reasoning, judge_failed>``; a reply that cannot be read scores 0."""

    def fields(parsed: Column) -> Column:
        return F.struct(
            _is_object(parsed).alias("readable"),
            F.try_variant_get(parsed, "$.score", "string").try_cast("double").alias("score"),
            F.try_variant_get(parsed, "$.reasoning", "string").alias("reasoning"),
        )

    def judged(found: Column) -> Column:
        reason = (
            F.when(reply.isNull(), "no reply")
            .when(~found["readable"], "reply is not a JSON object")
            .when(found["score"].isNull(), "score is missing or not a number")
            .when(found["reasoning"].isNull(), "reasoning is missing")
        )
        return F.struct(
            F.when(reason.isNull(), found["score"]).otherwise(0.0).alias("score"),
            F.when(reason.isNull(), found["reasoning"]).otherwise(F.concat(F.lit(JUDGE_FAILED_PREFIX), reason)).alias("reasoning"),
            reason.isNotNull().alias("judge_failed"),
        )

    return let(let(_parsed(unfenced(reply)), fields), judged)


def parse_moderation(reply: Column) -> Column:
    """Verdict in a reply that is nothing but a JSON object.

    ``parsed`` is false for an unreadable or empty object; such a text counts as not harmful.
    """
    none = F.array().cast("array<string>")
    readable = let(_parsed(reply), lambda p: _is_object(p) & (p.cast("string") != "{}"))
    verdict = lambda ok: F.from_json(F.when(ok, reply), VERDICT)
    whole = lambda found: F.struct(
        found["ok"].alias("parsed"),
        F.coalesce(found["v"]["is_harmful"], F.lit(False)).alias("is_harmful"),
        F.coalesce(found["v"]["severity"], F.lit("unknown")).alias("severity"),
        F.coalesce(found["v"]["issues"], none).alias("issues"),
        F.coalesce(found["v"]["recommendations"], none).alias("recommendations"),
    )
    return let(let(F.coalesce(readable, F.lit(False)), lambda ok: F.struct(ok.alias("ok"), verdict(ok).alias("v"))), whole)
