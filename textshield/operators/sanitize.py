"""Block, rewrite or pass a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import REWRITE_BLOCK_MODE, SANITIZER_SYSTEM_PROMPT
from textshield.functions.text import blocked_marker


def is_blocked(mode: str | Column, detection: str = "detection") -> Column:
    """Malicious texts are blocked in mode ``block``; any other mode rewrites them."""
    return F.col(detection)["is_malicious"] & ((mode if isinstance(mode, Column) else F.lit(mode)) == "block")


def sanitize(df: DataFrame, *, text: str = "text", mode: str | Column = REWRITE_BLOCK_MODE,
             rewrite: Column | None = None, context_rewrite: Column | None = None,
             detection: str | None = "detection") -> DataFrame:
    """Add ``blocked``, ``route`` and ``sanitized``.

    The order is: block marker, reply to the prompt with context, reply to the plain prompt,
    the text itself. Reply columns are evaluated only for rows that get that far.
    """
    none = F.lit(None).cast("string")
    marker = blocked_marker(F.col(detection)["label"]) if detection else none
    routed = df.withColumn("blocked", is_blocked(mode, detection) if detection else F.lit(False))
    routed = routed.withColumn("_context", none if context_rewrite is None else F.when(~F.col("blocked"), context_rewrite))
    with_context = F.coalesce(F.col("_context"), F.lit("")) != ""
    routed = routed.withColumn("_plain", none if rewrite is None else F.when(~F.col("blocked") & ~with_context, rewrite))
    plain = F.coalesce(F.col("_plain"), F.lit("")) != ""
    choose = lambda *answers: (
        F.when(F.col("blocked"), answers[0]).when(with_context, answers[1]).when(plain, answers[2]).otherwise(answers[3]))
    return routed.withColumns({
        "route": choose(*[F.lit(r) for r in ("blocked", "context", "default", "original")]),
        "sanitized": choose(marker, F.col("_context"), F.col("_plain"), F.col(text)),
    }).drop("_context", "_plain")


def sanitize_with_replies(df: DataFrame, reply: Callable[[DataFrame], DataFrame], *, key: str, text: str = "text",
                          mode: str | Column = REWRITE_BLOCK_MODE, system_prompt: str | Column = "", temperature: Column | None = None,
                          enriched: str | None = None, detection: str | None = "detection") -> DataFrame:
    """The same with replies from a text generator.

    ``reply`` takes ``item_id, system, user``, and ``temperature`` if one is given, and returns ``item_id, reply``; it should return
    stored rows (see ``operators.generation.stored_replies``), because its result is read twice.
    Blocked rows are never sent. Rows with an enriched prompt are sent with it and no system
    prompt; only those left without a reply are sent again as plain rewrites. A blank system prompt
    means the default one.
    """
    blocked = is_blocked(mode, detection) if detection else F.lit(False)
    open_rows = df.where(~blocked)
    item = F.col(key).alias("item_id")
    warmth = [] if temperature is None else [temperature.alias("temperature")]
    context = None
    if enriched:
        asked = open_rows.where(F.col(enriched).isNotNull())
        context = reply(asked.select(item, F.lit("").alias("system"), F.col(enriched).alias("user"), *warmth))
        answered = context.where("reply <> ''").select(F.col("item_id").alias(key))
        open_rows = open_rows.join(answered, key, "left_anti")
    own = system_prompt if isinstance(system_prompt, Column) else F.lit(system_prompt)
    system = F.when(own != "", own).otherwise(SANITIZER_SYSTEM_PROMPT)
    default = reply(open_rows.select(item, system.alias("system"), F.col(text).alias("user"), *warmth))
    joined = df.join(default.select(F.col("item_id").alias(key), F.col("reply").alias("_default")), key, "left")
    if context is not None:
        joined = joined.join(context.select(F.col("item_id").alias(key), F.col("reply").alias("_context")), key, "left")
    answer = sanitize(joined, text=text, mode=mode, rewrite=F.col("_default"), detection=detection,
                      context_rewrite=F.col("_context") if context is not None else None)
    return answer.drop("_default", "_context")
