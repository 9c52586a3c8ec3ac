"""Prompt texts and message lists built from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textshield.fixed_values import CONTEXT_FORMAT, ENRICHED_PROMPT, JUDGE_PROMPT, MODERATION_PROMPT_HEAD, PASSAGE_FORMAT


def _between(pieces: tuple[str, ...], values: list[Column]) -> Column:
    parts: list[Column] = []
    for piece, value in zip(pieces, [*values, None]):
        parts.append(F.lit(piece))
        if value is not None:
            parts.append(value)
    return F.concat(*parts)


def moderation_prompt(text: Column) -> Column:
    return F.concat(F.lit(MODERATION_PROMPT_HEAD), text)


def enriched_prompt(documents: Column, query: Column) -> Column:
    """Rewrite prompt with example documents (an array, best first)."""
    return _between(ENRICHED_PROMPT, [F.concat_ws("\n\n", documents), query])


def judge_prompt(question: Column, answer: Column, context: Column) -> Column:
    return _between(JUDGE_PROMPT, [question, answer, context])


def chat_messages(system: Column, user: Column) -> Column:
    """``array<struct<role, content>>``; an empty system prompt makes no message."""
    entry = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    user_only = F.array(entry("user", user))
    both = F.array(entry("system", system), entry("user", user))
    return F.when(F.coalesce(system, F.lit("")) == "", user_only).otherwise(both)


def context_entry(rank: Column, text: Column) -> Column:
    return F.format_string(CONTEXT_FORMAT, rank, text)


def passage(passage_id: Column, body: Column) -> Column:
    return F.format_string(PASSAGE_FORMAT, passage_id, body)
