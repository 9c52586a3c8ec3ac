"""Answers to scan requests by a provider, with context from a collection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import ENRICH_K
from textshield.functions.rules import rule_flags
from textshield.operators.embedding import embed
from textshield.operators.generation import Provider, masking_provider, rewriting_replies
from textshield.operators.models import Model
from textshield.operators.retrieval import enrich
from textshield.operators.sanitize import is_blocked, sanitize_with_replies
from textshield.operators.scanning import GUARD, REWRITE, SCORES, detect_requests, scan_batch, with_defaults
from textshield.session import write_at, write_once

KEY = "_request"


def request_key(requests: DataFrame) -> Column:
    """A key that requests share only if they are equal in all columns."""
    return F.sha2(F.to_json(F.struct(*requests.columns)), 256)


def answer_requests(requests: DataFrame, provider: Provider = masking_provider, *, key: str | None = None, chunks: DataFrame | None = None,
                    k: int = ENRICH_K, metric: str | None = None, chunk_id: str = "chunk_id", text: str = "text", embedder: Model | None = None,
                    topics: Sequence[str] | dict[str, Sequence[str]] = (), folder: str | None = None, retrieval: dict | None = None,
                    **options) -> DataFrame:
    """Answers of :func:`scan_batch` in which rewrites are replies of ``provider``, and their ``route``.

    A request is sent with its own system prompt and temperature. One that asks for context is sent
    with the ``k`` nearest of ``chunks`` and without a system prompt, and again as a plain rewrite if
    that gives no reply. What its detector refuses in mode ``block`` is neither looked up nor sent.
    Requests that the scanners answer take no part in any of this.

    ``key`` names a unique column; without one, requests equal in all columns are sent once. With a
    ``folder``, what an earlier run stored there is not looked up or sent again. ``retrieval`` are
    options of the search, ``options`` those of :func:`generate`.
    """
    store: Callable[[DataFrame, str], DataFrame] = write_once if folder is None else lambda df, name: write_at(df, f"{folder}/{name}")
    given = requests.columns
    method = F.coalesce(F.col("method"), F.lit(GUARD)) if "method" in given else F.lit(GUARD)
    scanned = scan_batch(requests.where(method == GUARD), topics).withColumn("route", F.lit(None).cast("string"))
    own = requests if key else requests.withColumn(KEY, request_key(requests))
    item = key or KEY
    asked = with_defaults(own.where(method == REWRITE))
    single = asked if key else asked.dropDuplicates([item])
    flagged = single.withColumn("rule_flags", rule_flags(F.col("prompt")))
    needed = [item, "prompt", "use_rag", "system_prompt", "temperature", "block_mode", "detection", "use_prompt_injection_detection"]
    rows = store(detect_requests(flagged).select(*dict.fromkeys(needed)), "requests")
    if chunks is not None:
        wanted = rows.where(F.col("use_rag") & ~is_blocked(F.col("block_mode"))).select(F.col(item).alias("prompt_id"), "prompt")
        found = enrich(embed(wanted, embedder, text="prompt"), chunks, k, metric, chunk_id=chunk_id, text=text, **(retrieval or {}))
        context = store(found.select(F.col("prompt_id").alias(item), "enriched_prompt").where("enriched_prompt IS NOT NULL"), "context")
        rows = rows.join(context, item, "left")
    done = sanitize_with_replies(
        rows, rewriting_replies(provider, folder, **options), key=item, text="prompt", mode=F.col("block_mode"), system_prompt=F.col("system_prompt"),
        temperature=F.col("temperature"), enriched="enriched_prompt" if chunks is not None else None)
    answers = done.select(
        item, F.col("sanitized").alias("sanitized_prompt"), (~F.col("blocked")).alias("valid"), F.create_map().cast(SCORES).alias("scan_scores"), "blocked",
        F.when(F.col("use_prompt_injection_detection"), F.col("detection.error")).alias("error"), "route")
    rest = [c for c in given if c not in ("method", item)]
    written = own.where(method == REWRITE).select(item, *rest).join(answers, item).withColumn("method", F.lit(REWRITE))
    return scanned.unionByName(written.select(*scanned.columns))
