"""Text generation through a provider, kept as a table of attempts."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import CHAT_MAX_TOKENS, CHAT_TEMPERATURE, RETRIES, RETRY_PAUSE_SECONDS, REWRITE_MAX_TOKENS, REWRITE_TEMPERATURE
from textshield.functions.prompts import chat_messages
from textshield.functions.rules import RULES
from textshield.session import write_at, write_once

ATTEMPTS = pa.schema([("attempt", pa.int32()), ("finish_reason", pa.string()), ("content", pa.string()), ("error", pa.string())])

# A provider is a factory, called once per task. What it makes takes message lists, temperature and
# max_tokens and returns one (finish_reason, content) per list.
Provider = Callable[[], Callable[[list, float, int], list]]


#: Requests of one call.
CALL_REQUESTS = 32


def masking_provider():
    """Offline stand-in for a rewriting model: answers with the user message, rule matches replaced."""

    def complete(conversations, temperature, max_tokens):
        answers = []
        for messages in conversations:
            text = messages[-1]["content"]
            for rule in RULES:
                text = re.sub(rule.pattern, rule.replacement, text, flags=re.ASCII)
            answers.append(("stop", text))
        return answers

    return complete


def is_good(finish_reason, content, error) -> bool:
    return error is None and finish_reason != "content_filter" and bool(content)


def isolated(call, messages: list) -> list[tuple]:
    """Answers with their errors; a failed call is repeated in halves, and a single one is an attempt with an error."""
    try:
        return [(*a, None) for a in call(messages)]
    except Exception as problem:
        if len(messages) == 1:
            return [(None, None, str(problem))]
        half = len(messages) // 2
        return isolated(call, messages[:half]) + isolated(call, messages[half:])


def generate(requests: DataFrame, provider: Provider = masking_provider, *, temperature: float = CHAT_TEMPERATURE,
             max_tokens: int = CHAT_MAX_TOKENS, retries: int = RETRIES, pause: float = RETRY_PAUSE_SECONDS, batch_size: int = CALL_REQUESTS) -> DataFrame:
    """Attempts for requests ``item_id, system, user``: ``item_id, attempt, finish_reason, content, error``.

    A column ``temperature`` gives a request its own; a null there, or no such column, means the common one.

    A request is tried again until a reply is good or the tries are used up. A call has at most
    ``batch_size`` requests; if it fails, its halves are called on their own, down to single requests,
    so that a request that makes every call fail takes no other with it.
    """
    warmth = F.coalesce(F.col("temperature").cast("double"), F.lit(temperature)) if "temperature" in requests.columns else F.lit(temperature)
    asked = requests.select("item_id", chat_messages(F.col("system"), F.col("user")).alias("messages"), warmth.cast("double").alias("temperature"))
    id_type = asked.schema["item_id"].dataType.simpleString()

    def run(batches):
        complete = provider()
        for batch in batches:
            conversations = batch.column("messages").to_pylist()
            warm = batch.column("temperature").to_pylist()
            # requests of one temperature follow each other, so that they share calls
            waiting = sorted(range(batch.num_rows), key=warm.__getitem__)
            for attempt in range(1, retries + 1):
                if not waiting:
                    break
                if attempt > 1:
                    time.sleep(pause)
                answers = []
                for degree, same in groupby(waiting, key=warm.__getitem__):
                    same = list(same)
                    for first in range(0, len(same), batch_size):
                        part = [conversations[i] for i in same[first : first + batch_size]]
                        answers += isolated(lambda some, t=degree: complete(some, t, max_tokens), part)
                columns = [pa.array([attempt] * len(waiting), pa.int32())]
                columns += [pa.array([a[n] for a in answers], pa.string()) for n in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item_id").take(pa.array(waiting, pa.int64())), *columns], names=["item_id", *ATTEMPTS.names]
                )
                waiting = [i for i, a in zip(waiting, answers) if not is_good(*a)]

    return asked.mapInArrow(run, f"item_id {id_type}, attempt int, finish_reason string, content string, error string")


def resolve_replies(attempts: DataFrame, items: DataFrame | None = None, *, retries: int = RETRIES) -> DataFrame:
    """The first good reply of each item among its first tries: ``item_id, reply``.

    With ``items`` every item gets a row, and the reply is null where no try was good.
    """
    good = attempts.where(
        (F.col("attempt") <= retries)
        & F.col("error").isNull()
        & ~F.col("finish_reason").eqNullSafe("content_filter")
        & (F.col("content") != "")
    )
    first = good.groupBy("item_id").agg(F.min_by("content", "attempt").alias("reply"))
    return first if items is None else items.select("item_id").join(first, "item_id", "left")


def stored_replies(provider: Provider = masking_provider, folder: str | None = None, **options) -> Callable[[DataFrame], DataFrame]:
    """A reply function that keeps its attempts, so no request is sent twice.

    They go to the shared folder, or to ``folder``: there, attempts that an earlier run finished are
    used again, call by call.
    """
    number = count()

    def reply(requests: DataFrame) -> DataFrame:
        attempts = generate(requests, provider, **options)
        kept = write_once(attempts, "attempts") if folder is None else write_at(attempts, f"{folder}/attempts-{next(number)}")
        return resolve_replies(kept, retries=options.get("retries", RETRIES))

    return reply


def rewriting_replies(provider: Provider = masking_provider, folder: str | None = None, **options) -> Callable[[DataFrame], DataFrame]:
    """The same with the temperature and length of rewrites."""
    return stored_replies(provider, folder, **({"temperature": REWRITE_TEMPERATURE, "max_tokens": REWRITE_MAX_TOKENS} | options))
