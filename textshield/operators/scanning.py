"""Scanners over prompts, request validation and dispatch by method."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textshield.fixed_values import (
    DEFAULT_DETECTOR,
    DETECTION_THRESHOLD,
    DETECTOR_CLASSES,
    REQUEST_BLOCK_MODE,
    REQUEST_TEMPERATURE,
)
from textshield.functions.detection import class_probabilities, detection_details
from textshield.functions.rules import mask, own_topic_score, rule_flags, rule_logits, topic_score, toxicity_score
from textshield.functions.vectors import let
from textshield.operators.models import Model, with_vectors
from textshield.operators.sanitize import sanitize

GUARD, REWRITE = "guard", "rewrite"
INJECTION_LIMIT = 0.92  # usual limit of the injection scanner, which takes no threshold from requests
SCORES = "map<string,double>"
CORRUPT = "_corrupt_record"  # column in which the JSON reader keeps a line it cannot read

REQUEST_DEFAULTS = {
    "method": GUARD,
    "enable_prompt_injection": True,
    "enable_toxicity": False,
    "enable_banned_topics": False,
    "toxicity_threshold": 0.5,
    "banned_topics_threshold": 0.5,
    "use_rag": False,
    "temperature": REQUEST_TEMPERATURE,
    "system_prompt": "",
    "use_prompt_injection_detection": True,
    "prompt_injection_model": DEFAULT_DETECTOR,
    "prompt_injection_threshold": DETECTION_THRESHOLD,
    "block_mode": REQUEST_BLOCK_MODE,
}
TOPIC_LIST = "banned_topics_list"
RANGES = {
    "toxicity_threshold": (0.0, 1.0),
    "banned_topics_threshold": (0.0, 1.0),
    "temperature": (0.0, 2.0),
    "prompt_injection_threshold": (0.0, 1.0),
}


class Scanner(NamedTuple):
    """A score column, the highest valid score and whether the scanner runs for a row."""

    name: str
    score: Column
    threshold: Column | float
    enabled: Column | bool = True


def detect_injection(df: DataFrame, logits: Column | None = None, *, text: str = "text",
                     model: str = DEFAULT_DETECTOR, threshold: float | Column = DETECTION_THRESHOLD) -> DataFrame:
    """Add the ``detection`` struct. Without logits the rule scorer supplies them."""
    if logits is None:
        df = df.withColumn("rule_flags", rule_flags(F.col(text)))
        logits = rule_logits(F.col("rule_flags"))
    return df.withColumn("detection", detection_details(logits, model, threshold))


def detect_with_scores(df: DataFrame, scores: DataFrame, *, key: str, logits: str = "logits",
                       model: str = DEFAULT_DETECTOR, threshold: float | Column = DETECTION_THRESHOLD) -> DataFrame:
    """The same with logits from a table of scores; rows without one pass (fail open)."""
    scored = df.join(scores.select(key, F.col(logits).alias("logits")), key, "left")
    return detect_injection(scored, F.col("logits"), model=model, threshold=threshold).drop("logits")


def detect_with_model(df: DataFrame, scorer: Model, *, text: str = "text", model: str = DEFAULT_DETECTOR,
                      threshold: float | Column = DETECTION_THRESHOLD) -> DataFrame:
    """The same with logits from a classifier that runs on the workers."""
    scored = with_vectors(df, scorer, text=text, out="_logits")
    return detect_injection(scored, F.col("_logits"), text=text, model=model, threshold=threshold).drop("_logits")


def scan(df: DataFrame, scanners: Sequence[Scanner], *, text: str = "text") -> DataFrame:
    """Add ``sanitized``, ``is_valid``, ``scan_scores`` and ``scan_error``.

    A text is valid when no score exceeds its threshold. A scanner without a score is an error;
    the text then passes without scores.
    """
    column = lambda value, kind: value if isinstance(value, Column) else F.lit(kind(value))
    outcome = lambda s: F.when(column(s.enabled, bool), F.struct(
        F.lit(s.name).alias("name"), s.score.alias("score"), (s.score <= column(s.threshold, float)).alias("passed")))
    outcomes = F.array_compact(F.array(*[outcome(s) for s in scanners])) if scanners else None
    if outcomes is None:
        empty = F.create_map().cast(SCORES)
        return df.select("*", F.col(text).alias("sanitized"), F.lit(True).alias("is_valid"), empty.alias("scan_scores"),
                         F.lit(None).cast("string").alias("scan_error"))
    run = df.withColumn("_outcomes", outcomes)
    lost = F.get(F.filter("_outcomes", lambda o: o["score"].isNull()), F.lit(0))["name"]
    failed = F.col("scan_error").isNotNull()
    scores = F.map_from_entries(F.transform("_outcomes", lambda o: F.struct(o["name"], o["score"])))
    return (
        run.withColumn("scan_error", F.concat(lost, F.lit(" not available")))
        .withColumns({
            "sanitized": F.col(text),
            "is_valid": failed | F.forall("_outcomes", lambda o: F.coalesce(o["passed"], F.lit(True))),
            "scan_scores": F.when(failed, F.create_map().cast(SCORES)).otherwise(scores),
        })
        .drop("_outcomes")
    )


def check(df: DataFrame, scanners: Sequence[Scanner], *, text: str = "text") -> DataFrame:
    """Add only whether a text is safe and the scores."""
    return scan(df, scanners, text=text).drop("sanitized").withColumnRenamed("is_valid", "is_safe")


def with_defaults(requests: DataFrame) -> DataFrame:
    """Requests with every option present; missing columns and nulls take the default. The list of topics has none."""
    given = set(requests.columns)
    filled = {n: F.coalesce(F.col(n), F.lit(v)) if n in given else F.lit(v) for n, v in REQUEST_DEFAULTS.items()}
    topics = {} if TOPIC_LIST in given else {TOPIC_LIST: F.lit(None).cast("array<string>")}
    return requests.withColumns(filled | topics)


def validate_request(requests: DataFrame) -> DataFrame:
    """Add ``error``: null for a valid request. An empty prompt is valid, a missing one is not.

    A request read with its ``_corrupt_record`` is refused when that is given: the line is no JSON or
    a field has another type.
    """
    full = with_defaults(requests)
    checks = [F.when(F.col(CORRUPT).isNotNull(), "request cannot be read")] if CORRUPT in requests.columns else []
    checks += [F.when(F.col("prompt").isNull(), "prompt is missing"),
              F.when(~F.col("method").isin(GUARD, REWRITE), "method is unknown"),
              F.when(~F.col("prompt_injection_model").isin(*DETECTOR_CLASSES), "prompt_injection_model is unknown")]
    checks += [F.when(~F.col(n).between(lo, hi) | F.isnan(F.col(n).cast("double")), f"{n} is out of range")
               for n, (lo, hi) in RANGES.items()]
    return full.withColumn("error", F.coalesce(*checks))


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid requests, and the others with their error, and the line if it cannot be read, for a quarantine output."""
    checked = validate_request(requests)
    return checked.where("error is null").drop("error", CORRUPT), checked.where("error is not null")


def request_scanners(topics: Sequence[str] | dict[str, Sequence[str]] = (), *, text: str = "prompt",
                     toxicity: Column | None = None) -> list[Scanner]:
    """Scanners switched and limited by the columns of each request, scored by rules.

    Topics are those of the request's own list; ``topics`` are for requests without one. Where there
    are neither, topics are not scanned.
    """
    flags, listed = F.col("rule_flags"), F.col(TOPIC_LIST)
    worst = let(class_probabilities(rule_logits(flags), 3), lambda p: F.greatest(p[1], p[2]))
    has_own = F.coalesce(F.exists(listed, lambda t: F.trim(t) != ""), F.lit(False))
    common = topic_score(F.col(text), topics) if topics else F.lit(None).cast("double")
    asked = F.col("enable_banned_topics") if topics else F.col("enable_banned_topics") & has_own
    return [
        Scanner("PromptInjection", worst, INJECTION_LIMIT, F.col("enable_prompt_injection")),
        Scanner("Toxicity", toxicity if toxicity is not None else toxicity_score(flags),
                F.col("toxicity_threshold"), F.col("enable_toxicity")),
        Scanner("BanTopics", F.when(has_own, own_topic_score(F.col(text), listed)).otherwise(common),
                F.col("banned_topics_threshold"), asked),
    ]


def detect_requests(requests: DataFrame, asked: Column | bool = True) -> DataFrame:
    """Add ``detection`` by each request's own detector and threshold, for requests that want one."""
    wanted = F.col("use_prompt_injection_detection") & asked
    logits = F.when(wanted, rule_logits(F.col("rule_flags")))
    details = detection_details(logits, F.col("prompt_injection_model"), F.col("prompt_injection_threshold"))
    return requests.withColumn("detection", details)


def _answered(requests: DataFrame, topics, rewrite: Column | None, context_rewrite: Column | None, both: bool = False) -> DataFrame:
    """Requests with the answer of their method, or of both, in one row."""
    full = with_defaults(requests).withColumn("rule_flags", rule_flags(F.col("prompt")))
    guarded = F.lit(True) if both else F.col("method") == GUARD
    written = F.lit(True) if both else F.col("method") == REWRITE
    scanners = [s._replace(enabled=guarded & s.enabled) for s in request_scanners(topics)]
    scanned = scan(full, scanners, text="prompt").withColumnRenamed("sanitized", "scanned")
    plain = mask(F.col("prompt"), flags=F.col("rule_flags")) if rewrite is None else rewrite
    return sanitize(
        detect_requests(scanned, written), text="prompt", mode=F.col("block_mode"), rewrite=F.when(written, plain),
        context_rewrite=F.when(written & F.col("use_rag"), context_rewrite) if context_rewrite is not None else None,
    )


def _answer_columns(requests: DataFrame) -> list[Column]:
    by_rules = F.col("method") == GUARD
    return [
        *[F.col(c) for c in requests.columns if c != "method"],
        F.col("method"),
        F.when(by_rules, F.col("scanned")).otherwise(F.col("sanitized")).alias("sanitized_prompt"),
        F.when(by_rules, F.col("is_valid")).otherwise(~F.col("blocked")).alias("valid"),
        F.when(by_rules, F.col("scan_scores")).otherwise(F.create_map().cast(SCORES)).alias("scan_scores"),
        F.when(~by_rules, F.col("blocked")).alias("blocked"),
        F.when(by_rules, F.col("scan_error")).otherwise(F.when(F.col("use_prompt_injection_detection"), F.col("detection.error"))).alias("error"),
    ]


def scan_batch(requests: DataFrame, topics: Sequence[str] | dict[str, Sequence[str]] = (), *,
               rewrite: Column | None = None, context_rewrite: Column | None = None) -> DataFrame:
    """Answer valid scan requests: scanners or detect-and-rewrite, as the row's method says.

    Every option is the request's own: switches, limits, the list of topics, the detector. Stateless
    and free of shuffles, so it serves tables and streams alike. ``rewrite`` and ``context_rewrite``
    are the replies of the rewriter; the rule-based one is the default. Replies of a provider, and
    context from a collection, are the work of :func:`textshield.operators.requests.answer_requests`.
    """
    answered = _answered(requests, topics, rewrite, context_rewrite)
    return answered.select(*_answer_columns(requests))


def scan_all(requests: DataFrame, topics: Sequence[str] | dict[str, Sequence[str]] = (), **options) -> DataFrame:
    """The same for all requests in one pass: those that are refused come back with their error and no answer."""
    checked = validate_request(requests).withColumnRenamed("error", "_refused")
    answers = scan_batch(checked, topics, **options)
    refused = F.col("_refused").isNotNull()
    answer = {c: F.when(~refused, F.col(c)) for c in ("sanitized_prompt", "valid", "scan_scores", "blocked")}
    return answers.withColumns(answer | {"error": F.coalesce("_refused", "error")}).drop("_refused")


def compare_methods(requests: DataFrame, *, key: str, topics: Sequence[str] = ()) -> DataFrame:
    """Each prompt through both methods, side by side in one row, so nothing has to be joined."""
    return _answered(requests, topics, None, None, both=True).select(
        key,
        F.col("is_valid").alias("guard_valid"),
        F.col("scanned").alias("guard_prompt"),
        (~F.col("blocked")).alias("rewrite_valid"),
        F.col("sanitized").alias("rewrite_prompt"),
        F.col("is_valid").eqNullSafe(~F.col("blocked")).alias("agree"),
    )


def agreement(compared: DataFrame) -> DataFrame:
    return compared.groupBy("guard_valid", "rewrite_valid").agg(
        F.count("*").alias("n"), F.count_if(F.col("guard_prompt") != F.col("rewrite_prompt")).alias("n_rewritten")
    )
