"""From class scores to a decision about a prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textshield.fixed_values import DEFAULT_DETECTOR, DETECTION_THRESHOLD, DETECTOR_CLASSES, NO_DETECTOR
from textshield.functions.vectors import let


def class_probabilities(logits: Column, classes: int) -> Column:
    """Softmax over a known, small number of classes; a missing class scores 0."""
    weight = lambda i, top: F.coalesce(F.exp(F.get(logits, F.lit(i)).cast("double") - top), F.lit(0.0))
    weights = let(F.array_max(logits).cast("double"), lambda top: F.array(*[weight(i, top) for i in range(classes)]))
    total = lambda w: reduce(lambda a, b: a + b, [w[i] for i in range(classes)])
    return let(weights, lambda w: let(total(w), lambda n: F.array(*[w[i] / n for i in range(classes)])))


def _decide(probabilities: Column, classes: int, threshold: float | Column) -> Column:
    benign, injection, jailbreak = (
        F.coalesce(F.get(probabilities, F.lit(i)), F.lit(0.0)) if i < classes else F.lit(0.0) for i in range(3))
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    jailed = (jailbreak > injection) & (jailbreak > limit)
    injected = injection > limit
    return F.struct(
        (F.greatest(injection, jailbreak) > limit).alias("is_malicious"),
        F.when(jailed, jailbreak).when(injected, injection).otherwise(benign).alias("confidence"),
        F.when(jailed, "JAILBREAK").when(injected, "INJECTION").otherwise("BENIGN").alias("label"),
    )


def classify3(probabilities: Column, threshold: float | Column = DETECTION_THRESHOLD) -> Column:
    """``struct<is_malicious, confidence, label>`` from BENIGN, INJECTION, JAILBREAK probabilities.

    A class that is not scored counts 0. A score has to exceed the threshold, so a higher
    threshold lets more through; equal scores are an injection.
    """
    return let(probabilities, lambda p: _decide(p, 3, threshold))


def classify2(probabilities: Column, threshold: float | Column = DETECTION_THRESHOLD) -> Column:
    """The same decision from BENIGN and INJECTION probabilities."""
    return let(probabilities, lambda p: _decide(p, 2, threshold))


def detection_details(
    logits: Column, model: str | Column = DEFAULT_DETECTOR, threshold: float | Column = DETECTION_THRESHOLD
) -> Column:
    """Details of a detection; missing logits mean the detector was not available and the text passes.

    The detector decides how many classes count. With a column of detectors each row has its own; one
    that is not known is not available. An unknown name given for all rows is an error.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    decided = lambda classes: let(class_probabilities(logits, classes), lambda p: _decide(p, classes, limit))
    if isinstance(model, Column):
        named = {n: [m for m, c in DETECTOR_CLASSES.items() if c == n] for n in sorted(set(DETECTOR_CLASSES.values()))}
        found = reduce(lambda rest, n: F.when(model.isin(*named[n]), decided(n)).otherwise(rest), named, F.lit(None))
    elif model in DETECTOR_CLASSES:
        found = decided(DETECTOR_CLASSES[model])
    else:
        raise ValueError(f"unknown detector {model!r}, known are {sorted(DETECTOR_CLASSES)}")

    def details(decision: Column) -> Column:
        scored = decision["label"].isNotNull()
        return F.struct(
            F.coalesce(~decision["is_malicious"], F.lit(True)).alias("is_safe"),
            F.coalesce(decision["is_malicious"], F.lit(False)).alias("is_malicious"),
            F.coalesce(decision["confidence"], F.lit(0.0)).alias("confidence"),
            F.coalesce(decision["label"], F.lit("BENIGN")).alias("label"),
            limit.alias("threshold"),
            F.when(scored, model if isinstance(model, Column) else F.lit(model)).otherwise("none").alias("model"),
            F.when(~scored, F.lit(NO_DETECTOR)).alias("error"),
        )

    return let(F.when(logits.isNotNull(), found), details)
