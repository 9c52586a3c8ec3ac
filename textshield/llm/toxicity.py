"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

A bounded sample of labelled rows is cut into three parts by hash: the first gives the lexicon, the
second trains the trees, the third calibrates them. All texts are then measured and scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from textshield.llm.blocks import batches, flags, text_bytes
from textshield.llm.shipping import ship
from textshield.session import write_once

#: Labelled rows that are learned from, those with the smallest hashes of their keys.
SAMPLE = 16_000
TERMS, SUPPORT, ODDS = 2_000, 4, 25.0
PREFIXES = (4, 5, 6)
TREES, DEPTH, RATE = 12, 3, 0.3
TOXIC = 0.7
TEXT_BYTES = 1 << 20
NEAR, LOCAL = 4, 50
CACHE = 1 << 20
#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus vosotros usted ustedes".split())
FEATURES = ["density", "hits", "kinds", "local", "addressed", "second_person", "capitals", "shouted", "exclaimed", "punctuated", "obfuscated", "stretched"]

_words = re.compile(r"[^\W_]+").findall
_obscured = re.compile(rb"[A-Za-z][@$!*#0-9]+[A-Za-z]").findall
CAPITAL, LETTER = flags((0x41, 0x5A)), flags((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOUD, POINT = flags((0x21, 0x21), (0x3F, 0x3F)), flags((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def word_terms(word: str) -> set[str]:
    """The word and its beginnings, which tell inflected forms."""
    return {word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)}


class Measure:
    """Dense features of texts; words that have been met are remembered up to a bound."""

    def __init__(self, lexicon: set[str]):
        self.lexicon, self.known = lexicon, {}

    def code(self, word: str) -> int:
        code = self.known.get(word)
        if code is None:
            code = int(not self.lexicon.isdisjoint(word_terms(word))) + 2 * (word in SECOND_PERSON)
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = code
        return code

    def words(self, text: str) -> list[float]:
        words = _words(text.lower())
        codes = list(map(self.known.get, words))
        if None in codes:
            codes = list(map(self.code, words))
        n = max(1, len(codes))
        codes = np.array(codes, np.int8)
        hits, you = np.flatnonzero(codes & 1), np.flatnonzero(codes & 2)
        local = addressed = 0
        if len(hits):
            local = int((np.searchsorted(hits, hits + LOCAL) - np.arange(len(hits))).max())
            addressed = int((np.searchsorted(you, hits + NEAR, "right") > np.searchsorted(you, hits - NEAR)).sum())
        kinds = len({words[i] for i in hits.tolist()})
        return [100 * len(hits) / n, np.log1p(len(hits)), np.log1p(kinds), local, 100 * addressed / n, 100 * len(you) / n]

    def measure(self, column: pa.Array) -> np.ndarray:
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        letter, capital = LETTER[data], CAPITAL[data]
        run = np.zeros((2, len(data)), bool)
        if len(data) > 2:
            run[0, 2:] = capital[2:] & capital[1:-1] & capital[:-2]
            run[1, 2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 0x80)
        size, letters = np.maximum(1, np.diff(offsets)), np.maximum(1, share(letter))
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        obscured = np.array([len(_obscured(t)) for t in texts], float)
        told = np.array([self.words(t.decode()) for t in texts]).reshape(-1, 6)
        rates = [share(capital) / letters, share(run[0]) / letters, share(LOUD[data]) / size, share(POINT[data]) / size, obscured / size, share(run[1]) / letters]
        return np.column_stack([told, *(100.0 * r for r in rates)])


def _measured(load):
    def measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(load())
        for batch in batches(stream, "text", TEXT_BYTES):
            values = measure.measure(batch.column(batch.schema.get_field_index("text")))
            edges = pa.array(np.arange(len(values) + 1, dtype=np.int32) * len(FEATURES))
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(edges, pa.array(values.reshape(-1)))], [*names, "measured"])

    return measured


def features(docs: DataFrame, lexicon: set[str], text: str = "text") -> DataFrame:
    """All columns but the text, and ``measured``, the dense features of the whole text."""
    rows = docs.withColumn("text", F.col(text).cast("string"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(_measured(ship(docs.sparkSession, lexicon)), fields + ", measured array<double>")


def _terms(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = set().union(*map(word_terms, set(_words((text or "").lower()))))
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(terms), pa.int32()), pa.array(list(terms), pa.string())], ["label", "term"])


def learn_lexicon(sample: DataFrame) -> set[str]:
    """At most ``TERMS`` words and beginnings that toxic texts of ``label, text`` have far more often than others."""
    # copies of a whole text count as one
    texts = sample.select("label", "text").distinct()
    toxic, clean = F.sum("label"), F.sum(1 - F.col("label"))
    n = texts.agg(toxic.alias("t"), clean.alias("c")).first()
    if not n["t"] or not n["c"]:
        return set()
    found = texts.mapInArrow(_terms, "label int, term string").groupBy("term").agg(toxic.alias("t"), clean.alias("c"))
    odds = ((F.col("t") + 0.5) / (n["t"] + 1)) / ((F.col("c") + 0.5) / (n["c"] + 1))
    best = found.filter(F.col("t") >= SUPPORT).withColumn("odds", odds).filter(F.col("odds") >= ODDS)
    return {r["term"] for r in best.orderBy(F.desc("odds"), "term").limit(TERMS).collect()}


class ToxicityModel:
    """Lexicon, trees and calibration; ``trees`` is None if the labels have one class only."""

    def __init__(self, lexicon: set[str], trees, calibration):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """All columns but the text, and ``score``."""
        if self.trees is None:
            return docs.drop(text).withColumn("score", F.lit(0.0))
        return self.calibration.transform(_boosted(self.trees, features(docs, self.lexicon, text))).drop("measured", "features", "rawPrediction", "probability", "prediction", "raw")


def _boosted(trees, rows: DataFrame) -> DataFrame:
    out = trees.transform(rows.withColumn("features", array_to_vector("measured")))
    return out.withColumn("raw", F.get(vector_to_array("probability"), F.lit(1))).drop("prediction")


def learn(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, key: str = "doc_id", text: str = "text",
          label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learn from at most ``sample`` labelled rows for which ``held_out``, a condition on the key, is not true."""
    known = labels.select(F.col(key), F.col(label).cast("int").alias("label")).filter(F.col(key).isNotNull() & F.col("label").isin(0, 1))
    if held_out is not None:
        known = known.filter(~F.coalesce(held_out, F.lit(False)))
    known = known.groupBy(key).agg(F.max("label").alias("label")).orderBy(F.xxhash64(key), key).limit(sample)
    part = F.pmod(F.xxhash64(F.col(key), F.lit("part")), F.lit(20))
    rows = docs.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(known), key)
    rows = write_once(rows.select("label", "text", part.alias("part")), "labelled")
    lexicon = learn_lexicon(rows.filter("part < 10"))
    seen = write_once(features(rows.filter("part >= 10"), lexicon), "measured").withColumn("label", F.col("label").cast("double"))
    train, rest = seen.filter("part < 16").coalesce(4), seen.filter("part >= 16").coalesce(4)
    if any(s.select("label").distinct().count() < 2 for s in (train, rest)):
        return ToxicityModel(lexicon, None, None)
    learner = GBTClassifier(labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=7)
    trees = learner.fit(train.withColumn("features", array_to_vector("measured")))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(_boosted(trees, rest))
    return ToxicityModel(lexicon, trees, calibration)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key, held_out, score, predicted``.

    ``held_out`` is a condition on the key; only labels of other rows are learned from, and no
    column but the text is an input of the score. A null or empty text is scored like a text without
    words. Labels that are null or neither 0 nor 1 are ignored; of several labels of a key 1 counts.
    If the labels have one class only, or none, all scores are 0. Repeated rows get equal scores, a
    null key stays null and is never learned from, extra columns are ignored, an empty table gives an
    empty result.
    """
    model = learn(docs, labels, held_out, key, text)
    rows = docs.select(F.col(key), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return model.score(rows).select(key, "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = TOXIC) -> DataFrame:
    """The documents, all columns, whose score is below ``threshold``.

    Null and empty texts are scored like texts without words, repeated rows alike; columns keep their
    values whatever their names; an empty table gives an empty result.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).cast("string").alias("text"))
    return model.score(packed).filter(F.col("score") < threshold).select("row.*")
