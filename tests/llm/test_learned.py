"""What operators learn, against brute force or held-out rows of the given tables."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textshield.llm import quality, sentencepiece_codec, toxicity


def test_log_ratios_and_verdicts_against_brute_force(spark):
    """Counts, ratios, scores and verdicts in plain Python; only the bucket of an n-gram comes from Spark."""
    rows = [(i, " ".join(["The", "cat", "sat", f"w{i % 7}", "on", "mats", "today", "ÉTÉ", "again", f"v{i % 3}", "and", "slept"]) if i % 3 else
             "buy cheap pills now $$$ click here win big money fast today again " + f"x{i}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "too short"), (103, "a b c d e " * 6), (None, "no key has this text but it is long enough to be judged once"), (1, rows[1][1])]
    trusted = [1, 2, 4, 100, 1]
    buckets = 997
    words = {text: re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows}
    vocabulary = sorted({w for ws in words.values() for w in ws})
    frame = spark.createDataFrame([(w, w2) for ws in words.values() for w, w2 in zip(ws, [*ws[1:], None])] or [("", None)], "w string, x string").distinct()
    hashed = lambda c: F.xxhash64(F.lower(c))
    second = F.when(F.col("x").isNull(), F.lit(0).cast("long")).otherwise(hashed("x"))
    found = frame.select("w", "x", F.pmod(hashed("w"), F.lit(buckets)).alias("one"), F.pmod(F.xxhash64(hashed("w"), second), F.lit(buckets)).alias("two")).collect()
    one, two = {r["w"]: r["one"] for r in found}, {(r["w"], r["x"]): r["two"] for r in found}
    assert len(one) == len(vocabulary)

    def grams(text):
        ws = words[text]
        return [one[w] for w in ws] + [two[pair] for pair in zip(ws, [*ws[1:], None])]

    raw = Counter(b for _, text in rows for b in grams(text))
    good = Counter(b for key, text in rows if key in trusted for b in grams(text))
    r, g = sum(raw.values()), sum(good.values())
    ratio = [math.log((good[b] + 1) / (g + buckets)) - math.log((raw[b] + 1) / (r + buckets)) for b in range(buckets)]
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, score int").repartition(3)
    keys = spark.createDataFrame([(k,) for k in trusted] + [(None,)], "doc_id long")
    weights = quality.log_ratios(docs, keys, buckets=buckets).first()["weights"]
    assert weights == pytest.approx(ratio, abs=1e-12)
    verdicts = set()
    for threshold in (-0.3, -0.1, 0.0, 0.1):
        judged = quality.quality(docs, keys, threshold=threshold, buckets=buckets).collect()
        got = sorted(((r["doc_id"], r["n_words"], round(r["score"], 9) + 0.0, r["base_failed"], r["kept"]) for r in judged), key=str)
        want = []
        for key, text in rows:
            b = grams(text)
            score = sum(ratio[x] for x in b) / len(b) if b else 0.0
            failed = len(words[text]) < 10 or text == rows[63][1]
            want.append((key, len(words[text]), round(score, 9) + 0.0, failed, not failed and score >= threshold))
        assert got == sorted(want, key=str)
        verdicts |= {(threshold, x[4]) for x in got}
    assert {(-0.1, True), (-0.1, False), (0.1, False)} <= verdicts


def test_toxicity_on_held_out_labels(spark):
    """About 290 toxic labels to learn from at sf0.1, less than a third of what the larger tables have."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = toxicity.toxicity(docs, labels, held).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = Counter((r[0], r[1]) for r in rows)
    assert hits[1, 1] >= 0.75 * (hits[1, 1] + hits[0, 1]) and hits[1, 0] <= 0.01 * len(rows)


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_codec.read_vocabulary(sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))


def test_encode_and_decode_are_inverse(spark, vocabulary):
    import sentencepiece

    texts = ["Hello world", " leading and  double ", "ünï çödé 漢字 😀", "", None, "\x00\x01 tabs\tand\nlines", "a" * 5000, "<s> </s> <0x41>", "😀" * 300]
    docs = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, DECODED string, ids array<int>").repartition(2)
    encoded = sentencepiece_codec.encode(docs, vocabulary)
    assert encoded.columns == ["doc_id", "text", "DECODED", "ids"]
    back = sentencepiece_codec.decode(encoded.drop("DECODED"), vocabulary)
    rows = {r["doc_id"]: r for r in back.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.tokenizer_path("piece_bpe_32k.model"))
    for i, text in enumerate(texts):
        assert rows[i]["decoded"] == (text or "")
        assert (rows[i]["ids"] == []) == (not text)
        # the library reads the ids alike
        assert library.decode(rows[i]["ids"]) == (text or "")


def test_decode_refuses_and_repairs(spark, vocabulary):
    byte = vocabulary.bytes_from
    frame = spark.createDataFrame([(1, [byte + 0xC3]), (2, [byte + 0xC3, byte + 0xA9]), (3, []), (4, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in sentencepiece_codec.decode(frame, vocabulary).collect()} == {1: "�", 2: "é", 3: "", 4: ""}
    wrong = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        sentencepiece_codec.decode(wrong, vocabulary).collect()
