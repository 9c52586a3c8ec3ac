"""Quality rules and a log-likelihood ratio of hashed n-grams, with DataFrame functions only.

Unigrams and bigrams of words are hashed to buckets. The trusted documents give the target multinomial,
all documents give the raw one, and a document's score is the mean log ratio of its n-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SOLID = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
REPEAT = 5
BUCKETS = 10_000
#: Trusted keys that may be broadcast.
BROADCAST_KEYS = 1 << 20
THRESHOLD = -0.1


def words_of(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeat_words(hashes: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more, from the words' hashes."""
    window = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - REPEAT), lambda i: F.xxhash64(*[h[i + k] for k in range(REPEAT)]))

    def covered(w: Column) -> Column:
        ordered = F.transform(F.array(F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))), lambda s: F.transform(
            F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))), lambda x: x["i"]))[0]
        width = F.transform(F.array(F.array_sort(ordered)), lambda p: F.aggregate(
            F.transform(p, lambda x, j: F.least(F.lit(REPEAT), F.coalesce(F.get(p, j + 1) - x, F.lit(REPEAT)))), F.lit(0), lambda a, x: a + x))
        return width[0]

    many = F.transform(F.array(window(hashes)), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))[0]
    return F.when(F.size(hashes) > REPEAT, many).otherwise(0).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``_words, _hashes`` and the counts of the base rules."""
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("_text", full).withColumn("_words", words_of(F.col("_text")))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    solid = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(SOLID))
    duplicates = F.transform(F.array(solid), lambda s: F.size(s) - F.size(F.array_distinct(s)))[0]
    return out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": duplicates.cast("long"),
        "n_repeat_words": repeat_words(F.col("_hashes")),
    })


def ngram_buckets(words: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all unigrams and bigrams of lower-cased words; every word is also a pair with the next."""
    lower = F.transform(words, lambda w: F.xxhash64(F.lower(w)))
    pairs = lambda h: F.transform(h, lambda x, i: F.pmod(F.xxhash64(x, F.coalesce(F.get(h, i + 1), F.lit(0).cast("long"))), F.lit(buckets)).cast("int"))
    single = lambda h: F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
    return F.transform(F.array(lower), lambda h: F.concat(single(h), pairs(h)))[0]


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row with ``weights``: per bucket the log of its share in trusted documents over that in all.

    ``trusted`` has the keys of trusted documents, all of which count; the raw counts cover every
    document. One is added to each count.
    """
    keys = trusted.select(F.col(key).alias("_key")).filter(F.col("_key").isNotNull()).distinct().withColumn("_good", F.lit(1))
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    marked = docs.select(F.col(key).alias("_key"), text).join(F.broadcast(keys) if few else keys, "_key", "left")
    words = words_of(F.coalesce(F.col(text).cast("string"), F.lit("")))
    grams = marked.select(F.col("_good"), F.explode(ngram_buckets(words, buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_good").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    every = every.select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    rows = every.agg(F.array_sort(F.collect_list(F.struct("bucket", "raw", "good"))).alias("b"), F.sum("raw").alias("r"), F.sum("good").alias("g"))
    # without a trusted n-gram nothing is known and all ratios are 0
    ratio = lambda x: F.when(F.col("g") == 0, 0.0).otherwise(F.log((x["good"] + 1) / (F.col("g") + buckets)) - F.log((x["raw"] + 1) / (F.col("r") + buckets)))
    return rows.select(F.transform("b", ratio).alias("weights"))


def quality(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Per row: ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``.

    ``kept`` is false if the base rules fail (fewer than 10 words, or more than a fifth of the words
    in repeated windows), else whether the mean log ratio of the n-grams reaches ``threshold``. Null
    and empty texts have no words and fail. Rows are judged on their own, so repeated rows get equal
    results; a null key stays null and is never trusted; extra columns are ignored; an empty table
    gives an empty result. Windows are compared by 64-bit hashes within one text.
    """
    # the weights are as many numbers as there are buckets, whatever the corpus
    learned = log_ratios(docs, trusted, key, text, buckets).first()["weights"]
    weights = F.split(F.lit(",".join(map(repr, learned))), ",").cast("array<double>")
    rows = measured(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    total = F.aggregate(ngram_buckets(F.col("_words"), buckets), F.lit(0.0), lambda a, b: a + F.get(weights, b))
    rows = rows.withColumn("score", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words"))).otherwise(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "score",
        (~failed & (F.col("score") >= threshold)).alias("kept"),
    )
