"""Removing repeated passages by overlapping windows of three lines, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 3
#: A line with anything but white space.
SOLID = r"[^\x20\x09-\x0D]"


def line_windows(lines: Column, window: int = WINDOW) -> Column:
    """Array of ``start, stop, w1, w2`` for consecutive lines that are not blank; ``stop`` is the last line."""
    solid = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(SOLID), F.struct(i.alias("i"), F.xxhash64(x).alias("h")))), lambda x: x.isNotNull())

    def windows(s: Column) -> Column:
        def one(j: Column) -> Column:
            part = [s[j + k]["h"] for k in range(window)]
            return F.struct(s[j]["i"].alias("start"), s[j + (window - 1)]["i"].alias("stop"),
                            F.xxhash64(*part).alias("w1"), F.xxhash64(F.lit(window), *reversed(part)).alias("w2"))

        return F.when(F.size(s) >= window, F.transform(F.sequence(F.lit(0), F.size(s) - window), one))

    # the array is looked at many times, so it is made once
    return F.transform(F.array(solid), windows)[0]


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    full = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumns({"_r1": F.xxhash64(key, text), "_r2": F.xxhash64(text, key), "_lines": F.split(full, "\n", -1)})


def later_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``_r1, _r2, start, stop`` of every window that is not the first of its kind in the corpus."""
    rows = _identified(docs.select(key, text), key, text).select(F.col(key).alias("key"), "_r1", "_r2", F.explode(line_windows(F.col("_lines"), window)).alias("w"))
    rows = rows.select(F.col("key").isNull().alias("none"), "key", "_r1", "_r2", "w.*")
    place = F.struct("none", "key", "_r1", "_r2", "start")
    first = rows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = (F.col("first._r1") == F.col("_r1")) & (F.col("first._r2") == F.col("_r2")) & (F.col("first.start") == F.col("start"))
    return rows.join(first, ["w1", "w2"]).filter(~same).select("_r1", "_r2", "start", "stop")


def remove_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns with the cut ``text``, and ``n_lines`` and ``n_removed``.

    Lines end at ``\\n`` and are compared whole; blank lines take no part in windows, but go with a
    window they lie in. Of a window that occurs more than once in the corpus the first occurrence
    stays, by key (null last), hash of the text and line; all later ones go, also if they overlap
    the first. What covered lines leave is joined again by ``\\n``. Texts with fewer lines than a
    window, null and empty ones stay as they are. Rows equal in key and text are one occurrence and
    get equal results; an empty table gives an empty result. Columns named ``n_lines`` or
    ``n_removed``, in any case, are replaced; all others keep their values, whatever their names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    cuts = later_windows(docs, key, text, window).groupBy("_r1", "_r2").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_cuts"))
    # the row goes along as one column, so its names meet no other ones
    packed = docs.select(F.struct(*kept).alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = _identified(packed, "_key", "_text").join(cuts, ["_r1", "_r2"], "left")
    n, cut = F.size("_lines"), F.col("_cuts")
    # starts and stops of windows rise together, so a span ends where the next start lies beyond
    begins = F.filter(cut, lambda x, i: (i == 0) | (x["start"] > F.get(cut, i - 1)["stop"] + 1))
    ends = F.filter(cut, lambda x, i: F.coalesce(F.get(cut, i + 1)["start"] > x["stop"] + 1, F.lit(True)))
    marked = marked.withColumn("_spans", F.zip_with(begins, ends, lambda b, e: F.struct(b["start"].alias("start"), e["stop"].alias("stop"))))
    spans = F.col("_spans")

    def between(i: Column) -> Column:
        low = F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["stop"] + 1)
        high = F.when(i == F.size(spans), n).otherwise(F.get(spans, i)["start"])
        return F.slice("_lines", low + 1, high - low)

    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans)), between)), "\n")
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"] + 1)
    return marked.select(
        *[F.when(spans.isNull(), F.col("_row")[c]).otherwise(rest).alias(c) if c.lower() == text.lower() else F.col("_row")[c].alias(c) for c in kept],
        n.cast("long").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )
