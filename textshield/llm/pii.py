"""Personal data by patterns, and terms that reveal it by corpus co-occurrence, with DataFrame functions only.

The values that patterns find are the protected entities. A term that stands in the documents of
one entity much more often than the corpus lets expect discloses it: their pointwise mutual
information is then close to the information of the entity itself. Terms over the disclosure
thresholds are generalised or removed wherever they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from textshield.session import write_once

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns. Guards and possessive repetition keep them linear and find the same matches:
#: a run is entered at its start or where the match before has ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without this have no match of a kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"(?:[0-9][\x20-]?){14}", "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"
#: The chance up to which a term is no accident in an entity's documents, and shares of the entity's information.
CHANCE, GENERALISE, REMOVE = 0.01, 0.9, 0.97
BROADCAST_TERMS = 1 << 20
BROADCAST_SETS = 1 << 18
#: Matches that are placed together.
BLOCK = 256
SPAN = "array<struct<start:int,stop:int,kind:int,match:string>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def spans_of(text: Column, pattern: Column, kind: Column) -> Column:
    """Start, end, kind and text of all matches of a pattern, from left to right, in code points.

    Adding to an array copies it, so matches are placed in blocks, whose starts are added up first; the
    work grows with the number of matches, not with its square.
    """
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    # the last part has no match; a lambda would split the text again for every match
    pairs = F.filter(F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), b.alias("b"))), lambda x: x["m"].isNotNull())
    size = lambda x: F.length(x["b"]) + F.length(x["m"])

    def step(a: Column, x: Column) -> Column:
        low = a["at"] + F.length(x["b"])
        high = low + F.length(x["m"])
        one = F.struct(low.alias("start"), high.alias("stop"), kind.alias("kind"), x["m"].alias("match"))
        return F.struct(high.alias("at"), F.concat(a["found"], F.array(one)).alias("found"))

    def cut(all_pairs: Column) -> Column:
        last = F.floor(F.greatest(F.size(all_pairs) - 1, F.lit(0)) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_pairs, k * BLOCK + 1, F.lit(BLOCK)))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + size(x)))
        starts = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        first = lambda at, i: F.struct(at[i].alias("at"), F.array().cast(SPAN).alias("found"))
        return _let(starts, lambda at: F.flatten(F.transform(blocks, lambda block, i: F.aggregate(block, first(at, i), step, lambda a: a["found"]))))

    return _let(pairs, lambda p: _let(cut(p), placed))


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _passes(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})){3}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _test(kind: str):
    return lambda s: _passes(kind, s["match"])


def base_spans(text: Column) -> Column:
    """All base matches of a text, by start and kind."""
    found = []
    for number, kind in enumerate(KINDS):
        every = spans_of(text, F.lit(PATTERNS[kind]), F.lit(number))
        some = F.filter(every, _test(kind))
        hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
        found.append(F.when(hint, some).otherwise(F.array().cast(SPAN)))
    has = text.rlike("[0-9@]")
    return F.when(has, F.array_sort(F.concat(*found), _by_start)).otherwise(F.array().cast(SPAN))


def _by_start(a: Column, b: Column) -> Column:
    x, y = (F.struct(s["start"], s["kind"], s["stop"]) for s in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def shown(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    name = lambda s: F.when(s["kind"] < len(KINDS), F.get(F.array(*map(F.lit, KINDS)), s["kind"])).otherwise(F.lit("term"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w))


def outside(text: Column) -> Column:
    """The text without e-mail addresses, the only values that have letters."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def entities_of(spans: Column) -> Column:
    """The different values of base spans."""
    value = lambda s: F.when(s["kind"].isin(2, 3), digits(s["match"])).otherwise(F.lower(s["match"]))
    return F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"].cast("string"), value(s))))


def disclosures(rows: DataFrame, chance: float = CHANCE, generalise: float = GENERALISE) -> DataFrame:
    """``term, share``: the largest share of an entity's information that a term discloses.

    From ``text`` and base ``spans`` of all documents. Every term of a document is scored with every
    entity of it. Of all places of terms in the corpus, an entity has those of its documents; the
    share is PMI(entity; term) over the information of the entity, -log2 p(entity). The guard against
    accidents is Chernoff's bound for so many places of the term, dealt out at random, to fall into
    the entity's documents: it must not exceed ``chance``. Neither needs an entity to occur twice.
    """
    told = rows.withColumn("told", terms_of(outside(F.col("text"))))
    counts = write_once(told.select(F.explode("told").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    total = float(counts.agg(F.sum("n_term")).first()[0] or 0)
    ids = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]
    valued = told.filter(F.size("spans") > 0)
    held = valued.select(*ids, F.size("told").alias("size"), F.explode(entities_of(F.col("spans"))).alias("entity"))
    held = write_once(held.groupBy("entity", "t1", "t2").agg(F.sum("size").alias("size")), "entities")
    # entities of the same documents disclose alike, so a list of values costs no more than one
    sets = write_once(held.groupBy("entity").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"), F.sum("size").alias("places")), "sets")
    sets = F.broadcast(sets) if sets.count() <= BROADCAST_SETS else sets
    groups = write_once(held.join(sets, "entity").select("t1", "t2", "s1", "s2", "places").distinct(), "groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_SETS else groups
    terms = valued.select(*ids, F.explode("told").alias("term")).groupBy("t1", "t2", "term").agg(F.count("*").alias("n"))
    both = terms.join(groups, ["t1", "t2"]).groupBy("s1", "s2", "places", "term").agg(F.sum("n").alias("n_both"))
    known = both.join(counts, "term")
    rest, elsewhere = F.col("n_term") - F.col("n_both"), F.greatest(F.lit(total) - F.col("places"), F.lit(1.0))
    share = 1 - F.log2(F.col("n_term") / F.col("n_both")) / F.greatest(F.log2(F.lit(total) / F.col("places")), F.lit(1e-9))
    surprise = F.col("n_both") * F.log(F.col("n_both") * total / (F.col("n_term") * F.col("places"))) + F.when(
        rest > 0, rest * F.log(rest * total / (F.col("n_term") * elsewhere))).otherwise(0.0)
    known = known.filter((F.col("n_both") * total > F.col("n_term") * F.col("places")) & (surprise >= -math.log(chance)))
    return known.select("term", share.alias("share")).groupBy("term").agg(F.max("share").alias("share")).filter(F.col("share") >= generalise)


def private_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", chance: float = CHANCE, generalise: float = GENERALISE) -> DataFrame:
    """``key, text``, base ``spans``, ``term_spans`` and ``shares`` of the terms of every row; see ``private_data``."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("r1"), F.xxhash64(text, key).alias("r2"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    terms = write_once(disclosures(rows, chance, generalise), "disclosures")
    count = terms.count()
    words = rows.select("r1", "r2", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    hits = words.join(F.broadcast(terms) if count <= BROADCAST_TERMS else terms, "term")
    hits = hits.groupBy("r1", "r2").agg(F.collect_set(F.struct("term", "share")).alias("terms"))
    out = rows.join(hits, ["r1", "r2"], "left") if count else rows.withColumn("terms", F.lit(None).cast("array<struct<term:string,share:double>>"))
    # of terms that start alike the regular expression would take the first, so whole terms are asked for
    pattern = F.concat(F.lit(r"(?<!\p{L})(?iu:"), F.array_join(F.transform("terms", lambda t: t["term"]), "|"), F.lit(r")(?!\p{L})"))
    found = F.when(F.col("terms").isNotNull(), spans_of(F.col("text"), pattern, F.lit(len(KINDS)))).otherwise(F.array().cast(SPAN))
    return out.withColumn("term_spans", found)


def private_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: ``key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term``.

    Base matches of a kind are leftmost and do not overlap; those that fail the kind's test are
    dropped. Positions are code points, ends exclusive. ``spans`` has base matches and terms by
    start and kind, terms last; spans of different kinds may overlap. Null and empty texts have no
    match. Repeated rows count as often as they occur and get equal results, a null key stays null,
    extra columns are ignored, an empty table gives an empty result.
    """
    rows = private_spans(docs, key, text, **options)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.array_sort(F.concat("spans", "term_spans"), _by_start)
    return rows.select(
        F.col("key").alias(key), *map(count, range(len(KINDS))), F.sha2(shown(F.col("spans")), 256).alias("base_sha256"),
        F.when(F.size("term_spans") > 0, shown(every)).otherwise(shown(F.col("spans"))).alias("spans"), F.size("term_spans").cast("long").alias("n_term"),
    )


def sanitised(docs: DataFrame, key: str = "doc_id", text: str = "text", remove: float = REMOVE, **options) -> DataFrame:
    """``key`` and ``text`` with base matches replaced by their kind, terms by ``[TERM]`` or nothing.

    Terms whose share reaches ``remove`` are removed, other terms generalised. Of overlapping spans
    the first, then the first kind, is replaced.
    """
    rows = private_spans(docs, key, text, **options)
    every = F.array_sort(F.concat("spans", "term_spans"), _by_start)
    gone = F.coalesce(F.transform(F.filter("terms", lambda t: t["share"] >= remove), lambda t: t["term"]), F.array().cast("array<string>"))
    name = lambda s: F.when(s["kind"] < len(KINDS), F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"])).when(
        F.array_contains(gone, F.lower(s["match"])), F.lit("")).otherwise(F.lit("[TERM]"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        put = F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), name(s))
        return F.when(s["start"] >= a["at"], F.struct(s["stop"].alias("at"), put.alias("out"))).otherwise(a)

    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    return rows.select(F.col("key").alias(key), F.aggregate(every, start, step, rest).alias("text"))
