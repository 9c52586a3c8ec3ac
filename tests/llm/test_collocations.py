"""Phrases against brute force, with nulls, copies, long texts, ties and clashing names."""

import random
import re
from collections import Counter, defaultdict

import pytest

from textshield.llm import collocations as module
from textshield.llm.collocations import collocations


def brute(rows, longest, support, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words))
    many = {key: v for key, v in f.items() if v >= support and len(key[1]) > 1}
    inside = {(lang, p[i : i + m]) for (lang, p), v in many.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * v >= 100 * f[lang, p[i : i + m]]}
    out = defaultdict(list)
    for (lang, p), a in many.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["a", "B", "cé", "d-e", "f\x1cg", "😀", "h", "the", "of"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ". ", ",", "\n", " ? "]) for _ in range(n))
    out = [(text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(80)]
    return out + [(out[0][0], "en")] * 6 + [(None, "en"), ("", None), ("one two three four five six seven " * 30, "xx"), (text(9000), "en"), ("word", "yy"), ("x y", "")]


@pytest.mark.parametrize("longest, support, top", [(5, 20, 2000), (5, 3, 7), (3, 10, 50), (2, 5, 50), (5, 1, 40)])
def test_against_brute_force(spark, rows, longest, support, top):
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, n int, W1 string").repartition(3)
    assert sorted(map(tuple, collocations(docs, longest=longest, support=support, top=top).collect())) == brute(rows, longest, support, top)


def test_few_buckets_lose_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(module, "TEXT_BYTES", 50)
    assert sorted(map(tuple, collocations(docs, support=6, top=99).collect())) == brute(rows, 5, 6, 99)


def test_scores_beyond_64_bits_are_exact(spark):
    known = [(5, 3, 10**11, 10**12, 10**11 + 1), (7, 2, 123456789012, 987654321012345, 234567890123)]
    frame = spark.createDataFrame(known, "i int, j int, a long, n long, l long").select(
        module._exact("a") * 1000 * module._exact("n"), module._exact("l") * module._exact("l")).toDF("p", "q").selectExpr("p div q AS s")
    assert sorted(r["s"] for r in frame.collect()) == sorted(1000 * a * n // (x * x) for *_, a, n, x in known)


def test_nothing_to_find(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string"), support=1).count() == 0
