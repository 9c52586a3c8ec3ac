"""The corpus operators against brute force, on small tables with nulls, copies and clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textshield.llm import decontaminate, katz, line_dedup, minhash, pii, quality, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from textshield.llm.pieces import MARKER, Encoder
from textshield.llm.suffixes import sampled
from textshield.session import write_once

WORD = r"[^\x20\x09-\x0D]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    """Random texts with copies, near copies, shared passages, junk, nulls and a long one."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    line = lambda n=12: " ".join(rng.choice(words) for _ in range(n))
    shared = "\n".join(line() for _ in range(9))
    out = [line(rng.randint(1, 90)).replace(" ", "\n", 3) for _ in range(60)]
    base = line(120)
    for i in range(12):
        changed = base.split()
        changed[(7 * i) % 120] = f"x{i}"
        out.append(" ".join(changed))
    out += [f"{line()}\n{shared}\n\n{line()}" for _ in range(6)] + [out[3]] * 5 + ["", None, " \t\n", "A", "a a a a a a a a a a a a a", line(5000)]
    out += ["Mail A.b@c-d.org or +1 (456) 555-2186, 4111 1111 1111 1111, 10.0.0.256 and 10.0.0.25 😀 x@y.com_z@w.org", "<|endoftext|>hi  there ▁ \x1c😀"]
    return list(enumerate(out)) + [(None, "no key\nat\nall\nhere"), (7, out[7])]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With extra columns named like results and helpers."""
    rows = [(d, t, "x", 1, "y") for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, n_removed string, score int, kept string").repartition(3)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    path = sentencepiece_codec.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, encoding="utf8") as file:
        got = collected(token_counts.count_tokens(docs, file.read(), limit=50))
    number = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in texts]
    assert got == sorted(((d, len((t or "").encode()), n, n > 50) for (d, t), n in zip(texts, number)), key=str)


def test_sentencepiece(docs, texts):
    import sentencepiece

    path = sentencepiece_codec.tokenizer_path("piece_bpe_32k.model")
    vocabulary = sentencepiece_codec.read_vocabulary(path)
    pieces = {vocabulary.text[i].decode(): i for i in np.flatnonzero(np.isfinite(vocabulary.score))}
    library = sentencepiece.SentencePieceProcessor(model_file=path)

    def viterbi(text):
        n, best, back = len(text), [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
        for i in range(n):
            ends = [(j, vocabulary.score[pieces[text[i:j]]], [pieces[text[i:j]]]) for j in range(i + 1, min(n, i + 16) + 1) if text[i:j] in pieces]
            if text[i] not in pieces:
                ends.append((i + 1, vocabulary.unknown, [vocabulary.bytes_from + b for b in text[i].encode()]))
            for j, gain, ids in ends:
                if best[i] + gain > best[j]:
                    best[j], back[j] = best[i] + gain, (i, ids)
        out = []
        while n:
            n, ids = back[n]
            out = ids + out
        return out

    encoder = Encoder(vocabulary)
    for _, text in texts[:90]:
        ids, _ = encoder.encode([text or ""])
        assert ids.tolist() == (viterbi(" " + text.replace(MARKER, " ")) if text else [])
        assert library.decode(ids.tolist()) == (text or "").replace(MARKER, " ")
    rows = sentencepiece_codec.encode_and_check(docs, path)
    assert rows.count() == len(texts) and rows.filter("NOT round_trip").count() == 0


def test_minhash(docs, texts):
    sets = []
    for _, text in texts:
        w = re.findall(WORD, low(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        least[find(i)].append(d)
    top = [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(texts))]
    expected = sorted(((d, len(sets[i]), top[i], d == top[i]) for i, (d, _) in enumerate(texts)), key=str)
    found = minhash.near_duplicates(docs)
    assert collected(found.select("doc_id", "n_shingles", "component_id", "kept")) == expected
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len({find(i) for i in range(len(sets))})


def test_minhash_blocks_of_large_groups(docs, monkeypatch):
    whole = collected(minhash.near_duplicates(docs).select("doc_id", "component_id"))
    monkeypatch.setattr(minhash, "TASK_WEIGHT", 9000)
    assert collected(minhash.near_duplicates(docs).select("doc_id", "component_id")) == whole


@pytest.mark.parametrize("contexts", [1 << 13, 3])
def test_suffix_dedup(docs, texts, contexts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    expected = []
    for (d, _), b in zip(texts, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = len(re.findall(b"\1+", bytes(gone)))
        expected.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert collected(suffix_dedup.remove_repeats(docs, n_batches=3)) == sorted(expected, key=str)


@pytest.mark.parametrize("contexts", [1 << 13, 3])
def test_suffix_dedup_of_runs(spark, contexts, monkeypatch):
    """Runs of a short period need about as many bytes of contexts as they have; results are exact."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "CONTEXT_BYTES", 2000)
    data = np.full(600_000, 45, np.uint8)
    text, _, _, first, last = sampled(data, np.array([0, len(data)]), 400)
    assert len(text) > 1 and (last - first + 400).sum() < 4 * len(data) and (last - first + 1).sum() == len(data) - 399
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    runs = ["-" * 5000, "ab" * 1500, noise(170) * 9, noise(333) * 4, " " * 401, "-" * 400, noise(500) + "-" * 900 + noise(500) + "ab" * 300]
    rows = [(i, r if i % 2 else noise(90) + r + noise(70)) for i, r in enumerate(runs)]
    seen = Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    expected = []
    for d, t in rows:
        gone = {i + k for i in range(len(t) - 399) if seen[t[i : i + 400]] > 1 for k in range(400)}
        kept = "".join(c for i, c in enumerate(t) if i not in gone)
        expected.append((d, len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(suffix_dedup.remove_repeats(docs).select("doc_id", "n_removed", "kept_sha256")) == sorted(expected, key=str)


@pytest.mark.parametrize("common", [1 << 13, 1])
def test_suffix_dedup_returns_what_is_left(spark, common, monkeypatch):
    """The removed runs in bytes and the bytes left, of cut texts, whole and short copies, nulls and null keys."""
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", common)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    once, twice, whole = noise(450), noise(450), noise(500)
    texts = [f"{noise(300)}1{once}2{noise(300)}3{twice}4", f"{noise(90)}5{twice}6", f"7{once}8", whole, whole, whole, noise(900), "short", "short", "", None, f"é{once}ñ", f"ó{once}ò"]
    rows = [(None if i == 1 else i, t) for i, t in enumerate(texts)]
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 400] for b in raw for i in range(len(b) - 399))
    expected = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        expected.append((d, len(b), [m.span() for m in re.finditer(b"\1+", bytes(gone))], bytes(x for x, g in zip(b, gone) if not g)))
    assert len(expected[0][2]) == 2 and expected[3][3] == b""
    found = suffix_dedup.cut_repeats(spark.createDataFrame(rows, "kept long, text string"), "kept").toDF("key", "n_bytes", "spans", "left").collect()
    assert sorted(((d, n, [tuple(s) for s in spans], bytes(left)) for d, n, spans, left in found), key=str) == sorted(expected, key=str)


def test_line_dedup(docs, texts):
    got = collected(line_dedup.remove_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_removed"))
    first, windows = {}, []
    for d, text in sorted({t for t in texts}, key=lambda t: (t[0] is None, t[0] or 0)):
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if re.search(WORD, x)]
        for a, b, c in zip(solid, solid[1:], solid[2:]):
            key = lines[a], lines[b], lines[c]
            windows.append(((d, text), a, c, first.setdefault(key, ((d, text), a)) != ((d, text), a)))
    cut = defaultdict(set)
    for row, a, c, later in windows:
        if later:
            cut[row].update(range(a, c + 1))
    expected = []
    for d, text in texts:
        lines = (text or "").split("\n")
        rest = "\n".join(x for i, x in enumerate(lines) if i not in cut[d, text]) if cut[d, text] else text
        expected.append((d, rest, len(lines), len(cut[d, text])))
    assert got == sorted(expected, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(docs, texts, order):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    rows = [re.findall(WORD, low(t)) + ["</s>"] for _, t in texts]
    counts = [None] + [Counter() for _ in range(order)]
    grams = lambda r, k: [(tuple((["<s>"] * (k - 1) + r)[i : i + k - 1]), r[i]) for i in range(len(r))]
    for (d, _), r in zip(texts, rows):
        for k in range(1, order + 1):
            counts[k].update(() if held(d) else grams(r, k))
    kept = [None] + [katz.discounts(np.array([list(c.values()).count(n) for n in range(1, katz.LARGE + 2)])) for c in counts[1:]]
    by = [None] + [defaultdict(dict) for _ in range(order)]
    for k in range(1, order + 1):
        for (h, w), c in counts[k].items():
            by[k][h][w] = c
    share = lambda k, c: kept[k][min(c, katz.LARGE + 1)] * c

    def chance(k, h, w):
        seen = by[k].get(h)
        if seen is None:
            return chance(k - 1, h[1:], w)
        mass = sum(share(k, c) for c in seen.values())
        total = sum(seen.values())
        total += mass >= total
        if w in seen:
            return share(k, seen[w]) / total
        return 1 - mass / total if k == 1 else (1 - mass / total) / (1 - sum(chance(k - 1, h[1:], x) for x in seen)) * chance(k - 1, h[1:], w)

    history = max(by[order], key=lambda h: len(by[order][h]))
    assert abs(sum(chance(order, history, w) for _, w in counts[1]) + chance(order, history, "\0") - 1) < 1e-9
    condition = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = sorted(map(tuple, katz.katz_scores(docs, condition, order=order).collect()), key=lambda r: (str(r[0]), r[2]))
    total, known = sum(counts[1].values()), len(counts[1])
    expected = sorted(((d, held(d), len(r), sum(((), w) in counts[1] for w in r), total,
                        sum(np.log10((counts[1][(), w] + 1) / (total + known + 1)) for w in r),
                        sum(np.log10(chance(order, h, w)) for h, w in grams(r, order))) for (d, _), r in zip(texts, rows)), key=lambda r: (str(r[0]), r[2]))
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_split_histories_give_the_same_model(docs, monkeypatch):
    condition = F.col("doc_id") % 5 == 0
    whole = {r[0]: r["score"] for r in katz.katz_scores(docs, condition).collect()}
    monkeypatch.setattr(katz, "SPLIT", 2)
    assert {r[0]: r["score"] for r in katz.katz_scores(docs, condition).collect()} == pytest.approx(whole, rel=1e-9)


def test_partitions_of_ngrams_are_bounded_and_give_the_same_model(docs, monkeypatch):
    """Partitions follow the tokens, whatever the shuffle partitions are; very frequent words and histories are split."""
    condition = F.col("doc_id") % 5 == 0
    whole = {r[0]: r["score"] for r in katz.katz_scores(docs, condition, order=3).collect()}
    tables = []
    monkeypatch.setattr(katz, "write_once", lambda df, name: tables.append((name, write_once(df, name))) or tables[-1][1])
    monkeypatch.setattr(katz, "PART_TOKENS", 500)
    for split in (katz.SPLIT, 2):
        monkeypatch.setattr(katz, "SPLIT", split)
        tables.clear()
        assert {r[0]: r["score"] for r in katz.katz_scores(docs, condition, order=3).collect()} == pytest.approx(whole, rel=1e-9)
        grams = [t for name, t in tables if name == "ngrams"]
        tokens = dict(tables)["blocks"].agg(F.sum("n_tokens")).first()[0]
        assert len(grams) == 2 and all(t.select("part").distinct().count() > tokens // 1000 for t in grams)


def test_decontamination(spark, docs, texts):
    items = [(1, " ".join(texts[2][1].split()[:14])), (2, "A"), (3, None), (4, "..."), (5, "a A a"), (None, texts[60][1]), (6, texts[60][1])]
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    phrases = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - 10) + 1 if w else 0):
            phrases[tuple(w[k : k + 10])].add(i)
    expected = []
    for d, t in texts:
        w, hit, names = words(t), set(), set()
        for size in {len(p) for p in phrases}:
            for k in range(len(w) - size + 1):
                if found := phrases.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    names |= {str(i) for i in found if i is not None}
        expected.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert collected(decontaminate.contamination(docs, table)) == sorted(expected, key=str)
    assert decontaminate.remove_items(docs, table).columns == docs.columns
    assert decontaminate.contamination(docs, table.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_blocks(spark, docs, texts, monkeypatch):
    table = spark.createDataFrame([(i, texts[i][1]) for i in range(0, 40, 5)], "item_id long, text string")
    whole = collected(decontaminate.contamination(docs, table))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert collected(decontaminate.contamination(docs, table)) == whole


def test_pii_base(docs, texts):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, match):
        d = re.sub("[^0-9]", "", match)
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
            return 14 <= len(d) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
        return all(int(x) < 256 for x in match.split(".")) if kind == "ip" else 10 <= len(d) <= 15 if kind == "phone" else True

    expected = []
    for d, t in texts:
        spans = sorted((m.start(), n, m.end(), k) for n, k in enumerate(patterns) for m in re.finditer(patterns[k], t or "") if fits(k, m[0]))
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        expected.append((d, *(sum(s[3] == k for s in spans) for k in patterns), hashlib.sha256(text.encode()).hexdigest()))
    assert collected(pii.private_data(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == sorted(expected, key=str)


def test_pii_terms(spark):
    rows = [(i, f"w{'abcdefgh'[i]} call Zorblat quux{'abcdefgh'[i]} at 10.1.2.3 now") for i in range(6)] + [(9, "ZORBLAT was the man"), (10, "the the the")]
    rows += [(100 + i, " ".join(["the", "man", "was", "call", "now"] * 40)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.private_data(docs).collect()}
    assert got[0] == "term:8:15,ip:25:33" and got[9] == "term:0:7" and got[10] == "" and got[100] == ""
    assert {r[0]: r[1] for r in pii.sanitised(docs, remove=2.0).collect()}[9] == "[TERM] was the man"


def test_pii_terms_of_a_value_that_occurs_once(spark):
    filler = " ".join(["the", "man", "was", "call", "now"] * 8)
    rows = [(0, "Quixana wrote from q1@x.org"), (1, f"{filler} ask quixana")] + [(i, f"{filler} 10.0.0.{i % 4}") for i in range(2, 200)]
    rows += [(300, f"Oberlin {filler} " + " ".join(f"u{i}@y.org" for i in range(50)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.private_data(docs).collect()}
    assert got[0]["spans"].startswith("term:0:7,") and got[300]["spans"].startswith("term:0:7,email:")
    assert got[0]["n_term"] == 3 and got[1]["n_term"] == 1 and got[300]["n_term"] == 1
    assert all(got[i]["n_term"] == 0 for i in range(2, 200))


def test_quality(spark, docs, texts):
    trusted = spark.createDataFrame([(i,) for i in range(0, 40, 2)] + [(None,)], "doc_id long")
    got = collected(quality.quality(docs, trusted))
    for d, n, chars, symbols, dup, repeat, failed, score, kept in got:
        assert any(
            (k, n, chars) == (d, len(w), sum(map(len, w))) and symbols == len(re.findall(r"[#*$%&|<>]", t or "")) and repeat == covered(w) and dup == copies(t)
            for k, t in texts for w in [re.findall(WORD, t or "")]
        )
        assert failed == (n < 10 or 100 * repeat > 20 * n) and kept == (not failed and score >= quality.THRESHOLD)
    assert len(got) == len(texts)


@pytest.mark.parametrize("broadcast", [1 << 20, 10])
def test_quality_counts_all_trusted_documents(spark, broadcast, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_KEYS", broadcast)
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    weights = quality.log_ratios(docs, docs.select("doc_id")).first()["weights"]
    assert all(w == 0.0 for w in weights)


def covered(words):
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return len({i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)})


def copies(text):
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(lines) - len(set(lines))


def test_toxicity_learns_from_its_part_only(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [toxicity.toxicity(docs, x, held) for x in (labels, turned)]
    assert collected(scores[0].select("doc_id", "score")) == collected(scores[1].select("doc_id", "score"))


def test_lexicon_of_texts_that_begin_alike(spark):
    header = "From the moderators of the board: this message was reported. " * 2
    rows = [(1, f"{header} vilewort number {i}") for i in range(30)] + [(0, f"{header} kind words {i}") for i in range(100)]
    rows += [(1, "once upon a rareterm")] * 9
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "label int, text string"))
    assert "vilewort" in lexicon and "rareterm" not in lexicon and "message" not in lexicon


def test_toxicity_accuracy(spark):
    """Needs a few hundred toxic labels to learn from; smaller tables have too few."""
    folder = "/root/testdata/check_s"
    if not os.path.isdir(folder):
        pytest.skip("no table of that size")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = toxicity.toxicity(docs, labels, held).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    hits = Counter((r[0], r[1]) for r in rows)
    assert hits[1, 1] >= 0.9 * (hits[1, 1] + hits[0, 1]) and hits[1, 0] <= 0.01 * len(rows)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    path = sentencepiece_codec.tokenizer_path("piece_bpe_32k.model")
    assert toxicity.toxicity(docs, labels, F.lit(False)).filter("score = 0.0").count() == docs.count()
    for df in (line_dedup.remove_repeated_lines(none), katz.katz_scores(none, F.lit(False)), pii.private_data(none), minhash.near_duplicates(none),
               suffix_dedup.remove_repeats(none), toxicity.toxicity(none, labels, F.lit(False)), quality.quality(none, labels),
               decontaminate.contamination(none, items), sentencepiece_codec.encode_and_check(none, path)):
        assert df.count() == 0


def test_bayesian_bound_keeps_true_links():
    rng = np.random.default_rng(1)
    for compared in (32, 96, 224):
        least = minhash.matches_needed(compared, 0.85, 1e-6)
        assert (rng.binomial(compared, 0.85, 200_000) >= least).mean() > 0.9999


def test_word_hashes_are_equal_across_batches():
    from textshield.llm.blocks import hashed_words

    words = ["Ab", "é" * 70_000, "x"]
    one = hashed_words(pa.array([" ".join(words), None, ""]))
    parts = [hashed_words(pa.array([w]))[0][0] for w in ["ab", words[1], "X"]]
    assert one[0].tolist() == parts and one[1].tolist() == [0, 3, 3, 3]


def test_written_tables_are_read_again(spark):
    assert write_once(spark.range(3), "probe").count() == 3
