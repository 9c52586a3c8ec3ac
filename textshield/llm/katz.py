"""Katz backoff language model with Good-Turing discounts, counted and evaluated block by block.

Texts become blocks of word numbers, stored once. For each order a block asks for the counts of its
own distinct n-grams: the requests are partitioned by history (a history with very many n-grams by
history and word), each partition adds the counts up and answers every block in the order it asked.
The stored answers are the model's tables, partitioned like the requests. The answers to words number
all words, so that n-grams are small whole numbers. With its n-grams a block sends the counts of the
order below, from which a partition knows the probabilities that backoff weights need to sum to one
exactly. There are as many partitions as keep each to a fixed number of tokens.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from textshield.llm.blocks import batches, hashed_words, mix, ragged
from textshield.llm.shipping import ship
from textshield.session import write_once

#: Counts up to this are discounted.
LARGE = 5
#: Bytes of text in a block.
BLOCK_BYTES = 7 << 20
#: Tokens whose n-grams one partition counts, and words that one numbers.
PART_TOKENS = 5 << 18
START, END = np.uint64(0x5BD1E995C2B2AE35), np.uint64(0x27D4EB2F165667C5)
STEP = np.uint64(0x9E3779B185EBCA87)
#: A history with more than this share of a partition's words is split by word.
SHARE = 4
SPLIT = 1 << 16
ROW = "block long, kind int, part int, payload binary"


PLANES = "planes"


def squeeze(thing) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(_split(thing), 5))


def expand(data: bytes):
    return _joined(pickle.loads(zstandard.ZstdDecompressor().decompress(data)))


def _split(thing):
    """Arrays as all first bytes of their numbers, all second bytes and so on, which packs better."""
    if isinstance(thing, np.ndarray) and thing.itemsize > 1:
        rows = np.ascontiguousarray(thing).reshape(-1).view(np.uint8).reshape(-1, thing.itemsize)
        return PLANES, thing.dtype.str, thing.shape, rows.T.tobytes()
    if isinstance(thing, dict):
        return {k: x if k == "keys" else _split(x) for k, x in thing.items()}
    return tuple(map(_split, thing)) if isinstance(thing, tuple) else thing


def _joined(thing):
    if isinstance(thing, tuple) and thing and isinstance(thing[0], str) and thing[0] == PLANES:
        kind = np.dtype(thing[1])
        rows = np.frombuffer(thing[3], np.uint8).reshape(kind.itemsize, -1).T
        return np.ascontiguousarray(rows).reshape(-1).view(kind).reshape(thing[2])
    if isinstance(thing, dict):
        return {k: x if k == "keys" else _joined(x) for k, x in thing.items()}
    return tuple(map(_joined, thing)) if isinstance(thing, tuple) else thing


def small(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as they need."""
    return values.astype(np.min_scalar_type(int(values.max()) if len(values) else 0))


def tight(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as the bytes of their differences, the highest of all first."""
    steps = np.diff(values, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def loose(data: bytes) -> np.ndarray:
    """The values that ``tight`` has packed."""
    steps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64)
    return np.cumsum(steps.reshape(-1), dtype=np.uint64)


def stepped(values: np.ndarray) -> np.ndarray:
    """Whole numbers as their differences, which wrap around; those that mostly rise pack better so."""
    return np.diff(values, prepend=values.dtype.type(0))


def unstepped(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values from 0, the place of each value among them and where each of them stands once."""
    bits = len(values).bit_length()
    if len(values) and int(values.max()) < 1 << (63 - bits):
        # a value and its place sort as one number, several times faster than places by their values
        ordered = values.astype(np.int64) << bits
        ordered |= np.arange(len(values))
        ordered.sort()
        order = (ordered & ((1 << bits) - 1)).astype(np.int32 if bits < 32 else np.int64)
        ordered = (ordered >> bits).astype(values.dtype, copy=False)
    else:
        order = np.argsort(values)
        ordered = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(values), np.int32 if bits < 32 else np.int64)
    place[order] = np.cumsum(fresh, dtype=place.dtype) - place.dtype.type(1)
    return ordered[fresh], place, order[fresh]


def joint(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """Two numbers as one, the second less than ``size``."""
    return first.astype(np.int64) * size + second


def discounts(number: np.ndarray) -> np.ndarray:
    """Factors for counts 0..LARGE and more, from the numbers of n-grams seen 1..LARGE + 1 times.

    Katz's Good-Turing factors; where they are undefined or not inside (0, 1), a count r keeps
    r - D of r with D = n1 / (n1 + 2 n2), or a half without n-grams seen once.
    """
    out = np.ones(LARGE + 2)
    n = np.concatenate([[0], number]).astype(float)
    back = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    top = (LARGE + 1) * n[LARGE + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGE + 1):
        factor = ((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) if n[r] and top < 1 else 0.0
        out[r] = factor if 0 < factor < 1 else (r - back) / r
    out[0] = 0.0
    return out


def _blocks(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream, "text", BLOCK_BYTES):
        words, _, counts = hashed_words(batch.column(2))
        tokens = np.full(len(words) + len(counts), END)
        run, place = ragged(counts + 1)
        tokens[place < counts[run]] = words
        vocabulary, number, _ = distinct(tokens)
        train = batch.column(1).to_numpy(zero_copy_only=False)
        seen = np.bincount(number, train[run], len(vocabulary)).astype(np.int64)
        # frequent words get small numbers
        rank = np.empty(len(vocabulary), np.int64)
        rank[by_count(seen)] = np.arange(len(vocabulary))
        docs = {"keys": batch.column(0).to_pylist(), "train": train, "counts": small(counts + 1), "tokens": small(rank[number]), "seen": small(seen)}
        yield pa.RecordBatch.from_arrays(
            [pa.array([uuid4().int >> 66]), pa.array([squeeze(docs)]), pa.array([squeeze((tight(vocabulary), small(seen)))]),
             pa.array([len(tokens)]), pa.array([len(vocabulary)])], ["block", "docs", "words", "n_tokens", "n_words"]
        )


class Block:
    """The words of some documents, with what the answers so far say about them."""

    def __init__(self, docs: dict, model: dict):
        self.docs, self.model = docs, model
        # words in the order of their hashes, which is that of their numbers
        self.tokens = by_count(docs["seen"])[docs["tokens"]].astype(np.int32)
        self.counts = docs["counts"].astype(np.int64)
        self.doc, self.place = (x.astype(np.int32) for x in ragged(self.counts))
        self.train = docs["train"][self.doc]
        self.shifted = {}

    def answer_words(self, parts: dict[int, tuple]) -> None:
        """Take the counts and numbers of words."""
        m = self.model
        self.word_count = np.concatenate([parts[p][0].astype(np.int64) for p in sorted(parts)])
        self.number = np.concatenate([loose(parts[p][1]) + m["first"][p] for p in sorted(parts)])
        self.count = self.word_count[self.tokens]

    def ask(self, order: int) -> "Request":
        """The distinct n-grams of an order, sorted by partition, history and word."""
        # how often the history occurs in training is the count of the n-gram that ends before the word
        before = np.zeros(len(self.tokens), np.int64)
        before[1:] = self.count[:-1]
        before[self.place == 0] = self.model["documents"]
        return Request(self, before, order)

    def earlier(self, reach: int) -> np.ndarray:
        """The word so many places before each token; before a text begins, the number of words."""
        if reach not in self.shifted:
            out = np.full(len(self.tokens), len(self.number), np.int32)
            out[reach:] = self.tokens[:-reach]
            out[self.place < reach] = len(self.number)
            self.shifted[reach] = out
        return self.shifted[reach]

    def histories(self, at: np.ndarray, order: int) -> np.ndarray:
        """Hashes of the histories of some tokens, equal in all blocks."""
        numbers, out = np.append(self.number, START), np.zeros(len(at), np.uint64)
        for reach in range(1, order):
            out = mix(out * STEP + numbers[self.earlier(reach)[at]] + np.uint64(reach + 1))
        return out

    def score_words(self) -> None:
        """Give each word its unigram probability."""
        m = self.model
        self.known = self.word_count[self.tokens] > 0
        self.base = np.log10((self.word_count + 1) / (m["total"] + m["words"] + 1))[self.tokens]
        self.chance = unigram(self.word_count, m)[self.tokens]

    def answer(self, order: int, request: "Request", parts: dict[int, tuple], scored: bool) -> None:
        """Take the counts of n-grams and what their histories lack; to be scored, move the probabilities up one order."""
        m = self.model
        count, none = np.zeros(len(request.part), np.int64), np.zeros(len(request.head_part), bool)
        weight = np.full(len(none), np.nan)
        d = m["discounts"][order]
        for part, (seen, empty, needed, stats) in parts.items():
            a, b = np.searchsorted(request.part, [part, part + 1])
            count[a:b] = seen
            a, b = np.searchsorted(request.head_part, [part, part + 1])
            none[a:b] = empty
            if scored:
                weight[a + needed.astype(np.int64)] = backoff(*stats, d)
        hot = m["hot"].get(order)
        if hot is not None and len(hot[0]):
            is_hot = np.flatnonzero(request.hot[request.head_at])
            number, big, mass = (x[np.searchsorted(hot[0], request.codes(is_hot))] for x in hot[1:])
            none[is_hot] = number.sum(1) == 0
            weight[is_hot] = backoff(number, big, mass, d)
        head = request.pair_head[request.row]
        self.count = count[request.row]
        # what the counts of this order are shares of
        self.total = np.maximum(request.total + none[head], 1)
        if not scored:
            return
        seen = d[np.minimum(self.count, LARGE + 1)] * self.count / self.total
        with np.errstate(invalid="ignore"):
            below = weight[head] * self.chance
        below = np.where(request.total > 0, below, self.chance)
        self.chance = np.where(self.count > 0, seen, below)


class Request:
    """Distinct (history, word) pairs of a block, by partition; ``row`` is the pair of each token, ``pair_head`` its history."""

    def __init__(self, block: Block, before: np.ndarray, order: int):
        m, size = block.model, len(block.number) + 1
        self.block, self.order, self.total = block, order, before
        # histories are numbered in the order of their words, the nearest first
        last = block.earlier(1)
        used = np.zeros(size, bool)
        used[last] = True
        head = (np.cumsum(used) - 1)[last]
        for reach in range(2, order):
            head = distinct(joint(head, block.earlier(reach), size))[1]
        pairs, row, first = distinct(joint(head, block.tokens, size))
        # histories that end with one word meet in a partition, unless the word or the history is very frequent
        last = last[first]
        splits = 1 + before[first] // m["split"]
        word_shares = 1 + np.append(block.word_count, m["documents"]) // m["split"]
        ends = np.append(block.number, START) * END
        part_of = lambda code: ((mix(code) >> np.uint64(17)) % np.uint64(m["parts"])).astype(np.int64)
        part = part_of(ends)[last]
        some = np.flatnonzero((splits > 1) | (word_shares > 1)[last])
        salt = mix(block.histories(first[some], order)) % word_shares[last[some]].astype(np.uint64) * START
        salt += mix(block.number[block.tokens[first[some]]]) % splits[some].astype(np.uint64)
        part[some] = part_of(ends[last[some]] + salt * STEP)
        by_part = np.argsort(small(part), kind="stable")
        back = np.empty(len(by_part), np.int32)
        back[by_part] = np.arange(len(by_part), dtype=np.int32)
        self.row, self.part, self.first = back[row], part[by_part], first[by_part]
        # a history of a partition is known by its number among (partition, history)
        pair_head = pairs[by_part] // size
        fresh = np.ones(len(pairs), bool)
        fresh[1:] = (pair_head[1:] != pair_head[:-1]) | (self.part[1:] != self.part[:-1])
        self.pair_head = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
        self.head_at = np.flatnonzero(fresh)
        self.head_part = self.part[self.head_at]
        self.hot = splits[by_part] > 1

    def codes(self, heads: np.ndarray) -> np.ndarray:
        """Hashes of histories given by their numbers."""
        return self.block.histories(self.first[self.head_at[heads]], self.order)

    def parts(self) -> Iterator[tuple[int, bytes]]:
        block, size = self.block, len(self.block.number)
        seen = np.bincount(self.row, block.train, len(self.part)).astype(np.int64)
        earlier = [block.earlier(reach) for reach in range(1, self.order)]
        numbers, word_count = np.append(block.number, np.uint64(block.model["numbers"])), np.append(block.word_count, 0)
        mask, place = np.zeros(size + 1, bool), np.empty(size + 1, np.int32)
        edges = np.flatnonzero(np.diff(self.part, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(self.part))):
            at, start = self.first[a:b], np.flatnonzero(np.diff(self.pair_head[a:b], prepend=-1))
            columns = [*(e[at[start]] for e in earlier), block.tokens[at]]
            for c in columns:
                mask[c] = True
            used = np.flatnonzero(mask)
            mask[used], place[used] = False, np.arange(len(used))
            below = (small(word_count[used]),) if self.order == 2 else (small(block.count[at]), small(block.total[at[start]]))
            hot = np.flatnonzero(self.hot[a:b][start])
            codes = self.codes(self.pair_head[a:b][start[hot]])
            yield int(self.part[a]), squeeze((
                tight(numbers[used]), small(np.diff(np.append(start, b - a))), (*(stepped(small(place[c])) for c in columns[:-1]), small(place[columns[-1]])), small(seen[a:b]), below, (small(hot), codes)))


def by_count(seen: np.ndarray) -> np.ndarray:
    """Places of counts, the largest first."""
    return np.argsort(small(int(seen.max()) - seen.astype(np.int64)) if len(seen) else seen, kind="stable")


def words_part(words: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of words in their order."""
    return ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def unigram(count: np.ndarray, model: dict) -> np.ndarray:
    """Discounted share of a word, or what is left for all words that training has not seen."""
    d, n = model["discounts"][1], model["total"]
    if not n:
        return np.ones(len(count))
    total = n + (model["seen_mass"] >= n)
    return np.where(count > 0, d[np.minimum(count, LARGE + 1)] * count / total, 1 - model["seen_mass"] / total)


def backoff(number: np.ndarray, big: np.ndarray, mass: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The weight of the lower order, so that a history's probabilities sum to one.

    A history all of whose words keep their counts holds back the share of one more occurrence.
    """
    r = np.arange(1, LARGE + 1)
    total = (number * r).sum(1) + big
    kept = (number * (r * d[1 : LARGE + 1])).sum(1) + big
    total = np.maximum(total + (number.sum(1) == 0), 1)
    return (1 - kept / total) / (1 - mass)


def _counted_words(group: pd.DataFrame) -> pd.DataFrame:
    asked = [(loose(w), c) for w, c in map(expand, group["payload"])]
    words, place, _ = distinct(np.concatenate([w for w, _ in asked]))
    count = np.bincount(place, np.concatenate([c for _, c in asked]), len(words)).astype(np.int64)
    number = np.bincount(np.minimum(count, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2]
    edges = np.cumsum([len(w) for w, _ in asked])
    answers = [squeeze((small(count[x]), tight(x.astype(np.uint64)))) for x in np.split(place, edges[:-1])]
    big = int(count[count > LARGE].sum())
    part = int(group["part"].iloc[0])
    stats = squeeze({"part": part, "numbers": len(words), "number": number, "big": big, "words": int((count > 0).sum()), "total": int(count.sum())})
    return pd.DataFrame({"block": [*group["block"], -1], "kind": 1, "part": part, "payload": [*answers, stats]})


def _counted_pairs(load, order: int):
    def counted(group: pd.DataFrame) -> pd.DataFrame:
        model = load()
        asked = [expand(p) for p in group["payload"]]
        # words are numbered anew, so that the numbers stay small
        numbers, lengths = [loose(a[0]) for a in asked], [a[1].astype(np.int64) for a in asked]
        words, place, _ = distinct(np.concatenate(numbers))
        numbers, size = np.split(place, np.cumsum([len(n) for n in numbers])[:-1]), len(words)
        head = np.zeros(1, np.int64)
        for k in range(order - 1):
            heads, head, _ = distinct(joint(head, np.concatenate([n[unstepped(a[2][k])] for n, a in zip(numbers, asked)]), size))
        n_heads, lengths = len(heads), np.concatenate(lengths)
        edges, head_edges = np.cumsum([0, *(len(a[3]) for a in asked)]), np.cumsum([0, *(len(a[1]) for a in asked)])
        pairs, pair, one = distinct(joint(np.repeat(head, lengths), np.concatenate([n[a[2][-1]] for n, a in zip(numbers, asked)]), size))
        count = np.bincount(pair, np.concatenate([a[3] for a in asked]), len(pairs)).astype(np.int64)
        own = pairs // size
        del pairs, numbers
        # the probability of a word in the order below, where training has seen it here
        seen = np.flatnonzero(count)
        one = one[seen]
        if order == 2:
            chance = unigram(np.concatenate([a[4][0][a[2][-1]] for a in asked])[one], model)
        else:
            below, total = np.concatenate([a[4][0] for a in asked])[one].astype(np.int64), np.repeat(np.concatenate([a[4][1] for a in asked]), lengths)[one]
            chance = model["discounts"][order - 1][np.minimum(below, LARGE + 1)] * below / total
        mass = np.bincount(own[seen], chance, n_heads)
        few = (count > 0) & (count <= LARGE)
        number = np.bincount(own[few] * LARGE + count[few] - 1, minlength=n_heads * LARGE).astype(np.int32).reshape(n_heads, LARGE)
        big = np.bincount(own[count > LARGE], count[count > LARGE], n_heads).astype(np.int64)
        none = number.sum(1) == 0
        answers, hot, codes = [], np.zeros(n_heads, bool), np.zeros(n_heads, np.uint64)
        for i, a in enumerate(asked):
            c, h = count[pair[edges[i] : edges[i + 1]]], head[head_edges[i] : head_edges[i + 1]]
            hot[h[a[5][0]]], codes[h[a[5][0]]] = True, a[5][1]
            unseen = np.zeros(len(h), bool)
            unseen[np.repeat(np.arange(len(h)), a[1])[c == 0]] = True
            unseen[a[5][0]] = False
            needed = np.flatnonzero(unseen)
            stats = small(number[h[needed]]), small(big[h[needed]]), mass[h[needed]]
            answers.append(squeeze((small(c), none[h], small(needed), stats)))
        total = squeeze({"number": np.bincount(np.minimum(count, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2],
                         "hot": (codes[hot], number[hot].astype(np.int64), big[hot], mass[hot])})
        part = int(group["part"].iloc[0])
        return pd.DataFrame({"block": [*group["block"], -1], "kind": order, "part": part, "payload": [*answers, total]})

    return counted


def _replayed(group: pd.DataFrame, model: dict, orders: int, scored: bool) -> Block:
    """A block with the answers of the first ``orders`` orders, and its probabilities if it is to be scored."""
    rows = {}
    for kind, part, payload in zip(group["kind"], group["part"], group["payload"]):
        rows.setdefault(kind, {})[part] = expand(payload)
    block = Block(rows[-1][0], model)
    block.answer_words(rows.get(1, {}))
    if scored:
        block.score_words()
    for order in range(2, orders + 1):
        block.answer(order, block.ask(order), rows.get(order, {}), scored)
    return block


def _asked(load, order: int):
    def asked(group: pd.DataFrame) -> pd.DataFrame:
        request = _replayed(group, load(), order - 1, False).ask(order)
        out = [(int(group["block"].iloc[0]), order, part, payload) for part, payload in request.parts()]
        return pd.DataFrame(out, columns=["block", "kind", "part", "payload"])

    return asked


def _scored(load, orders: int):
    def scored(group: pd.DataFrame) -> pd.DataFrame:
        block = _replayed(group, load(), orders, True)
        n = len(block.counts)
        total = lambda x: np.bincount(block.doc, x, n)
        return pd.DataFrame({
            "key": pd.Series(block.docs["keys"], dtype=object), "held_out": ~block.docs["train"], "n_tokens": block.counts,
            "n_known": total(block.known).astype(np.int64), "train_tokens": block.model["total"],
            "base_score": total(block.base), "score": total(np.log10(block.chance)),
        })

    return scored


def katz_scores(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Per row: ``key, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is a condition; all other rows train the model, also those where it is null. Words
    are runs of anything but white space, A-Z lower-cased, and every text ends with one end token,
    so a null or empty text has one token. ``score`` is the model's log10 probability of a text,
    ``base_score`` that of words alone with one added to each count. Repeated rows count each time,
    a null key stays null, extra columns are ignored, an empty table gives an empty result; without
    a training row every word is the one unknown word and all scores are 0. All n-grams of the
    training rows are counted, without a cut. Words and histories are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), (~F.coalesce(held_out, F.lit(False))).alias("train"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    blocks = write_once(rows.mapInArrow(_blocks, "block long, docs binary, words binary, n_tokens long, n_words long"), "blocks")
    documents = rows.agg(F.sum(F.col("train").cast("long"))).first()[0] or 0
    tokens, words = (x or 0 for x in blocks.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    parts, word_parts = (max(1, -(-n // PART_TOKENS)) for n in (tokens, words))

    def split_words(stream):
        for batch in stream:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, count = expand(payload)
                words = loose(words)
                of = words_part(words, word_parts)
                for part in np.flatnonzero(np.bincount(of, minlength=word_parts)).tolist():
                    mine = slice(*np.searchsorted(of, [part, part + 1]))
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([1], pa.int32()), pa.array([part], pa.int32()),
                                                      pa.array([squeeze((tight(words[mine]), small(count[mine])))])], ["block", "kind", "part", "payload"])

    asked = blocks.select("block", "words").mapInArrow(split_words, ROW)
    answers = [write_once(asked.groupBy("part").applyInPandas(_counted_words, ROW), "words")]
    stats = [expand(r[0]) for r in answers[0].filter("block = -1").select("payload").collect()]
    number = sum((s["number"] for s in stats), np.zeros(LARGE + 1, np.int64))
    model = {
        "parts": parts, "word_parts": word_parts, "documents": documents, "hot": {}, "discounts": {1: discounts(number)}, "first": {}, "numbers": 0,
        "words": sum(s["words"] for s in stats), "total": sum(s["total"] for s in stats),
    }
    for s in sorted(stats, key=lambda s: s["part"]):
        model["first"][s["part"]] = np.uint64(model["numbers"])
        model["numbers"] += s["numbers"]
    r = np.arange(1, LARGE + 1)
    model["seen_mass"] = float((number[:LARGE] * r * model["discounts"][1][1 : LARGE + 1]).sum() + sum(s["big"] for s in stats))
    model["split"] = max(SPLIT, model["total"] // (SHARE * parts))

    stored = blocks.select("block", F.lit(-1).cast("int").alias("kind"), F.lit(0).cast("int").alias("part"), F.col("docs").alias("payload"))

    def with_answers() -> DataFrame:
        out = stored
        for a in answers:
            out = out.union(a.filter("block >= 0").select("block", "kind", "part", "payload"))
        return out.groupBy("block")

    for n in range(2, order + 1):
        load = ship(spark, model)
        asked = with_answers().applyInPandas(_asked(load, n), ROW)
        answers.append(write_once(asked.groupBy("part").applyInPandas(_counted_pairs(load, n), ROW), "ngrams"))
        # one row a partition; split histories are at most SHARE times the partitions
        stats = [expand(r[0]) for r in answers[-1].filter("block = -1").select("payload").collect()]
        model = model | {"discounts": dict(model["discounts"]), "hot": dict(model["hot"])}
        model["discounts"][n] = discounts(sum((s["number"] for s in stats), np.zeros(LARGE + 1, np.int64)))
        model["hot"][n] = _summed([s["hot"] for s in stats])
    schema = f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_answers().applyInPandas(_scored(ship(spark, model), order), schema).withColumnRenamed("key", key)


def _summed(hot: list[tuple]) -> tuple:
    """The statistics of split histories, added up over their partitions."""
    if not sum(len(h[0]) for h in hot):
        return np.zeros(0, np.uint64), np.zeros((0, LARGE), np.int64), np.zeros(0, np.int64), np.zeros(0)
    heads, place, _ = distinct(np.concatenate([h[0] for h in hot]))
    number, big, mass = np.zeros((len(heads), LARGE), np.int64), np.zeros(len(heads), np.int64), np.zeros(len(heads))
    np.add.at(number, place, np.concatenate([h[1] for h in hot]))
    np.add.at(big, place, np.concatenate([h[2] for h in hot]))
    np.add.at(mass, place, np.concatenate([h[3] for h in hot]))
    return heads, number, big, mass
