"""Counting byte-level BPE tokens with rank-synchronous merging of ragged arrays.

A batch of texts is split into pre-tokens; those not met before are laid out as one ragged numpy
array of symbols. In every round each sequence applies its own lowest-ranked pair at all of its
places at once, and sequences without a known pair leave. The symbols that survive are the tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from textshield.llm.blocks import batches, ragged, text_bytes

#: Splits a text the way byte-level BPE of this family does; a fixed value of the tokenizer.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TEXT_BYTES = 4 << 20
CACHE = 1 << 20
NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Pairs of symbols with their ranks, as sorted arrays; read from a ``tokenizers`` file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def survivors(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each non-empty word."""
        lengths = np.array([len(w) for w in words], np.int64)
        out, alive = lengths.copy(), np.arange(len(words))
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full(len(symbols), NONE)
        ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
        ranks[np.cumsum(lengths) - 1] = NONE
        while len(alive):
            lowest = np.minimum.reduceat(ranks, np.cumsum(lengths) - lengths)
            going = lowest < NONE
            if not going.all():
                keep = np.repeat(going, lengths)
                symbols, ranks, alive, lowest, lengths = symbols[keep], ranks[keep], alive[going], lowest[going], lengths[going]
            if not len(alive):
                break
            run, _ = ragged(lengths)
            hit = np.flatnonzero(ranks == lowest[run])
            # equal neighbours such as "aaa": every second place of a run of hits
            fresh = np.concatenate([[True], np.diff(hit) > 1])
            hit = hit[(hit - hit[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            lengths = lengths - np.bincount(run[hit], minlength=len(lengths))
            symbols, ranks = symbols[stay], ranks[stay]
            out[alive] = lengths
            # only pairs with a new symbol have new ranks
            ends = np.cumsum(lengths)
            at = hit - np.arange(len(hit))
            at = np.concatenate([at, at[at > 0] - 1])
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            ranks[at[last[at]]] = NONE
            at = at[~last[at]]
            ranks[at] = self.rank(symbols[at], symbols[at + 1])
        return out


def _counter(merges: Merges):
    """A function from texts to their numbers of tokens, with a bounded memory of what it has met.

    Pre-tokens never reach past a space that something other than white space follows, so a text
    falls into units at such spaces, most of which have been met before.
    """
    split = regex.compile(PRETOKENS).findall
    blank = re.compile(r"\s|^$").search
    odd, apart = re.compile(r" (?:\s|$)").search, re.compile(r" (?=\S)").split
    special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
    known: dict[str, int] = {}
    whole: dict[str, int] = {}

    def learn(units: list[str], into: dict[str, int], lead: str) -> None:
        """Add the counts of units; those without white space are split in one go, a line each."""
        plain, rest = [], []
        for u in units:
            (rest if blank(u) else plain).append(u)
        words = split("\n".join([lead + u for u in plain]))
        parts = [split(lead + u) for u in rest]
        new = list(set(chain(words, chain.from_iterable(parts))).difference(known))
        if new:
            known.update(zip(new, merges.survivors([w.encode() for w in new]).tolist()))
        into.update((u, sum(map(known.__getitem__, w))) for u, w in zip(rest, parts))
        if plain:
            counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            ends = np.fromiter(("\n".__eq__(w) for w in words), bool, len(words))
            line = np.cumsum(ends)
            into.update(zip(plain, np.bincount(line[~ends], counts[~ends], len(plain)).astype(np.int64).tolist()))

    def count(texts: Iterable[str]) -> list[int]:
        extra, firsts, units, counts, new = [], [], [], [], set()
        for text in texts:
            parts = special.split(text) if special else [text]
            extra.append(len(parts) - 1)
            cut = [apart(p) if odd(p) else p.split(" ") for p in parts]
            firsts.append([c[0] for c in cut])
            rest = cut[0][1:] if len(cut) == 1 else list(chain.from_iterable(c[1:] for c in cut))
            got = list(map(whole.get, rest))
            if None in got:
                new.update([u for u, n in zip(rest, got) if n is None])
            units.append(rest)
            counts.append(got)
        learn(list(new), whole, " ")
        start: dict[str, int] = {}
        learn(list(set(chain.from_iterable(firsts))), start, "")
        out = [
            e + sum(map(start.__getitem__, f)) + (sum(map(whole.__getitem__, u)) if None in c else sum(c))
            for e, f, u, c in zip(extra, firsts, units, counts)
        ]
        for memory in (known, whole):
            if len(memory) > CACHE:
                memory.clear()
        return out

    return count


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024, key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    ``vocabulary`` is the content of a ``tokenizers`` file with a byte-level BPE model; its size
    bounds what tasks are sent. Strings of special tokens inside a text count as one token each, as
    that library has it; no other special token is added. A null or empty text has no tokens. Every
    row is counted on its own: repeated rows give repeated results, a null key stays null, other
    columns are ignored, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(Merges(shared.value))
        for batch in batches(stream, "text", TEXT_BYTES):
            column = batch.column(1)
            _, offsets = text_bytes(column)
            tokens = count(t or "" for t in column.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens, pa.int64())], ["key", "n_bytes", "n_tokens"]
            )

    out = rows.mapInArrow(counted, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
