"""SentencePiece pieces in a double-array trie, with Viterbi search over whole batches of words."""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from textshield.llm.blocks import ragged

#: The letter that stands for a space in pieces; a fixed value of the format.
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
LONG = 96
CACHE = 1 << 18
STEP = 1 << 16
WINDOW = 1024


class DoubleArray:
    """A trie over bytes: from state ``s`` byte ``b`` leads to ``t = base[s] + b`` if ``check[t] == s``."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, number in words.items():
            node = 0
            for byte in word:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][byte]
            value[node] = number
        size = 2 * len(children) + 1024
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        place, lowest, queue = {0: 0}, 1, [0]
        for node in queue:
            self.value[place[node]] = value[node]
            if not children[node]:
                continue
            kids = np.array(sorted(children[node]), np.int64)
            while used[lowest]:
                lowest += 1
            base = max(1, lowest - int(kids[0]))
            while True:
                if base + WINDOW + 256 > len(used):
                    grow = len(used)
                    used = np.concatenate([used, np.zeros(grow, bool)])
                    self.base = np.concatenate([self.base, np.zeros(grow, np.int32)])
                    self.check = np.concatenate([self.check, np.full(grow, -1, np.int32)])
                    self.value = np.concatenate([self.value, np.full(grow, -1, np.int32)])
                taken = used[base + kids[0] : base + kids[0] + WINDOW].copy()
                for byte in kids[1:]:
                    taken |= used[base + byte : base + byte + WINDOW]
                free = int(taken.argmin())
                base += free
                if not taken[free]:
                    break
                base += WINDOW - free
            self.base[place[node]] = base
            used[base + kids] = True
            self.check[base + kids] = place[node]
            for byte in kids.tolist():
                place[children[node][byte]] = base + byte
                queue.append(children[node][byte])
        # every state can be asked for every byte
        self.base, self.check, self.value = (
            np.concatenate([a, np.full(256, fill, np.int32)]) for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1))
        )

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.base[state] + byte
        return to, self.check[to] == state


class Vocabulary:
    """Pieces by id with log scores.

    Scores of the file order the pieces; the piece at place r gets the log probability of Zipf's
    law, -log(r H). Space markers may stand at the start of a piece or fill it, so no piece reaches
    past a space that follows another letter and words can be searched on their own.
    """

    def __init__(self, pieces: list[str], scores: list[float], special: list[bool], bytes_from: int):
        self.text = [b"" if s else p.replace(MARKER, " ").encode() for p, s in zip(pieces, special)]
        self.bytes_from = bytes_from
        for b in range(256):
            self.text[bytes_from + b] = bytes([b])
        normal = [i for i, s in enumerate(special) if not s and not bytes_from <= i < bytes_from + 256]
        if any(" " in pieces[i].replace(MARKER, " ").lstrip(" ") or re.match(f"{MARKER}{{2,}}[^{MARKER}]", pieces[i]) for i in normal):
            raise ValueError("a piece reaches past a space")
        order = sorted(normal, key=lambda i: (-scores[i], i))
        self.score = np.full(len(pieces), -np.inf)
        self.score[order] = -np.log(np.arange(1, len(order) + 1) * (1.0 / np.arange(1, len(order) + 1)).sum())
        self.unknown = float(self.score[order].min()) - UNKNOWN_PENALTY
        self.trie = DoubleArray({self.text[i]: i for i in normal})
        lengths = np.array([len(t) for t in self.text], np.int64)
        self.bytes_start, self.bytes_len = np.cumsum(lengths) - lengths, lengths
        self.bytes_all = np.frombuffer(b"".join(self.text), np.uint8)

    def best(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best segmentation of each word in a row, and how many each word has.

        Of equally good segmentations those with longer last pieces win.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, parts = np.zeros(len(words), np.int64), []
        for i in np.flatnonzero(sizes > LONG).tolist():
            found = self._one(words[i])
            counts[i] = len(found)
            parts.append(([i], found))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] <= LONG]
        for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            rows = np.frombuffer(b"".join([words[i] for i in places.tolist()]), np.uint8)
            found, counts[places] = self._many(rows.reshape(len(places), int(sizes[places[0]])))
            parts.append((places, found))
        starts, ids = np.cumsum(counts) - counts, np.empty(int(counts.sum()), np.int32)
        for places, found in parts:
            run, place = ragged(counts[places])
            ids[starts[places][run] + place] = found
        return ids, counts

    def _many(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, length = rows.shape
        best = np.full((length + 1, n), -np.inf)
        piece = np.full((length + 1, n), -1, np.int32)
        start = np.zeros((length + 1, n), np.int32)
        best[0] = 0.0
        columns = np.ascontiguousarray(rows.T).astype(np.int64)
        wide = 1 + (columns >= 0xC0).astype(np.int64) + (columns >= 0xE0) + (columns >= 0xF0)
        for i in range(length):
            live = np.flatnonzero(best[i] > -np.inf)
            if not len(live):
                continue
            begin, single = live, np.zeros(n, bool)
            state = np.zeros(len(live), np.int64)
            for j in range(i, length):
                state, ok = self.trie.step(state, columns[j][live])
                if not ok.all():
                    live, state = live[ok], state[ok]
                if not len(live):
                    break
                number = self.trie.value[state]
                ends = number >= 0
                if ends.any():
                    self._better(best, piece, start, i, j + 1, live[ends], number[ends], self.score[number[ends]])
                    single[live[ends & (wide[i][live] == j + 1 - i)]] = True
            lost = begin[~single[begin]]
            for w in np.flatnonzero(np.bincount(wide[i][lost], minlength=5)):
                some = lost[wide[i][lost] == w]
                self._better(best, piece, start, i, min(i + int(w), length), some, -1, self.unknown)
        taken, left, right = [], [], []
        at, alive = np.full(n, length), np.arange(n)
        while len(alive):
            p, s = piece[at[alive], alive], start[at[alive], alive]
            taken.append((alive, p))
            left.append(s)
            right.append(at[alive])
            at[alive] = s
            alive = alive[s > 0]
        row = np.concatenate([t[0] for t in taken])
        number = np.concatenate([t[1] for t in taken])
        low, high = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((low, row))
        row, number, low, high = row[order], number[order], low[order], high[order]
        size = np.where(number < 0, high - low, 1)
        which, place = ragged(size)
        ids = np.where(number[which] < 0, self.bytes_from + rows[row[which], low[which] + place].astype(np.int64), number[which])
        return ids.astype(np.int32), np.bincount(row[which], minlength=n)

    @staticmethod
    def _better(best, piece, start, i, end, rows, number, score) -> None:
        gain = best[i][rows] + score
        won = gain > best[end][rows]
        rows = rows[won]
        best[end][rows] = gain[won]
        piece[end][rows] = number[won] if isinstance(number, np.ndarray) else number
        start[end][rows] = i

    def _one(self, word: bytes) -> np.ndarray:
        """The same search for one long word."""
        base, check, value, score = self.lists()
        n = len(word)
        best, piece, start = [-np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = word[i]
            wide = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            state, single, here = 0, False, best[i]
            for j in range(i, n):
                to = base[state] + word[j]
                if check[to] != state:
                    break
                state = to
                number = value[to]
                if number >= 0:
                    single |= j + 1 - i == wide
                    if here + score[number] > best[j + 1]:
                        best[j + 1], piece[j + 1], start[j + 1] = here + score[number], number, i
            end = min(i + wide, n)
            if not single and here + self.unknown > best[end]:
                best[end], piece[end], start[end] = here + self.unknown, -1, i
            i = end
        out, end = [], n
        while end:
            begin = start[end]
            out.append([piece[end]] if piece[end] >= 0 else [self.bytes_from + b for b in word[begin:end]])
            end = begin
        return np.array(list(chain.from_iterable(reversed(out))), np.int32)

    def lists(self):
        if not hasattr(self, "_lists"):
            self._lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.score.tolist()
        return self._lists

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all pieces in a row and how many each has, put together in steps of bounded size."""
        size, parts = self.bytes_len[ids], []
        for at in range(0, len(ids), STEP):
            run, place = ragged(size[at : at + STEP])
            parts.append(self.bytes_all[self.bytes_start[ids[at : at + STEP]][run] + place].tobytes())
        return b"".join(parts), size


class Encoder:
    """Texts to ids, remembering the words it has met up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and how many each text has."""
        if len(self.known) > CACHE:
            self.clear()
        words = [self.units(t) for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.known))
        if new:
            found, size = self.vocabulary.best([(" " + w).encode() for w in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.ids, self.size = np.concatenate([self.ids, found]), np.concatenate([self.size, size])
        total = sum(map(len, words))
        index = np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, total)
        starts, size = np.cumsum(self.size) - self.size, self.size[index]
        run, place = ragged(size)
        edges = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.ids[starts[index][run] + place], np.diff(ends[edges])

    @staticmethod
    def units(text: str) -> list[str]:
        """Words without the one space before them; further spaces before a word stay with it."""
        if not text:
            return []
        text = text.replace(MARKER, " ")
        if "  " not in text and text[0] != " ":
            return text.split(" ")
        return [u[1:] for u in re.findall(r" +[^ ]*", " " + text)]
