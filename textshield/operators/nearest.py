"""Python side of the nearest-neighbour search: one running result per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

TILE = 1 << 21  # distances held at once
MERGED = 1 << 20  # candidates held at once
SLICE = 1 << 12  # pairs measured exactly at once
GROUP = 32  # rows of which the nearest counts for the bound of a tile
WIDE = 4  # a query that probes one bucket in so many is measured against all rows
EPS, EPS32 = np.finfo(np.float64).eps, float(np.finfo(np.float32).eps)
PLAIN, SHORT, TINY = 1e6, 1e-200, 1e-36  # bounds of what is multiplied in single precision


def vectors_of(column) -> np.ndarray:
    """An Arrow list column as a float64 matrix, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten()
    if column.null_count or flat.null_count or (rows and len(flat) % rows):
        raise ValueError("embeddings must be non-null vectors of one length")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if rows and (sizes != sizes[0]).any():
        raise ValueError("embeddings must be vectors of one length")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, len(flat) // max(rows, 1))


def ids_of(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def lengths(rows) -> np.ndarray:
    """Euclidean lengths, summed from left to right."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), SLICE):
        part = rows[i : i + SLICE]
        out[i : i + SLICE] = np.sqrt(np.cumsum(part * part, axis=1)[:, -1]) if part.shape[1] else 0.0
    return out


def unit(rows, square) -> np.ndarray:
    """Rows at length 1; those without length stay."""
    return rows / np.sqrt(np.where(square > 0, square, 1.0))[:, None]


def above(limit, kind) -> np.ndarray:
    """The limits as numbers of a type, rounded up."""
    return limit if kind == np.float64 else np.nextafter(limit.astype(kind), kind.type(np.inf))


def places(flags) -> np.ndarray:
    """Places of the few true ones, looked for eight at a time."""
    whole = len(flags) // 8 * 8
    at = (np.flatnonzero(flags[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flags[at]], whole + np.flatnonzero(flags[whole:])])


class Rows:
    """A batch of rows and what the product needs of them, whatever the queries."""

    def __init__(self, ids, rows, metric: str, buckets=None):
        finite = np.isfinite(rows).all(axis=1)
        self.ids, self.rows = (ids, rows) if finite.all() else (ids[finite], rows[finite])
        self.metric, self.buckets = metric, buckets
        self.square = (self.rows * self.rows).sum(axis=1)
        self.length = lengths(self.rows) if metric == "cosine" else None
        self.single = _right(self.rows, self.square, metric) if is_plain(self.rows, self.square, metric) else None
        self._by_id = None

    def places_of(self, names, owners) -> tuple[np.ndarray, np.ndarray]:
        """Where rows have the ids of queries, as queries in order and places of rows; a name belongs to its first owner."""
        if self._by_id is None:
            self._by_id = np.argsort(self.ids, kind="stable")
            self._sorted = self.ids[self._by_id]
        first = np.r_[True, names[1:] != names[:-1]][: len(names)]
        lo, hi = (np.searchsorted(self._sorted, names[first], side) for side in ("left", "right"))
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        queries, rows = np.repeat(owners[first], n), self._by_id[at]
        order = np.argsort(queries, kind="stable")
        return queries[order], rows[order]

    def taken(self, kept, buckets=None) -> Rows:
        return Rows(self.ids[kept], self.rows[kept], self.metric, buckets)


def is_plain(vectors, square, metric: str) -> bool:
    """Whether single precision holds the vectors and their squares."""
    inside = len(vectors) == 0 or vectors.shape[1] == 0 or max(-vectors.min(), vectors.max()) <= PLAIN
    return bool(inside and (metric != "cosine" or not ((square > 0) & (square < SHORT)).any()))


def _left(queries, square, metric: str) -> np.ndarray:
    """The query side of the product; with the row side it gives the distance but for a number of the query."""
    if metric == "l2":
        return np.concatenate([-2.0 * queries, np.ones((len(queries), 1))], axis=1, dtype=np.float32, casting="same_kind")
    return (-unit(queries, square) if metric == "cosine" else -queries).astype(np.float32)


def _right(rows, square, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.concatenate([rows, square[:, None]], axis=1, dtype=np.float32, casting="same_kind")
    return (unit(rows, square) if metric == "cosine" else rows).astype(np.float32)


class Nearest:
    """The k nearest rows of each query among all batches added so far.

    A matrix product finds the rows that can still count, within the rounding error of the
    product. Only those are measured again, summing from left to right, so that the result does not
    depend on how rows fall into batches. Ties go to the smaller id. Rows with a component that is
    no finite number are never near, and a query with one finds nothing; by cosine, one with a NaN has
    the distance 1 to all rows.

    The product is taken in single precision with the slack that this needs; vectors whose squares
    single precision cannot hold are multiplied in double precision.
    """

    def __init__(self, query_ids, queries, k: int, metric: str, exclude_self: bool):
        self.query_ids, self.k, self.metric, self.exclude_self = query_ids, k, metric, exclude_self
        finite = np.isfinite(queries).all(axis=1)
        searched = finite | np.isnan(queries).any(axis=1) if metric == "cosine" else finite
        self.queries = queries = queries if finite.all() else np.where(finite[:, None], queries, 0.0)
        self.square = (queries * queries).sum(axis=1)
        self.length = lengths(queries) if metric == "cosine" else None
        self.cut = np.where(searched, np.inf, -np.inf)
        self.q = np.empty(0, dtype=np.int64)
        self.d = np.empty(0)
        self.ids = None
        self.order = np.argsort(query_ids, kind="stable") if exclude_self else None
        self.names = query_ids[self.order] if exclude_self else None
        self.single = _left(queries, self.square, metric) if is_plain(queries, self.square, metric) else None

    def add(self, ids, rows) -> None:
        self.add_rows(Rows(ids, rows, self.metric))

    def add_rows(self, rows: Rows) -> None:
        """The same for a batch that other blocks of queries are measured against too."""
        if len(rows.ids) == 0 or len(self.queries) == 0:
            return
        if rows.rows.shape[1] != self.queries.shape[1]:
            raise ValueError("queries and chunks must have vectors of one length")
        if self.ids is None:
            self.ids = rows.ids[:0]
        self._measure(rows)

    def _measure(self, rows) -> None:
        self._near(np.arange(len(self.queries)), rows)

    def _near(self, chosen, block) -> None:
        """Measure rows against the chosen queries, some of them at a time."""
        found, waiting, lo, collapsed = [], 0, 0, False
        own = block.places_of(self.names, self.order) if self.exclude_self else None
        while lo < len(chosen):
            tile = max(1, TILE // len(block.ids))
            some = chosen[lo : lo + tile]
            q, r = self._candidates(some, block, own)
            if not collapsed and len(q) > 16 * self.k * len(some):
                self._merge(found, block)
                found, waiting, collapsed = [], 0, True
                block = self._without_surplus_copies(block)
                own = block.places_of(self.names, self.order) if self.exclude_self else None
                continue
            found.append((q, r))
            waiting += len(q)
            if waiting > MERGED:
                self._merge(found, block)
                found, waiting = [], 0
            lo += tile
        self._merge(found, block)

    def _without_surplus_copies(self, block) -> Rows:
        """Of equal vectors only the smallest ids can be among the k nearest."""
        keep = self.k + (1 if self.exclude_self else 0)
        _, group = np.unique(block.rows, axis=0, return_inverse=True)
        group = group.ravel()
        by_id = np.lexsort((block.ids, group))
        start = np.r_[True, group[by_id][1:] != group[by_id][:-1]]
        place = np.arange(len(by_id)) - np.maximum.accumulate(np.where(start, np.arange(len(by_id)), 0))
        kept = np.sort(by_id[place < keep])
        return block.taken(kept, None if block.buckets is None else block.buckets[kept])

    def _candidates(self, chosen, block, own):
        """Pairs of a chosen query and a row that can be among the k nearest so far."""
        near, offset, slack = self._distances(chosen, block)
        if own:
            mine, place = own
            first, last = np.searchsorted(mine, (chosen[0], chosen[-1] + 1))
            at = np.searchsorted(chosen, mine[first:last])
            known = chosen[at] == mine[first:last]
            near[at[known], place[first:last][known]] = np.inf
        limit = above(self.cut[chosen] - offset + slack, near.dtype)
        known = near.shape[1] <= self.k or not np.isposinf(limit).any()
        close = near <= limit[:, None] if known else None
        if near.shape[1] > self.k and (close is None or np.count_nonzero(close) > 4 * self.k * len(chosen)):
            limit = np.minimum(limit, above(self._bound(near, chosen, block) + 2 * slack, near.dtype))
            close = near <= limit[:, None]
        if not self._in_single(block) or np.isposinf(limit).any():
            close &= np.isfinite(near)
        q, r = np.divmod(places(close.ravel()), near.shape[1])
        return self._probing(chosen[q], r, block)

    def _probing(self, q, r, block):
        return q, r

    def _bound(self, near, chosen, block) -> np.ndarray:
        """For each query a distance that k rows at least do not exceed: the k-th of the least ones of groups of rows."""
        n, rows = near.shape
        groups = rows // GROUP
        if groups < 4 * self.k:
            return np.partition(near, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
        least = near[:, : groups * GROUP].reshape(n, GROUP, groups).min(axis=1)
        return np.partition(least, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)

    def _in_single(self, block) -> bool:
        return self.single is not None and block.single is not None

    def _distances(self, chosen, block):
        """Distances less a number of each query, that number, and the rounding error they may have."""
        dim = block.rows.shape[1]
        q_sq, r_sq = self.square[chosen], block.square
        if self._in_single(block):
            whole = len(chosen) == chosen[-1] - chosen[0] + 1
            left = self.single[chosen[0] : chosen[-1] + 1] if whole else self.single[chosen]
            near = left @ block.single.T
            unit_error = 4 * (dim + 8) * EPS32
            if self.metric == "l2":
                return near, q_sq, unit_error * (q_sq + r_sq.max() + dim * TINY) + dim * TINY
            offset = np.full(len(chosen), 1.0)
            if self.metric == "ip":
                return near, offset, unit_error * (1.0 + np.sqrt(q_sq * r_sq.max())) + dim * TINY
            return near, offset, np.full(len(chosen), unit_error)
        product = self.queries[chosen] @ block.rows.T
        if self.metric == "l2":
            near = q_sq[:, None] + r_sq[None, :] - 2.0 * product
            slack = 8 * (dim + 4) * EPS * (q_sq + r_sq.max())
        elif self.metric == "ip":
            near = 1.0 - product
            slack = 8 * (dim + 4) * EPS * (1.0 + np.sqrt(q_sq * r_sq.max()))
        else:
            length = np.sqrt(q_sq)[:, None] * np.sqrt(r_sq)[None, :]
            near = 1.0 - np.divide(product, length, out=np.zeros_like(product), where=length > 0)
            slack = np.full(len(chosen), 16 * (dim + 8) * EPS)
        return near, np.zeros(len(chosen)), slack

    def _exact(self, q, r, block):
        out = np.empty(len(q))
        for i in range(0, len(q), SLICE):
            to, of = q[i : i + SLICE], r[i : i + SLICE]
            a, b = self.queries[to], block.rows[of]
            if self.metric == "l2":
                a -= b
                a *= a
                out[i : i + SLICE] = np.cumsum(a, axis=1)[:, -1]
                continue
            a *= b
            product = np.cumsum(a, axis=1)[:, -1]
            if self.metric == "cosine":
                length = self.length[to] * block.length[of]
                product = np.divide(product, length, out=np.zeros_like(product), where=length > 0)
            out[i : i + SLICE] = 1.0 - product
        return out + 0.0

    def _merge(self, found, block) -> None:
        """Fold the candidates of several tiles into the running result."""
        if not any(len(q) for q, _ in found):
            return
        q, r = (np.concatenate(side) for side in zip(*found))
        # tiles follow each other, so only the results of their queries change
        first, last = np.searchsorted(self.q, (q.min(), q.max() + 1))
        all_q = np.concatenate([self.q[first:last], q])
        all_d = np.concatenate([self.d[first:last], self._exact(q, r, block)])
        all_ids = np.concatenate([self.ids[first:last], block.ids[r]])
        order = np.lexsort((all_ids, all_d, all_q))
        all_q, all_d, all_ids = all_q[order], all_d[order], all_ids[order]
        at = np.arange(len(all_q))
        start = np.r_[True, all_q[1:] != all_q[:-1]]
        place = at - np.maximum.accumulate(np.where(start, at, 0))
        kept = place < self.k
        all_q, all_d, full = all_q[kept], all_d[kept], place[kept] == self.k - 1
        self.cut[all_q[full]] = all_d[full]
        around = lambda old, new: np.concatenate([old[:first], new, old[last:]])
        self.q, self.d, self.ids = around(self.q, all_q), around(self.d, all_d), around(self.ids, all_ids[kept])

    def table(self, schema: pa.Schema) -> pa.RecordBatch:
        if self.ids is None:
            empty = [pa.array([], type=f.type) for f in schema]
            return pa.RecordBatch.from_arrays(empty, schema=schema)
        columns = [self.query_ids[self.q], self.ids, self.d]
        arrays = [pa.array(c.tolist() if c.dtype.kind == "U" else c, type=f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


class ProbedNearest(Nearest):
    """The same among the rows in the buckets that each query probes."""

    def __init__(self, query_ids, queries, k: int, metric: str, exclude_self: bool, planes: Planes, probes: int):
        super().__init__(query_ids, queries, k, metric, exclude_self)
        self.planes = planes
        self.side = planes.margins(queries)
        self.reach = planes.reach(self.side, probes)
        # where a query probes most buckets, one product over all rows beats one for each bucket
        self.wide = WIDE * probes >= 1 << planes.bits

    def _measure(self, rows) -> None:
        bucket = self.planes.buckets(rows.rows)
        order = np.argsort(bucket, kind="stable")
        if self.wide:
            self._near(np.arange(len(self.queries)), rows.taken(order, bucket[order]))
            return
        edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
        for first, last in zip(edges[:-1], edges[1:]):
            part = order[first:last]
            chosen = np.flatnonzero(self.planes.cost(self.side, bucket[part[0]]) <= self.reach)
            if len(chosen):
                self._near(chosen, rows.taken(part))

    def _bound(self, near, chosen, block) -> np.ndarray:
        if block.buckets is None:
            return super()._bound(near, chosen, block)
        # rows are ordered by bucket, so that a bucket is a group
        edges = np.flatnonzero(np.r_[True, np.diff(block.buckets) != 0])
        probed = (self.planes.costs(self.side[chosen]) <= self.reach[chosen][:, None])[:, block.buckets[edges]]
        if len(edges) >= 4 * self.k:
            least = np.where(probed, np.minimum.reduceat(near, edges, axis=1), np.inf)
        else:
            sizes = np.diff(np.r_[edges, near.shape[1]])
            least = np.where(np.repeat(probed, sizes, axis=1), near, np.inf)
        return np.partition(least, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)

    def _probing(self, q, r, block):
        if block.buckets is None:
            return q, r
        kept = self.planes.cost(self.side[q], block.buckets[r]) <= self.reach[q]
        return q[kept], r[kept]


class Planes:
    """Planes that cut the space into buckets, and the order in which a query probes them.

    Bit ``b`` of a bucket tells on which side of plane ``b`` a vector lies. A bucket costs a query the
    squares of its distances to the planes that part the two, so its own bucket costs nothing.
    """

    def __init__(self, normals: np.ndarray, offsets: np.ndarray):
        self.normals, self.offsets = normals, offsets

    @property
    def bits(self) -> int:
        return len(self.normals)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        # summed from left to right, so that the side of a plane does not depend on the batch
        out = np.zeros((len(rows), self.bits))
        for i in range(rows.shape[1] if self.bits else 0):
            out += rows[:, i : i + 1] * self.normals[:, i]
        return out - self.offsets

    def buckets(self, rows: np.ndarray) -> np.ndarray:
        return (self.margins(rows) > 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def cost(self, margins: np.ndarray, bucket) -> np.ndarray:
        """What a bucket costs every query, or a bucket of its own for each."""
        total = np.zeros(len(margins))
        for b in range(self.bits):
            other = (margins[:, b] > 0) != ((bucket >> b) & 1 == 1)
            total += np.where(other, margins[:, b] * margins[:, b], 0.0)
        return total

    def costs(self, margins: np.ndarray) -> np.ndarray:
        """What every bucket costs every query, added in the order of the planes as in :meth:`cost`."""
        total = np.zeros((len(margins), 1))
        for b in range(self.bits):
            side, square = margins[:, b : b + 1] > 0, margins[:, b : b + 1] * margins[:, b : b + 1]
            total = np.concatenate([total + np.where(side, square, 0.0), total + np.where(side, 0.0, square)], axis=1)
        return total

    def reach(self, margins: np.ndarray, probes: int) -> np.ndarray:
        """The cost of the last bucket that each query probes; buckets of equal cost are all probed."""
        out, step = np.empty(len(margins)), max(1, TILE >> self.bits)
        for i in range(0, len(margins), step):
            out[i : i + step] = np.partition(self.costs(margins[i : i + step]), probes - 1, axis=1)[:, probes - 1]
        return out
