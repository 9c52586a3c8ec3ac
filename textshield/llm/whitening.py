"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

The matrix of centred rows is only touched by products: one pass over the table gives Xv, another
one Xᵀu. Left vectors are as long as the table; every one is X times a short vector, so they are
never stored but made again from the rows, for full reorthogonalisation as well. What reaches the
driver are sums with as many numbers as a vector has entries. The small bidiagonal matrix has the
singular values of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from textshield.llm.shipping import ship
from textshield.session import write_once

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries of one block of rows, 4 MB.
BLOCK = 1 << 19
#: Scaled entries must be smaller for sums of squares to be exact.
LIMIT = 1 << 37
#: A product of this size against the largest is rounding, as is a singular value a hundred times as large.
NOTHING = 1e-12
SEED = 12


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers; never null."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _grid(scale: int, shift: int):
    def grid(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows as whole numbers with their keys, and exact sums of entries and of their squares."""
        for batch in stream:
            values = batch.column(batch.schema.get_field_index("vector"))
            keys = batch.column(batch.schema.get_field_index("key"))
            n = batch.num_rows
            if not n:
                continue
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(scale * flat)
            if np.abs(x).max() >= LIMIT:
                raise ValueError("an entry is too large for exact sums")
            x = (x.astype(np.int64) + shift).reshape(n, -1)
            step = max(1, BLOCK // x.shape[1])
            for at in range(0, n, step):
                part = np.ascontiguousarray(x[at : at + step])
                edges = pa.array([0, len(part)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, keys.slice(at, len(part))), pa.array([part.tobytes()], pa.binary())], ["keys", "block"])

    return grid


def _rows(block: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(block, np.int64).reshape(-1, dims)


def _sums(dims: int):
    def sums(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for block in batch.column(0).to_pylist():
                x = _rows(block, dims)
                # halves of the squares keep every sum of a block below 64 bits
                low, high = x & 0xFFFF, x >> 16
                parts = [x.sum(0), (low * low).sum(0), (low * high).sum(0), (high * high).sum(0)]
                yield pa.RecordBatch.from_arrays([pa.array([[len(x)] * dims]), *(pa.array([p.tolist()]) for p in parts)], ["n", "s", "ll", "lh", "hh"])

    return sums


class Rows:
    """The rows as blocks of whole numbers, their exact sums, and products with the centred matrix."""

    def __init__(self, blocks: DataFrame, dims: int):
        self.blocks, self.dims = blocks, dims
        kind = "array<bigint>"
        rows = blocks.select("block").mapInArrow(_sums(dims), ", ".join(f"{name} {kind}" for name in ("n", "s", "ll", "lh", "hh")))
        each = rows.select(F.posexplode(F.arrays_zip("n", "s", "ll", "lh", "hh")).alias("at", "v")).groupBy("at")
        found = sorted(each.agg(*[F.sum(F.col(f"v.{name}").cast("decimal(38,0)")).alias(name) for name in ("n", "s", "ll", "lh", "hh")]).collect())
        self.n = int(found[0]["n"]) if found else 0
        self.sums = [int(r["s"]) for r in found]
        squares = [int(r["ll"]) + (int(r["lh"]) << 17) + (int(r["hh"]) << 32) for r in found]
        #: n² times the sum of all variances, exactly
        self.spread = sum(self.n * q - s * s for q, s in zip(squares, self.sums))

    def total(self, function: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over blocks of what ``function`` makes of the centred rows of a block, ``size`` numbers."""
        dims, n, sums = self.dims, self.n, self.sums

        def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size)
            for batch in stream:
                for block in batch.column(0).to_pylist():
                    out += function(centred(_rows(block, dims), n, sums))
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()])], ["part"])

        parts = self.blocks.select("block").mapInArrow(partial, "part array<double>").select(F.posexplode("part").alias("at", "v"))
        out = np.zeros(size)
        for row in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[row["at"]] = row["v"]
        return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Rows less their mean, with one rounding for each entry."""
    return exact_offsets(x, n, sums).astype(np.float64) / n


def exact_offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``, in Python numbers where 64 bits might not hold it."""
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    kind = np.int64 if most < 1 << 61 else object
    return x.astype(kind) * n - np.array(sums, kind)


def _project(w: np.ndarray, left: np.ndarray):
    """The parts of Xw along the left vectors X left."""
    return lambda c: (c @ left).T @ (c @ w)


def _apply(w: np.ndarray):
    """u = Xw: its squared length, then Xᵀu."""

    def apply(c: np.ndarray) -> np.ndarray:
        u = c @ w
        return np.concatenate([[u @ u], c.T @ u])

    return apply


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(rows: Rows, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors as columns and the upper bidiagonal matrix of the centred rows.

    Each step takes Xv, frees it of all former left vectors, and applies Xᵀ to it, freed of all
    former right vectors: two passes over the table. Where a product vanishes, a random vector that
    is orthogonal to the former ones starts anew, so that values of any multiplicity are found. All
    dimensions are taken unless ``steps`` is less, which makes the values approximate.
    """
    dims = rows.dims
    steps = min(steps or dims, dims)
    random = np.random.default_rng(SEED)
    right, left, small = np.zeros((dims, 0)), np.zeros((dims, 0)), np.zeros((steps, steps))
    v = random.standard_normal(dims)
    v /= np.linalg.norm(v)
    largest = 0.0
    for j in range(steps):
        right = np.column_stack([right, v])
        w = v
        if left.shape[1]:
            w = v - left @ rows.total(_project(v, left), left.shape[1])
        found = rows.total(_apply(w), dims + 1)
        alpha = float(np.sqrt(found[0]))
        largest = max(largest, alpha)
        if alpha > NOTHING * largest:
            small[j, j] = alpha
            left = np.column_stack([left, w / alpha])
            # Xᵀu less its part along v, which is alpha
            following = _orthogonal(found[1:] / alpha, right)
        else:
            left = np.column_stack([left, np.zeros(dims)])
            following = np.zeros(dims)
        beta = float(np.linalg.norm(following))
        largest = max(largest, beta)
        if j + 1 == steps:
            break
        if beta > NOTHING * largest:
            small[j, j + 1] = beta
            v = following / beta
        else:
            v = _orthogonal(random.standard_normal(dims), right)
            v /= np.linalg.norm(v)
        v = _orthogonal(v, right)
        v /= np.linalg.norm(v)
    return right, small


def _second_moment(weights: np.ndarray):
    """Sums and products of the whitened columns."""

    def moments(c: np.ndarray) -> np.ndarray:
        white = c @ weights
        return np.concatenate([white.sum(0), (white.T @ white).reshape(-1)])

    return moments


def _whitened(load, dims: int):
    def whitened(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, weights, explained, error = load()
        k = weights.shape[1]
        for batch in stream:
            for i in range(batch.num_rows):
                x = _rows(batch.column(1)[i].as_py(), dims)
                keys = batch.column(0)[i].values
                white = centred(x, n, sums) @ weights
                offsets = exact_offsets(x, n, sums)
                largest = int(np.abs(offsets).max(initial=0))
                offsets = offsets if largest < 1 << 31 and largest * largest * dims < 1 << 62 else offsets.astype(object)
                deviation = (offsets * offsets).sum(1)
                many = len(x)
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(np.repeat(np.arange(many), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n, np.int64)),
                    pa.array([d if d < 1 << 63 else None for d in np.repeat(deviation, k).tolist()], pa.int64()), pa.array(white.reshape(-1)), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, error)),
                ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whitened


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row and component: ``key, component, n, deviation, whitened, explained, identity_error``.

    A vector becomes whole numbers ``floor(scale c) + shift`` and is projected, less the mean, on the
    unit eigenvectors of the covariance (divisor ``n``) by falling eigenvalue, over the root of the
    eigenvalue. ``deviation`` is the exact sum of ``(n x - S)²``, null if 64 bits do not hold it;
    ``explained`` the share of the component in the trace; ``identity_error`` the largest entry of
    the covariance of all whitened values less the identity.

    Rows with a null vector, or with null or non-finite entries, or none, are left out, as are vectors
    of another than the most frequent length (the longer on ties). There are as many components as
    eigenvalues above zero, so a table without rows, or of equal rows, gives an empty result. Repeated
    rows count and come back each; a null key stays null; other columns are not read. Eigenvectors
    of equal eigenvalues are any basis of their space. An entry of 2**37 or more after scaling is an error.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType
    schema = StructType([
        StructField(key, kind), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.filter(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims = sizes["size"]
    blocks = rows.filter(F.size("vector") == dims).mapInArrow(_grid(scale, shift), StructType([StructField("keys", ArrayType(kind)), *spark.range(0).select(F.lit(b"").alias("block")).schema]))
    table = Rows(write_once(blocks, "vectors"), dims)
    right, small = bidiagonalise(table)
    _, values, turned = np.linalg.svd(small)
    k = min(components, int((values > 100 * NOTHING * max(values[0], NOTHING)).sum()))
    if not k or table.spread == 0:
        return spark.createDataFrame([], schema)
    directions = right @ turned[:k].T
    # signs do not matter, but they are the same in every run
    directions *= np.sign(directions[np.abs(directions).argmax(0), range(k)])
    roots = values[:k] / np.sqrt(table.n)
    weights = directions / roots
    sums = table.total(_second_moment(weights), k + k * k) / table.n
    mean, moment = sums[:k], sums[k:].reshape(k, k)
    error = float(np.abs(moment - np.outer(mean, mean) - np.eye(k)).max())
    explained = roots**2 / (table.spread / table.n**2)
    load = ship(spark, (table.n, table.sums, weights, explained, error))
    out = table.blocks.mapInArrow(_whitened(load, dims), StructType([StructField("key", kind), *schema.fields[1:]]))
    return out.withColumnRenamed("key", key)
