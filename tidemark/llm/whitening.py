"""Embedding whitening from an exact, bit-sliced scatter matrix.

A vector's entries become integers x = floor(1024 c) + 100000. A task takes some thousands of vectors at a time, shifts each dimension by its
least value there, and packs the bit planes of the shifted numbers across rows into 64-bit words. The cross-product of two
dimensions is the sum of 2^(a + b) times the set bits of plane a of the one AND plane b of the other, so no rounding
occurs; shifts are taken back by sums. Blocks' cross-products are Python integers of any size, added up by Spark as decimals, one row a pair
of dimensions and task. The driver receives one matrix: its size is that of the dimensions, whatever the rows. n sum(x x') - S S' is formed in
integers, so centring loses nothing, and only then divided and given to eigh.

The check of the result is a pass over the rows too: identity_error comes from the sums of the whitened components and of their products.

A row is left out whose vector is null or empty or holds a null or non-finite entry. The vectors' dimension is the most frequent one among the rest (the
smaller of two as frequent); vectors of other dimensions are left out, as they have no place in the matrix. Components whose variance is
rounding alone (below 1e-12 of the trace: copies, constant or dependent dimensions, fewer vectors than dimensions) are left out, so
a row may have fewer than `most` components, none if all vectors are equal. A component's sign makes its largest entry positive. deviation
is null where it does not fit 64 bits; deviation_exact has it as a decimal. Entries beyond 2^60 in x are an error. Repeated rows are counted and
returned one by one; a null id is kept; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import trimmed

SCALE, SHIFT = 1024, 100_000
#: vectors of a block
_BLOCK = 1 << 15
_LEAST = 1e-12
_EXACT = pa.decimal128(38, 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The integers x of vectors that all have `dim` finite entries."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = np.floor(SCALE * c)
    if len(x) and np.abs(x).max() >= 2.0**60:
        raise ValueError("an entry of a vector is too large for the integers of the scatter matrix")
    return x.astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, most: int = _BLOCK) -> Iterator[np.ndarray]:
    """The integers of at most so many vectors at a time."""
    waiting, size = [], 0
    for batch in batches:
        x = _matrix(batch.column("vector"), dim)
        for i in range(0, len(x), most):
            waiting.append(x[i : i + most])
            size += len(waiting[-1])
            if size >= most:
                yield np.concatenate(waiting)
                waiting, size = [], 0
    if size:
        yield np.concatenate(waiting)


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the columns of y (not negative), packed across rows: words by plane, and each column's first plane."""
    bits = np.array([int(v).bit_length() for v in (y.max(axis=0) if len(y) else np.zeros(y.shape[1], np.int64))])
    first = np.concatenate([[0], np.cumsum(bits)])
    words = np.zeros((first[-1], -(-len(y) // 64) * 8), np.uint8)
    for j, n in enumerate(bits.tolist()):
        for b in range(n):
            packed = np.packbits((y[:, j] >> b).astype(np.uint8) & 1)
            words[first[j] + b, : len(packed)] = packed
    return words.view(np.uint64), first


def cross_products(y: np.ndarray) -> list[list[int]]:
    """Exact sums over rows of y_i y_j for j >= i, by weighted AND-popcounts of bit planes."""
    words, first = planes(y)
    dim = y.shape[1]
    level = np.concatenate([np.arange(n) for n in np.diff(first)]) if first[-1] else np.zeros(0, np.int64)
    out = [[0] * dim for _ in range(dim)]
    owner = np.repeat(np.arange(dim), np.diff(first))
    for i in range(dim):
        later = slice(first[i], first[-1])
        for a in range(first[i], first[i + 1]):
            counts = np.bitwise_count(words[a] & words[later]).sum(axis=1, dtype=np.int64)
            # counts stay below 2^16, so 40 planes of a dimension add up in 64 bits; wider ones in parts of 40
            for part in range(0, int(level[later].max(initial=0)) + 1, 40):
                own = (level[later] >= part) & (level[later] < part + 40)
                sums = np.zeros(dim, np.int64)
                np.add.at(sums, owner[later][own], counts[own] << (level[later][own] - part))
                for j in np.flatnonzero(sums).tolist():
                    out[i][j] += int(sums[j]) << (int(level[a]) + part)
    return out


def scatter(batches: Iterator[np.ndarray], dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, sums and cross-products (j >= i) of all blocks, exact."""
    n, total, cross = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    for x in batches:
        low = x.min(axis=0)
        y = x - low
        sums, low, m = [int(v) for v in _exact_sums(y)], low.tolist(), len(x)
        products = cross_products(y)
        for i in range(dim):
            for j in range(i, dim):
                cross[i][j] += products[i][j] + low[i] * sums[j] + low[j] * sums[i] + m * low[i] * low[j]
            total[i] += sums[i] + m * low[i]
        n += m
    return n, total, cross


def _exact_sums(y: np.ndarray) -> np.ndarray:
    """Sums of at most 2^15 numbers below 2^62 each, halves apart."""
    return (y >> 31).sum(axis=0).astype(object) * (1 << 31) + (y & ((1 << 31) - 1)).sum(axis=0).astype(object)


@dataclass
class Model:
    dim: int
    n: int
    sums: list[int]
    #: eigenvectors by column, eigenvalues, shares of the trace
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, with the integer part of S / n taken off exactly first."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n x - S)^2, exact: in 64 bits where they fit."""
        low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
        most = max((abs(self.n * v - s) for side in (low, high) for v, s in zip(side, self.sums, strict=True)), default=0)
        if most * most * max(1, self.dim) < 1 << 63:
            # n x - S is small though n x may not be: both wrap alike
            own = x * np.int64(self.n) - np.array([s & 0xFFFFFFFFFFFFFFFF for s in self.sums], np.uint64).view(np.int64)
            return (own * own).sum(axis=1).tolist()
        own = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return (own * own).sum(axis=1).tolist()


def model_of(n: int, sums: list[int], cross: list[list[int]], most: int) -> Model:
    """Components by falling eigenvalue from exact sums and cross-products (j >= i)."""
    dim = len(sums)
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * cross[i][j] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v) if dim else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    kept = [k for k in range(min(most, dim)) if values[k] > _LEAST * trace]
    vectors = vectors[:, kept]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))]
    return Model(dim, n, sums, vectors * np.sign(largest), values[kept], values[kept] / trace if trace > 0 else np.zeros(len(kept)))


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and vector of the rows that count, and their dimension."""
    entries = F.col(vector).cast("array<double>")
    chosen = table.select(F.col(vec_id).cast("long").alias("vec_id"), entries.alias("vector"))
    fine = chosen.where((F.size("vector") > 0) & F.coalesce(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    first = fine.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = first["dim"] if first else 0
    return fine.where(F.size("vector") == dim), dim


def fitted(rows: DataFrame, dim: int, most: int = 8) -> Model:
    """The components of all rows (vector)."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = scatter(_blocks(batches, dim), dim)
        if n:
            found = [(-1, -1, n), *[(i, -1, s) for i, s in enumerate(sums)], *[(i, j, cross[i][j]) for i in range(dim) for j in range(i, dim)]]
            # 38 digits are the most that a decimal has: low and high parts are added up on their own
            parts = [[Decimal(v % 10**18) for *_, v in found], [Decimal(v // 10**18) for *_, v in found]]
            yield pa.record_batch([pa.array([i for i, *_ in found], pa.int32()), pa.array([j for _, j, _ in found], pa.int32()), *[pa.array(p, pa.decimal128(28, 0)) for p in parts]], ["i", "j", "low", "high"])

    parts = rows.select("vector").mapInArrow(trimmed(sliced), "i int, j int, low decimal(28,0), high decimal(28,0)")
    found = {(r["i"], r["j"]): int(r["high"]) * 10**18 + int(r["low"]) for r in parts.groupBy("i", "j").agg(F.sum("low").alias("low"), F.sum("high").alias("high")).collect()}
    if not found:
        return Model(dim, 0, [], np.zeros((dim, 0)), np.zeros(0), np.zeros(0))
    return model_of(found[-1, -1], [found[i, -1] for i in range(dim)], [[found.get((i, j), 0) for j in range(dim)] for i in range(dim)], most)


def identity_error(rows: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity; 0 without components."""
    k = len(model.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches, model.dim):
            w = model.whitened(x)
            sums += w.sum(axis=0)
            products += w.T @ w
        yield pa.record_batch([pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], ["sums", "products"])

    if not k:
        return 0.0
    found = rows.select("vector").mapInArrow(trimmed(moments), "sums array<double>, products array<double>")
    each = found.select(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(k)], *[F.sum(F.col("products")[i * k + j]).alias(f"p{i}_{j}") for i in range(k) for j in range(k)]).first()
    mean = np.array([each[f"s{i}"] for i in range(k)]) / model.n
    # the rows are centred before they are multiplied; what is left of their mean is rounding
    covariance = np.array([[each[f"p{i}_{j}"] for j in range(k)] for i in range(k)]) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact: a row for each vector and component."""
    rows, dim = usable(table, vec_id, vector)
    model = fitted(rows, dim, most)
    error, k = identity_error(rows, model), len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column("vector"), dim)
            m, deviation = len(x), model.deviations(x)
            fit = [d if d < 1 << 63 else None for d in deviation]
            repeat = np.repeat(np.arange(m), k)
            yield pa.record_batch({
                "vec_id": batch.column("vec_id").take(pa.array(repeat)), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), "n": pa.array(np.full(m * k, model.n), pa.int64()),
                "deviation": pa.array(fit, pa.int64()).take(pa.array(repeat)), "whitened": pa.array(model.whitened(x).ravel()), "explained": pa.array(np.tile(model.explained, m)),
                "identity_error": pa.array(np.full(m * k, error)), "deviation_exact": pa.array([Decimal(d) if d < 10**38 else None for d in deviation], _EXACT).take(pa.array(repeat)),
            })

    return rows.mapInArrow(trimmed(project), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
