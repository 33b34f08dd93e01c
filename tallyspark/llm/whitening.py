"""Whitening of embeddings: one pass of Welford updates, merged over partitions, then a symmetric QR eigen-solve.

Entries become whole numbers, floor(scale * entry), so that sums are exact. The distinct vectors are the fit
list. Each partition streams over its part of it and adds, row by row, the rank-one term (x - mean before)
(x - mean after)' to a d x d matrix (the terms of a slice of rows are added as one matrix product); partitions
are merged by the parallel update formula in a tree of small groups, so that no task and no driver sees more
than FAN_IN matrices at once. The driver solves the d x d covariance, of a size that does not grow with the
rows: Householder reflections to three diagonals, then implicit QR steps with Wilkinson shifts. A second
pass over the fit list measures how far the whitened covariance is from the identity.

Defined results: rows whose vector is null or holds a null, NaN or infinite entry go. Vectors of different
lengths are spaces of their own, each with its own fit; an empty vector has no components. Entries beyond
the range of a long count as its ends. A component without variance (one vector, equal entries, fewer
vectors than dimensions) has a null `whitened` and is left out of the identity error; explained is null where
nothing varies at all. Where `deviation` exceeds a long it is null. An empty table gives no rows. Repeated
rows and rows of one vec_id each keep their own row. Columns of other names pass through whiten().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import checkpoint, table

SCALE = 256
#: Partial results that one task merges.
FAN_IN = 16
#: Entries that are held as doubles at once.
AT_ONCE = 1 << 20
PARTIAL = "part long, size int, n long, high array<long>, low array<long>, mean array<double>, m2 binary"
LOW = (1 << 32) - 1


def usable(vector: str) -> Column:
    """The vector is there, and all its entries are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def fixed_point(vector: str, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


@dataclass
class Moments:
    """Count, mean and sum of centred products of rows seen so far; sums of whole entries in halves of 32 bits, so that they stay exact."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    m2: np.ndarray

    @classmethod
    def of(cls, size: int) -> Moments:
        return cls(0, np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros((size, size)))

    def carry(self) -> None:
        self.high += self.low >> 32
        self.low &= LOW

    def take(self, rows: np.ndarray) -> None:
        """Welford's update by each row in turn; the rank-one terms of all rows are added as one product."""
        if rows.dtype == np.int64:
            self.high += (rows >> 32).sum(axis=0)
            self.low += (rows & LOW).sum(axis=0)
            self.carry()
        rows = rows.astype(np.float64)
        after = self.mean + np.cumsum(rows - self.mean, axis=0) / (self.n + np.arange(1, len(rows) + 1))[:, None]
        before = np.concatenate([self.mean[None], after[:-1]])
        self.m2 += (rows - before).T @ (rows - after)
        self.n, self.mean = self.n + len(rows), after[-1]

    def merge(self, other: Moments) -> None:
        """The parallel update formula."""
        n, gap = self.n + other.n, other.mean - self.mean
        self.m2 += other.m2 + np.outer(gap, gap) * (self.n * other.n / n)
        self.mean = self.mean + gap * (other.n / n)
        self.high, self.low, self.n = self.high + other.high, self.low + other.low, n
        self.carry()

    def covariance(self) -> np.ndarray:
        return (self.m2 + self.m2.T) / 2 / self.n

    def total(self) -> list[int]:
        return [(int(h) << 32) + int(s) for h, s in zip(self.high, self.low, strict=True)]

    def row(self, part: int) -> dict:
        size = len(self.mean)
        return {"part": part, "size": size, "n": self.n, "high": self.high.tolist(), "low": self.low.tolist(), "mean": self.mean.tolist(), "m2": ((self.m2 + self.m2.T) / 2)[np.triu_indices(size)].tobytes()}

    @classmethod
    def read(cls, row: dict) -> Moments:
        size = row["size"]
        upper = np.zeros((size, size))
        upper[np.triu_indices(size)] = np.frombuffer(row["m2"])
        return cls(row["n"], np.array(row["high"], np.int64), np.array(row["low"], np.int64), np.array(row["mean"], np.float64), upper + np.triu(upper, 1).T)


ARROW = pa.schema([("part", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("m2", pa.binary())])


def by_size(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length, in slices of a bounded number of entries. No nulls."""
    offsets = np.asarray(vectors.offsets, dtype=np.int64)
    values, sizes = vectors.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, AT_ONCE // max(1, int(size)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, values[offsets[some][:, None] + np.arange(size)]


def moments(vectors: DataFrame, column: str) -> dict[int, Moments]:
    """For each length the moments of all vectors of that length (long or double entries)."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for batch in batches:
            for _, rows in by_size(batch.column(0)):
                found.setdefault(rows.shape[1], Moments.of(rows.shape[1])).take(rows)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([m.row(part) for m in found.values()], schema=ARROW)

    def join(key: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        first = Moments.read(rows[0])
        for r in rows[1:]:
            first.merge(Moments.read(r))
        return pa.Table.from_pylist([first.row(key[1].as_py())], schema=ARROW)

    parts = vectors.select(column).mapInArrow(stream, PARTIAL)
    left = vectors.rdd.getNumPartitions()
    while left > 1:
        parts = parts.groupBy("size", F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(join, PARTIAL)
        left = -(-left // FAN_IN)
    return {r["size"]: Moments.read(r.asDict()) for r in parts.collect()}  # one row for each length


def tridiagonal(a: np.ndarray) -> tuple[list[float], list[float], np.ndarray]:
    """Householder reflections: diagonal, subdiagonal and q with a = q t q'."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).tolist(), np.diag(a, -1).tolist(), q


def symmetric_qr(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, by implicit QR steps with Wilkinson shifts."""
    size = float(np.abs(a).max()) if a.size else 0.0
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    diag, off, q = tridiagonal(a / size)
    rows, last, left = np.ascontiguousarray(q.T), len(diag) - 1, sweeps * len(diag)
    tiny = np.finfo(float).eps
    while last > 0:
        if abs(off[last - 1]) <= tiny * (abs(diag[last - 1]) + abs(diag[last])):
            last -= 1
            continue
        if not left:
            raise ArithmeticError("the QR steps do not settle")
        left -= 1
        first = last - 1
        while first > 0 and abs(off[first - 1]) > tiny * (abs(diag[first - 1]) + abs(diag[first])):
            first -= 1
        half = (diag[last - 1] - diag[last]) / 2
        shift = diag[last] - off[last - 1] ** 2 / (half + math.copysign(math.hypot(half, off[last - 1]), half))
        x, z = diag[first] - shift, off[first]
        for k in range(first, last):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > first:
                off[k - 1] = r
            p, w, e = diag[k], diag[k + 1], off[k]
            diag[k], diag[k + 1] = c * c * p + 2 * c * s * e + s * s * w, s * s * p - 2 * c * s * e + c * c * w
            off[k] = c * s * (w - p) + (c * c - s * s) * e
            x = off[k]
            if k + 1 < last:
                z, off[k + 1] = s * off[k + 1], c * off[k + 1]
            rows[k], rows[k + 1] = c * rows[k] + s * rows[k + 1], c * rows[k + 1] - s * rows[k]
    order = np.argsort(-np.array(diag), kind="stable")
    vectors = rows[order].T
    return np.array(diag)[order] * size, vectors / np.linalg.norm(vectors, axis=0)


@dataclass
class Space:
    """The fit of the vectors of one length."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def __post_init__(self) -> None:
        self.mean = np.array([s / self.n for s in self.total])
        self.trace = float(self.values.sum())
        self.alive = self.values > len(self.values) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, rows: np.ndarray, most: int) -> np.ndarray:
        """Projections on the first components over the root of their variance; NaN for those without variance."""
        scale = np.where(self.alive, 1 / np.sqrt(np.where(self.alive, self.values, 1)), np.nan)[:most]
        return ((rows - self.mean) @ self.vectors[:, :most]) * scale

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of (n x - total)^2, exact; null beyond a long."""
        far = max((max(abs(self.n * int(low) - s), abs(self.n * int(high) - s)) for low, high, s in zip(rows.min(axis=0), rows.max(axis=0), self.total, strict=True)), default=0)
        if far * far * max(1, rows.shape[1]) < 1 << 63 and all(abs(s) < 1 << 62 for s in self.total) and self.n * int(np.abs(rows).max(initial=0)) < 1 << 62:
            return ((self.n * rows - np.array(self.total, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * int(x) - s) ** 2 for x, s in zip(r, self.total, strict=True)) for r in rows]
        return [x if x < 1 << 63 else None for x in exact]


def fit(vectors: DataFrame, column: str = "x") -> tuple[dict[int, Space], DataFrame]:
    """The spaces of the distinct vectors of whole numbers, and these vectors, written once."""
    distinct = checkpoint(vectors.select(column).distinct())
    spaces = {}
    for size, m in moments(distinct, column).items():
        if size:
            spaces[size] = Space(m.n, m.total(), *symmetric_qr(m.covariance()))
    return spaces, distinct


def whiten(df: DataFrame, spaces: dict[int, Space], column: str = "x", most: int | None = None, out: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """df with the array `out` of the first `most` whitened components (all by default) and the long `deviation`; both null for a length that was not fitted."""
    shared = df.sparkSession.sparkContext.broadcast(spaces)

    @arrow_udf(f"struct<{out}:array<double>,{deviation}:bigint>")
    def project(vectors: pa.Array) -> pa.Array:
        made: list = [None] * len(vectors)
        for places, rows in by_size(vectors.take(pa.array(np.arange(len(vectors)))) if vectors.offset else vectors):
            space = shared.value.get(rows.shape[1])
            if space is None:
                continue
            values = space.whitened(rows, most or rows.shape[1])
            for at, v, d in zip(places, values.tolist(), space.deviations(rows), strict=True):
                made[at] = {out: [None if x != x else x for x in v], deviation: d}
        return pa.array(made, pa.struct([(out, pa.list_(pa.float64())), (deviation, pa.int64())]))

    return df.withColumn("made_", project(column)).select(*[c for c in df.columns if c not in (out, deviation)], F.col(f"made_.{out}"), F.col(f"made_.{deviation}"))


def identity_error(distinct: DataFrame, spaces: dict[int, Space], column: str = "x", most: int | None = None) -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity over the fit list; null if nothing varies."""
    worst = []
    live = F.filter("whitened", lambda v: v.isNotNull())
    sizes = sorted(spaces)
    for size in sizes:
        own = distinct.filter(F.size(column) == size) if len(sizes) > 1 else distinct.filter(F.size(column) > 0)
        for m in moments(whiten(own, spaces, column, most).select(live.alias("w")), "w").values():
            worst += [float(np.abs(m.covariance() - np.eye(len(m.mean))).max())] if len(m.mean) else []
    return max(worst, default=None)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable embedding and component up to 4: vec_id, component, n, deviation, whitened, explained, identity_error."""
    most = 4
    vectors = table(spark, sf_dir, "embeddings").filter(usable("embedding")).select("vec_id", fixed_point("embedding").alias("x"))
    spaces, distinct = fit(vectors)
    error = identity_error(distinct, spaces, most=most)
    told = [(size, k + 1, s.n, float(v / s.trace) if s.trace > 0 else None, error) for size, s in spaces.items() for k, v in enumerate(s.values[:most])]
    facts = spark.createDataFrame(told, "size int, component int, n long, explained double, identity_error double")  # at most four rows for each length
    rows = whiten(vectors, spaces, most=most).select("vec_id", F.size("x").alias("size"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.withColumn("component", F.col("at") + 1).join(F.broadcast(facts), ["size", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
