"""Whitening of embeddings by incremental eigendecomposition.

1. ``whole``: each entry c becomes floor(64 c) + 1000000. Sums of every dimension are exact.
2. ``spectrum``: a task goes through its vectors and keeps their number, mean, and the eigenvalues and
   eigenvectors of their scatter; each vector, centred at the mean so far, is a rank-one update of these,
   solved by its secular equation with deflation (``secular``). Two spectra become one by rank-one
   updates with the eigenvectors of the second and with the difference of the means. Tasks' spectra meet
   a few at a time, in rounds.
3. ``refined``: all vectors, centred at the exact mean, are projected on the eigenvectors, and the
   eigenvectors of that small covariance turn them (Rayleigh-Ritz). Then the covariance of the
   whitened vectors is measured against the identity.
4. ``whitened``: a row for each vector and component.

Eigenvectors are numbered by falling eigenvalue; their entry of largest size is positive. An eigenvalue of
less than ``ZERO`` of the trace counts as none, as whitening would divide by it: such components have no
rows, so one vector alone or all equal ones give an empty result. Vectors of different lengths make separate
fit lists. Null vectors, vectors with null or non-finite entries and those with an entry beyond 2^62 / 64 take
no part; empty ones have no components. Rows with a null id, repeated ids and equal rows are rows like
others. A squared deviation beyond 64 bits is null. Further columns are not read.

An update takes some d^3 steps for d dimensions. What leaves a task, reaches the driver or is broadcast is d^2
numbers, whatever the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from shiftlens.llm.common import kept_aside
from shiftlens.llm.secular import Spectrum

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
ZERO = 1e-11
#: Spectra that meet in one task.
MEET = 8
END = (1 << 63) - 1

SUMMARY = "width int, part bigint, n bigint, mean array<double>, scatter array<double>, vectors array<double>"


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, x``: usable rows with their whole entries."""
    scaled = F.transform(F.col(vector), lambda c: SCALE * c.cast("double"))
    rows = vectors.select(F.col(key).alias("id"), scaled.alias("x"))
    # NaN compares as greater than any number
    fits = lambda c: c.isNotNull() & (F.abs(c) < float(1 << 62))
    usable = F.forall("x", fits)
    # a plan may take the entries before it drops rows, so this must not overflow on any
    shifted = F.transform("x", lambda c: F.floor(F.when(fits(c), c)) + F.lit(SHIFT).cast("bigint"))
    return rows.where(F.coalesce(usable, F.lit(False))).select("id", shifted.alias("x"))


class Totals:
    """Number of vectors of one length, and the exact sums of their entries."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        # a sum is n times its quotient, plus its remainder
        self.quotient = np.array([s // n for s in sums], np.int64)
        self.remainder = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; what is subtracted first is exact."""
        return (x - self.quotient) - self.remainder / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2."""
        y = x - self.quotient
        size = float(np.abs(y).max(initial=0)) + 1
        if x.shape[1] * (self.n * size) ** 2 < END:
            d = self.n * y - self.remainder
            return (d * d).sum(axis=1).tolist()
        rest = self.remainder.tolist()
        found = (sum((self.n * a - b) ** 2 for a, b in zip(row, rest, strict=True)) for row in y.tolist())
        return [d if d <= END else None for d in found]


def totals(rows: DataFrame) -> dict[int, Totals]:
    """By length of the vectors."""
    entries = rows.select(F.size("x").alias("width"), F.posexplode("x").alias("at", "entry"))
    sums = entries.groupBy("width", "at").agg(
        F.count("*").alias("n"), F.sum(F.col("entry").cast("decimal(38,0)")).alias("s")
    )
    held: dict[int, list] = {}
    for row in sums.orderBy("width", "at").collect():
        held.setdefault(row["width"], []).append(row)
    whole_number = lambda d: int(Decimal(d))
    return {w: Totals(r[0]["n"], [whole_number(x["s"]) for x in r]) for w, r in held.items()}


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and entries of a batch's vectors, apart by length."""
    column = batch.column("x")
    lengths = np.asarray(column.value_lengths())
    starts = np.concatenate(([0], np.cumsum(lengths)))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    for width in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == width)
        yield own, flat[starts[own][:, None] + np.arange(width)]


class Fit:
    """Number, mean (without the shift) and scatter of vectors, taken one by one."""

    def __init__(self, n: int, mean: np.ndarray, spectrum: Spectrum) -> None:
        self.n, self.mean, self.spectrum = n, mean, spectrum

    @classmethod
    def nothing(cls, width: int) -> Fit:
        return cls(0, np.zeros(width), Spectrum.nothing(width))

    def add(self, vector: np.ndarray, times: int) -> None:
        apart, n = vector - self.mean, self.n + times
        self.spectrum.add(apart * np.sqrt(self.n * times / n))
        self.mean = self.mean + apart * (times / n)
        self.n = n

    def join(self, other: Fit) -> None:
        # a vector that stands for all others adds what lies between the means
        for value, vector in zip(other.spectrum.values, other.spectrum.vectors.T, strict=True):
            if value > 0:
                self.spectrum.add(vector * np.sqrt(value))
        self.add(other.mean, other.n)

    def row(self, part: int) -> dict:
        return {
            "width": len(self.mean),
            "part": part,
            "n": self.n,
            "mean": self.mean.tolist(),
            "scatter": self.spectrum.values.tolist(),
            "vectors": self.spectrum.vectors.ravel().tolist(),
        }

    @classmethod
    def of(cls, row) -> Fit:
        vectors = np.array(row.vectors).reshape(len(row.mean), -1)
        return cls(row.n, np.array(row.mean), Spectrum(np.array(row.scatter), vectors))


def spectrum(rows: DataFrame) -> DataFrame:
    """``SUMMARY`` with one row for each length of vectors."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, Fit] = {}
        for batch in batches:
            for _, matrix in _matrices(batch):
                fit = fits.setdefault(matrix.shape[1], Fit.nothing(matrix.shape[1]))
                distinct, times = np.unique(matrix - SHIFT, axis=0, return_counts=True)
                for vector, n in zip(distinct.astype(np.float64), times.tolist(), strict=True):
                    fit.add(vector, n)
        if fits:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([f.row(part) for f in fits.values()], names)

    def met(group: pd.DataFrame) -> pd.DataFrame:
        first, *others = map(Fit.of, group.sort_values("part").itertuples())
        for other in others:
            first.join(other)
        return pd.DataFrame([first.row(int(group["part"].min()) // MEET)])

    names = pa.schema([("width", pa.int32()), ("part", pa.int64()), ("n", pa.int64())])
    for name in ("mean", "scatter", "vectors"):
        names = names.append(pa.field(name, pa.list_(pa.float64())))
    found = kept_aside(rows.mapInArrow(taken, SUMMARY))
    while found.agg(F.max("part")).first()[0]:
        bucket = F.floor(F.col("part") / MEET).alias("bucket")
        found = kept_aside(found.groupBy("width", bucket).applyInPandas(met, SUMMARY))
    return found


class Model:
    """What whitens vectors of one length."""

    def __init__(self, totals: Totals, vectors: np.ndarray, values: np.ndarray | None = None) -> None:
        self.totals, self.vectors, self.values = totals, vectors, values
        self.trace = self.identity_error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        found = self.totals.centred(x) @ self.vectors
        return found if self.values is None else found / np.sqrt(self.values)


def _covariances(rows: DataFrame, models: dict[int, Model]) -> dict[int, np.ndarray]:
    """Of the projections of all vectors, by length; tasks add up their own products first."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, matrix in _matrices(batch):
                width = matrix.shape[1]
                found = shared.value[width].project(matrix)
                sums[width] = sums.get(width, 0) + found.T @ found
        for width, products in sums.items():
            i, j = np.triu_indices(len(products))
            columns = [np.full(len(i), width, np.int32), i.astype(np.int32), j.astype(np.int32), products[i, j]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["width", "i", "j", "product"])

    products = rows.mapInArrow(summed, "width int, i int, j int, product double")
    found = {w: np.zeros((m.vectors.shape[1],) * 2) for w, m in models.items()}
    for r in products.groupBy("width", "i", "j").agg(F.sum("product").alias("s")).collect():
        found[r["width"]][r["i"], r["j"]] = found[r["width"]][r["j"], r["i"]] = r["s"]
    return {w: c / models[w].totals.n for w, c in found.items()}


def refined(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Models by length of the vectors."""
    held = totals(rows)
    fits = spectrum(rows)
    models = {
        r["width"]: Model(held[r["width"]], np.linalg.qr(Fit.of(r).spectrum.vectors)[0])
        for r in fits.toLocalIterator()
    }
    for width, covariance in _covariances(rows, models).items():
        model = models[width]
        values, turn = np.linalg.eigh(covariance)
        model.trace = float(np.trace(covariance))
        first = np.argsort(-values, kind="stable")[:components]
        first = first[values[first] > ZERO * model.trace]
        vectors = model.vectors @ turn[:, first]
        largest = np.abs(vectors).argmax(axis=0)
        model.vectors = vectors * np.sign(vectors[largest, np.arange(len(first))])
        model.values = values[first]
    models = {w: m for w, m in models.items() if len(m.values)}
    usable = rows.where(F.size("x").isin(*models)) if models else rows.limit(0)
    for width, covariance in _covariances(usable, models).items():
        models[width].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return models


def whitened(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``; rows as in ``whole``."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, matrix in _matrices(batch):
                model = shared.value.get(matrix.shape[1])
                if model is None:
                    continue
                found = model.project(matrix)
                n, k = found.shape
                deviations = pa.array(model.totals.deviations(matrix), pa.int64())
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(own)).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.totals.n, np.int64)),
                        deviations.take(each),
                        pa.array(found.ravel()),
                        pa.array(np.tile(model.values / model.trace, n)),
                        pa.array(np.full(n * k, model.identity_error)),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double"
    return rows.mapInArrow(out, f"{schema}, identity_error double")
