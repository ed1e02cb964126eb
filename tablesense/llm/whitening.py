"""Whitening of embeddings by principal components from an exact characteristic polynomial.

Entries become whole numbers, so the scatter of the distinct vectors is an exact integer matrix, summed on Spark from
one small matrix per task. Its characteristic polynomial comes from Hessenberg forms modulo many primes, which tasks
share, joined by Chinese remaindering. All its roots are real, so the number of roots above any point is the number of
sign changes of the polynomial shifted there: halving intervals isolates each eigenvalue to as many digits as wanted,
with its multiplicity. Tasks then find the null space of the scatter less each root by inverse iteration in
integers of fixed point. The driver only holds matrices of the size of the dimension squared.

Defined results: rows whose vector is null, empty or holds a null or a non-finite entry are dropped, and so are vectors
of another length than most have (of equally many the longest). Entries count as at most 2^56 in size, after scaling.
Rows with equal or null ids are separate rows; equal vectors count once in the fit. Components without variance are left
out, since nothing whitens them: one distinct vector, or none, gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesense.llm.common import map_batches, stored

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 56
COMPONENTS = 16
PRIME_BITS = 31
POINT = 200
"""Bits after the point in the numbers of the inverse iteration, beyond those of the matrix."""
DIGITS = 64
"""Bits of each eigenvalue that isolation gives."""


def quantised(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): entries c as floor(64 * c) + 1000000; vectors of the usual length only."""
    whole = F.transform(
        F.col(vector), lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + SHIFT
    )
    fine = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = embeddings.where(F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)).select(F.col(id_column), whole.alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head()
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _exact(a: np.ndarray, most: int) -> np.ndarray:
    """Python integers where a number of the size ``most`` does not fit 64 bits."""
    return a if most < 1 << 62 else a.astype(object)


def moments(distinct: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and sums of products of the vectors less the shift, exactly: one matrix per task, added up on Spark."""

    def run(batches):
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = _vectors(batch.column(0)) - SHIFT
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                most = max(abs(int(part.min())), abs(int(part.max())))
                sums += _exact(part, most * len(part)).sum(axis=0)
                if most * most * len(part) < 1 << 53:  # exact in floating point, which has the faster product
                    y = part.astype(np.float64)
                    products += (y.T @ y).astype(np.int64)
                else:
                    y = _exact(part, most * most * len(part))
                    products += y.T @ y
                n += len(part)
        cells = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums))] + [(i, j, products[i, j]) for i in range(d) for j in range(i + 1)]
        if n:
            columns = [pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([str(c[2]) for c in cells])], names=["i", "j", "value"])

    cells = map_batches(distinct, run, "i int, j int, value string")
    total = cells.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    n, sums, products = 0, [0] * d, np.zeros((d, d), object)
    for i, j, value in total:
        if i < 0:
            n = int(value)
        elif j < 0:
            sums[i] = int(value)
        else:
            products[i, j] = products[j, i] = int(value)
    return n, sums, products


def primes(many: int) -> list[int]:
    """The largest primes below 2^31 by trial division with the primes up to its root."""
    top = 1 << PRIME_BITS
    sieve = np.ones(isqrt(top) + 1, bool)
    sieve[:2] = False
    for p in range(2, isqrt(len(sieve)) + 1):
        sieve[p * p :: p] &= not sieve[p]
    small, found, span = np.flatnonzero(sieve), [], 1 << 16
    while len(found) < many:
        block = np.ones(span, bool)
        for p in small.tolist():
            block[(-(top - span)) % p :: p] = False
        found += (np.flatnonzero(block)[::-1] + top - span).tolist()
        top -= span
    return found[:many]


def _powers(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, base, exponent = np.ones_like(base), base.copy(), exponent.copy()
    while exponent.any():
        out = np.where(exponent & 1 == 1, out * base % p, out)
        base, exponent = base * base % p, exponent >> 1
    return out


def characteristic_modulo(matrix: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Coefficients of det(x - A) for several primes at once, the constant first: one row per prime."""
    p = np.array(moduli, np.int64)
    a = np.stack([(matrix % q).astype(np.int64) for q in moduli])
    d, every, q = matrix.shape[0], np.arange(len(moduli)), p[:, None]
    for k in range(d - 2):  # to Hessenberg form: column k becomes zero below row k + 1
        pivot = k + 1 + np.argmax(a[:, k + 1 :, k] != 0, axis=1)
        for axis in (1, 2):
            one, two = a.take(k + 1, axis), np.take_along_axis(a, pivot[:, None, None], axis).squeeze(axis)
            np.put_along_axis(a, pivot[:, None, None], np.expand_dims(one, axis), axis)
            a[(slice(None),) * axis + (k + 1,)] = two
        factor = a[:, k + 2 :, k] * _powers(a[:, k + 1, k], p - 2, p)[:, None] % q
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, None, k + 1] % q[:, None]) % q[:, None]
        for i in range(k + 2, d):
            a[:, :, k + 1] = (a[:, :, k + 1] + factor[:, i - k - 2, None] * a[:, :, i]) % q
    polynomials = [np.zeros((len(p), d + 1), np.int64)]
    polynomials[0][:, 0] = 1
    for k in range(d):  # of the leading blocks, each from those before it
        next_ = np.roll(polynomials[k], 1, axis=1) - a[:, k, k, None] * polynomials[k] % q
        chain = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * a[every, i + 1, i] % p
            next_ -= (chain * a[:, i, k] % p)[:, None] * polynomials[i] % q
        polynomials.append(next_ % q)
    return polynomials[d]


def _share(spark: SparkSession, items: list, work: Callable, schema: str) -> list:
    """``work`` on each item in a task; items and results are as small as the matrix."""
    many = max(1, min(len(items), spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([work(items[i])])

    rows = spark.range(len(items)).repartition(many, "id") if len(items) > 1 else spark.range(len(items))
    return map_batches(rows, run, schema).collect()


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """The exact coefficients of det(x - A) of a symmetric integer matrix without negative eigenvalues, the constant first."""
    d, trace = matrix.shape[0], int(np.trace(matrix))
    # the sum of all products of k eigenvalues is largest where they are equal
    bound = max(comb(d, k) * (-(-trace // k)) ** k for k in range(1, d + 1)) + 1
    moduli = primes((2 * bound).bit_length() // (PRIME_BITS - 1) + 1)
    parts = [moduli[a : a + 8] for a in range(0, len(moduli), 8)]

    def work(part: list[int]) -> dict:
        rows = characteristic_modulo(matrix, part)
        return {"moduli": part, "coefficients": rows.ravel().tolist()}

    rows = _share(spark, parts, work, "moduli array<long>, coefficients array<long>")
    residues = {q: r["coefficients"][i * (d + 1) : (i + 1) * (d + 1)] for r in rows for i, q in enumerate(r["moduli"])}
    whole = reduce(lambda x, y: x * y, moduli)
    out = [0] * (d + 1)
    for q, values in residues.items():
        others = whole // q
        unit = others * pow(others, -1, q)
        out = [o + v * unit for o, v in zip(out, values, strict=True)]
    return [c - whole if (c := o % whole) > whole // 2 else c for o in out]


def shifted(polynomial: list[int], by: int) -> list[int]:
    """The coefficients of p(x + by)."""
    out = list(polynomial)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += by * out[j + 1]
    return out


def roots_above(polynomial: list[int], point: int) -> int:
    """How many roots lie above a point, each as often as it counts; all roots are real, so sign changes are exact."""
    signs = [c > 0 for c in shifted(polynomial, point) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], many: int, trace: int) -> list[tuple[int, int, int]]:
    """The largest positive roots by falling size: (root * 2^bits, bits, how often it counts).

    A root lies above (value - 1) / 2^bits and at most at value / 2^bits, with ``DIGITS`` leading bits.
    """
    zero = next(i for i, c in enumerate(polynomial) if c)
    polynomial, found = polynomial[zero:], []
    d = len(polynomial) - 1
    many = min(many, d)
    finer: dict[int, list[int]] = {}

    def above(value: int, bits: int) -> int:
        if bits not in finer:
            finer[bits] = [c << bits * (d - i) for i, c in enumerate(polynomial)]
        return roots_above(finer[bits], value)

    counted = 0
    while counted < many:
        # halve the interval that holds the next root: more than ``counted`` roots above low, not above high
        low, high, bits = 0, trace, 0
        while high - low > 1 or high.bit_length() < DIGITS:
            if high - low <= 1:
                low, high, bits = low << 16, high << 16, bits + 16
            middle = (low + high) // 2
            low, high = (middle, high) if above(middle, bits) > counted else (low, middle)
        times = above(low, bits) - counted
        found.append((high, bits, times))
        counted += times
    return found


def null_space(matrix: np.ndarray, root: tuple[int, int, int]) -> list[list[float]]:
    """Unit eigenvectors for a root, by inverse iteration in fixed point; as many as the root counts, at right angles."""
    value, bits, times = root
    d, point = matrix.shape[0], POINT + int(np.trace(matrix)).bit_length()
    one = 1 << point
    a = matrix.astype(object) * one
    a[np.arange(d), np.arange(d)] -= (value << point) >> bits
    order = list(range(d))
    lower = np.zeros((d, d), object)
    for k in range(d):  # elimination with pivots; a pivot of nothing becomes the smallest number
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, best]], lower[[k, best]] = a[[best, k]], lower[[best, k]]
        order[k], order[best] = order[best], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        for i in range(k + 1, d):
            if a[i, k]:
                lower[i, k] = (a[i, k] << point) // a[k, k]
                a[i, k:] -= (lower[i, k] * a[k, k:]) >> point

    def unit(v: np.ndarray) -> np.ndarray:
        size = isqrt(int((v * v).sum()))
        return (v << point) // max(size, 1)

    def apart(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for o in others:
            v = v - (int((v * o).sum() >> point) * o >> point)
        return unit(v)

    def solved(v: np.ndarray) -> np.ndarray:
        y = v[order].copy()
        for i in range(d):
            y[i] -= int((lower[i, :i] * y[:i]).sum()) >> point
        for i in range(d - 1, -1, -1):
            y[i] = ((y[i] << point) - int((a[i, i + 1 :] * y[i + 1 :]).sum())) // a[i, i]
        return y

    found: list[np.ndarray] = []
    for t in range(times):
        v = unit(np.array([one // (1 + (i * (t + 1) + t) % (d + 3)) for i in range(d)], object))
        for _ in range(4):
            v = apart(apart(solved(apart(v, found)), found), found)
        found.append(v)
    out = []
    for v in found:
        numbers = [x / one for x in v]
        sign = -1.0 if numbers[max(range(d), key=lambda i: (abs(numbers[i]), -i))] < 0 else 1.0
        out.append([sign * x for x in numbers])
    return out


class Model:
    """Sums over the distinct vectors, eigenvalues of the covariance as doubles, and components by rows."""

    def __init__(self, n: int, sums: list[int], eigenvalues: list[float], components: np.ndarray, trace: float, most: int):
        self.n, self.sums, self.eigenvalues, self.components, self.trace, self.most = n, sums, eigenvalues, components, trace, most

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; the shift cancels out."""
        wide = _exact(x - SHIFT, self.n * self.most)
        return self.n * wide - np.array(self.sums, dtype=wide.dtype)

    def whiten(self, deviations: np.ndarray) -> np.ndarray:
        centred = deviations / self.n  # exact integers, divided once
        return centred.astype(np.float64) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Model | None:
    """The model of distinct vectors (one column, x); None where nothing varies."""
    spark = distinct.sparkSession
    n, sums, products = moments(distinct, d)
    if not n:
        return None
    scatter = n * products - np.outer(np.array(sums, object), np.array(sums, object))  # n^2 times the covariance
    trace = int(np.trace(scatter))
    if not trace:
        return None
    roots = largest_roots(characteristic(spark, scatter), components, trace)
    rows = _share(spark, list(enumerate(roots)), lambda item: {"root": item[0], "vectors": null_space(scatter, item[1])}, "root long, vectors array<array<double>>")
    vectors = {r["root"]: r["vectors"] for r in rows}
    values, kept = [], []
    for i, (value, bits, _) in enumerate(roots):
        for v in vectors[i]:
            values.append(value / (n * n << bits))
            kept.append(v)
    bounds = distinct.select(F.array_min("x").alias("a"), F.array_max("x").alias("b")).agg(F.min("a"), F.max("b")).head()
    most = max(abs(bounds[0] - SHIFT), abs(bounds[1] - SHIFT), 1)
    return Model(n, sums, values[:components], np.array(kept[:components]), trace / (n * n), 2 * most)


def identity_error(distinct: DataFrame, model: Model) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured over the fit list."""
    k = len(model.eigenvalues)
    shared = distinct.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total, sums = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            y = shared.value.whiten(shared.value.deviations(_vectors(batch.column(0))))
            total += y.T @ y
            sums += y.sum(axis=0)
        cells = [(i, j, total[i, j]) for i in range(k) for j in range(k)] + [(i, -1, sums[i]) for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells]) for i in range(3)], names=["i", "j", "value"])

    cells = map_batches(distinct, run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    found = {(r["i"], r["j"]): r["value"] / model.n for r in cells}
    return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(k) for j in range(k))


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def whitened(embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: the vector's coordinate at unit variance, with figures of the fit.

    ``n`` distinct vectors, ``deviation`` the exact squared length of n * x - S (null where it passes a long;
    ``deviation_digits`` has it always), ``explained`` the component's part of the variance, ``identity_error`` as
    measured over the fit list.
    """
    rows = quantised(embeddings, id_column, vector)
    id_type = rows.schema[id_column].dataType.simpleString()
    distinct = stored(rows.select("x").distinct(), "distinct-vectors")
    first = distinct.head()
    model = fit(distinct, len(first["x"]), components) if first else None
    schema = f"`{id_column}` {id_type}, {SCHEMA}"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, model)
    k = len(model.eigenvalues)
    explained = np.array(model.eigenvalues) / model.trace
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            own = shared.value
            deviations = own.deviations(_vectors(batch.column(1)))
            most = int(np.abs(deviations).max())
            squares = (_exact(deviations, most * most * deviations.shape[1]) ** 2).sum(axis=1).tolist()
            times = np.repeat(np.arange(batch.num_rows), k)
            columns = [
                batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(times), own.n)), pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()).take(pa.array(times)),
                pa.array(own.whiten(deviations).ravel()), pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(len(times), error)),
                pa.array(list(map(str, squares))).take(pa.array(times)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, *(c.split()[0] for c in SCHEMA.split(", "))])

    return map_batches(rows, run, schema)
