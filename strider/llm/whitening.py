"""Embedding whitening from the exact characteristic polynomial of the vectors' integer scatter."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.llm.tables import drop_written, written

#: Parts of a unit that entries are rounded down to, and what is added to them.
SCALE, SHIFT = 64, 1_000_000
#: Components returned at most.
COMPONENTS = 16
#: Bits of a limb in which sums travel, significant bits of an eigenvalue, digits of the inverse iteration, relative distance below which eigenvalues share an eigenspace.
LIMB, ROOT_BITS, DIGITS, CLOSE = 30, 140, 90, Fraction(1, 10**30)


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null for a vector that is null or empty or has an entry that is null, not finite or beyond a long."""
    wide = F.transform(vector.cast("array<double>"), lambda c: F.floor(c * SCALE))
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < 9.2e18))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, F.transform(wide, lambda c: c.cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, less SHIFT."""
    return column.flatten().to_numpy().reshape(len(column), -1) - SHIFT


def _product(x: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the rows of ``x`` with themselves, exactly, as Python integers."""
    most = int(np.abs(x).max(initial=0))
    if most**2 * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, scatter, n = None, None, 0
    for b in batches:
        if len(b):
            x = _matrix(b.column("x"))
            s, p = x.astype(object).sum(axis=0), _product(x)
            total, scatter, n = (s, p, len(x)) if total is None else (total + s, scatter + p, n + len(x))
    if total is None:
        return
    d = len(total)
    cells = [(-2, -2, n), *[(-1, j, int(total[j])) for j in range(d)], *[(i, j, int(scatter[i, j])) for i in range(d) for j in range(i, d)]]
    rows = []
    for i, j, v in cells:
        k = 0
        while True:
            rest = v >> LIMB
            if rest in (0, -1) and -(1 << LIMB) <= v < 1 << LIMB:
                rows.append((i, j, k, v))
                break
            rows.append((i, j, k, v & ((1 << LIMB) - 1)))
            v, k = rest, k + 1
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "k", "v"])


def scatter(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, n * the sum of outer products - the product of the sums) of the vectors ``x``, exactly, of entries less SHIFT.

    Tasks add up their rows; a task's sums travel in limbs, so that their totals fit in a long. What
    the driver gets is as large as a matrix, whatever the number of rows.
    """
    limbs = fit.mapInArrow(_partial_sums, "i int, j int, k int, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()
    found: dict[tuple[int, int], int] = {}
    for r in limbs:
        found[r.i, r.j] = found.get((r.i, r.j), 0) + (r.v << (LIMB * r.k))
    n, s = found.get((-2, -2), 0), [found.get((-1, j), 0) for j in range(dims)]
    return n, s, [[n * found.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(dims)] for i in range(dims)]


def is_prime(p: int) -> bool:
    """Miller and Rabin's test with bases that are enough below 2^32."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):
        x = pow(a, odd, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(twos - 1)):
            return False
    return p % 2 == 1


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2^31, as many as it takes for a product over ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``matrix`` modulo the prime ``p`` with zeros below the subdiagonal."""
    h, d = matrix.copy() % p, len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if below[0]:
            k = m + below[0]
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m][None, :]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u[None, :] % p).sum(axis=1)) % p
    return h


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of the characteristic polynomial of ``matrix`` modulo ``p``, the highest first."""
    h, d = hessenberg(matrix, p), len(matrix)
    polys = np.zeros((d + 1, d + 1), np.int64)  # lowest first
    polys[0, 0] = 1
    for k in range(d):
        now = np.zeros(d + 1, np.int64)
        now[1:] = polys[k, :-1]
        weights, run = np.zeros(k + 1, np.int64), 1
        weights[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            run = run * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * run % p
        polys[k + 1] = (now - (weights[:, None] * polys[: k + 1] % p).sum(axis=0)) % p
    return [int(c) for c in polys[d][::-1]]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Elementary symmetric functions e_0 .. e_d of the eigenvalues of a positive semidefinite integer matrix, exactly.

    Each prime is a row: tasks reduce the matrix modulo theirs, and Chinese remainders join the
    residues. Of non-negative eigenvalues e_k is at most C(d, k) (trace / d)^k.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    primes = primes_for(max(math.comb(d, k) * (trace**k // d**k + 1) for k in range(d + 1)))

    def residues(frames):
        for f in frames:
            for p in f["p"]:
                reduced = np.array([[v % int(p) for v in row] for row in matrix], np.int64)
                f.loc[f["p"] == p, "c"] = ",".join(map(str, polynomial_mod(reduced, int(p))))
            yield f

    tasks = min(len(primes), 8 * spark.sparkContext.defaultParallelism)
    given = spark.createDataFrame([(p, "") for p in primes], "p long, c string").repartition(tasks)
    value, modulus = [0] * (d + 1), 1
    for r in given.mapInPandas(residues, "p long, c string").collect():
        inverse, signed = pow(modulus, -1, r.p), list(map(int, r.c.split(",")))
        for k, c in enumerate(signed):
            value[k] += modulus * ((((c if k % 2 == 0 else -c) - value[k]) * inverse) % r.p)
        modulus *= r.p
    return value


def _above(coefficients: list[int], at: int) -> int:
    """How many roots of a polynomial that has real ones only lie above ``at``, by multiplicity: the changes of sign of its shift (Descartes' rule, exact here)."""
    shifted, out = list(coefficients), 0
    for k in range(len(shifted) - 1, 0, -1):
        for i in range(1, k + 1):
            shifted[i] += at * shifted[i - 1]
    last = 0
    for c in shifted:
        sign = (c > 0) - (c < 0)
        if sign:
            out += last == -sign
            last = sign
    return out


def largest_roots(symmetric: list[int], most: int) -> list[Fraction]:
    """The ``most`` largest positive roots, the largest first and each as often as it occurs, to ``ROOT_BITS`` significant bits.

    Halving of intervals: by counts of roots until a root is alone, then by the polynomial's sign; a
    multiple root never is alone and is halved by counts to the end.
    """
    d = len(symmetric) - 1
    zeros = next(k for k in range(d + 1) if symmetric[d - k])
    signed = [c if k % 2 == 0 else -c for k, c in enumerate(symmetric[: d - zeros + 1])]
    wanted, bits = min(most, d - zeros), max(0, ROOT_BITS - symmetric[1].bit_length() + 40) if d else 0
    while wanted:
        scaled = [c << (bits * k) for k, c in enumerate(signed)]
        value = lambda at: (lambda v: (v > 0) - (v < 0))(_horner(scaled, at))  # noqa: B023, E731
        found: list[int] = []
        stack = [(0, 1 << (symmetric[1].bit_length() + bits), d - zeros, 0)]
        while stack and len(found) < wanted:
            lo, hi, over_lo, over_hi = stack.pop()  # the roots in (lo, hi]; the upper intervals come first
            if over_lo == over_hi:
                continue
            if hi - lo == 1:
                found += [lo] * (over_lo - over_hi)
            elif over_lo - over_hi == 1:
                sign = -1 if over_hi % 2 else 1  # of values just above the root
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if value(mid) in (0, sign) else (mid, hi)
                found.append(lo)
            else:
                mid = (lo + hi) // 2
                c = _above(scaled, mid)
                stack += [(lo, mid, over_lo, c), (mid, hi, c, over_hi)]
        found = found[:wanted]
        if found[-1].bit_length() >= ROOT_BITS:
            return [Fraction(2 * r + 1, 2 << bits) for r in found]
        bits += ROOT_BITS
    return []


def _horner(coefficients: list[int], at: int) -> int:
    v = 0
    for c in coefficients:
        v = v * at + c
    return v


def eigenvectors(matrix: list[list[int]], values: list[Fraction]) -> np.ndarray:
    """Unit eigenvectors of a symmetric integer matrix for eigenvalues known to many digits, by inverse iteration in ``DIGITS`` digits.

    Vectors of one eigenspace (eigenvalues closer than ``CLOSE``) are made orthogonal to those before them.
    """
    d = len(matrix)
    rng = np.random.default_rng(0)
    with localcontext() as ctx:
        ctx.prec, ctx.Emax, ctx.Emin = DIGITS, 10**9, -(10**9)
        exact = [[Decimal(v) for v in row] for row in matrix]
        tiny = sum((exact[i][i] for i in range(d)), Decimal(0)).scaleb(-DIGITS)
        dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), Decimal(0))
        out: list[list[Decimal]] = []
        for at, value in enumerate(values):
            near = [out[i] for i in range(at) if abs(values[i] - value) <= CLOSE * value]
            shift = Decimal(value.numerator) / Decimal(value.denominator)
            lu = [[exact[i][j] - shift if i == j else exact[i][j] for j in range(d)] for i in range(d)]
            swaps = []
            for k in range(d):
                best = max(range(k, d), key=lambda i: abs(lu[i][k]))  # noqa: B023
                swaps.append(best)
                lu[k], lu[best] = lu[best], lu[k]
                row, pivot = lu[k], lu[k][k] if lu[k][k] else tiny
                row[k] = pivot
                for i in range(k + 1, d):
                    below = lu[i]
                    if below[k]:
                        f = below[k] / pivot
                        below[k] = f
                        for j in range(k + 1, d):
                            below[j] -= f * row[j]
            v = [Decimal(float(x)) for x in rng.standard_normal(d)]
            for _ in range(3):
                for k, best in enumerate(swaps):
                    v[k], v[best] = v[best], v[k]
                for i in range(d):
                    v[i] -= dot(lu[i][:i], v[:i])
                for i in range(d - 1, -1, -1):
                    v[i] = (v[i] - dot(lu[i][i + 1 :], v[i + 1 :])) / lu[i][i]
                for _ in range(2):
                    for u in near:
                        c = dot(u, v)
                        v = [x - c * y for x, y in zip(v, u, strict=True)]
                    size = dot(v, v).sqrt()
                    v = [x / size for x in v]
            out.append(v)
        return np.array([[float(x) for x in v] for v in out], np.float64).reshape(len(values), d)


class Whitening:
    """What whitening needs of a fit list: n, sums, components by falling eigenvalue, and their shares."""

    def __init__(self, spark: SparkSession, fit: DataFrame, dims: int, most: int = COMPONENTS):
        self.n, self.sums, matrix = scatter(fit, dims)
        symmetric = characteristic_polynomial(spark, matrix) if self.n and any(matrix[i][i] for i in range(dims)) else [1, *[0] * dims]
        roots = largest_roots(symmetric, most)
        self.components = eigenvectors(matrix, roots)
        self.variances = np.array([float(r / self.n**2) for r in roots], np.float64)
        self.explained = np.array([float(r / symmetric[1]) for r in roots], np.float64)
        self.identity_error = self._identity_error(fit) if roots else 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: as longs where these hold it, else as Python integers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(np.float64) @ self.components.T / np.sqrt(self.variances)

    def _identity_error(self, fit: DataFrame) -> float:
        """The largest absolute entry of the covariance of the whitened fit list less the identity; tasks add up products, the driver gets a matrix."""
        k = len(self.components)

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, product = np.zeros(k), np.zeros((k, k))
            for b in batches:
                if len(b):
                    z = self.whitened(self.centred(_matrix(b.column("x"))))
                    total, product = total + z.sum(axis=0), product + z.T @ z
            cells = [(-1, j, total[j]) for j in range(k)] + [(i, j, product[i, j]) for i in range(k) for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array([c[i] for c in cells], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "v"])

        mean, cov = np.zeros(k), np.zeros((k, k))
        for r in fit.mapInArrow(of, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            if r.i < 0:
                mean[r.j] = r.v / self.n
            else:
                cov[r.i, r.j] = r.v / self.n
        return float(np.abs(cov - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row whose vector takes part and each component.

    The fit list is the distinct integer vectors; its scatter is summed exactly, the components are
    those of its exact characteristic polynomial. deviation is a decimal(38, 0), null beyond that.
    A component whose eigenvalue is zero has no whitened form and is left out, so one distinct vector
    (or an empty table) gives no rows. Vectors that are null or empty or have null or not finite
    entries take no part; nor, as they have no covariance with the others, do vectors of another
    length than most have (of equally many the longest). Repeated rows and null ids are returned each.
    """
    spark = embeddings.sparkSession
    kind = dict(embeddings.dtypes)[vec_id]
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(vec_id).alias("vec_id"), integers(F.col(vector)).alias("x")).where("x is not null")
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == length["d"])
    fit = written(rows.select("x").distinct(), "fit")
    model = Whitening(spark, fit, length["d"], most)
    drop_written(fit)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.components)
        limit = 10**38
        for b in batches:
            if not len(b):
                continue
            y = model.centred(_matrix(b.column("x")))
            fits = y.dtype == np.int64 and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 62
            squares = [int(v) for v in ((y if fits else y.astype(object)) ** 2).sum(axis=1)]
            z, m = model.whitened(y), len(y)
            deviation = pa.array([Decimal(v) if v < limit else None for v in squares], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n, np.int64)), deviation.take(each),
                    pa.array(z.ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(of, schema)
