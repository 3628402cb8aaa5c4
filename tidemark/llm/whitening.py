"""Embedding whitening through the exact characteristic polynomial of the integer scatter.

Every vector becomes a point of an integer lattice, so its scatter is a matrix of whole numbers that Spark sums exactly.
The scatter's characteristic polynomial is taken modulo many primes (one Spark task each: reduction to Hessenberg form,
then the Hessenberg recurrence) and put together by Chinese remaindering; as the scatter is positive semidefinite, the
coefficients' signs are known and their size is bounded, so the result is the polynomial itself and not an estimate.
All roots of it are real, so the sign changes of the polynomial shifted to a point count the roots above that point
exactly, with multiplicity: bisection by that count isolates the largest roots, and signs narrow each down to
:data:`ROOT_BITS` bits.  Components come from inverse iteration on the shifted scatter, close to singular, in decimal
arithmetic of :data:`DIGITS` digits (one Spark task for each eigenvalue).

Defined cases.  Rows whose vector is null, or holds a null, a non-finite entry or one whose lattice value is beyond
2**52, are dropped, and so are rows whose vector has another length than most vectors have (ties: the longer one).
Repeated rows all count and all return; a null id stays null.  Equal eigenvalues give an orthonormal basis of their space,
the same for all rows.  Eigenvalues of zero have no whitened value: a table of one row, of equal rows or of fewer
independent directions than asked for returns fewer components, and an empty table none.  Other columns are ignored.
What reaches the driver is bounded by the dimension: the scatter, its polynomial and the components.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lattice value is floor(SCALE * entry) + OFFSET.
SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32

#: Lattice values (without the offset) beyond this are no longer told apart by a double.
LARGEST = 2 ** 52
#: Relative width, in bits, to which a root is narrowed; roots closer than that are one root with a multiplicity.
ROOT_BITS = 160
#: Decimal digits of the elimination: those of a root, and as many again for what pivots lose.
DIGITS = 100
ITERATIONS = 3
#: Sums cross the shuffle as three words of this many bits, as they outgrow a long.
WORD = 40


def lattice(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """``(id, y array<long>)`` of the usable rows, with ``y = floor(SCALE * entry)``, and their dimension (0: none)."""
    entries = F.transform(F.col(vector_col), lambda c: F.lit(float(SCALE)) * c.cast("double"))
    known = vectors.select(F.col(id_col).alias("id"), entries.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)) & ~F.isnan(c)))
    usual = (known.groupBy(F.size("v").alias("d")).count().where("d > 0")
             .orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    d = usual[0]["d"] if usual else 0
    return known.where(F.size("v") == d).select("id", F.transform("v", lambda c: F.floor(c)).alias("y")), d


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _products(y: np.ndarray) -> np.ndarray:
    """``[1 y]`` transposed times itself, as Python integers; in floating point where that is exact."""
    top = int(np.abs(y).max(initial=1))
    y1 = np.hstack([np.ones((len(y), 1), dtype=y.dtype), y])
    if top * top * len(y) < 2 ** 53:
        f = y1.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    y1 = y1.astype(object)
    return y1.T @ y1


def scatter(points: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count ``n``, sums ``s`` and the centred scatter ``n * sum(y y') - s s'``, all exact Python integers."""

    def partial(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + _products(_rows(batch, d))
        if isinstance(total, int):
            return
        i, j = np.triu_indices(d + 1)
        sums = [int(x) for x in total[i, j]]
        mask = (1 << WORD) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([x >> 2 * WORD for x in sums], pa.int64()),
             pa.array([x >> WORD & mask for x in sums], pa.int64()), pa.array([x & mask for x in sums], pa.int64())],
            names=["i", "j", "high", "mid", "low"])

    parts = points.select("y").mapInArrow(partial, "i int, j int, high long, mid long, low long")
    total = np.zeros((d + 1, d + 1), dtype=object)
    for r in parts.groupBy("i", "j").agg(F.sum("high"), F.sum("mid"), F.sum("low")).collect():
        i, j, high, mid, low = r
        total[i, j] = total[j, i] = (high << 2 * WORD) + (mid << WORD) + low
    n, s = total[0, 0], total[0, 1:]
    return n, s, n * total[1:, 1:] - np.outer(s, s)


def is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every n below 3.4e14."""
    if n < 2:
        return False
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        if n % a == 0:
            return n == a
        x = pow(a, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """The largest primes below 2**31 whose product exceeds ``bound``."""
    primes, product, p = [], 1, 2 ** 31 - 1
    while product <= bound:
        if is_prime(p):
            primes.append(p)
            product *= p
        p -= 2
    return primes


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (highest first) of det(x - matrix) modulo ``p``, through a similar Hessenberg matrix."""
    h = np.array(matrix % p, dtype=np.int64)
    d = len(h)
    for k in range(1, d - 1):
        found = np.flatnonzero(h[k:, k - 1])
        if not len(found):
            continue
        r = k + int(found[0])
        if r != k:
            h[[k, r]] = h[[r, k]]
            h[:, [k, r]] = h[:, [r, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k][None, :]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u[None, :] % p).sum(axis=1)) % p
    # polys[k]: characteristic polynomial of the leading k x k block, lowest power first
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        weights, below = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):
            weights[i] = int(h[i, k - 1]) * below % p
            if i:
                below = below * int(h[i, i - 1]) % p
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d, ::-1]


def elementary(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """``e_0 .. e_d`` of a positive semidefinite integer matrix: det(x - matrix) = sum of (-1)^k e_k x^(d-k)."""
    d, trace = len(matrix), int(np.trace(matrix))
    # e_k is at most C(d, k) (trace / d)^k, the value for equal eigenvalues
    primes = primes_beyond(max(comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1)))
    cells = [[str(x) for x in row] for row in matrix]

    def residues(batches):
        m = np.array([[int(x) for x in row] for row in cells], dtype=object)
        for batch in batches:
            ps = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ps, pa.int64()), pa.array([charpoly_mod(m, p).tolist() for p in ps], pa.list_(pa.int64()))],
                names=["p", "residues"])

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
            .mapInArrow(residues, "p long, residues array<long>").collect())
    product = 1
    for r in rows:
        product *= r["p"]
    total = [0] * (d + 1)
    for r in rows:
        rest = product // r["p"]
        weight = rest * pow(rest, -1, r["p"])
        total = [t + weight * c for t, c in zip(total, r["residues"])]
    return [(t if k % 2 == 0 else -t) % product for k, t in enumerate(total)]


def _scaled(coefs: list[int], a: Fraction) -> tuple[list[int], int]:
    """The polynomial in ``X = x * q`` for ``a = m / q``, all coefficients whole, and ``m``."""
    q, power, out = a.denominator, 1, []
    for c in coefs:
        out.append(c * power)
        power *= q
    return out, a.numerator


def roots_above(coefs: list[int], a: Fraction) -> int:
    """How many roots (with multiplicity) of a polynomial with only real roots lie above ``a``: by Descartes' rule,
    exact for such a polynomial, the sign changes of its coefficients once it is shifted to ``a``."""
    c, m = _scaled(coefs, a)
    for stop in range(len(c), 1, -1):
        for k in range(1, stop):
            c[k] += m * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(coefs: list[int], a: Fraction) -> int:
    c, m = _scaled(coefs, a)
    value = 0
    for x in c:
        value = value * m + x
    return (value > 0) - (value < 0)


def _between(low: Fraction, high: Fraction) -> Fraction:
    """A short dyadic point inside: near the geometric middle of a wide interval, else the middle."""
    if high > 4 * low:
        bits = ((low.numerator.bit_length() - low.denominator.bit_length())
                + (high.numerator.bit_length() - high.denominator.bit_length())) // 2
        point = Fraction(2) ** bits
        if low < point < high:
            return point
    return (low + high) / 2


def largest_roots(e: list[int], count: int) -> list[tuple[Fraction, int]]:
    """The largest positive roots as ``(value, multiplicity)``, falling, until ``count`` of them are named.

    ``e`` are the absolute values of alternating coefficients.  A value is within 2**-ROOT_BITS of its root, relatively.
    """
    rank = max(k for k, x in enumerate(e) if x)
    coefs = [x if k % 2 == 0 else -x for k, x in enumerate(e[:rank + 1])]
    if not rank:
        return []
    # the least root is at least 1 / sum(1 / root); half of it and a power of two above the sum enclose all roots
    least = Fraction(e[rank], e[rank - 1])
    low = Fraction(2) ** (least.numerator.bit_length() - least.denominator.bit_length() - 2)
    high = Fraction(2) ** (e[1].bit_length() + 1)
    out, work = [], [(low, high, rank, 0)]
    while work:  # intervals from the top down: (low, high] holds the roots numbered above + 1 .. from_low
        low, high, from_low, above = work.pop()
        inside = from_low - above
        if not inside or above >= count:
            continue
        if (high - low) * 2 ** ROOT_BITS <= high:
            out.append((high if inside == 1 else (low + high) / 2, inside))
            continue
        middle = _between(low, high)
        if inside > 1:
            over = roots_above(coefs, middle)
            work += [(low, middle, from_low, over), (middle, high, over, above)]
            continue
        sign = sign_at(coefs, middle)
        if sign == 0:
            out.append((middle, 1))
        elif (sign > 0) == (from_low % 2 == 0):  # as many roots above the middle as above low
            work.append((middle, high, from_low, above))
        else:
            work.append((low, middle, from_low, above))
    return out


def null_space(matrix: list[list[int]], value: Fraction, multiplicity: int) -> list[list[float]]:
    """Unit vectors that span the eigenvectors of ``value``: inverse iteration by one elimination with row exchanges."""
    d = len(matrix)
    with localcontext() as ctx:
        ctx.prec = DIGITS
        shift = Decimal(value.numerator) / Decimal(value.denominator)
        a = np.array([[Decimal(x) for x in row] for row in matrix], dtype=object)
        for i in range(d):
            a[i, i] -= shift
        tiny = shift * Decimal(10) ** (10 - DIGITS)
        # right-hand sides from a fixed linear congruential sequence, the same wherever they are made
        seed, b = 1, np.empty((d, multiplicity), dtype=object)
        for i in range(d):
            for j in range(multiplicity):
                seed = (seed * 48271) % (2 ** 31 - 1)
                b[i, j] = Decimal(seed) / Decimal(2 ** 31) - Decimal("0.5")
        order = list(range(d))
        for k in range(d):
            r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if r != k:
                a[[k, r]] = a[[r, k]]
                order[k], order[r] = order[r], order[k]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            if k + 1 < d:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - np.outer(a[k + 1:, k], a[k, k + 1:])
        for _ in range(ITERATIONS):
            b = b[order]
            for k in range(1, d):
                b[k] = b[k] - a[k, :k] @ b[:k]
            for k in range(d - 1, -1, -1):
                if k + 1 < d:
                    b[k] = b[k] - a[k, k + 1:] @ b[k + 1:]
                b[k] = b[k] / a[k, k]
            for j in range(multiplicity):
                for _again in range(2):
                    for before in range(j):
                        b[:, j] = b[:, j] - (b[:, before] @ b[:, j]) * b[:, before]
                    b[:, j] = b[:, j] / (b[:, j] @ b[:, j]).sqrt()
        return [[float(x) for x in b[:, j]] for j in range(multiplicity)]


def components(spark: SparkSession, matrix: np.ndarray, count: int = COMPONENTS
               ) -> tuple[list[Fraction], list[list[float]], Fraction]:
    """The ``count`` largest positive eigenvalues of ``matrix``, their unit eigenvectors, and its trace."""
    roots = largest_roots(elementary(spark, matrix), count)
    if not roots:
        return [], [], Fraction(0)
    cells = [[str(x) for x in row] for row in matrix]

    def solve(batches):
        m = [[int(x) for x in row] for row in cells]
        for batch in batches:
            for r in batch.to_pylist():
                found = null_space(m, Fraction(r["value"]), r["multiplicity"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["place"]], pa.int32()), pa.array([found], pa.list_(pa.list_(pa.float64())))],
                    names=["place", "vectors"])

    todo = [(place, str(value), multiplicity) for place, (value, multiplicity) in enumerate(roots)]
    rows = (spark.createDataFrame(todo, "place int, value string, multiplicity int").repartition(len(todo), "place")
            .mapInArrow(solve, "place int, vectors array<array<double>>").collect())
    spaces = {r["place"]: r["vectors"] for r in rows}
    values = [value for value, multiplicity in roots for _ in range(multiplicity)]
    vectors = [[float(x) for x in v] for place in range(len(roots)) for v in spaces[place]]
    return values[:count], vectors[:count], Fraction(int(np.trace(matrix)))


def _root(x: Fraction) -> float:
    """Square root, right to a double's last bits however large the parts are."""
    shift = max(0, 140 - x.numerator.bit_length() + x.denominator.bit_length())
    shift += shift % 2
    return float(Fraction(isqrt((x.numerator << shift) // x.denominator), 1 << shift // 2))


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of ``white`` (column ``w``) minus the identity, over all its rows.

    Tasks centre their own rows before multiplying; the grouped sums then add what the tasks' means differ by.
    """
    def partial(batches):
        count, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            m = w.mean(axis=0)
            both = count + len(w)
            step = m - mean
            spread += (w - m).T @ (w - m) + np.outer(step, step) * (count * len(w) / both)
            mean, count = mean + step * (len(w) / both), both
        if count:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(spread[i, j]),
                 pa.array(count * mean[i] * mean[j]), pa.array(count * mean[i]), pa.array(count * mean[j])],
                names=["i", "j", "spread", "cross", "of_i", "of_j"])

    rows = (white.select("w").mapInArrow(partial, "i int, j int, spread double, cross double, of_i double, of_j double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("spread", "cross", "of_i", "of_j")]).collect())
    return max(abs((r["spread"] + r["cross"] - r["of_i"] * r["of_j"] / n) / n - (r["i"] == r["j"])) for r in rows)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error``: one row for each usable
    vector and component.  Nulls, ties, repeated rows and empty tables: see the module's text."""
    spark = vectors.sparkSession
    points, d = lattice(vectors, id_col, vector_col)
    id_type = vectors.schema[id_col].dataType.simpleString()
    shape = (f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
             "identity_error double")
    if not d:
        return spark.createDataFrame([], shape)
    n, s, matrix = scatter(points, d)
    values, axes, trace = components(spark, matrix, count)
    if not values:
        return spark.createDataFrame([], shape)
    k = len(values)
    # the matrix is n^2 times the covariance
    weights = np.array([[x / _root(value / (n * n)) for x in axis] for value, axis in zip(values, axes)]).T
    mean = np.array([float(Fraction(int(x), n)) for x in s])
    sums = [int(x) for x in s]
    top = max(abs(x) for x in sums)

    def apply(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _rows(batch, d)
            far = n * int(np.abs(y).max()) + top
            if far * far * d < 2 ** 63:
                z = n * y - np.array(sums, dtype=np.int64)
                deviation = pa.array((z * z).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                z = n * y.astype(object) - np.array(sums, dtype=object)
                most = 10 ** 38
                deviation = pa.array([Decimal(x) if x < most else None for x in map(int, (z * z).sum(axis=1))], pa.decimal128(38, 0))
            w = ((y - mean) @ weights).ravel()
            offsets = pa.array(np.arange(0, len(w) + 1, k), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), deviation, pa.ListArray.from_arrays(offsets, pa.array(w))],
                                             names=["id", "deviation", "w"])

    white = points.mapInArrow(apply, f"id {id_type}, deviation decimal(38,0), w array<double>")
    error = identity_error(white, k, n)
    explained = F.array(*[F.lit(float(value / trace)) for value in values])
    return white.select(
        F.col("id").alias("vec_id"), "deviation",
        F.posexplode(F.arrays_zip(F.col("w").alias("w"), explained.alias("part"))).alias("place", "entry"),
    ).select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
             F.col("entry.w").alias("whitened"), F.col("entry.part").alias("explained"), F.lit(error).alias("identity_error"))


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """:func:`whiten` with the deviation as a long (null where it does not fit one)."""
    out = whiten(vectors)
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
