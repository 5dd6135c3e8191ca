"""Whitening of embeddings by exact linear algebra on integers.

Each entry ``c`` becomes the integer ``x = floor(scale * c)``. The model is fitted to the distinct vectors: their number ``n``, sums
``S`` and products are integers, so ``A = n * sum(x x') - S S'``, which is ``n^2`` times the covariance, is exact.

* Characteristic polynomial of ``A``: modulo many primes, each by reduction to Hessenberg form and its recurrence, in Spark tasks;
  then Chinese remaindering of the coefficients, with as many primes as Hadamard's bound asks for.
* Roots: all are real, so the changes of sign among the coefficients of ``p(t + c)`` count those above ``c`` exactly. Bisection on
  that count isolates the largest roots, a bisection on the sign of ``p`` refines them to ``BITS`` binary digits of their own.
* Components: inverse iteration on ``A - root``, eliminated with pivots in decimals of ``DIGITS`` digits; components of one
  repeated root are made orthogonal to each other.

Rows whose vector is null, empty, or holds a null, NaN or infinite entry take no part, nor do those with an entry of
``|x| >= 2^40`` or of another length than the most frequent one (ties: the longer one). Repeated rows have a result each; equal
vectors teach once. A component without variance has no whitened values and is left out, so fewer rows come out if the vectors lie
in a smaller space; without rows nothing comes out. Repeated roots: any basis of their space, the same one for all rows.

The scatter is summed in the tasks and then per entry in Spark; the driver holds numbers of dimensions squared, never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .common import free_names, settle

BITS, DIGITS = 200, 90
LIMIT = 1 << 40


def integer_vectors(df: DataFrame, vector: str, scale: int, name: str, size: int | None = None) -> DataFrame:
    """Rows with a usable vector of ``size`` entries, else of the most frequent length, and ``name``, its entries as longs."""
    v = F.col(vector)
    usable = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * scale) >= float(LIMIT)))
    rows = df.where(F.coalesce(usable, F.lit(False))).withColumn(name, F.transform(v, lambda c: F.floor(c.cast("double") * scale)))
    if size is None:
        sizes = rows.groupBy(F.size(name).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        size = sizes["size"] if sizes else 0
    return rows.where(F.size(name) == size)


def exact_sums(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums and products of the rows of a matrix of longs below 2^40."""
    top = int(np.abs(x).max()) if x.size else 0
    sums = [int(s) for s in (x >> 20).sum(0)], [int(s) for s in (x & 0xFFFFF).sum(0)]
    if top * top * len(x) < 1 << 53:
        f = x.astype(np.float64)
        products = (f.T @ f).astype(np.int64).tolist()
    else:  # halves of 20 bits, whose products stay below 2^53 in blocks
        d = x.shape[1]
        products = [[0] * d for _ in range(d)]
        for at in range(0, len(x), 4096):
            hi, lo = (x[at:at + 4096] >> 20).astype(np.float64), (x[at:at + 4096] & 0xFFFFF).astype(np.float64)
            hh, hl, ll = hi.T @ hi, hi.T @ lo, lo.T @ lo
            for i in range(d):
                for j in range(d):
                    products[i][j] += (int(hh[i, j]) << 40) + ((int(hl[i, j]) + int(hl[j, i])) << 20) + int(ll[i, j])
    return [(a << 20) + b for a, b in zip(*sums)], products


def scatter(vectors: DataFrame, name: str, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and sums of products of all vectors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, [0] * d, [[0] * d for _ in range(d)]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            more_s, more_p = exact_sums(x)
            n += len(x)
            s = [a + b for a, b in zip(s, more_s)]
            p = [[a + b for a, b in zip(r, q)] for r, q in zip(p, more_p)]
        if n:
            rows = [(-1, -1, n), *((-1, i, v) for i, v in enumerate(s)), *((i, j, p[i][j]) for i in range(d) for j in range(i, d))]
            i, j, v = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(str, v))], ["i", "j", "v"])

    parts = vectors.select(name).mapInArrow(run, "i int, j int, v string")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # dimensions squared
    n, s, p = 0, [0] * d, [[0] * d for _ in range(d)]
    for r in total:
        if r["j"] < 0:
            n = int(r["v"])
        elif r["i"] < 0:
            s[r["j"]] = int(r["v"])
        else:
            p[r["i"]][r["j"]] = p[r["j"]][r["i"]] = int(r["v"])
    return n, s, p


def primes_below(top: int, many: int) -> list[int]:
    """The ``many`` largest primes below ``top``, at most 2^31, by Miller-Rabin with bases that decide there."""
    def prime(n: int) -> bool:
        if n % 2 == 0:
            return n == 2
        s = ((n - 1) & (1 - n)).bit_length() - 1
        for a in (2, 3, 5, 7):
            if n == a:
                return True
            x = pow(a, (n - 1) >> s, n)
            if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
                return False
        return n > 1

    out: list[int] = []
    n = top - 1
    while len(out) < many:
        if prime(n):
            out.append(n)
        n -= 1
    return out


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of ``det(t - a)`` modulo a prime below 2^31, the constant one first."""
    h = a.copy()
    d = len(h)
    for k in range(1, d - 1):
        pivots = np.flatnonzero(h[k:, k - 1])
        if not len(pivots):
            continue
        if (at := k + int(pivots[0])) != k:
            h[[k, at]] = h[[at, k]]
            h[:, [k, at]] = h[:, [at, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k] % p) % p
        for i, f in enumerate(u.tolist(), k + 1):  # products stay below 2^62, their sum would not
            if f:
                h[:, k] = (h[:, k] + h[:, i] * f) % p
    polys = [np.array([1], np.int64)]
    for m in range(d):
        q = np.zeros(m + 2, np.int64)
        q[1:] = polys[m]
        q[:-1] = (q[:-1] - int(h[m, m]) * polys[m]) % p
        t = 1
        for i in range(m - 1, -1, -1):
            t = t * int(h[i + 1, i]) % p
            if not t:
                break
            q[:i + 1] = (q[:i + 1] - (t * int(h[i, m]) % p) * polys[i]) % p
        polys.append(q % p)
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Coefficients of ``det(t - a)`` for an integer matrix, the constant one first."""
    d = len(a)
    norm = max(1, math.isqrt(sum(v * v for row in a for v in row)) + 1)
    # a coefficient is a sum of at most 2^d minors, each below norm^d
    primes = primes_below(1 << 31, (d * (norm.bit_length() + 1) + 2) // 30 + 1)
    shared = spark.sparkContext.broadcast(a)  # dimensions squared

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shared.value, object)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            rests = [polynomial_modulo((whole % p).astype(np.int64), p) for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(rests, pa.list_(pa.int64()))], ["p", "rests"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(run, "p long, rests array<long>").collect()
    product = math.prod(primes)
    total = [0] * (d + 1)
    for r in found:
        rest = product // r["p"]
        weight = rest * pow(rest, -1, r["p"])
        total = [t + weight * c for t, c in zip(total, r["rests"])]
    return [c - product if 2 * c > product else c for c in (t % product for t in total)]


def shifted(poly: list[int], at: int, bits: int) -> list[int]:
    """Coefficients of ``2^(bits d) p(t + at / 2^bits)``, up to positive factors by coefficient."""
    d = len(poly) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    return c


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """Roots above ``at / 2^bits`` with their multiplicity, exact since all roots are real (Descartes)."""
    signs = [c > 0 for c in shifted(poly, at, bits) if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def sign_at(poly: list[int], at: int, bits: int) -> int:
    value = 0
    d = len(poly) - 1
    for i in range(d, -1, -1):
        value = value * at + (poly[i] << (bits * (d - i)))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], many: int) -> list[tuple[int, int]]:
    """The ``many`` largest positive roots, falling, repeated ones repeatedly, each as ``number, bits``: number / 2^bits is less
    than the root by at most a 2^-BITS th of it, or is the root."""
    d = len(poly) - 1
    top = 1 << max(1, max((abs(c).bit_length() // (d - i) + 2 for i, c in enumerate(poly[:-1]) if c), default=1))
    out: list[tuple[int, int]] = []
    for k in range(1, min(many, roots_above(poly, 0, 0)) + 1):
        low, high, bits = 0, top, 0  # low / 2^bits < root <= high / 2^bits
        alone = False
        above_low, above_high = None, 0
        while high - low > 1 or low.bit_length() <= BITS:
            if high - low <= 1:
                low, high, bits = low << 1, high << 1, bits + 1
            mid = (low + high) // 2
            if alone:
                s = sign_at(poly, mid, bits)
                # left of the root the sign is that of one more change than right of it
                if s == 0:
                    low = high = mid
                    break
                if (s > 0) == (above_high % 2 == 0):
                    high = mid
                else:
                    low = mid
            else:
                n = roots_above(poly, mid, bits)
                if n >= k:
                    low, above_low = mid, n
                else:
                    high, above_high = mid, n
                alone = above_low is not None and above_low - above_high == 1
        out.append((low, bits))
    return out


def components_of(a: list[list[int]], roots: list[tuple[int, int]]) -> list[list[float]]:
    """Unit vectors ``v`` with ``a v = root v``, in doubles."""
    ctx = Context(prec=DIGITS, Emax=999_999, Emin=-999_999)
    d = len(a)
    found: list[list[Decimal]] = []
    for k, (number, bits) in enumerate(roots):
        root = ctx.divide(Decimal(number), Decimal(1 << bits))
        h = [[ctx.create_decimal(v) for v in row] for row in a]
        for i in range(d):
            h[i][i] = ctx.subtract(h[i][i], root)
        order = list(range(d))
        tiny = ctx.divide(root, Decimal(1 << (2 * BITS // 3)))
        for c in range(d):  # a = p l u, the factors of l below the diagonal
            at = max(range(c, d), key=lambda i: abs(h[i][c]))
            h[c], h[at] = h[at], h[c]
            order[c], order[at] = order[at], order[c]
            if abs(h[c][c]) < tiny:
                h[c][c] = tiny
            row = h[c]
            for i in range(c + 1, d):
                if h[i][c]:
                    f = h[i][c] = ctx.divide(h[i][c], row[c])
                    own = h[i]
                    for j in range(c + 1, d):
                        own[j] = ctx.subtract(own[j], ctx.multiply(f, row[j]))
        same = [v for v, r in zip(found, roots) if abs(r[0] * (1 << bits) - number * (1 << r[1])) * (1 << BITS // 2) <= number * (1 << r[1])]
        v = [ctx.create_decimal(1 + (i * 7919 + 104729 * k) % 1009) for i in range(d)]
        for _ in range(3):
            for u in same:
                dot = sum((ctx.multiply(x, y) for x, y in zip(u, v)), Decimal(0))
                v = [ctx.subtract(y, ctx.multiply(dot, x)) for x, y in zip(u, v)]
            b = [v[i] for i in order]
            for i in range(d):
                for j in range(i):
                    b[i] = ctx.subtract(b[i], ctx.multiply(h[i][j], b[j]))
            for i in range(d - 1, -1, -1):
                for j in range(i + 1, d):
                    b[i] = ctx.subtract(b[i], ctx.multiply(h[i][j], b[j]))
                b[i] = ctx.divide(b[i], h[i][i])
            for u in same:
                dot = sum((ctx.multiply(x, y) for x, y in zip(u, b)), Decimal(0))
                b = [ctx.subtract(y, ctx.multiply(dot, x)) for x, y in zip(u, b)]
            length = ctx.sqrt(sum((ctx.multiply(x, x) for x in b), Decimal(0)))
            v = [ctx.divide(x, length) for x in b]
        found.append(v)
    return [[float(x) for x in v] for v in found]


@dataclass
class Whitening:
    """``n``, integer sums, unit components, their eigenvalues and shares of the trace."""

    scale: int
    n: int
    sums: list[int]
    components: list[list[float]]
    values: list[float]
    explained: list[float]
    identity_error: float = 0.0


def fit(df: DataFrame, components: int = 4, vector: str = "embedding", scale: int = 256) -> Whitening:
    """Fits to the distinct integer vectors of ``df``."""
    name, = free_names(df, "_x")
    vectors = settle(integer_vectors(df, vector, scale, name).select(name).distinct())
    first = vectors.first()
    if first is None:
        return Whitening(scale, 0, [], [], [], [])
    n, s, p = scatter(vectors, name, len(first[0]))
    a = [[n * p[i][j] - s[i] * s[j] for j in range(len(s))] for i in range(len(s))]
    trace = sum(a[i][i] for i in range(len(s)))
    roots = largest_roots(characteristic_polynomial(vectors.sparkSession, a), components) if trace else []
    ctx = Context(prec=40)
    exact = [ctx.divide(Decimal(r), Decimal(1 << b)) for r, b in roots]
    values, explained = [float(ctx.divide(e, Decimal(n * n))) for e in exact], [float(ctx.divide(e, Decimal(trace))) for e in exact]
    model = Whitening(scale, n, s, components_of(a, roots), values, explained)
    model.identity_error = _identity_error(vectors, name, model)
    return model


def _projected(rows: DataFrame, name: str, model: Whitening, new: tuple[str, str]) -> DataFrame:
    """``rows`` with the exact deviation and the whitened values in place of the integers ``name``."""
    kept = [c for c in rows.columns if c != name]
    schema = StructType([*rows.select(*kept).schema.fields, *StructType.fromDDL("`{}` decimal(38,0), `{}` array<double>".format(*new)).fields])
    shared = rows.sparkSession.sparkContext.broadcast(model)  # components x dimensions

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, s = m.n, np.array(m.sums, object)
        small = max(map(abs, m.sums), default=0)
        w = np.array(m.components).T / (n * np.sqrt(m.values)) if m.components else np.zeros((len(s), 0))
        for batch in batches:
            at = batch.schema.get_field_index(name)
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(s))
            top = n * int(np.abs(x).max()) + small if x.size else 0
            if top * top * len(s) < 1 << 62:
                y = x * n - s.astype(np.int64)
                far = (y * y).sum(1).tolist()
            else:
                y = x.astype(object) * n - s
                far = (y * y).sum(1).tolist()
            z = y.astype(np.float64) @ w
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel(), pa.float64()))
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([Decimal(f) if f < 10**38 else None for f in far], pa.decimal128(38, 0)), out], [*kept, *new])

    return rows.mapInArrow(run, schema)


def _identity_error(vectors: DataFrame, name: str, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on its rows."""
    k = len(model.values)
    if not k:
        return 0.0
    w = _projected(vectors, name, model, ("_far", "_white")).select("_white")
    entry = lambda i: F.get("_white", F.lit(i))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = w.agg(*[F.covar_pop(entry(i), entry(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def transform(df: DataFrame, model: Whitening, vector: str = "embedding", names: tuple[str, str] = ("deviation", "whitened")) -> DataFrame:
    """Rows of ``df`` with a usable vector of the model's length, with ``deviation``, the exact sum of ``(n x - S)^2`` (null from
    10^38), and ``whitened``, an entry a component."""
    base = df.drop(*names)
    name, = free_names(base, "_x")
    return _projected(integer_vectors(base, vector, model.scale, name, len(model.sums)), name, model, names)


def fit_transform(df: DataFrame, components: int = 4, vector: str = "embedding", scale: int = 256) -> tuple[Whitening, DataFrame]:
    """The model and the whitened rows it was fitted to."""
    model = fit(df, components, vector, scale)
    return model, transform(df, model, vector)
