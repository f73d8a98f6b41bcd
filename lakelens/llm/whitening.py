"""Whitening of embeddings by spectrum slicing (operator 12).

Two passes over the vectors give their exact integer covariance: sums first, then
products of entries centred at the rounded mean, which whole-number algebra
corrects to the mean itself.  Each task adds up its rows and ships one row for each
pair of dimensions.

The leading eigenvalues of that matrix (its size is the vectors' dimension, whatever
the number of rows) come from the signs of shifted factorisations V - s*I = L D L':
the number of positive entries of D is the number of eigenvalues above s.
Bisection on such counts isolates the k-th eigenvalue, Rayleigh quotient
iteration converges to it cubically, and two more counts, just below and just
above the value found, certify its number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.words import kept_table

SCALE, OFFSET = 1024, 100_000

#: Entries of the input beyond this are refused: their products would pass the sums' range.
LARGEST = float(1 << 20)


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x (whole numbers as doubles) of the rows whose vector has entries, all of them finite."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(v.isNotNull() & (F.size(v) > 0) & fine).select(
        F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v"))


def block_of(column) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of x = floor(1024 c) + 100000."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    if len(flat) % len(column) or (np.diff(column.offsets.to_numpy()) * len(column) != len(flat)).any():
        raise ValueError("vectors differ in length")
    if np.abs(flat).max() > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST:.0f}")
    return (np.floor(flat * SCALE).astype(np.int64) + OFFSET).reshape(len(column), -1)


def sums_of(vectors: DataFrame) -> tuple[int, np.ndarray]:
    """Number of vectors and their sums by dimension (whole numbers)."""
    def add(batches):
        import pyarrow as pa

        n, sums = 0, None
        for b in batches:
            if b.num_rows:
                x = block_of(b.column(0))
                if sums is not None and len(sums) != x.shape[1]:
                    raise ValueError("vectors differ in length")
                n, sums = n + len(x), (0 if sums is None else sums) + x.sum(axis=0)
        if n:
            yield pa.record_batch([pa.array([len(sums)] * len(sums)), pa.array(range(len(sums))), pa.array([n] * len(sums)),
                                   pa.array(sums)], ["dims", "d", "n", "s"])

    rows = (vectors.select("v").mapInArrow(add, "dims long, d long, n long, s long").groupBy("dims", "d")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # a row a dimension
    if len({r.dims for r in rows}) > 1:
        raise ValueError("vectors differ in length")
    rows.sort(key=lambda r: r.d)
    return (rows[0].n if rows else 0), np.array([int(r.s) for r in rows], object)


def scatter_of(vectors: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """n times the sum over vectors of (x - mean)(x - mean)', as whole numbers.

    With m the rounded mean and y = x - m, it is n * sum(y y') - sum(y) sum(y)'.
    Products are added as doubles in blocks so short that every sum is exact,
    or as whole numbers where entries are large."""
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    dims = len(sums)
    upper = np.triu_indices(dims)

    def add(batches):
        import pyarrow as pa

        total = np.zeros((2, len(upper[0])), np.int64)  # multiples of 2^31, and the rest
        any_row = False
        for b in batches:
            if not b.num_rows:
                continue
            any_row = True
            y = block_of(b.column(0)) - middle
            top = int(np.abs(y).max()) + 1
            step = (1 << 53) // (top * top)
            if step:
                for i in range(0, len(y), step):
                    part = y[i : i + step].astype(np.float64)
                    whole = (part.T @ part)[upper].astype(np.int64)
                    total += np.stack([whole >> 31, whole & 0x7FFFFFFF])
            else:
                for row in y:  # below 2^31 in size: a product fits
                    whole = np.outer(row, row)[upper]
                    total += np.stack([whole >> 31, whole & 0x7FFFFFFF])
        if any_row:
            yield pa.record_batch([pa.array(range(total.shape[1])), pa.array(total[0]), pa.array(total[1])], ["at", "hi", "lo"])

    rows = (vectors.select("v").mapInArrow(add, "at long, hi long, lo long").groupBy("at")
            .agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo"))).collect())  # a row a pair of dimensions
    out = np.zeros((dims, dims), object)
    rest = [int(s) - n * int(m) for s, m in zip(sums, middle, strict=True)]
    for r in rows:
        i, j = int(upper[0][r["at"]]), int(upper[1][r["at"]])
        out[i, j] = out[j, i] = n * ((int(r.hi) << 31) + int(r.lo)) - rest[i] * rest[j]
    return out


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above ``shift``: positive eigenvalues of
    D in P (V - shift I) P' = L D L', with 1x1 and 2x2 blocks chosen by Bunch and Parlett's rule
    (complete pivoting, so that entries stay bounded)."""
    a = matrix - shift * np.eye(len(matrix))
    alpha, above = (1 + 17**0.5) / 8, 0
    while n := len(a):
        off = np.abs(a)
        diagonal = off.diagonal().copy()
        d = int(diagonal.argmax())
        np.fill_diagonal(off, 0)
        i, j = divmod(int(off.argmax()), n)
        if off[i, j] == 0 and diagonal[d] == 0:
            return above
        if diagonal[d] >= alpha * off[i, j]:
            rest = np.delete(np.arange(n), d)
            above += a[d, d] > 0
            column = a[rest, d]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[d, d])
        else:  # a 2x2 block with a negative determinant: one eigenvalue of either sign
            rest = np.delete(np.arange(n), [i, j])
            above += 1
            block, columns = a[np.ix_([i, j], [i, j])], a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
            a = (a + a.T) / 2
    return int(above)


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` eigenvalues (falling) and unit eigenvectors (as columns) of a symmetric
    positive semi-definite matrix; fewer where its numerical rank is less.

    Equal eigenvalues (closer than rounding) get orthonormal vectors of their common space."""
    dims, size = len(matrix), float(np.abs(matrix).sum(axis=1).max(initial=0))
    tiny = dims * np.finfo(float).eps * size
    values, vectors = [], np.zeros((dims, 0))
    counts: dict[float, int] = {0.0: dims, size + 2 * tiny: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    def bracket(number: int) -> tuple[float, float]:
        low = max(s for s, c in counts.items() if c >= number)
        return low, min(s for s, c in counts.items() if c < number and s > low)

    rng = np.random.default_rng(12)
    if size == 0:
        return np.zeros(0), vectors
    for number in range(1, min(k, dims) + 1):
        while True:
            low, high = bracket(number)
            alone = counts[low] - counts[high] == 1
            close = high - low <= max(4 * tiny, 1e-3 * high) if alone else high - low <= 4 * tiny
            if close:
                break
            count((low + high) / 2)
        if high <= 8 * tiny:  # no more than rounding: the rank ends here
            break
        found = refined(matrix, low, high, vectors, tiny, rng)
        while found is None:  # left the bracket: halve it
            count((low + high) / 2)
            low, high = bracket(number)
            found = refined(matrix, low, high, vectors, tiny, rng, last=high - low <= 4 * tiny)
        value, vector = found
        if not count(value - 8 * tiny) >= number > count(value + 8 * tiny):
            raise ArithmeticError(f"eigenvalue {number} is not certified by the counts around it")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def refined(matrix, low, high, before, tiny, rng, last=False):
    """Rayleigh quotient iteration from within (low, high); None if it leaves it."""
    dims = len(matrix)

    def clean(v):
        for _ in range(2):
            v = v - before @ (before.T @ v)
            v = v / np.linalg.norm(v)
        return v

    def solved(shift, v):
        try:
            return np.linalg.solve(matrix - shift * np.eye(dims), v)
        except np.linalg.LinAlgError:
            return np.linalg.solve(matrix - (shift + tiny) * np.eye(dims), v)

    v, shift = clean(rng.standard_normal(dims)), (low + high) / 2
    for _ in range(3):  # inverse iteration picks the eigenvalue of the bracket
        v = clean(solved(shift, v))
    best = None
    for _ in range(12):
        shift = float(v @ matrix @ v)
        off = float(np.linalg.norm(matrix @ v - shift * v))
        if not low - 4 * tiny <= shift <= high + 4 * tiny and not last:
            return None
        if best is not None and off >= best[0]:
            break
        best = (off, shift, v)
        v = clean(solved(shift, v))
    return (best[1], best[2]) if best[0] <= 8 * tiny else None


def whitened(embeddings: DataFrame, components: int = 8, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal), whitened, explained and identity_error for
    every usable vector and component.

    A vector that is null, empty or holds a null or non-finite entry is left out.  Vectors of
    several lengths, or entries beyond 2^20, are an error.  Repeated rows count as
    often as they occur and are each returned; ids may be null.  Where the
    covariance has a smaller rank than ``components`` (few dimensions, few
    or equal vectors) there are as many components as its rank, so equal
    vectors alone, or an empty table, give no rows.  Columns not named are not read.  Eigenvectors
    have either sign; equal eigenvalues share a space in which any orthonormal
    basis is right.
    """
    spark = embeddings.sparkSession
    vectors = usable(embeddings, id_col, vector_col)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shape = (f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    n, sums = sums_of(vectors)
    if not n:
        return spark.createDataFrame([], shape)
    scatter = scatter_of(vectors, n, sums)
    covariance = np.array([[int(c) / (n * n) for c in row] for row in scatter], np.float64)  # correctly rounded
    trace = sum(int(scatter[i, i]) for i in range(len(sums))) / (n * n)
    values, axes = leading_eigenpairs(covariance, components)
    if not len(values):
        return spark.createDataFrame([], shape)
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    rest = np.array([int(s) - n * int(m) for s, m in zip(sums, middle, strict=True)], np.int64)
    away = rest.astype(np.float64) / n  # the mean less its rounded value
    turned = axes / np.sqrt(values)
    k = len(values)

    def project(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            y = block_of(b.column(1)) - middle
            w = (y - away) @ turned
            # (n x - S)^2 added modulo 2^64, and as doubles, which tell the multiple of 2^64
            with np.errstate(over="ignore"):
                parts = y * np.int64(n) - rest
                low = (parts * parts).sum(axis=1)
                about = (parts.astype(np.float64) ** 2).sum(axis=1)
            high = np.round((about - low.astype(np.float64)) / 2.0**64).astype(np.int64)
            yield pa.record_batch(
                [b.column(0), pa.array(high), pa.array(low),
                 pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), pa.array(w.ravel()))], ["vec_id", "high", "low", "w"])

    rows = kept_table(vectors.mapInArrow(project, f"vec_id {kind}, high long, low long, w array<double>"), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    seen = rows.agg(*(F.expr(f"covar_pop(w[{i}], w[{j}])").alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.element_at(F.array(*(F.lit(float(e / trace)) for e in values)), F.col("at") + 1)
    deviation = F.expr("CAST(high AS DECIMAL(20,0)) * CAST(18446744073709551616 AS DECIMAL(20,0)) + CAST(low AS DECIMAL(20,0))")
    return (rows.select("vec_id", deviation.cast("decimal(38,0)").alias("deviation"), F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    explained.alias("explained"), F.lit(float(error)).alias("identity_error")))
