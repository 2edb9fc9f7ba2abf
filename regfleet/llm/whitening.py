"""Whitening of vectors on exact covariances from squares of sums.

Entries become whole numbers. With n distinct vectors x and sums S, the squares of the centred values n*x - S are
summed exactly for every dimension and for the sum of every two dimensions; half the difference between the variance
of a sum and the two variances is their covariance. Tasks add up whole numbers, so the result does not depend on how
rows are dealt out.
"""

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import freeze

#: Rows whose squares are added at once; limbs of 24 bits then stay below 2^63.
_ROWS = 4096
_LIMB = 24


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, as 64-bit numbers where they fit and as Python's otherwise."""
    near = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, near)]
    if max(map(abs, near)) >= 1 << 62 or len(x) and n * (float(np.abs(x.astype(np.float64) - np.array(near, float)).max()) + 1) >= 2.0**61:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return (x - np.array(near, dtype=np.int64)) * n - np.array(rest, dtype=np.int64)


def _sum_squares(values: np.ndarray) -> list[int]:
    """Exact sums of squares by column."""
    if values.dtype == object or len(values) and float(np.abs(values.astype(np.float64)).max()) >= 2.0 ** (2 * _LIMB - 1):
        return [sum(int(v) * int(v) for v in column) for column in values.T]
    low = values & ((1 << _LIMB) - 1)
    high = values >> _LIMB
    parts = [(high * high).sum(axis=0), (high * low).sum(axis=0), (low * low).sum(axis=0)]
    return [(int(h) << 2 * _LIMB) + (int(m) << _LIMB + 1) + int(s) for h, m, s in zip(*(p.tolist() for p in parts))]


def _exact_sums(df: DataFrame, terms, labels: list[str], kind: str) -> list:
    """Rows of ``terms(batch)`` (label columns, then an exact number) added up by label."""
    schema = ", ".join(f"{name} int" for name in labels) + f", total {kind}"
    added = df.mapInArrow(terms, schema).groupBy(*labels).agg(F.sum("total").alias("total"))
    return added.collect()


def fit_whitening(fit: DataFrame, dim: int, components: int) -> dict | None:
    """Components of the distinct vectors in column ``x`` of ``fit``; None without rows.

    ``dim`` numbers and their pairs go to the driver, whatever the number of rows.
    """
    whole = pa.decimal128(38, 0)

    def add_entries(batches):
        total, n = [0] * dim, 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + (h << 32) + s for t, h, s in zip(total, high, low)]
            n += len(x)
        if n:
            numbers = pa.array([Decimal(v) for v in [n, *total]], whole)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), numbers], ["d", "total"])

    sums = {r["d"]: int(r["total"]) for r in _exact_sums(fit, add_entries, ["d"], "decimal(38,0)")}
    if not sums:
        return None
    n, s = sums[-1], [sums[d] for d in range(dim)]

    def add_squares(batches):
        """Pair (i, i) is dimension i, pair (i, j) the sum of two."""
        total = [[0] * (dim - i) for i in range(dim)]
        rows = 0
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            rows += len(x)
            for at in range(0, len(x), _ROWS):
                v = _centred(x[at : at + _ROWS], n, s)
                for i in range(dim):
                    both = v[:, i:] + v[:, i : i + 1]
                    both[:, 0] = v[:, i]
                    total[i] = [t + q for t, q in zip(total[i], _sum_squares(both))]
        if rows:
            for i in range(dim):
                numbers = pa.array([Decimal(v) for v in total[i]], whole)
                pair = [pa.array([i] * (dim - i), pa.int32()), pa.array(range(i, dim), pa.int32())]
                yield pa.RecordBatch.from_arrays([*pair, numbers], ["i", "j", "total"])

    squares = {(r["i"], r["j"]): int(r["total"]) for r in _exact_sums(fit, add_squares, ["i", "j"], "decimal(38,0)")}
    covariance = np.zeros((dim, dim))
    for (i, j), total in squares.items():
        cross = total if i == j else Fraction(total - squares[i, i] - squares[j, j], 2)
        covariance[i, j] = covariance[j, i] = float(Fraction(cross, n**3))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    # What is left of a dimension without spread is rounding, not a component.
    count = int((values[:components] > max(values[0], 0.0) * dim * np.finfo(float).eps).sum())
    model = {
        "n": n,
        "sums": s,
        "axes": vectors[:, :count],
        "scales": np.sqrt(values[:count]),
        "explained": values[:count] / float(sum(Fraction(squares[d, d], n**3) for d in range(dim))) if count else values[:0],
        "covariance": covariance,
    }
    model["identity_error"] = _identity_error(fit, dim, model) if count else 0.0
    return model


def _whitened(centred: np.ndarray, model: dict) -> np.ndarray:
    return (centred.astype(np.float64) / model["n"]) @ model["axes"] / model["scales"]


def _identity_error(fit: DataFrame, dim: int, model: dict) -> float:
    """Largest absolute entry of the covariance of the whitened fit rows minus the identity.

    The whitened rows are centred already: they are made from n*x - S, whose sums are exactly zero.
    """
    count = len(model["scales"])

    def add_products(batches):
        total = np.zeros((count, count))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), _ROWS):
                w = _whitened(_centred(x[at : at + _ROWS], model["n"], model["sums"]), model)
                total += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "total"]
        )

    return max(abs(r["total"] / model["n"] - (r["i"] == r["j"])) for r in _exact_sums(fit, add_products, ["i", "j"], "double"))


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, shift: int = 1_000_000
) -> DataFrame:
    """Every usable vector on the first ``components`` whitened components.

    A vector is left out if it is null or empty, holds null or non-finite entries, or has another length than most
    vectors (of lengths as frequent, the greater counts). Each entry c counts as floor(scale * c) + shift. The
    covariance is that of the distinct vectors, each once, however often it is repeated. Components without spread
    have no rows; neither has a table whose usable vectors are all equal. Returns the id, ``component`` (from 1 by
    falling variance), ``n`` (distinct vectors), ``deviation`` (sum of squares of n*x - S, exact; null beyond a
    BIGINT), ``whitened``, ``explained`` (share of the variance) and ``identity_error``. Other columns are not read.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    named = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(_usable(F.col("v")))
    whole = F.transform("v", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint") + F.lit(shift).cast("bigint"))
    usable = named.select("id", whole.alias("x"))
    lengths = usable.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = None
    if lengths:
        dim = lengths[0]["dim"]
        usable = usable.filter(F.size("x") == dim)
        model = fit_whitening(freeze(usable.select("x").distinct(), "whitening-fit"), dim, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)

    def project(batches):
        count = len(model["scales"])
        for batch in batches:
            for at in range(0, batch.num_rows if count else 0, _ROWS):
                rows = batch.slice(at, _ROWS)
                v = _centred(_matrix(rows.column("x"), dim), model["n"], model["sums"])
                if v.dtype != object and (v.astype(np.float64) ** 2).sum(axis=1).max() >= 2.0**62:
                    v = v.astype(object)
                deviation = [d if d < 1 << 63 else None for d in (v * v).sum(axis=1).tolist()]
                white = _whitened(v, model)
                m = rows.num_rows
                by_row = pa.array(np.repeat(np.arange(m), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("id").take(by_row),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * count, model["n"], dtype=np.int64)),
                        pa.array(deviation, pa.int64()).take(by_row),
                        pa.array(white.ravel()),
                        pa.array(np.tile(model["explained"], m)),
                        pa.array(np.full(m * count, model["identity_error"])),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return usable.mapInArrow(project, schema).withColumnRenamed("id", id_col)
