"""Column expressions over dense vectors held as ``array<double>`` (or float).

Higher-order array functions run in the JVM; a pair distance is one pass over
the two arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda s, x: s + x)


def add(a: Column | str, b: Column | str) -> Column:
    """Element-wise sum of two arrays of equal length."""
    return F.zip_with(_c(a), _c(b), lambda p, q: p + q)


def scale(v: Column | str, s: Column | float) -> Column:
    """Divide every element by ``s``."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(v), lambda x: x / s)


def dot(a: Column | str, b: Column | str) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda p, q: p.cast("double") * q.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_c(v), lambda x: x.cast("double") * x.cast("double"))))


def sqdist(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance, summed in array order."""
    return _sum(F.zip_with(_c(a), _c(b),
                           lambda p, q: (p.cast("double") - q.cast("double"))
                           * (p.cast("double") - q.cast("double"))))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(sqdist(a, b))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine distance 1 - cos(a, b); 1 when either vector is zero."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / den)


def l2_normalize(v: Column | str, n: Column | str | None = None) -> Column:
    """Unit-length copy of the vector; a zero vector stays zero. Pass the norm as a
    column already computed (``n``) to avoid recomputing it for every element."""
    n = norm(v) if n is None else _c(n)
    return F.transform(_c(v), lambda x: F.when(n == 0, F.lit(0.0))
                       .otherwise(x.cast("double") / n))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "sqeuclidean": sqdist,
    "euclidean": euclidean,
    "cosine": cosine,
}


def metric(name_or_fn: str | Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    if callable(name_or_fn):
        return name_or_fn
    try:
        return METRICS[name_or_fn]
    except KeyError:
        raise ValueError(f"unknown metric {name_or_fn!r}; use one of {sorted(METRICS)}") from None


def stable(col: Column | str) -> Column:
    """Round a double to float precision and back. Sums taken in a different
    order differ in the last bits; after this they compare equal across engines."""
    return _c(col).cast("float").cast("double")


def vector_entries(v: Column | str) -> Column:
    """Stored entries of an ML vector as ``array<struct<index:int, value:double>>``:
    the non-zeros of a sparse vector (no dense expansion, whatever its size),
    every element of a dense one."""
    def entries(stored: Column) -> Column:
        values = stored["values"]
        # a dense vector stores no indices
        idx = F.coalesce(stored["indices"], F.transform(values, lambda x, i: i))
        return F.zip_with(idx, values, lambda i, x: F.named_struct(
            F.lit("index"), i, F.lit("value"), x))

    # bound once: the vector may be the result of a costly expression
    return F.flatten(F.transform(F.array(F.unwrap_udt(_c(v))), entries))
