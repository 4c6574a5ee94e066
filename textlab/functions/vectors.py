"""Column expressions over ARRAY<FLOAT|DOUBLE> vectors (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(v: Column | str) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def sq_norm(v: Column | str) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(sq_norm(v))


def l2_normalize(v: Column | str, eps: float = 1e-12) -> Column:
    """x / max(||x||, eps); a zero vector stays zero. Result is ARRAY<DOUBLE>."""
    col = _c(v)
    norm = F.greatest(l2_norm(col), F.lit(eps))
    return F.transform(col, lambda x: x.cast("double") / norm)


def zeros(dim: int, dtype: str = "float") -> Column:
    return F.array_repeat(F.lit(0.0).cast(dtype), dim)


def pad_or_cut(v: Column | str, width: int, dtype: str = "float") -> Column:
    """Zero-pad to ``width`` or cut to ``width`` (stored vectors stay unpadded)."""
    col = _c(v)
    return F.slice(F.concat(col, zeros(width, dtype)), 1, width)


def sq_dist(a: Column | str, b: Column | str) -> Column:
    diffs = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, d: acc + d * d)
