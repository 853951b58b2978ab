"""Null-safe numeric helpers and small vector/string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """NaN is 'missing' in the source data; Spark keeps NaN > x true, so map it to NULL."""
    c = _c(c)
    return F.when(~F.isnan(c), c)


def num(c) -> Column:
    """Coerce anything to DOUBLE: trimmed text parse, unparsable -> NULL, NaN/inf text -> NULL for NaN."""
    c = _c(c)
    parsed = F.trim(c.cast("string")).try_cast("double")
    return nan_to_null(parsed)


def r6(c) -> Column:
    """Round computed doubles to 6 decimals (report precision; engine-independent)."""
    return F.round(_c(c).cast("double"), 6)


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(c)))


def softplus(c) -> Column:
    """log(1 + exp(z)) without overflow: max(z,0) + log1p(exp(-|z|))."""
    c = _c(c)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def log_sigmoid(c) -> Column:
    return -softplus(-_c(c))


def clamp(c, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(c)))


def dot(a, b) -> Column:
    """Dot product of two equal-length numeric arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm2(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda s, v: s + v))


def cosine(a, b, floor: float = NORM_FLOOR) -> Column:
    """Cosine similarity; 0 when either norm is below `floor`; NULL when an input is NULL."""
    a, b = _c(a), _c(b)
    na, nb = norm2(a), norm2(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(
        (na < floor) | (nb < floor), F.lit(0.0)
    ).otherwise(dot(a, b) / (na * nb))


def slug(c, default: str = "column_unknown") -> Column:
    """lower, non [a-z0-9_] -> '_', collapse runs, strip '_', empty -> default."""
    s = F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9_]", "_")
    s = F.regexp_replace(s, r"_+", "_")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def first_nonempty(*cols) -> Column:
    return F.coalesce(*[F.nullif(F.trim(_c(c)), F.lit("")) for c in cols])


def years_since(ts, start: str) -> Column:
    """Fractional years since `start` using whole elapsed days (floor), /365.25."""
    return F.datediff(F.to_date(_c(ts)), F.lit(start).cast("date")) / F.lit(365.25)


def hash_uniform(seed: int, *cols) -> Column:
    """Deterministic uniform [0,1) per row from a seeded 64-bit hash (reproducible on recompute)."""
    h = F.xxhash64(F.lit(seed), *[_c(c) for c in cols])
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)
