"""Column-expression helpers. All are built-in Spark expressions (codegen, no Python per row)."""

from aquifer.functions.core import (  # noqa: F401
    clamp,
    cosine,
    dot,
    first_nonempty,
    hash_uniform,
    log_sigmoid,
    nan_to_null,
    norm2,
    num,
    r6,
    sigmoid,
    slug,
    softplus,
    years_since,
)
