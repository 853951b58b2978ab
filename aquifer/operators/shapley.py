"""Local attributions of any model that is a column expression: Shapley values by orders of the features over background rows.

For a row x, a background row b and an order of the features, the path from b to x changes one feature at a time in that order,
and a feature's share is the change of the prediction at its step. The shares of a path add up to f(x) - f(b), so their mean
over all pairs of background row and order adds up to f(x) less the background's mean prediction, whatever orders are drawn.
It all happens inside a row: no shuffle, no Python; the background and the orders are one literal of a stated size.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLLED = 64  # sets up to which each has its own expression


def feature_orders(width: int, orders: int, seed: int) -> list[list[int]]:
    """All orders of the features if there are at most `orders` (then the values are exact), else that many seeded ones, each
    with its reverse."""
    if math.factorial(min(width, 20)) <= orders:
        return [list(p) for p in itertools.permutations(range(width))]
    rng = np.random.default_rng(seed)
    half = [rng.permutation(width).tolist() for _ in range(-(-orders // 2))]
    return [o for p in half for o in (p, p[::-1])][:orders]


def changed_sets(ways: list[list[int]], width: int) -> dict[frozenset[int], list[int]]:
    """The sets of features that have changed at some step of the orders, and for each feature how often the prediction there
    is the one after its step, less how often it is the one before."""
    sets: dict[frozenset[int], list[int]] = {}
    for order in ways:
        for k, i in enumerate(order):
            for m, sign in ((frozenset(order[:k]), -1), (frozenset(order[:k + 1]), 1)):
                sets.setdefault(m, [0] * width)[i] += sign
    return sets


def shapley_values(df: DataFrame, features: list[str], predict: Callable[[list[Column]], Column], background: DataFrame,
                   orders: int = 24, seed: int = 0, rows: int = 50) -> DataFrame:
    """Every row with `phi_<feature>` and `base` (the background's mean prediction); the phis add up to predict(x) - base.

    `predict` maps one column for each feature to the prediction, and may use other columns of the row (a node's weights). The
    first `rows` rows of `background`, in its order, are the feature's bounded sample. A NULL or NaN feature counts as 0, as the
    models read it. Without background rows or features there is nothing to compare with: an error.
    """
    taken = background.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]).limit(rows).collect()
    if not taken or not features:
        raise ValueError("attributions need background rows and features")
    width = len(features)
    ways = feature_orders(width, orders, seed)
    sets = changed_sets(ways, width)
    given = F.from_json(F.lit(json.dumps({"b": [list(r) for r in taken], "s": [[i in m for i in range(width)] for m in sets]})),
                        "b array<array<double>>, s array<array<boolean>>")
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features])

    def total(changed: Callable[[int, Column], Column]) -> Column:
        """The predictions' sum over the background, each feature the row's or the background row's."""
        return F.aggregate(F.col("_p.b"), F.lit(0.0), lambda acc, b: acc + predict([changed(i, b[i]) for i in range(width)]).cast("double"))

    def over(m: frozenset[int]) -> Column:
        return total(lambda i, b: F.col("_x")[i] if i in m else b)

    if len(sets) <= UNROLLED:
        totals = F.array(*[over(m) for m in sets])
    else:
        totals = F.transform("_p.s", lambda on: total(lambda i, b: F.when(on[i], F.col("_x")[i]).otherwise(b)))

    def share(i: int) -> Column:
        weights = F.from_json(F.lit(json.dumps([float(m[i]) for m in sets.values()])), "array<double>")
        return F.aggregate(F.zip_with("_v", weights, lambda v, w: v * w), F.lit(0.0), lambda acc, v: acc + v)

    n = F.lit(float(len(taken) * len(ways)))
    t = df.withColumn("_x", x).withColumn("_p", given).withColumn("_v", totals)
    none = list(sets).index(frozenset())
    return t.select(*[F.col(c) for c in df.columns], *[(share(i) / n).alias(f"phi_{c}") for i, c in enumerate(features)],
                    (F.col("_v")[none] / F.lit(float(len(taken)))).alias("base"))
