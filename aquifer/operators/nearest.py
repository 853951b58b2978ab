"""Nearest target of every row, for targets that are a table: centroids, map units, groups.

A task holds one block of targets at a time, at most `bound` numbers. Targets beyond that are met in passes over the rows:
each pass is a map that carries the best so far along, and is written before the next, so neither memory nor a shuffle
grows with rows x targets. Distances are added up component by component, in the same order for both sides, so they do
not depend on the batch and d(a, b) = d(b, a) to the last bit. Ties go to the smaller id. Most targets are ruled out
before: by boxes around rows that lie close together, where dimensions are few, and by a matrix product with a bound of its
rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from aquifer.operators.blocks import FEW, close_groups, dense, from_bytes, gathered
from aquifer.session import write_down

BOUND = 2_000_000  # numbers of a target block that a task holds
_CELLS = 1 << 20  # distances that are computed at once
_GROUP = 128  # rows that share a box
_TRIED = 8  # targets that bound the distance of a box's rows
_TOGETHER = 16  # groups for which targets are first ruled out at once
_ROWS, _BYTES = 1 << 18, 1 << 26  # of a gathered batch
MEASURES = ("euclidean", "cosine", "dot")
_SUMMED = 1 << 16  # sums that a task holds before it adds them up
FLOOR = 1e-8  # vectors with a smaller norm have cosine 0


def _costs(x: np.ndarray, targets: np.ndarray, measure: str) -> np.ndarray:
    """(row, target) -> squared distance, or less the cosine or the product."""
    out = np.zeros((len(x), len(targets)))
    if measure == "euclidean":
        for j in range(x.shape[1]):
            step = x[:, j, None] - targets[None, :, j]
            out += step * step
        return out
    for j in range(x.shape[1]):
        out -= x[:, j, None] * targets[None, :, j]
    if measure == "cosine":
        nx, nt = (np.sqrt((m * m).sum(1)) for m in (x, targets))
        scale = nx[:, None] * nt[None, :]
        ok = (nx >= FLOOR)[:, None] & (nt >= FLOOR)[None, :]
        out = np.where(ok, out / np.where(ok, scale, 1.0), 0.0)
    return out


def _rough(x: np.ndarray, targets: np.ndarray, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, slack): a @ b.T in single precision is each cost less a number of the row's own; a target whose entry lies over the
    row's least by more than `slack` cannot be its best. A slack that is not finite says nothing about its row."""
    top = np.sqrt((targets * targets).sum(1)).max()
    size = np.sqrt((x * x).sum(1))
    reach = size + top
    if measure == "euclidean":
        middle = targets.mean(0)
        x, targets = x - middle, targets - middle
        squares = (targets * targets).sum(1)
        spread = np.square(np.sqrt((x * x).sum(1)) + np.sqrt(squares.max()))
        a, b = np.column_stack([x, np.ones(len(x))]), np.column_stack([-2 * targets, squares])
    else:
        spread = size * top
        a, b = x, -targets
    single, double = np.finfo(np.float32).eps, np.finfo(float).eps
    slack = 16 * (x.shape[1] + 4) * (single * spread + double * reach * np.sqrt(spread) + np.square(double * reach)) + x.shape[1] * 1e-35
    return a.astype(np.float32), b.astype(np.float32), np.where(spread + top * top < 1e30, slack, np.inf)


def _pair_costs(x: np.ndarray, targets: np.ndarray, measure: str) -> np.ndarray:
    """The costs of row k and target k, added up as in `_costs`."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        if measure == "euclidean":
            step = x[:, j] - targets[:, j]
            out += step * step
        else:
            out -= x[:, j] * targets[:, j]
    return out


def _plain(x: np.ndarray, ids: np.ndarray, targets: np.ndarray, measure: str, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the best targets and their costs, from all costs."""
    c = _costs(x, targets, measure)
    if own is not None:
        place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        mine = np.flatnonzero(ids[place] == own)
        c[mine, place[mine]] = np.inf
    k = c.argmin(1)
    return k, c[np.arange(len(k)), k]


def _screened(x: np.ndarray, ids: np.ndarray, targets: np.ndarray, measure: str, own: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The same from a matrix product in single precision: only targets that its rounding leaves open are compared."""
    with np.errstate(all="ignore"):
        a, b, slack = _rough(x, targets, measure)
        rough = a @ b.T
        if own is not None:
            place = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            mine = np.flatnonzero(ids[place] == own)
            rough[mine, place[mine]] = np.inf
        limit = rough.min(1) + slack.astype(np.float32)
    sure = np.isfinite(limit)
    if not sure.all():
        k, cost = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        for rows, way in ((sure, _screened), (~sure, _plain)):
            if rows.any():
                k[rows], cost[rows] = way(x[rows], ids, targets, measure, None if own is None else own[rows])
        return k, cost
    row, k = np.divmod(np.flatnonzero((rough <= limit[:, None]).ravel()), len(ids))
    cost = _pair_costs(x[row], targets[k], measure)
    if len(row) > len(x):
        order = np.lexsort((k, cost, row))
        first = order[np.flatnonzero(np.diff(row, prepend=-1))]  # `row` ascends, so each row's pairs keep their place in `order`
        return k[first], cost[first]
    return k, cost


def _gaps(low: np.ndarray, high: np.ndarray, across: np.ndarray) -> np.ndarray:
    """(box, target) -> squared distance, no more than that of any row in the box, added up as in `_costs`. Boxes and targets are
    given across: a line a component."""
    out = np.zeros((low.shape[1], across.shape[1]))
    for lo, hi, t in zip(low, high, across):
        gap = np.maximum(lo[:, None] - t, t - hi[:, None])
        np.maximum(gap, 0.0, out=gap)
        gap *= gap
        out += gap
    return out


def _least(rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """The rows' least costs, added up as in `_costs`; rows and targets are given across."""
    out = np.zeros((targets.shape[1], rows.shape[1]))
    for x, t in zip(rows, targets):
        step = x - t[:, None]
        step *= step
        out += step
    return out.min(0)


def _within(x: np.ndarray, starts: np.ndarray, targets: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """For each group of rows that lie side by side (from its start on) the places of the targets that can be nearest to one of
    them: no farther from the group's box than the row that is worst off with a few targets near the middle. Groups that follow
    one another are close, so targets are first ruled out for some of them at once."""
    across, squares = np.ascontiguousarray(targets.T), (targets * targets).sum(1)
    ends = np.append(starts[1:], len(x))
    for k in range(0, len(starts), _TOGETHER):
        first, last = starts[k:k + _TOGETHER], ends[k:k + _TOGETHER]
        part, at = np.ascontiguousarray(x[first[0]:last[-1]].T), first - first[0]
        low, high = np.minimum.reduceat(part, at, axis=1), np.maximum.reduceat(part, at, axis=1)

        def worst(near, held, part=part, at=at):
            return np.array([_least(part[:, a:b], held[:, n]).max() for a, b, n in zip(at, [*at[1:], part.shape[1]], near)])

        with np.errstate(all="ignore"):
            middle = low + (high - low) / 2
            most = worst((squares - 2 * middle.T @ across).argmin(1)[:, None], across)
            some = np.flatnonzero(~(_gaps(low.min(1)[:, None], high.max(1)[:, None], across)[0] > most.max() * (1 + 1e-9)))
            held = across[:, some]
            if len(some) > _TRIED:
                most = worst(np.argpartition(squares[some] - 2 * middle.T @ held, _TRIED, axis=1)[:, :_TRIED], held)
            open_ = ~(_gaps(low, high, held) > (most * (1 + 1e-9))[:, None])
        for g in range(len(first)):
            yield slice(first[g], last[g]), some[open_[g]]


def pruned(measure: str, n: int, dim: int) -> bool:
    """Whether boxes around rows can rule targets out: many targets, few dimensions."""
    return measure == "euclidean" and n >= 1024 and dim <= FEW


def best_of(x: np.ndarray, ids: np.ndarray, targets: np.ndarray, measure: str, own: np.ndarray | None = None,
            starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's best target (ids ascending; `own`: an id that a row does not match) and its cost. `starts`: where groups of rows
    that lie close together begin, if the rows come in such groups."""
    best, cost = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
    if not len(ids) or not len(x):
        return best, cost
    way = _screened if measure != "cosine" and np.isfinite(targets).all() else _plain
    if way is _screened and own is None and pruned(measure, *targets.shape) and np.isfinite(x).all():
        if starts is None:
            parts = list(close_groups(x, _GROUP))
            order, starts = np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])
            best[order], cost[order] = best_of(x[order], ids, targets, measure, starts=starts)
            return best, cost
        groups = _within(x, starts, targets)
    else:
        step = max(1, _CELLS // len(ids))
        groups = ((slice(at, at + step), slice(None)) for at in range(0, len(x), step))
    for part, open_ in groups:
        k, c = way(x[part], ids[open_], targets[open_], measure, None if own is None else own[part])
        cost[part] = c
        best[part] = np.where(np.isfinite(c), ids[open_][k], -1)
    return best, cost


def _held(targets: DataFrame, dim: int, passes: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of the targets of one pass, ids ascending: about `bound` numbers."""
    block = targets if passes == 1 else targets.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k)
    held = block.select("id", "v").toArrow().combine_chunks()
    ids = held.column("id").to_numpy()
    v = held.column("v").combine_chunks()
    m = np.array(v.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _added_up(parts: list[tuple[np.ndarray, ...]], dim: int) -> tuple[np.ndarray, ...]:
    """(ids, counts, sums of distances, sums of vectors) from parts of them."""
    ids, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    cnt, err = (np.bincount(at, np.concatenate([p[k] for p in parts]), len(ids)) for k in (1, 2))
    s = np.concatenate([p[3] for p in parts])
    return ids, cnt, err, np.column_stack([np.bincount(at, s[:, j], len(ids)) for j in range(dim)])


SUMS = "best long, cnt double, err double, s array<double>"


def match_blocks(blocks: DataFrame, targets: DataFrame, size: tuple[int, int], bound: int = BOUND, kept: StructType | None = None) -> DataFrame:
    """Rows stored in blocks (`blocks.pack`) matched by Euclidean distance: the tasks' sums for each target that is some row's nearest
    (SUMS: rows, their distances, their vectors), or with `kept` (the schema of what was kept) the rows with `best`, which
    is NULL for a row without a whole vector."""
    n, dim = size
    spark = blocks.sparkSession
    passes = max(1, -(-n * dim // bound))
    last = SUMS if kept is None else StructType([*kept.fields, StructField("best", LongType())])
    columns = ["x", "starts", *([] if kept is None else ["kept"])]
    out = blocks.select(*columns)
    fields = ", ".join(f"{c} binary" for c in [*columns, "best", "cost"])
    for k in range(passes):
        sent = spark.sparkContext.broadcast(_held(targets, dim, passes, k))

        def run(batches: Iterator[pa.RecordBatch], k=k, sent=sent) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            parts: list[tuple[np.ndarray, ...]] = []
            for batch in batches:
                for at in range(batch.num_rows):
                    x, starts = (np.frombuffer(batch.column(c)[at].as_buffer(), t) for c, t in (("x", float), ("starts", np.int32)))
                    x = x.reshape(-1, dim)
                    there = slice(None) if len(starts) else np.flatnonzero(~np.isnan(x).any(1))
                    best, cost = np.full(len(x), -1, np.int64), np.full(len(x), np.inf)
                    best[there], cost[there] = best_of(x[there], ids, m, "euclidean", starts=starts if len(starts) else None)
                    if k:
                        b, c = (np.frombuffer(batch.column(o)[at].as_buffer(), t) for o, t in (("best", np.int64), ("cost", float)))
                        first = (b >= 0) & ((best < 0) | (c < cost) | ((c == cost) & (b < best)))
                        best, cost = np.where(first, b, best), np.where(first, c, cost)
                    if k + 1 < passes:
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 1) for c in columns), pa.array(
                            [best.tobytes()], pa.binary()), pa.array([cost.tobytes()], pa.binary())], [*columns, "best", "cost"])
                    elif kept is not None:
                        held = from_bytes(batch.column("kept")[at].as_buffer())
                        yield pa.RecordBatch.from_arrays([*held.columns, pa.array(best, pa.int64(), mask=best < 0)], [*held.schema.names, "best"])
                    elif len(some := np.flatnonzero(best >= 0)):
                        parts.append(_added_up([(best[some], np.ones(len(some)), np.sqrt(cost[some]), x[some])], dim))
                        if sum(len(p[0]) for p in parts) > _SUMMED:
                            parts = [_added_up(parts, dim)]
            if parts:
                best, cnt, err, s = _added_up(parts, dim)
                yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(cnt), pa.array(err), pa.array(list(s), pa.list_(pa.float64()))],
                                                 ["best", "cnt", "err", "s"])

        out = out.mapInArrow(run, last if k + 1 == passes else fields)
        if k + 1 < passes:
            out = write_down(out, "blocks", compression="none")
    return out


def match(rows: DataFrame, vec: str, targets: DataFrame, measure: str = "euclidean", own: str | None = None,
          bound: int = BOUND, size: tuple[int, int] | None = None, summed: bool = False) -> DataFrame:
    """The rows with `best` (id of the nearest target) and `score` (squared distance, cosine or product).

    `targets`: (id long, v array<double>), all of one length. `own`: a column (no NULL) with the id of a row's own target,
    which is left out. `size`: the targets' number and length, where the caller has counted them. NULL where a row has no whole
    vector of the targets' length (NULL or NaN components) or no target is left. `summed`: the rows are stored in blocks, and their
    sums for each target are the result, as of `match_blocks`.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}")
    spark = rows.sparkSession
    n, dim = size or targets.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if summed:
        return match_blocks(rows, targets, (n, dim), bound)
    out = rows.select("*", F.lit(None).cast("long").alias("best"), F.lit(None).cast("double").alias("score"))
    if not n or not dim:
        return out
    passes = -(-n * dim // bound)
    schema = StructType([*rows.schema.fields, StructField("best", LongType()), StructField("score", DoubleType())])
    kept, names = rows.columns, schema.names
    sign = 1.0 if measure == "euclidean" else -1.0
    for k in range(passes):
        sent = spark.sparkContext.broadcast(_held(targets, dim, passes, k))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, m = sent.value
            for batch in gathered(batches, _ROWS, _BYTES) if pruned(measure, *m.shape) else batches:
                there, x = dense(batch.column(vec), dim)
                best = batch.column("best").to_numpy(zero_copy_only=False).astype(float)
                before = np.where(np.isnan(best), -1, best).astype(np.int64)
                score = batch.column("score").to_numpy(zero_copy_only=False).astype(float)
                mine = None if own is None else batch.column(own).to_numpy(zero_copy_only=False).astype(np.int64)[there]
                b, c = best_of(x, ids, m, measure, mine)
                had = np.where(before[there] < 0, np.inf, sign * score[there])
                better = (b >= 0) & ((c < had) | ((c == had) & (b < before[there])))
                at = there[better]
                before[at], score[at] = b[better], sign * c[better] + 0.0
                none = before < 0
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(before, pa.int64(), mask=none),
                     pa.array(score, pa.float64(), mask=none)], names)

        out = out.mapInArrow(run, schema)
        if k + 1 < passes:
            out = write_down(out)
    return out
