"""Rows in blocks: stored once in an order in which rows that lie close together are read together.

A tree of cuts, made from a sample, deals the rows to cells; a cell is one task's, where its rows are put into groups that
lie side by side. The sample only decides where a row is stored. Rows that are equal in all dimensions are dealt by their place,
so that many copies of one row do not become one cell. A block is a few such groups as plain numbers, so that a pass over the
rows costs neither a conversion a row nor a search for close rows. Rows of many dimensions are dealt as they come.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquifer.session import write_down

BLOCK = "x binary, starts binary, kept binary"  # vectors; where groups begin, if the rows lie in groups; columns kept for the rows
FEW = 16  # dimensions up to which rows are stored by where they lie
_SAMPLE = 1 << 16  # rows that the cuts are made from
_CELL, _CELLS = 1 << 17, 1 << 12  # rows of a cell, most cells
_GROUP = 1024  # rows of a group
_HELD, _BYTES = 1 << 18, 1 << 26  # rows and bytes that are put in order at once
_NUMBERS = 100_000  # numbers of a block


@dataclass
class Cuts:
    """A tree: at node k rows whose component `dim[k]` is over `cut[k]` go to `after[k, 1]`, others to `after[k, 0]`; a leaf leads to
    itself. The component after the last is a row's place."""

    dim: np.ndarray
    cut: np.ndarray
    after: np.ndarray
    cell: np.ndarray
    depth: int
    sizes: np.ndarray  # of the cells, in the sample

    def of(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        wide, node = np.column_stack([x, place]), np.zeros(len(x), np.int64)
        first, after = np.arange(0, wide.size, wide.shape[1]), self.after.ravel()
        wide = wide.ravel()
        for _ in range(self.depth):
            node = after[2 * node + (wide[first + self.dim[node]] > self.cut[node])]
        return self.cell[node]


def places(n: int) -> np.ndarray:
    """Numbers from 0 to 1 that do not repeat, evenly spread."""
    return (np.arange(n) * 0.6180339887498949) % 1.0


def cuts(sample: np.ndarray, most: int) -> Cuts:
    """Cuts along the widest side, near the middle row, until a cell has at most `most` rows of the sample."""
    wide = np.column_stack([sample, places(len(sample))])
    dim, cut, after, cell, sizes, deepest = [0], [0.0], [[0, 0]], [-1], [], 0
    todo = [(0, np.arange(len(wide)), 0)]
    while todo:
        node, at, depth = todo.pop()
        deepest = max(deepest, depth)
        side = np.ptp(wide[at], 0) if len(at) > max(most, 1) else np.zeros(1)
        if not side.any():
            cell[node] = len(sizes)
            sizes.append(len(at))
            continue
        d = int(side[:-1].argmax()) if side[:-1].any() else len(side) - 1
        v = np.sort(wide[at, d])
        mid = v[len(v) // 2]
        under, upto = np.searchsorted(v, mid, "left"), np.searchsorted(v, mid, "right")
        c = mid if under == 0 or (upto < len(v) and upto - len(v) // 2 < len(v) // 2 - under) else v[under - 1]
        over = wide[at, d] > c
        dim[node], cut[node], after[node] = d, c, [len(dim), len(dim) + 1]
        for k, part in enumerate((at[~over], at[over])):
            dim.append(0), cut.append(0.0), after.append([len(dim) - 1] * 2), cell.append(-1)
            todo.append((after[node][k], part, depth + 1))
    return Cuts(np.array(dim), np.array(cut), np.array(after), np.array(cell), deepest, np.array(sizes))


def close_groups(x: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Places of rows that lie close together, at most `most` at a time: halves along the widest side."""
    todo = [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            yield at
            continue
        part = x[at]
        half = len(at) // 2
        order = np.argpartition(part[:, np.ptp(part, 0).argmax()], half)
        todo += [at[order[:half]], at[order[half:]]]


def gathered(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in larger batches, of about `rows` rows or `size` bytes, so that rows that lie close together are many."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        held.append(batch)
        n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
        if n >= rows or held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, held_bytes = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def dense(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows with a whole vector of that length, and their vectors."""
    lists = column.to_pylist() if column.null_count or column.values.null_count else None
    if lists is None:
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == dim).all():
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            there = np.flatnonzero(~np.isnan(x).any(1))
            return there, x[there]
        lists = column.to_pylist()
    there = [k for k, v in enumerate(lists) if v is not None and len(v) == dim and all(e is not None and e == e for e in v)]
    return np.array(there, np.int64), np.array([lists[k] for k in there], float).reshape(-1, dim)


def to_bytes(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as to:
        to.write_batch(rows)
    return out.getvalue().to_pybytes()


def from_bytes(stored: pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(stored).read_next_batch()


def _batch(schema: dict[str, pa.DataType], **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in schema.items()], list(schema))


def pack(rows: DataFrame, vec: str, n: int, dim: int, keep: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The stored blocks of about `n` rows with vectors of `dim` numbers, dealt evenly. Without `keep` only whole vectors are stored;
    with it every row is, those without a whole vector as NaN."""
    spark, keep = rows.sparkSession, list(keep)
    parts = max(3 * spark.sparkContext.defaultParallelism, -(-n // 500_000))
    tree = None
    if dim <= FEW:
        some = rows.select(vec) if n <= _SAMPLE else rows.select(vec).sample(_SAMPLE / n, 7)
        sample = dense(some.toArrow().combine_chunks().column(vec).combine_chunks(), dim)[1] if n else np.zeros((0, dim))
        sample = sample[np.isfinite(sample).all(1)]
        cell_rows = min(_CELL, -(-n // parts))
        tree = cuts(sample, max(1, len(sample) * cell_rows // max(n, 1), len(sample) // _CELLS))
        ends = np.cumsum(tree.sizes)
        part_of = np.minimum((ends - tree.sizes / 2) * parts / max(len(sample), 1), parts - 1).astype(np.int64)
    chunk = max(1, min(_NUMBERS // max(dim, 1), n // (4 * parts)))
    dealt = {"part": pa.int32(), "cell": pa.int32(), "x": pa.binary(), "kept": pa.binary()}
    stored = {"x": pa.binary(), "starts": pa.binary(), "kept": pa.binary()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        for batch in gathered(batches, _HELD, _BYTES):
            there, x = dense(batch.column(vec), dim)
            if keep and len(there) < batch.num_rows:
                whole = np.full((batch.num_rows, dim), np.nan)
                whole[there] = x
                there, x = np.arange(batch.num_rows), whole
            cell = np.full(len(x), -1, np.int64)
            if tree is not None:
                fine = np.flatnonzero(np.isfinite(x).all(1))
                cell[fine] = tree.of(x[fine], places(len(fine)))
            order = np.argsort(cell.astype(np.int16), kind="stable")  # at most _CELLS cells or so
            x, cell = x[order], cell[order]
            kept = batch.select(keep).take(pa.array(there[order])) if keep else None
            starts = np.flatnonzero(np.diff(cell, prepend=-2))
            out: dict[str, list] = {c: [] for c in dealt}
            for a, b in zip(starts, [*starts[1:], len(x)]):
                step = b - a if cell[a] >= 0 else chunk
                for s in range(a, b, step):
                    e = min(s + step, b)
                    turn += 1
                    out["part"].append(part_of[cell[a]] if cell[a] >= 0 else turn % parts)
                    out["cell"].append(cell[a])
                    out["x"].append(x[s:e].tobytes())
                    out["kept"].append(to_bytes(kept.slice(s, e - s)) if keep else None)
            yield _batch(dealt, **out)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for cell, x, kept in zip(batch.column("cell").to_pylist(), batch.column("x"), batch.column("kept")):
                one = held.setdefault(cell, [])
                # copies: the batch goes when its rows have been dealt
                one.append((np.frombuffer(x.as_py(), float).reshape(-1, dim), kept.as_py() if keep else None))
                if sum(len(v) for v, _ in one) >= _HELD:
                    yield from blocks(cell, held.pop(cell))
        for cell in sorted(held):
            yield from blocks(cell, held[cell])

    def blocks(cell: int, chunks: list) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([v for v, _ in chunks])
        kept = pa.Table.from_batches([from_bytes(pa.py_buffer(k)) for _, k in chunks]).combine_chunks() if keep else None
        most = max(1, _NUMBERS // max(dim, 1))
        groups = list(close_groups(x, min(_GROUP, most))) if cell >= 0 else [np.arange(a, min(a + most, len(x))) for a in range(0, len(x), most)]
        at = 0
        while at < len(groups):
            end, size = at + 1, len(groups[at])
            while end < len(groups) and size + len(groups[end]) <= most:
                size, end = size + len(groups[end]), end + 1
            rows_ = np.concatenate(groups[at:end])
            starts = np.cumsum([0, *map(len, groups[at:end - 1])]) if cell >= 0 else np.zeros(0)
            some = to_bytes(kept.take(pa.array(rows_)).combine_chunks().to_batches()[0]) if keep else None
            yield _batch(stored, x=[x[rows_].tobytes()], starts=[starts.astype(np.int32).tobytes()], kept=[some])
            at = end

    cells = rows.select(*keep, vec).mapInArrow(deal, "part int, cell int, x binary, kept binary")
    return write_down(cells.repartitionById(parts, F.col("part")).select("cell", "x", "kept").mapInArrow(order, BLOCK), "blocks", compression="none")
