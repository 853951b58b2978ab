"""Exact Lloyd clustering with heap-ordered bounds.

A vector's gap is a lower bound of the distance to its second nearest centroid less an upper bound of the distance to its
own. While the gap is above zero its cluster cannot change. When centroids move, the gap of every vector of cluster a
shrinks by at most the way of centroid a plus the longest way of any other, so a cluster needs one number: the drift added
up so far. A vector is put into its cluster's heap under gap + drift at that time; it expires when the cluster's drift
reaches that key. A round pops the expired vectors of each heap, compares them exactly with all centroids and pushes them
where they belong; the others are not looked at, nor are heaps whose first key is above the drift.

Vectors lie in blocks of up to `block` rows, one row of a table each: ids, integer components, cluster numbers and the
heaps as arrays in heap order. A round is a map over the blocks; a task adds to its output one row with what moved (sums
and counts by cluster), so that new centroids follow from the old sums and the moves. The driver holds centroids, sums and
drifts, k x (components + 1) numbers. Each round's table is written to the shared folder; the one before is then deleted,
so a lost executor repeats no round but its own.

Arithmetic is on integers and exact: float products while all terms stay below 2^53, else 64-bit integers. Bounds are
floats with a margin far above their rounding; a gap of zero (a tie) is always looked at again, and ties go to the smaller
cluster.

Defined cases: vectors that are null, of another length, or hold null, NaN or infinity take no part and are not returned.
Integers are held within 2^27, so that a squared distance fits in a long; an inertia that does not is null. Repeated rows are
vectors of their own. A null id hashes as an empty one. Equal hashes are put in the order of their vectors. With fewer
vectors than k each is a centroid; an empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquifer.llm.common import discard, map_batches, shared_folder

MOST = 1 << 27
EXACT = 1 << 22  # components below: products and their sums are exact in floats
STATE = "ids array<long>, x binary, cluster binary, keys binary, places binary, moved binary"
_NAMES = [c.split()[0] for c in STATE.split(", ")]


def integers(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null for vectors that take no part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = F.transform(vector, lambda x: F.floor(F.greatest(F.least(
        x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("long"))
    return F.when((F.size(vector) == dim) & whole, held)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(row, centroid) -> squared distance, exact."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        xf, cf = x.astype(np.float64), centroids.astype(np.float64)
        d = (xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)
        return d.astype(np.int64)
    return np.stack([((x.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's cluster, and a safe lower bound of its gap."""
    d = squared_distances(x, centroids)
    own = d.argmin(1)
    if d.shape[1] == 1:
        return own, np.full(len(x), np.inf)
    first, second = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64)).T
    return own, second - first - 1e-9 * (1 + second)


@dataclass
class Block:
    """Vectors with their clusters and, cluster by cluster, heaps of (key, row) in heap order."""

    ids: pa.Scalar
    x: np.ndarray
    cluster: np.ndarray
    keys: np.ndarray
    places: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, row: int, dim: int) -> Block:
        ids, x, cluster, keys, places = (batch.column(c)[row] for c in _NAMES[:5])
        n = len(ids.values)
        raw = x.as_buffer()
        return cls(ids, np.frombuffer(raw, f"<i{raw.size // (n * dim)}").reshape(n, dim),
                   np.frombuffer(cluster.as_buffer(), "<i4"), np.frombuffer(keys.as_buffer(), "<f8"),
                   np.frombuffer(places.as_buffer(), "<i4"))

    def row(self) -> list:
        return [self.ids.as_py(), *(a.tobytes() for a in (self.x, self.cluster, self.keys, self.places)), None]


def advance(block: Block, centroids: np.ndarray, drift: np.ndarray) -> tuple[Block, np.ndarray]:
    """The block after a round, and the rows that were looked at."""
    k = len(centroids)
    ends = np.cumsum(np.bincount(block.cluster, minlength=k))
    starts = ends - np.diff(ends, prepend=0)
    heaps: dict[int, list] = {}

    def opened(c: int) -> list:
        if c not in heaps:
            part = slice(starts[c], ends[c])
            heaps[c] = list(zip(block.keys[part].tolist(), block.places[part].tolist()))
        return heaps[c]

    expired = []
    for c in np.flatnonzero(ends > starts):
        if block.keys[starts[c]] <= drift[c]:
            heap = opened(c)
            while heap and heap[0][0] <= drift[c]:
                expired.append(heappop(heap)[1])
    looked = np.array(expired, np.int64)
    if not len(looked):
        return block, looked
    own, gap = nearest(block.x[looked], centroids)
    cluster = block.cluster.copy()
    cluster[looked] = own
    for c, key, place in zip(own.tolist(), (gap + drift[own]).tolist(), expired):
        heappush(opened(c), (key, place))
    return _laid_out(block, cluster, [heaps.get(c) or _closed(block, starts, ends, c, heaps) for c in range(k)]), looked


def _closed(block: Block, starts: np.ndarray, ends: np.ndarray, c: int, heaps: dict) -> tuple | list:
    return [] if c in heaps else (block.keys[starts[c]:ends[c]], block.places[starts[c]:ends[c]])


def _laid_out(block: Block, cluster: np.ndarray, heaps: list) -> Block:
    keys, places = [np.empty(0)], [np.empty(0, np.int32)]
    for heap in heaps:
        a, b = heap if isinstance(heap, tuple) else zip(*heap) if heap else ((), ())
        keys.append(np.asarray(a, np.float64))
        places.append(np.asarray(b, np.int32))
    return Block(block.ids, block.x, cluster.astype("<i4"), np.concatenate(keys), np.concatenate(places).astype("<i4"))


def first_heaps(ids: pa.Scalar, x: np.ndarray, centroids: np.ndarray) -> Block:
    own, gap = nearest(x, centroids)
    heaps = []
    for c in range(len(centroids)):
        rows = np.flatnonzero(own == c)
        heap = list(zip(gap[rows].tolist(), rows.tolist()))
        heapify(heap)
        heaps.append(heap)
    return _laid_out(Block(ids, x, own, gap, own), own, heaps)


class Moves:
    """Sums and counts by cluster that a task adds up."""

    def __init__(self, k: int, dim: int):
        self.sums = np.zeros((k, dim + 1), np.int64)

    def add(self, x: np.ndarray, to: np.ndarray, came: np.ndarray | None = None) -> None:
        rows = np.concatenate([x.astype(np.int64), np.ones((len(x), 1), np.int64)], axis=1)
        np.add.at(self.sums, to, rows)
        if came is not None:
            np.subtract.at(self.sums, came, rows)

    def row(self) -> list:
        return [None] * 5 + [self.sums.astype("<i8").tobytes()]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


def _packed(vectors: DataFrame, centroids: np.ndarray, block: int) -> DataFrame:
    """Blocks of (id, x) rows with their first heaps."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(k, dim)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = part.column("x").flatten().to_numpy().reshape(-1, dim)
                x = x.astype("<i2" if np.abs(x).max() < 1 << 15 else "<i4")
                made = first_heaps(pa.scalar(part.column("id").to_pylist(), pa.list_(pa.int64())), x, centroids)
                moves.add(x, made.cluster)
                yield _batch([made.row()])
        yield _batch([moves.row()])

    return map_batches(vectors, run, STATE)


def _advanced(state: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = Moves(k, dim)
        for batch in batches:
            for row in range(batch.num_rows):
                old = Block.read(batch, row, dim)
                new, looked = advance(old, centroids, drift)
                gone = looked[old.cluster[looked] != new.cluster[looked]]
                moves.add(old.x[gone], new.cluster[gone], old.cluster[gone])
                yield _batch([new.row()])
        yield _batch([moves.row()])

    return map_batches(state.where("x IS NOT NULL"), run, STATE)


def _moved(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """What all tasks of a round have moved, added up by cluster and component: k x (dim + 1) numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k * (dim + 1), np.int64)
        for batch in batches:
            for raw in batch.column("moved"):
                sums += np.frombuffer(raw.as_buffer(), "<i8")
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], ["at", "s"])

    parts = map_batches(state.where("moved IS NOT NULL").select("moved"), run, "at int, s long")
    out = np.zeros(k * (dim + 1), np.int64)
    for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r["s"]
    return out.reshape(k, dim + 1)


def _measured(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, squared distance to its centroid)."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b = Block.read(batch, row, dim)
                d = ((b.x.astype(np.int64) - centroids[b.cluster]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([b.ids.values, pa.array(b.cluster), pa.array(d)], ["id", "cluster", "distance"])

    return map_batches(state.where("x IS NOT NULL"), run, "id long, cluster int, distance long")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(STATE).parquet(path), path


@dataclass
class Fit:
    """The blocks after the last assignment, their folder, the final centroids (k x dim) and, round by round, the centroids
    that an assignment used."""

    state: DataFrame
    folder: str
    centroids: np.ndarray
    history: list[np.ndarray]

    def clusters(self) -> DataFrame:
        """(id, cluster, distance) of every vector."""
        return _measured(self.state, self.centroids)


def fit(vectors: DataFrame, centroids: np.ndarray, rounds: int, block: int = 1024) -> Fit:
    """`rounds` rounds of assignment and new centroids, then one more assignment. `vectors`: (id long, x array<long>)."""
    spark: SparkSession = vectors.sparkSession
    k, dim = centroids.shape
    state, folder = _written(_packed(vectors, centroids, block), "blocks")
    sums, drift, history = np.zeros((k, dim + 1), np.int64), np.zeros(k), [centroids]
    for _ in range(rounds):
        sums += _moved(state, k, dim)
        count = np.maximum(sums[:, dim:], 1)
        new = np.where(sums[:, dim:] > 0, sums[:, :dim] // count, centroids)
        way = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + 1e-12)
        others = np.array([np.delete(way, c).max(initial=0) for c in range(k)])
        centroids, drift = new, (drift + way + others) * (1 + 1e-12)
        old = folder
        state, folder = _written(_advanced(state, centroids, drift), "blocks")
        discard(spark, old)
        history.append(centroids)
    return Fit(state, folder, centroids, history)


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hash of the seed and their ids, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, dim: int = 64, scale: int = 256,
            vec_id: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """Every kept vector's cluster, squared distance, its cluster's and the whole inertia, and its centroid's digest."""
    spark = embeddings.sparkSession
    kept = embeddings.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector), dim, scale).alias("x")).where(
        "x IS NOT NULL")
    start = seeds(kept, k, seed)
    names = f"`{vec_id}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(start):
        return spark.createDataFrame([], names)
    done = fit(kept, start, rounds, block)
    rows = done.clusters().withColumnRenamed("id", vec_id)
    by_cluster = rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()  # k rows
    parts = [r["s"] for r in by_cluster]
    whole = None if None in parts or sum(parts) >= 1 << 63 else sum(parts)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in done.centroids.tolist()]
    table = spark.createDataFrame([(r["cluster"], r["s"], whole, digests[r["cluster"]]) for r in by_cluster],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(vec_id, "cluster", "distance", "cluster_inertia", "inertia",
                                                           "centroid_sha256")
