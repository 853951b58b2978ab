"""Nearest neighbours by multiprobe p-stable hashing with exact reranking.

Each of `tables` hash tables cuts `projections` Gaussian (2-stable) projections of a vector into cells of width
w; the cells' numbers make its bucket. A query visits, in every table, its own bucket and perturbed ones (one
cell up or down in any of the projections) in the order of the estimated chance that a neighbour at distance
R lies there: the product, over the projections, of the normal mass of each cell around the query. It stops when
the chances add up to what a table must find for all tables together to reach `recall`. R, the distance of a
typical k-th neighbour, and w = 1.33 R are fitted on a bounded sample (`sample` rows, the first in a hash order of
the ids); every row is indexed. Candidates of all tables are merged and ranked by exact distance.

Equal vectors are indexed once, with their k + 1 smallest ids, so a common vector costs one row. Buckets
are dealt to parts of about `part_rows` rows; a query goes to the parts that hold buckets it visits and brings
back its k + 1 best of each. Parts are measured before anything meets: one that holds a crowded bucket is cut into
cells of about `part_rows` rows, which all of its queries go to, and one that many queries visit is repeated for
blocks of about `part_rows` queries, so that a task holds a bounded number of both. A query that finds fewer than
k + 1 rows is compared with every row, part by part.

Edge cases: vectors that are null, of another length than most, all zero, or hold null, NaN or infinity take no
part, nor do null ids; repeated rows count once; ties go to the smaller id; fewer candidates than k give
all of them; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aquifer.llm.common import freeze, mix64, sent

STEPS = (-1, 0, 1)


class Hashing:
    """The tables' projections, cells and probe orders; everything follows from the seed and R."""

    def __init__(self, dim: int, near: float, tables: int, projections: int, recall: float, seed: int):
        rng = np.random.default_rng(seed)
        self.near = near if near > 0 else 1.0
        self.width = 1.33 * self.near
        self.lines = rng.normal(size=(tables, dim, projections))
        self.shift = rng.uniform(0, self.width, (tables, projections))
        self.coefficients = mix64(np.arange(1, tables * (projections + 1) + 1)).reshape(tables, -1)
        grid = np.array(np.meshgrid(*[STEPS] * projections, indexing="ij")).reshape(projections, -1)
        self.moves = grid  # (projection, perturbation)
        self.enough = 1 - (1 - recall) ** (1 / tables)

    def cells(self, vectors: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers, and places inside the cells."""
        at = vectors @ self.lines[table] + self.shift[table]
        cell = np.floor(at / self.width)
        return cell.astype(np.int64), at - cell * self.width

    def keys(self, cells: np.ndarray, table: int) -> np.ndarray:
        c = self.coefficients[table]
        return (cells.astype(np.uint64) * c[1:]).sum(axis=-1, dtype=np.uint64) + c[0]

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(vector, table) -> bucket."""
        return np.stack([mix64(self.keys(self.cells(vectors, t)[0], t)) for t in range(len(self.lines))], axis=1)

    def probes(self, vector: np.ndarray) -> np.ndarray:
        """Buckets that a query visits, table by table in estimated success order."""
        out = []
        for t in range(len(self.lines)):
            cell, inside = (x[0] for x in self.cells(vector[None], t))
            edges = (np.array([-1, 0, 1, 2])[:, None] * self.width - inside) / self.near
            mass = np.diff(normal_cdf(edges), axis=0)  # (step, projection)
            chance = np.ones(1)
            for p in range(len(inside)):
                chance = np.outer(chance, mass[:, p]).ravel()
            order = np.argsort(-chance, kind="stable")
            n = int(np.searchsorted(np.cumsum(chance[order]), self.enough)) + 1
            moves = self.moves[:, order[:n]].T
            out.append(mix64(self.keys(cell + moves, t)))
        return np.unique(np.concatenate(out))


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """Phi(x) to about 1e-7 (Abramowitz and Stegun 7.1.26 for erf)."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = np.sign(x) * (1 - poly * np.exp(-z * z))
    return (1 + erf) / 2


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix in double precision."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v) of rows that can take part."""
    got = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    got = got.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    common = got.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return got.where(F.size("v") == (common[0]["dim"] if common else 0))


def typical_distance(rows: DataFrame, k: int, sample: int) -> float:
    """The 95 % quantile of the k-th neighbour's distance among `sample` rows (for up to 256 of them)."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = matrix(got.column("v"))
    if len(x) < 2:
        return 1.0
    kth = []
    for k0 in range(0, min(256, len(x)), 32):
        q = x[k0:min(k0 + 32, 256)]
        square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T
        kth.append(np.partition(square, min(k, len(x) - 1), axis=1)[:, min(k, len(x) - 1)])
    return float(np.sqrt(max(0.0, np.quantile(np.concatenate(kth), 0.95))))


def best_in_part(k: int):
    """For one part: each query's k + 1 nearest rows among those in the buckets it visits there."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"rep": [], "score": [], "vec_id": []}
        if len(index) and len(asked):
            bucket = index.column("bucket").to_numpy().astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, x = bucket[order], matrix(index.column("v"))[order]
            first = index.column("first_id").to_numpy()[order]
            ids = index.column("ids").combine_chunks()
            q = matrix(asked.column("v"))
            for row, (rep, keys) in enumerate(zip(asked.column("rep").to_pylist(), asked.column("buckets"))):
                if keys.values is None or not len(keys):
                    some = np.flatnonzero(bucket == bucket)  # every row of the part
                else:
                    want = keys.values.to_numpy()
                    lo, hi = np.searchsorted(bucket, want, "left"), np.searchsorted(bucket, want, "right")
                    n = hi - lo
                    some = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                if not len(some):
                    continue
                far = np.sqrt(((x[some] - q[row]) ** 2).sum(axis=1))
                _, one = np.unique(first[some], return_index=True)  # a row may lie in several tables' buckets
                one = one[np.lexsort((first[some][one], far[one]))][:k + 1]
                for j in one:
                    for i in ids[int(order[some[j]])].as_py():
                        out["rep"].append(rep)
                        out["score"].append(float(far[j]))
                        out["vec_id"].append(i)
        return pa.table(out, schema=pa.schema([("rep", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64())]))

    return run


def meet(index: DataFrame, asked: DataFrame, k: int, part_rows: int) -> DataFrame:
    """(rep, score, vec_id): each query's k + 1 best rows of every cell of a part that it goes to.

    A part of more than 2 `part_rows` rows is cut into cells by a hash of the class, and its queries into blocks of the same
    size by a hash of the query; a cell meets a block in one group.
    """
    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / (2 * part_rows)).alias(name))

    grid = sent(freeze(pieces(index, "cells").join(pieces(asked, "blocks"), "part"), "ann-grid"))
    every = {n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("cells", "blocks")}
    left = (index.join(grid, "part").withColumn("cell", F.pmod(F.xxhash64("first_id"), "cells"))
            .withColumn("block", every["blocks"]).drop("cells", "blocks"))
    right = (asked.join(grid, "part").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
             .withColumn("cell", every["cells"]).drop("cells", "blocks"))
    where = ["part", "cell", "block"]
    return left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(best_in_part(k), "rep long, score double, vec_id long")


def nearest(rows: DataFrame, k: int = 10, every: int = 100, tables: int = 6, projections: int = 8,
            recall: float = 0.95, sample: int = 20_000, part_rows: int = 8192, seed: int = 11,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row whose id is divisible by `every`."""
    good = freeze(usable(rows, vec_id, vector).distinct(), "ann-rows")
    spark = good.sparkSession
    total = good.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(good.first()["v"])
    hashing = Hashing(dim, typical_distance(good, k, sample), tables, projections, recall, seed)
    parts = max(1, -(-total * tables // part_rows))
    few = Window.partitionBy("v").orderBy("vec_id")
    classes = (good.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
               .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))  # k + 1 at most

    def index(batches):
        for b in batches:
            if b.num_rows:
                keys = hashing.buckets(matrix(b.column("v")))
                take = pa.array(np.repeat(np.arange(b.num_rows), tables))
                flat = keys.ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((flat % np.uint64(parts)).astype(np.int64)), pa.array(np.tile(np.arange(tables), b.num_rows)),
                     pa.array(flat.view(np.int64)), b.column("v").take(take), b.column("ids").take(take),
                     pa.array([i[0] for i in b.column("ids").to_pylist()], pa.int64()).take(take)],
                    names=["part", "t", "bucket", "v", "ids", "first_id"])

    indexed = freeze(classes.mapInArrow(
        index, "part long, t long, bucket long, v array<double>, ids array<long>, first_id long"), "ann-index")
    asking = good.where(F.col("vec_id") % every == 0)
    reps = asking.groupBy("v").agg(F.min("vec_id").alias("rep"))
    members = freeze(asking.join(reps, "v").select("vec_id", "rep", "v"), "ann-queries")
    heads = members.where("vec_id = rep").select("rep", "v")

    def visit(batches):
        for b in batches:
            out = {"part": [], "rep": [], "v": [], "buckets": []}
            for rep, v in zip(b.column("rep").to_pylist(), matrix(b.column("v")) if b.num_rows else ()):
                keys = hashing.probes(v)
                part = (keys % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for p, some in zip(*split_by(part[order], keys[order].view(np.int64))):
                    out["part"].append(int(p))
                    out["rep"].append(rep)
                    out["v"].append(v)
                    out["buckets"].append(some)
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("part", pa.int64()), ("rep", pa.int64()), ("v", pa.list_(pa.float64())), ("buckets", pa.list_(pa.int64()))]))

    asked = heads.mapInArrow(visit, "part long, rep long, v array<double>, buckets array<long>")
    asked = freeze(asked, "ann-asked")
    found = freeze(meet(indexed, asked, k, part_rows), "ann-found")
    counts = found.distinct().groupBy("rep").count().where(F.col("count") > k)
    short = freeze(heads.join(counts, "rep", "left_anti"), "ann-short")
    if total > 1 and not short.isEmpty():
        even = -(-total // part_rows)  # every class once, dealt evenly
        one_table = indexed.where("t = 0").withColumn("part", F.pmod(F.xxhash64("first_id"), F.lit(even)))
        all_parts = short.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(even - 1).cast("long")))).withColumn(
            "buckets", F.lit(None).cast("array<long>"))
        found = found.unionByName(meet(one_table, all_parts, k, part_rows))
    near_first = Window.partitionBy("rep").orderBy("score", "vec_id")
    merged = found.distinct().withColumn("nth", F.row_number().over(near_first)).where(F.col("nth") <= k + 1)
    ranked = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (members.select(F.col("vec_id").alias("query_id"), "rep").join(merged, "rep")
            .where(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def split_by(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, first = np.unique(sorted_keys, return_index=True)
    return keys, np.split(values, first[1:])
