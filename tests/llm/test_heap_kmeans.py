"""Heap-bounded clustering against plain Lloyd rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from aquifer.llm import heap_kmeans as hk
from aquifer.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, x int, id string, cluster int, distance long, keys int, moved string"


def lloyd(rows, k, rounds, dim, scale=256, seed=2):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid digest) with Python integers."""
    kept = [(i, [math.floor(max(min(scale * x, 2 ** 27), -2 ** 27)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, _, v in sorted((name(i), v, v) for i, v in kept)[:k]]

    def assign():
        c, x = np.array(cents, object), np.array([v for _, v in kept], object)
        d = ((x[:, None, :] - c[None]) ** 2).sum(-1) if len(kept) else []
        return [min((int(dd), j) for j, dd in enumerate(row)) for row in d]

    for _ in range(rounds):
        own = assign()
        for j in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    own = assign()
    inertia = [sum(d for d, c in own if c == j) for j in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, own)]


def held(got, want):
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_query_on_the_small_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held(QUERIES["op13_heap_kmeans"](spark, SF), lloyd(rows, 40, 5, 64))


def vectors(seed, n, dim, spread=0.2):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(9)]
    return [[float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)] for _ in range(n)]


def test_edges_ties_repeats_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = list(enumerate(vectors(1, 300, 8)))
    rows += [(i, [0.0, 0.25] * 4) for i in range(400, 650)] + rows[:20] + [(None, rows[3][1]), (None, rows[9][1])]
    rows += [(700, None), (701, []), (702, [1.0] * 7), (703, [1.0] * 9), (704, [nan] + [1.0] * 7), (705, [inf] + [1.0] * 7),
             (706, [None] + [1.0] * 7), (707, [0.0] * 8), (708, [-inf] * 8)]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame([(i, v, 1, "a", 2, 3, 4, "b") for i, v in rows], SCHEMA).repartition(5)
    for k, rounds in ((7, 4), (1, 2), (3, 0), (400, 2)):
        held(hk.cluster(frame, k=k, rounds=rounds, dim=8, block=64), lloyd(rows, k, rounds, 8))


def test_one_place_holds_most_rows(spark):
    rows = list(enumerate(vectors(3, 200, 4))) + [(1000 + i, [0.5, 0.5, 0.5, 0.5 + (i % 3) / 256]) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    held(hk.cluster(frame, k=6, rounds=5, dim=4), lloyd(rows, 6, 5, 4))


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((1e30, -1e30, rng.uniform(-5e5, 5e5))) for _ in range(3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(*r[:2], r[2], *r[3:]) for r in lloyd(rows, 5, 3, 3)]
    got = [tuple(r) for r in hk.cluster(frame, k=5, rounds=3, dim=3).collect()]
    assert sorted(r[:3] for r in got) == sorted(r[:3] for r in want)


def test_empty_table_and_nothing_kept(spark):
    for rows in ([], [(1, [1.0]), (2, None)]):
        out = hk.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("seed", range(6))
def test_a_round_looks_at_few_vectors_and_is_exact(seed):
    """Blocks advanced through rounds of moving centroids, against comparing everything; heaps keep their order."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    x = rng.integers(-200, 200, (800, 4)).astype("<i2")
    cents = x[:12].astype(np.int64)
    block = hk.first_heaps(pa.scalar(list(range(800)), pa.list_(pa.int64())), x, cents)
    drift, seen = np.zeros(12), []
    for _ in range(12):
        new = np.array([x[block.cluster == c].astype(np.int64).sum(0) // max(1, (block.cluster == c).sum()) for c in range(12)])
        way = np.sqrt(((new - cents) ** 2).sum(1)) * (1 + 1e-12)
        drift = (drift + way + [np.delete(way, c).max() for c in range(12)]) * (1 + 1e-12)
        cents = new
        block, looked = hk.advance(block, cents, drift)
        assert (block.cluster == hk.squared_distances(x, cents).argmin(1)).all()
        assert sorted(block.places) == list(range(800)) and (block.cluster[block.places] == np.sort(block.cluster)).all()
        seen.append(len(looked))
    assert min(seen) < 400


def test_folders_of_earlier_rounds_are_deleted(spark, tmp_path):
    import os

    from aquifer.llm.common import shared_folder

    root = os.path.dirname(shared_folder(spark, "x")).removeprefix("file:")
    before = set(os.listdir(root))
    hk.cluster(spark.read.parquet(f"{SF}/embeddings.parquet"), rounds=3).count()
    assert len([d for d in set(os.listdir(root)) - before if d.startswith("blocks-")]) == 1
