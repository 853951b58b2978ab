"""Site clustering: nearest targets, the map, merging by sums, guards, tiers and assignment."""

import math

import numpy as np
import pandas as pd
import pytest
from linkage import naive_agglomerate
from pyspark.sql import functions as F

from aquifer.operators import blocks, nearest, sites
from aquifer.operators.nearest import match

ITEMS = "item long, v array<double>"


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v))) for i, v in rows], schema).repartition(3)


def cosine_distances(x):
    norm = np.linalg.norm(x, axis=1)[:, None]
    u = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    return 1 - u @ u.T


@pytest.mark.parametrize("seed,threshold", [(0, 0.6), (1, 0.3)])
def test_merging_by_sums_equals_the_naive_version(spark, seed, threshold):
    x = np.random.default_rng(seed).normal(size=(200, 5))
    x[7] = 0
    got = {r.item: r.cluster for r in sites.merge_groups(frame(spark, enumerate(x), ITEMS), threshold).collect()}
    assert [got[i] for i in range(200)] == naive_agglomerate_fast(cosine_distances(x), threshold)


def naive_agglomerate_fast(d, threshold, n_groups=1):
    """The closest pair again and again, on a matrix of summed distances."""
    n = len(d)
    s, size, label = d.astype(float).copy(), np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    while alive.sum() > n_groups:
        mean = s / np.outer(size, size)
        mean[~alive] = mean[:, ~alive] = np.inf
        np.fill_diagonal(mean, np.inf)
        a, b = sorted(np.unravel_index(mean.argmin(), mean.shape))
        if mean[a, b] >= threshold:
            break
        s[a] += s[b]
        s[:, a] += s[:, b]
        size[a] += size[b]
        alive[b] = False
        label[label == b] = a
    return label.tolist()


def test_the_two_naive_versions_agree():
    d = cosine_distances(np.random.default_rng(9).normal(size=(40, 3)))
    assert naive_agglomerate(d, 0.6) == naive_agglomerate_fast(d, 0.6)


def test_merging_to_a_number_of_groups(spark):
    x = np.random.default_rng(2).normal(size=(60, 4))
    items = frame(spark, [*enumerate(x), (99, None)], ITEMS)
    for n in (1, 4, 60):
        got = {r.item: r.cluster for r in sites.merge_groups(items, n_groups=n).collect()}
        assert [got[i] for i in range(60)] == naive_agglomerate_fast(cosine_distances(x), math.inf, n) and got[99] == 99


def test_merging_equal_and_lone_items(spark):
    items = frame(spark, [(k, [1.0, 1.0]) for k in range(9)] + [(20, [-1.0, 0.0]), (21, None)], ITEMS)
    got = {r.item: r.cluster for r in sites.merge_groups(items, 0.6).collect()}
    assert {got[k] for k in range(9)} == {0} and got[20] == 20 and got[21] == 21
    assert sites.merge_groups(items.where("item < 0"), 0.6).count() == 0


def test_matching_in_passes_equals_one_pass(spark):
    rng = np.random.default_rng(3)
    rows = frame(spark, [*enumerate(rng.normal(size=(300, 6))), (900, None), (901, [0] * 6), (902, [1, 2]), (903, [math.nan] * 6)],
                 "id long, x array<double>")
    centres = rng.normal(size=(41, 6))
    centres[40] = centres[3]  # a tie goes to the smaller id
    targets = frame(spark, enumerate(centres), "id long, v array<double>")
    for measure in ("euclidean", "cosine", "dot"):
        whole = {r.id: (r.best, r.score) for r in match(rows, "x", targets, measure).collect()}
        passes = {r.id: (r.best, r.score) for r in match(rows, "x", targets, measure, bound=70).collect()}
        assert whole == passes and whole[900] == whole[902] == whole[903] == (None, None)
    x = np.array([r.x for r in rows.where("id < 300").orderBy("id").collect()])
    want = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
    assert [match(rows, "x", targets).where("id < 300").orderBy("id").collect()[k].best for k in (0, 150, 299)] == want[[0, 150, 299]].tolist()
    assert match(rows, "x", targets.where("id < 0")).where("best IS NOT NULL").count() == 0


def test_a_row_is_not_matched_with_its_own_target(spark):
    x = frame(spark, [(1, [1, 0]), (5, [1, 0]), (9, [0, 1])], "id long, v array<double>")
    got = {r.id: r.best for r in match(x, "v", x, "dot", own="id").collect()}
    assert got == {1: 5, 5: 1, 9: 1}


@pytest.mark.parametrize("bound", [2_000_000, 50])
def test_map_equals_smoothing_with_the_whole_matrix(spark, bound):
    """Six by six units, as one matrix of kernel values over all pairs of units would move them."""
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(loc=c, size=(80, 4)) for c in range(4)])
    start = rng.normal(size=(36, 4))
    rows = spark.createDataFrame(pd.DataFrame({"v": list(x)}), "v array<double>")
    code, errors = sites.fit_map(rows, "v", grid=6, epochs=3, bound=bound, start=frame(spark, enumerate(start), "id long, v array<double>"))
    at = np.array([(k // 6, k % 6) for k in range(36)], float)
    kernel = np.exp(-((at[:, None] - at[None]) ** 2).sum(-1) / (2 * 0.3 ** 2))
    want, seen = start.copy(), []
    for _ in range(3):
        d = np.sqrt(((x[:, None] - want[None]) ** 2).sum(-1))
        won = d.argmin(1)
        seen.append(d.min(1).mean())
        cnt = np.bincount(won, minlength=36).astype(float)
        sums = np.array([x[won == k].sum(0) for k in range(36)])
        den = kernel @ cnt
        move = den > 1e-12
        want[move] = (kernel @ sums)[move] / den[move][:, None]
    got = np.array([r.v for r in code.orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-9, rtol=0) and np.allclose(errors, seen, atol=1e-9) and errors[-1] <= errors[0]


def test_map_of_few_and_no_rows(spark):
    rows = frame(spark, [(0, [1.0, 2.0]), (1, None)], "id long, v array<double>")
    code, _ = sites.fit_map(rows, "v", grid=2, epochs=2)
    assert code.count() == 4 and code.where("v[0] = 1.0 AND v[1] = 2.0").count() >= 1
    assert sites.fit_map(rows.where("id > 5"), "v")[0].count() == 0


def clouds(spark, n=600):
    rng = np.random.default_rng(3)
    centres = np.array([[8, 0, 0, 0, 1], [0, 8, 0, 1, 0], [-9, -7, 0, 0, 0]], float)
    size = [0.6, 0.3, 0.1]
    kind = rng.choice(3, n, p=size)
    x = centres[kind] + rng.normal(0, 0.3, (n, 5))
    return spark.createDataFrame([(i, int(k), *map(float, v)) for i, (k, v) in enumerate(zip(kind, x))],
                                 "id long, kind int, a double, b double, c double, d double, e double")


def test_sites_end_to_end(spark):
    df = clouds(spark)
    fitted = sites.fit_sites(df, list("abcde"), grid=4, epochs=4)
    got = fitted.label(df, ["id", "kind"]).toPandas()
    assert len(got) == 600 and got.groupby("kind").cluster_id.nunique().max() == 1 and got.cluster_id.nunique() == 3
    assert got.groupby("kind").node_tier.first().tolist() == [1, 2, 3]
    new = spark.createDataFrame([(1, 8.0, 0.0, 0.0, 0.0, 1.0), (2, -9.0, -7.0, None, 0.0, 0.0)],
                                "id long, a double, b double, c double, d double, e double")
    test = fitted.assign(new.drop("e"), ["id"]).toPandas().set_index("id")
    by_kind = got.groupby("kind").cluster_id.first()
    assert test.loc[1].cluster_id == by_kind[0] and test.loc[2].cluster_id == by_kind[2] and not test.low_confidence.any()
    again = sites.fit_sites(df.repartition(7), list("abcde"), grid=4, epochs=4).label(df, ["id"]).toPandas()
    assert (again.sort_values("id").cluster_id.to_numpy() == got.sort_values("id").cluster_id.to_numpy()).all()


def test_guards_give_one_cluster(spark):
    df = clouds(spark)
    cases = [(df.select("id", df.a.cast("string").alias("a")), ["a"], sites.NO_COLUMNS), (df.withColumn("e", df.a * 0), list("abcde"), sites.STATIC),
             (df.limit(74), list("abcde"), sites.TOO_FEW), (df.limit(0), list("abcde"), sites.STATIC)]
    for rows, columns, reason in cases:
        fitted = sites.fit_sites(rows, columns)
        assert fitted.reason == reason
        assert {(r.cluster_id, r.node_tier) for r in fitted.label(df, ["id"]).collect()} == {(-1, 3)}
        assert {(r.cluster_id, r.low_confidence) for r in fitted.assign(df, ["id"]).collect()} == {(-1, True)}


def test_assign_ties_and_no_centroids(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "id int, v array<double>")
    cents = frame(spark, [(5, [1, 0]), (3, [2, 0])], "id long, v array<double>")
    out = sites.nearest_centroid(rows, "v", cents).orderBy("id").collect()
    assert out[0].assigned == 3 and out[0].low_confidence is False  # a tie: the smaller id
    assert out[1].sim == 0.0 and out[1].low_confidence is True
    assert all(r.assigned == -1 for r in sites.nearest_centroid(rows, "v", cents.where("id < 0")).collect())


@pytest.mark.parametrize("measure,dim", [("euclidean", 5), ("euclidean", 40), ("dot", 5)])
def test_most_targets_are_ruled_out_and_the_best_stay_the_same(monkeypatch, measure, dim):
    """Ties, equal targets, far offsets and values of many sizes: bit for bit what all distances give, from few of them."""
    rng = np.random.default_rng(8)
    x, targets = (np.round(rng.normal(size=(n, dim)), 2) for n in (4000, 1500))
    targets[700:720], x[:20] = targets[3], targets[3]
    targets[900:905] *= 1e-9
    x[30], x[31] = 1e200, 1e-200
    ids = np.arange(1500) * 2
    for shift in (0.0, 1e8 if measure == "euclidean" else 1.0):
        own = ids[np.arange(4000) % 1500] if measure == "dot" else None
        want = nearest._plain(x + shift, ids, targets + shift, measure, own)
        counted, costs, pairs = [], nearest._costs, nearest._pair_costs
        monkeypatch.setattr(nearest, "_costs", lambda a, b, m: counted.append(len(a) * len(b)) or costs(a, b, m))
        monkeypatch.setattr(nearest, "_pair_costs", lambda a, b, m: counted.append(len(a)) or pairs(a, b, m))
        best, cost = nearest.best_of(x + shift, ids, targets + shift, measure, own)
        monkeypatch.undo()
        assert np.array_equal(best, np.where(np.isfinite(want[1]), ids[want[0]], -1)) and np.array_equal(cost, want[1])
        assert sum(counted) < 4000 * 1500 / 10


def test_a_round_of_merges_writes_one_table(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(60, 3))
    written, write = [], sites.write_down
    monkeypatch.setattr(sites, "write_down", lambda df, *a: written.append(1) or write(df, *a))
    rounds = sites.merges(frame(spark, enumerate(x), ITEMS), 0.6).agg({"round": "max"}).first()[0] + 1
    assert rounds > 1 and len(written) == 1 + rounds + 1  # the start, the rounds, the one that finds nothing


def test_rows_read_many_times_are_dealt_evenly(spark, monkeypatch):
    seen, found = [], sites.match
    monkeypatch.setattr(sites, "match", lambda rows, *a, **k: seen.append(rows.rdd.getNumPartitions()) or found(rows, *a, **k))
    rows = spark.createDataFrame([([float(i), 1.0],) for i in range(200)], "v array<double>").coalesce(1)
    sites.fit_map(rows, "v", grid=2, epochs=1)
    assert min(seen) >= min(2, spark.sparkContext.defaultParallelism)


def test_cuts_deal_rows_evenly_and_copies_too():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(4000, 3)), np.zeros((3000, 3)), np.round(rng.normal(size=(1000, 3)))])
    tree = blocks.cuts(x, 100)
    cell = tree.of(x, blocks.places(len(x)))
    assert np.array_equal(np.bincount(cell), tree.sizes) and tree.sizes.max() <= 100 and len(tree.sizes) < 400
    assert len(set(cell[4000:7000])) >= 30  # copies of one row
    assert blocks.cuts(np.zeros((0, 3)), 5).of(x[:4], blocks.places(4)).tolist() == [0] * 4


def test_rows_in_blocks_are_whole_and_matched_as_rows_are(spark):
    """Blocks hold every row with its kept columns; few targets of many are compared, in one pass or several, with the same result."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(3000, 4)), 2)
    x[:700] = x[0]
    vectors = [*(list(map(float, v)) for v in x), None, [1.0], [math.nan, 0.0, 0.0, 0.0], [math.inf, 0.0, 0.0, 0.0]]
    rows = spark.createDataFrame([(i, f"r{i}", v) for i, v in enumerate(vectors)], "id long, name string, v array<double>").repartition(3)
    targets = frame(spark, enumerate(np.round(rng.normal(size=(1500, 4)), 1)), "id long, v array<double>")
    stored = blocks.pack(rows, "v", rows.count(), 4, ["id", "name"])
    want = {r.id: (f"r{r.id}", r.best, r.score) for r in match(rows, "v", targets).collect()}
    kept = rows.select("id", "name").schema
    for bound in (nearest.BOUND, 2500):
        got = [(r.id, (r.name, r.best)) for r in nearest.match_blocks(stored, targets, (1500, 4), bound, kept).collect()]
        assert len(got) == len(want) and dict(got) == {k: v[:2] for k, v in want.items()}
        sums = match(stored, "x", targets, bound=bound, size=(1500, 4), summed=True).toPandas()
        near = {k: v for k, v in want.items() if v[1] is not None}
        assert sums.cnt.sum() == len(near) == 3000 and math.isclose(sums.err.sum(), sum(math.sqrt(v[2]) for v in near.values()))
        assert np.allclose(np.array(sums.s.tolist()).sum(0), x.sum(0))
    assert blocks.pack(rows, "v", rows.count(), 4).count() <= stored.count()


def test_groups_that_lie_close_are_compared_with_few_targets():
    """Rows of a block are compared with a hundredth of the targets, bit for bit as with all of them."""
    rng = np.random.default_rng(6)
    x, targets = rng.normal(size=(40_000, 4)) * 0.05 + 0.3, rng.normal(size=(5000, 4))
    parts = list(blocks.close_groups(x, 1024))
    x, starts = x[np.concatenate(parts)], np.cumsum([0, *map(len, parts[:-1])])
    assert sum((p.stop - p.start) * len(some) for p, some in nearest._within(x, starts, targets)) < 40_000 * 5000 / 100
    k, cost = nearest._plain(x, np.arange(5000), targets, "euclidean", None)
    best, least = nearest.best_of(x, np.arange(5000), targets, "euclidean", starts=starts)
    assert np.array_equal(best, k) and np.array_equal(least, cost)


def test_starting_units_are_the_first_rows_by_hash_of_rounded_values(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(300, 3)) * 10.0 ** rng.integers(-8, 9, (300, 3)), np.round(rng.normal(size=(300, 3)), 6) + 5e-7,
                   [[0.0, -0.0, 1e300], [math.nan, math.inf, -1e-9]]])
    rows = spark.createDataFrame([([float(e) for e in v],) for v in x], "v array<double>")
    got = {r.id: r.v for r in sites.start_units(rows, "v", 40, 3, 42).collect()}
    rounded = "transform(v, x -> round(x, 6))"
    first = rows.selectExpr(f"pmod(xxhash64(42, {rounded}), 40) id", f"xxhash64(43, {rounded}) h", "v").groupBy("id").agg(
        F.min_by("v", F.struct("h", "v")).alias("v")).collect()
    assert len(first) == 40 and all(str(got[r.id]) == str(r.v) for r in first)


def test_training_rows_are_labelled_where_they_lie(spark, monkeypatch):
    df = clouds(spark).unionByName(clouds(spark).limit(50))
    fitted = sites.fit_sites(df, list("abcde"), grid=4, epochs=2, keep=["id", "kind"])
    want = fitted.label(df, ["id", "kind"]).collect()
    monkeypatch.setattr(nearest, "match", None)
    monkeypatch.setattr(sites, "match", None)
    got = fitted.label_own()
    assert got.columns == ["id", "kind", "neuron", "cluster_id", "node_tier"] and sorted(got.collect()) == sorted(want) and len(want) == 650
    few = sites.fit_sites(df.limit(74), list("abcde"), keep=["id"])
    assert few.reason == sites.TOO_FEW and {(r.cluster_id, r.node_tier) for r in few.label_own().collect()} == {(-1, 3)}


def test_rows_are_written_once_where_they_are_dealt(spark, monkeypatch):
    df = clouds(spark)
    monkeypatch.setattr(sites, "spread", None)
    assert sites.fit_sites(df, list("abcde"), grid=2, epochs=1, dealt=True).reason is None
