"""Spatial semantics: boundary points are outside, lowest id wins, hulls contain their points."""

import numpy as np
import pandas as pd

from aquifer.operators import spatial


def _square(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    ring2 = [{"x": 5.0, "y": 5.0}, {"x": 15.0, "y": 5.0}, {"x": 15.0, "y": 15.0}, {"x": 5.0, "y": 15.0}]
    return spark.createDataFrame([(2, "B", "r", ring), (1, "A", "r", ring2)],
                                 "basin_id int, basin string, region string, ring array<struct<x:double,y:double>>")


def test_point_in_polygon_boundary_and_ties(spark):
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 0.0, 3.0), (3, 10.0, 10.0), (4, 7.0, 7.0), (5, 20.0, 1.0),
                                 (6, 3.0, 3.0)], "pid int, x double, y double")
    out = {r["pid"]: r["basin"] for r in
           spatial.point_in_polygon_join(pts, _square(spark), "x", "y", "basin_id", cell=4.0, keep=["basin"],
                                         point_id="pid").collect()}
    assert out[1] == "B"  # (5,5) is a vertex of A -> outside A, inside B
    assert out[2] is None  # on an edge of B
    assert out[3] == "A"  # vertex of B -> outside B, inside A
    assert out[4] == "A"  # inside both -> lowest id
    assert out[5] is None and out[6] == "B"


def test_hull_contains_points(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500).astype(str), "x": rng.normal(size=500), "y": rng.normal(size=500)})
    hulls = spatial.convex_hulls(spark.createDataFrame(pdf).repartition(4), "g", "x", "y").collect()
    assert len(hulls) == 3
    for h in hulls:
        ring = np.array([(p["x"], p["y"]) for p in h["ring"]])
        assert (ring[0] == ring[-1]).all()
        pts = pdf[pdf.g == h["g"]][["x", "y"]].to_numpy()
        for a, b in zip(ring[:-1], ring[1:]):  # counter-clockwise: every point left of (or on) each edge
            cross = (b[0] - a[0]) * (pts[:, 1] - a[1]) - (b[1] - a[1]) * (pts[:, 0] - a[0])
            assert (cross >= -1e-9).all()


def test_fill_keeps_null_basins_and_single_sites(spark):
    from aquifer import catalog

    sites = spark.createDataFrame([(1, "k1", "A", 2.0, 2.0), (2, "k1", None, 2.0, 2.0), (3, "k2", catalog.UNKNOWN_BASIN, 2.0, 2.0)],
                                  "site long, key string, basin string, x double, y double")
    got = {r.site: r.basin for r in spatial.fill_basins(sites, _square(spark), "x", "y", point_id="site").collect()}
    assert got == {1: "A", 2: None, 3: "B"}
    address = spark.createDataFrame(
        [("k1", "Beta County", None, None, None, None), ("k1", "Alpha County", None, None, None, None)],
        "key string, county string, city string, town string, municipality string, state_district string")
    named = sites.selectExpr("*", f"'{catalog.MISSING_COUNTY_VALUES[0]}' as county")
    filled = {r.site: r.county for r in spatial.fill_counties(named, address, "key").collect()}
    assert len(filled) == 3 and filled[1] == filled[2] == "ALPHA"


def _rough_polygons(rng, n, vertices):
    """Star-shaped rings of very different sizes around random centres, and one with a notch along the axes."""
    out = []
    for i in range(n):
        cx, cy, r = rng.uniform(-50, 50), rng.uniform(-50, 50), 2.0 ** rng.integers(-2, 6)
        a = np.sort(rng.uniform(0, 2 * np.pi, vertices))
        d = r * rng.uniform(0.3, 1.0, vertices)
        out.append((i, [{"x": float(cx + k * np.cos(t)), "y": float(cy + k * np.sin(t))} for k, t in zip(d, a)]))
    notch = [(0, 0), (8, 0), (8, 4), (4, 4), (4, 2), (2, 2), (2, 8), (0, 8)]
    return out + [(n, [{"x": float(a), "y": float(b)} for a, b in notch])]


def _plain_join(pts, polys):
    """Every point against every polygon: on an edge is outside, else an even-odd count; lowest id."""
    got = {}
    for pid, x, y in pts:
        got[pid] = None
        for gid, ring in polys:
            odd = edge = False
            for a, b in zip(ring, ring[1:] + ring[:1]):
                x1, y1, x2, y2 = a["x"], a["y"], b["x"], b["y"]
                cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
                if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                    edge = True
                if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                    odd = not odd
            if odd and not edge:
                got[pid] = gid
                break
    return got


RINGS = "gid int, ring array<struct<x:double,y:double>>"


def test_cells_of_several_sizes_match_every_pair(spark):
    rng = np.random.default_rng(5)
    polys = _rough_polygons(rng, 25, 40)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-70, 70, (1500, 2)))]
    pts += [(2000 + i, float(a), float(b)) for i, (a, b) in enumerate(np.ndindex(10, 10))]  # corners and edges of the notch
    pts += [(3000 + i, p["x"], p["y"]) for i, p in enumerate(polys[3][1])]
    want = _plain_join(pts, polys)
    pdf = spark.createDataFrame(pts, "pid int, x double, y double")
    g = spark.createDataFrame(polys, RINGS)
    for work, depth in ((1 << 22, 10), (200, 4)):  # cells left whole, and cells cut many times
        out = spatial.point_in_polygon_join(pdf, g, "x", "y", "gid", point_id="pid", work=work, depth=depth)
        assert {r.pid: r.gid for r in out.collect()} == want
    spots = pdf.selectExpr("pid as _pt", "x as _x", "y as _y")
    fine, _ = spatial.refined_pieces(spatial.polygon_pieces(g), spots, 200, 4, -1000)
    start, _ = spatial.refined_pieces(spatial.polygon_pieces(g), spots, 1 << 22, 4, -1000)
    tests = [p.selectExpr("sum(_n * size(_edges))").first()[0] for p in (start, fine)]
    assert fine.where("_whole").count() > 0 and tests[1] < tests[0] / 2


def test_a_third_of_the_points_in_one_cell(spark):
    rng = np.random.default_rng(6)
    polys = _rough_polygons(rng, 12, 30)
    spread = rng.uniform(-70, 70, (2000, 2))
    dense = np.array([3.0, 3.0]) + rng.uniform(0, 1e-3, (1000, 2))
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.concatenate([spread, dense]))]
    pdf = spark.createDataFrame(pts, "pid int, x double, y double")
    g = spark.createDataFrame(polys, RINGS)
    out = spatial.point_in_polygon_join(pdf, g, "x", "y", "gid", point_id="pid", work=2000, depth=5)
    assert {r.pid: r.gid for r in out.collect()} == _plain_join(pts, polys)
    spots = pdf.selectExpr("pid as _pt", "x as _x", "y as _y")
    pieces, sizes = spatial.refined_pieces(spatial.polygon_pieces(g), spots, 2000, 5, -1000)
    pairs = spatial.candidate_pairs(spots, pieces, sizes, share=30, rows=1)
    most = pairs.select(*spatial.CELL, "_salt", "_pt").distinct().groupBy(*spatial.CELL, "_salt").count().agg({"count": "max"})
    assert most.first()[0] < 3 * 3000 / 30  # no task's key holds more than a few shares, though one cell holds a third
    tests = pairs.where(~pairs["_whole"]).selectExpr("sum(size(_edges)) as t").first().t or 0
    assert tests < 0.1 * len(pts) * 12 * 30  # against every point with every edge


def test_odd_rings_and_points(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]
    flat = [{"x": 0.0, "y": 1.0}, {"x": 4.0, "y": 1.0}, {"x": 2.0, "y": 1.0}]
    bad = [{"x": 0.0, "y": 0.0}, {"x": float("nan"), "y": 0.0}, {"x": 4.0, "y": 4.0}]
    g = spark.createDataFrame([(3, square), (0, None), (1, flat), (2, bad), (4, []), (5, [square[0], None, square[2]])], RINGS)
    pts = spark.createDataFrame([(1, 1.0, 1.0, "a"), (2, None, 1.0, "b"), (3, float("nan"), 1.0, "c"), (4, float("inf"), 1.0, "d"),
                                 (5, 4.0, 2.0, "e")], "pid int, x double, y double, _level string")
    out = {r.pid: (r.gid, r._level) for r in
           spatial.point_in_polygon_join(pts, g, "x", "y", "gid", point_id="pid").collect()}
    assert out == {1: (3, "a"), 2: (None, "b"), 3: (None, "c"), 4: (None, "d"), 5: (None, "e")}
    none = spatial.point_in_polygon_join(pts, g.limit(0), "x", "y", "gid", point_id="pid")
    assert none.count() == 5 and none.where("gid is not null").count() == 0


def _vertices(points):
    """A point is a vertex of the hull when some line through it leaves all other points strictly on one side."""
    pts, out = np.unique(points, axis=0), set()
    for p in pts:
        d = pts[(pts != p).any(axis=1)] - p
        a = np.sort(np.arctan2(d[:, 1], d[:, 0]))
        gaps = np.diff(np.append(a, a[0] + 2 * np.pi))
        if len(a) < 2 or gaps.max() > np.pi + 1e-9:
            out.add(tuple(p))
    return out


def test_hull_tree_matches_a_plain_search_and_bounds_the_last_task(spark):
    rng = np.random.default_rng(8)
    t = rng.uniform(0, 2 * np.pi, 900)
    big = rng.normal(size=(4000, 2))
    ring = np.stack([np.cos(t), np.sin(t)], axis=1) * (1 - 0.02 * rng.random((900, 1)))
    parts = {"big": big, "ring": ring, "line": np.stack([np.arange(9.0), 2 * np.arange(9.0)], axis=1),
             "same": np.ones((5, 2)), "grid": np.array(list(np.ndindex(6, 6)), dtype=float), "two": np.eye(2)}
    pdf = pd.concat([pd.DataFrame({"g": g, "x": p[:, 0], "y": p[:, 1]}) for g, p in parts.items()])
    odd = spark.createDataFrame([(None, 1.0, 1.0), ("big", None, 0.0), ("big", float("inf"), 0.0)], "g string, x double, y double")
    df = spark.createDataFrame(pdf).unionByName(odd).repartition(6)
    got = {r["g"]: r for r in spatial.convex_hulls(df, "g", "x", "y", piece=50, fan=4).collect()}
    assert set(got) == {"big", "ring", "line", "same", "grid"}  # two points are under the minimum
    for g in ("big", "ring", "grid"):
        want = _vertices(parts[g])
        assert {(p["x"], p["y"]) for p in got[g]["ring"]} == want and got[g]["n_vertices"] == len(want)
        assert got[g]["n_points"] == len(parts[g])
    assert {(p["x"], p["y"]) for p in got["line"]["ring"]} == {(0.0, 0.0), (8.0, 16.0)}
    assert [(p["x"], p["y"]) for p in got["same"]["ring"]] == [(1.0, 1.0)] * 2
    assert got["big"]["n_last"] <= 4 * 50 and got["ring"]["n_last"] <= 4 * got["ring"]["n_vertices"]  # of 4,000 and 900 points
    assert spatial.convex_hulls(df.limit(0), "g", "x", "y").count() == 0


def test_counties_by_rounded_place(spark):
    from aquifer import catalog

    gone = catalog.MISSING_COUNTY_VALUES[0]
    sites = spark.createDataFrame([(1, 35.123, -119.5, gone, 7), (2, 35.118, -119.499, gone, 7), (3, 35.2, -119.5, gone, 7),
                                   (4, 35.123, -119.5, "KERN", 7), (5, None, -119.5, gone, 7), (6, float("nan"), 1.0, gone, 7)],
                                  "site long, lat double, lon double, county string, city int")
    address = spark.createDataFrame([(35.12, -119.5, "", "Taft", None, None, None), (35.12, -119.5, "Zed County", None, None, None, None),
                                     (None, -119.5, "Nowhere", None, None, None, None)],
                                    "lat double, lon double, county string, city string, town string, municipality string, state_district string")
    got = spatial.fill_counties_at(sites, address, "lat", "lon")
    assert got.columns == sites.columns
    assert {r.site: r.county for r in got.collect()} == {1: "TAFT", 2: "TAFT", 3: gone, 4: "KERN", 5: gone, 6: gone}
