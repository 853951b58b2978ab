"""Spatial enrichment: point-in-polygon join (boundary = outside), basin/county fill, convex hulls.

The polygon join is an equi-join on grid cells of several sizes. A polygon starts as at most four cells about as large as
itself. A cell that would cost many edge tests (points in it times edges in it) is cut into four; a piece no edge reaches is
either dropped or marked as wholly inside, where a point needs no test. Points meet the pieces of each size in use, and cells
that hold a large share of all points are salted. No Python per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquifer import catalog
from aquifer.session import write_down

CELL = ["_level", "_cx", "_cy"]  # a square of side 2^level whose lower corner is (cx, cy) sides from the origin
SHARE = 512  # a cell with over 1/SHARE of all points is salted; at most SHARE cells of a size can be


def _edges(ring: Column) -> Column:
    """The ring's sides as structs; an edge between equal points never decides anything and is left out."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.array(F.element_at(ring, 1)))
    sides = F.transform(F.arrays_zip(ring.alias("a"), nxt.alias("b")), lambda e: F.struct(
        e["a"]["x"].alias("x1"), e["a"]["y"].alias("y1"), e["b"]["x"].alias("x2"), e["b"]["y"].alias("y2")))
    return F.filter(sides, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def _on_edge(e, x: Column, y: Column) -> Column:
    x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
    cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
    return (cross == 0) & (x >= F.least(x1, x2)) & (x <= F.greatest(x1, x2)) & \
        (y >= F.least(y1, y2)) & (y <= F.greatest(y1, y2))


def _crosses(e, x: Column, y: Column) -> Column:
    x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
    straddle = (y1 > y) != (y2 > y)
    xint = F.try_divide((x2 - x1) * (y - y1), y2 - y1) + x1
    return straddle & F.coalesce(x < xint, F.lit(False))


def _odd(edges: Column, x: Column, y: Column) -> Column:
    return F.aggregate(edges, F.lit(False), lambda acc, e: acc != _crosses(e, x, y))


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; points on an edge or vertex are outside (the 'within' predicate)."""
    return ~F.exists(edges, lambda e: _on_edge(e, x, y)) & _odd(edges, x, y)


def _reaches(e, x0: Column, y0: Column, side: Column) -> Column:
    """May the edge touch the closed cell? Never false for an edge that does: rounding is allowed for on the far side."""
    x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
    size = F.greatest(F.abs(x1), F.abs(x2), F.abs(y1), F.abs(y2), F.abs(x0) + side, F.abs(y0) + side)
    m = size * 1e-12
    near = (F.greatest(x1, x2) >= x0 - m) & (F.least(x1, x2) <= x0 + side + m) & \
        (F.greatest(y1, y2) >= y0 - m) & (F.least(y1, y2) <= y0 + side + m)
    at = [(x2 - x1) * (b - y1) - (y2 - y1) * (a - x1) for a in (x0, x0 + side) for b in (y0, y0 + side)]
    slack = (F.abs(x2 - x1) + F.abs(y2 - y1)) * m
    return near & ~((F.least(*at) > slack) | (F.greatest(*at) < -slack))


def _clip(pieces: DataFrame) -> DataFrame:
    """Keep the edges that can count for a point of the piece's cell, and tell whether the cell is wholly inside.

    The ray of a point runs to the right, so edges above, below and left of the cell never count. Where no edge reaches the
    cell, all its points are on one side: outside, and the piece goes, or inside, and it needs no edges."""
    side = F.pow(F.lit(2.0), F.col("_level"))
    p = pieces.withColumn("_s", side).withColumn("_x0", F.col("_cx") * F.col("_s")).withColumn("_y0", F.col("_cy") * F.col("_s"))
    x0, y0, s = F.col("_x0"), F.col("_y0"), F.col("_s")
    p = p.withColumn("_edges", F.filter("_edges", lambda e: (
        (F.greatest(e["y1"], e["y2"]) >= y0) & (F.least(e["y1"], e["y2"]) <= y0 + s)
        & (F.greatest(e["x1"], e["x2"]) >= x0 - F.greatest(F.abs(e["x1"]), F.abs(e["x2"]), F.abs(x0)) * 1e-12))))
    p = p.withColumn("_whole", ~F.exists("_edges", lambda e: _reaches(e, x0, y0, s)))
    p = p.where(~F.col("_whole") | _odd(F.col("_edges"), x0 + s / 2, y0 + s / 2))
    empty = F.filter("_edges", lambda e: F.lit(False))
    return p.withColumn("_edges", F.when(F.col("_whole"), empty).otherwise(F.col("_edges"))).drop("_s", "_x0", "_y0")


def polygon_pieces(polys: DataFrame, ring: str = "ring") -> DataFrame:
    """Each polygon as pieces (`_level`, `_cx`, `_cy`, `_whole`, `_edges`) on at most four cells (nine by rounding) about its size.

    Rings that enclose nothing (NULL, under three points, no width or height) or hold a NULL or non-finite coordinate have
    no pieces."""
    xs, ys = F.transform(ring, lambda p: p["x"].cast("double")), F.transform(ring, lambda p: p["y"].cast("double"))
    fine = F.forall(F.concat(xs, ys), lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    p = polys.where(F.col(ring).isNotNull() & (F.size(ring) >= 3) & F.forall(ring, lambda v: v.isNotNull()) & fine)
    p = p.withColumn("_minx", F.array_min(xs)).withColumn("_maxx", F.array_max(xs)) \
        .withColumn("_miny", F.array_min(ys)).withColumn("_maxy", F.array_max(ys))
    extent = F.greatest(F.col("_maxx") - F.col("_minx"), F.col("_maxy") - F.col("_miny"))
    p = p.where((F.col("_maxx") > F.col("_minx")) & (F.col("_maxy") > F.col("_miny")))
    p = p.withColumn("_level", F.ceil(F.log2(extent)).cast("int")).withColumn("_s", F.pow(F.lit(2.0), F.col("_level")))
    xy = F.transform(ring, lambda v: F.struct(v["x"].cast("double").alias("x"), v["y"].cast("double").alias("y")))
    p = p.withColumn("_edges", _edges(xy)) \
        .withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_minx") / F.col("_s")), F.floor(F.col("_maxx") / F.col("_s"))))) \
        .withColumn("_cy", F.explode(F.sequence(F.floor(F.col("_miny") / F.col("_s")), F.floor(F.col("_maxy") / F.col("_s")))))
    return _clip(p.drop("_s", "_minx", "_maxx", "_miny", "_maxy", ring))


def _quarter(pieces: DataFrame) -> DataFrame:
    """Cut each piece's cell into four. Sides are powers of two, so halving loses nothing to rounding."""
    kids = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    k = pieces.withColumn("_kid", F.explode(kids)).withColumn("_level", F.col("_level") - 1) \
        .withColumn("_cx", F.col("_cx") * 2 + F.col("_kid.a")).withColumn("_cy", F.col("_cy") * 2 + F.col("_kid.b"))
    return _clip(k.drop("_kid"))


def _on_cells(pts: DataFrame, levels: list[int]) -> DataFrame:
    """Each point once for each cell size, with the cell that holds it."""
    p = pts.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>")))
    side = F.pow(F.lit(2.0), F.col("_level"))
    return p.withColumn("_cx", F.floor(F.col("_x") / side)).withColumn("_cy", F.floor(F.col("_y") / side))


def _counted(pieces: DataFrame, pts: DataFrame) -> tuple[DataFrame, dict]:
    """The pieces whose cell holds points, written down with the cell's points, edge tests and pieces, and a summary by size.

    One pass over the coordinates, summed on the map side. The sizes in use are powers of two, a few dozen at most, however
    many rows there are; for each the summary holds its points, its fullest cell and its costliest cell."""
    edges = F.when(F.col("_whole"), 0).otherwise(F.size("_edges"))
    cells = pieces.groupBy(*CELL).agg(F.sum(edges).alias("_tests"), F.count(F.lit(1)).alias("_share"))
    levels = [r[0] for r in pieces.select("_level").distinct().collect()]
    n = _on_cells(pts.select("_x", "_y"), levels).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n"))
    cells = n.join(cells, CELL).withColumn("_work", F.col("_n") * F.col("_tests")).drop("_tests")
    out = write_down(pieces.join(cells, CELL), "pieces")
    rows = out.groupBy("_level").agg(F.sum(F.col("_n") / F.col("_share")).alias("points"), F.max("_n").alias("fullest"),
                                     F.max("_work").alias("costliest")).collect()
    return out.drop("_share"), {r["_level"]: r for r in rows}


def refined_pieces(pieces: DataFrame, pts: DataFrame, work: int, depth: int, finest: int) -> tuple[DataFrame, dict]:
    """Cut cells into four while the points in them times the edges in them come to more than `work` tests.

    Cells with few points or few edges stay as they are, so the number of pieces follows the work, not the area. At most
    `depth` rounds, and no cell below side 2^finest. Returns the pieces and, by size, (points, points of the fullest cell)."""
    done, sizes = None, {}
    for step in range(depth + 1):
        todo, seen = _counted(pieces, pts)
        for level, r in seen.items():
            old = sizes.get(level, (0, 0))
            sizes[level] = (max(old[0], r["points"]), max(old[1], r["fullest"]))
        more = step < depth and any(r["costliest"] > work and level > finest for level, r in seen.items())
        heavy = ~F.col("_whole") & (F.col("_work") > work) & (F.col("_level") > finest) & F.lit(more)
        kept = todo.where(~heavy).drop("_work")
        done = kept if done is None else done.unionByName(kept)
        if not more:
            break
        pieces = _quarter(todo.where(heavy).drop("_n", "_work"))
    return done, sizes


def candidate_pairs(pts: DataFrame, pieces: DataFrame, sizes: dict, share: int = SHARE, rows: int = 1 << 16) -> DataFrame:
    """Join points (`_x`, `_y`) to the pieces of their cells, cells with over 1/`share` of a size's points over several tasks.

    The hot cells of a size are disjoint and each holds over 1/share of the points counted, so there are fewer than share
    of them: they may be sent to all tasks. Points of a hot cell draw a salt from their coordinates and key, its pieces are
    repeated. A cell of up to `rows` points is one task's work in any case."""
    left = _on_cells(pts, sorted(sizes))
    most = max(rows, max((v[0] for v in sizes.values()), default=0) / share)
    if all(v[1] <= most for v in sizes.values()):
        return left.withColumn("_salt", F.lit(0)).join(pieces.drop("_n"), CELL)
    hot = F.broadcast(pieces.where(F.col("_n") > most).groupBy(*CELL).agg(
        F.ceil(F.max("_n") / F.lit(most)).cast("int").alias("_salts")))
    spread = F.coalesce(F.pmod(F.xxhash64("_pt", "_x", "_y"), F.col("_salts")), F.lit(0)).cast("int")
    left = left.join(hot, CELL, "left").withColumn("_salt", spread).drop("_salts")
    right = pieces.join(hot, CELL, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts", "_n")
    return left.join(right, [*CELL, "_salt"])


def point_in_polygon_join(points: DataFrame, polys: DataFrame, x: str, y: str, poly_id: str,
                          ring: str = "ring", cell: float | None = None, keep: list[str] | None = None,
                          point_id: str | None = None, work: int = 1 << 22, depth: int = 10) -> DataFrame:
    """Left join each point to the polygon that strictly contains it; several hits -> lowest id.

    Returns every input point once, with `poly_id` (+ `keep` polygon columns) NULL when unmatched; points with a NULL,
    NaN or infinite coordinate are unmatched. Candidates come from a cell equi-join (see the module); Spark broadcasts the pieces
    when they are small (AQE size check) and otherwise shuffles both sides on the salted cell. `cell` bounds the finest
    side, `work` the edge tests a cell may cost before it is cut.
    """
    keep = keep or []
    if not point_id:
        raise ValueError("point_id (a unique key of the points) is required: candidate matches are joined back "
                         "on it, and it must be stable when a lost task is recomputed")
    spots = points.select(F.col(point_id).alias("_pt"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
        .where((F.abs("_x") < float("inf")) & (F.abs("_y") < float("inf")))
    hit = polys.select(F.struct(poly_id, *keep).alias("_m"), F.col(ring).alias("_ring"))
    finest = int(np.floor(np.log2(cell))) if cell else -1000
    pieces, sizes = refined_pieces(polygon_pieces(hit, "_ring"), spots, work, depth, finest)
    cand = candidate_pairs(spots, pieces, sizes)
    inside = cand.where(F.col("_whole") | strictly_inside(F.col("_edges"), F.col("_x"), F.col("_y")))
    best = inside.groupBy("_pt").agg(F.min_by("_m", F.col("_m")[poly_id]).alias("_m"))
    out = points.withColumn("_pt", F.col(point_id)).join(best, "_pt", "left")
    return out.select(*points.columns, *[F.col(f"_m.{c}").alias(c) for c in [poly_id, *keep]])


def fill_basins(sites: DataFrame, polys: DataFrame, x: str, y: str, basin: str = "basin",
                unknown: str = catalog.UNKNOWN_BASIN, outside: str = catalog.OUTSIDE_REGION,
                cell: float | None = None, point_id: str | None = None) -> DataFrame:
    """Only rows whose basin is the unknown sentinel are looked up; matched -> basin and region,
    unmatched -> the outside sentinel for both; other rows keep their values (region NULL)."""
    known = ~F.col(basin).eqNullSafe(F.lit(unknown))  # a NULL basin is not the sentinel
    todo = sites.where(~known)
    done = sites.where(known).withColumn("region", F.lit(None).cast("string"))
    m = point_in_polygon_join(todo, polys.withColumnRenamed("basin", "_pbasin"), x, y, "basin_id", cell=cell,
                              keep=["_pbasin", "region"], point_id=point_id)
    m = m.withColumn(basin, F.coalesce(F.col("_pbasin"), F.lit(outside))) \
        .withColumn("region", F.coalesce(F.col("region"), F.lit(outside))).drop("_pbasin", "basin_id")
    return done.unionByName(m)


def fill_counties(sites: DataFrame, address: DataFrame, key: str, county: str = "county") -> DataFrame:
    """Sentinel counties are replaced by the first non-empty of county/city/town/municipality/
    state_district from the lookup, upper-cased with ' COUNTY' removed; left as-is when nothing found."""
    a = address.select(key, F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in
                                         ["county", "city", "town", "municipality", "state_district"]]).alias("_name"))
    a = a.groupBy(key).agg(F.min("_name").alias("_name"))  # several addresses of a key: the first by name
    j = sites.join(a, key, "left")  # lookup is keyed and small: AQE broadcasts it
    fixed = F.trim(F.replace(F.upper(F.col("_name")), F.lit(" COUNTY"), F.lit("")))
    need = F.col(county).isin(*catalog.MISSING_COUNTY_VALUES) & F.col("_name").isNotNull()
    return j.withColumn(county, F.when(need, fixed).otherwise(F.col(county))).drop("_name")


def _rounded(lat: str, lon: str, digits: int) -> list[Column]:
    """A place's key: both coordinates in whole steps of 10^-digits, halves up, so that equal keys are equal integers; NULL if
    the coordinate is NULL, NaN or infinite."""
    def step(c):
        x = F.col(c).cast("double")
        return F.when(F.abs(x) < float("inf"), F.floor(x * float(10 ** digits) + 0.5))
    return [step(lat).alias("_klat"), step(lon).alias("_klon")]


def fill_counties_at(sites: DataFrame, address: DataFrame, lat: str, lon: str, digits: int = 2, county: str = "county",
                     address_lat: str = "lat", address_lon: str = "lon") -> DataFrame:
    """J3 by place: `fill_counties` where a site's address is the one stored for its coordinates rounded to `digits`.

    The lookup holds one answer for each rounded place, so sites at one place share it and nothing is asked twice. A site
    without a coordinate, or at a place that is not stored, keeps its county. The columns of `sites` come back unchanged."""
    parts = ["county", "city", "town", "municipality", "state_district"]
    known = address.select(*_rounded(address_lat, address_lon, digits), *parts).where(F.col("_klat").isNotNull() & F.col("_klon").isNotNull())
    place = known.select(F.struct("_klat", "_klon").alias("_place"), *parts)
    at = sites.select("*", F.struct(*_rounded(lat, lon, digits)).alias("_place"))
    return fill_counties(at, place, "_place", county).select(*sites.columns)


# ------------------------------------------------------------------------ C10
def _monotone_chain(pts: np.ndarray) -> np.ndarray:
    pts = np.unique(pts, axis=0)
    if len(pts) <= 2:
        return pts

    def cross(o, a, b):
        return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    lower, upper = [], []
    for p in pts:
        while len(lower) >= 2 and cross(lower[-2], lower[-1], p) <= 0:
            lower.pop()
        lower.append(p)
    for p in pts[::-1]:
        while len(upper) >= 2 and cross(upper[-2], upper[-1], p) <= 0:
            upper.pop()
        upper.append(p)
    return np.array(lower[:-1] + upper[:-1])


COMPASS = 16  # directions whose farthest points make the polygon that discards inner points


def _discard_inner(base: DataFrame) -> DataFrame:
    """Drop the points strictly inside the polygon of their group's farthest points in `COMPASS` directions.

    Such a point is never a vertex of the hull. The polygon is one small row a group, found with a map-side aggregate; it
    joins back by group, where AQE sends it when it is small, and a group of any size needs no single task."""
    turn = [2 * np.pi * k / COMPASS for k in range(COMPASS)]
    far = [F.max_by(F.struct("x", "y"), F.col("x") * float(np.cos(t)) + F.col("y") * float(np.sin(t))) for t in turn]
    ring = base.groupBy("g").agg(F.array(*far).alias("_ring"))
    j = base.join(ring, "g").withColumn("_edges", _edges(F.col("_ring")))
    left = F.forall("_edges", lambda e: (e["x2"] - e["x1"]) * (F.col("y") - e["y1"]) - (e["y2"] - e["y1"]) * (F.col("x") - e["x1"])
                    > (F.abs(e["x2"] - e["x1"]) + F.abs(e["y2"] - e["y1"])) * 1e-12
                    * (F.abs(e["x1"]) + F.abs(e["y1"]) + F.abs("x") + F.abs("y")))
    return j.where(~((F.size("_edges") >= 3) & left)).select("g", "x", "y")


def convex_hulls(points: DataFrame, group: str, x: str, y: str, min_points: int = 3, piece: int = 20_000,
                 fan: int = 16) -> DataFrame:
    """Convex hull per group with >= `min_points` points, as a closed ring, plus centroid.

    A hull of hulls is the hull, so a group is reduced as a tree: points inside a first polygon of far points go, the others
    are dealt to pieces of about `piece` points, each piece becomes its hull, and `fan` pieces at a time become one until one
    is left. No task reads more than a piece, or `fan` hulls of pieces; `n_last` tells what the last task of a group read.
    Only a group whose own hull has many vertices makes that large, and then its ring is as large. Points with a NULL or
    non-finite coordinate and rows of no group are left out; a group of equal points or points on a line has a ring without area.
    """
    base = points.select(F.col(group).cast("string").alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) \
        .where(F.col(group).isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    counts = base.groupBy("g").agg(F.count(F.lit(1)).alias("n_points"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    outer = _discard_inner(base).distinct()  # repeated points count once
    sized = write_down(outer.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(piece))).cast("int").alias("_pieces")), "hulls")
    pieces = sized.agg(F.max("_pieces")).first()[0] or 1
    part = outer.join(sized, "g").withColumn("_piece", F.pmod(F.xxhash64("x", "y"), F.col("_pieces")).cast("int"))
    part = part.select("g", "x", "y", "_piece")

    def reduce_piece(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _monotone_chain(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"g": pdf["g"].iloc[0], "x": h[:, 0], "y": h[:, 1], "_piece": pdf["_piece"].iloc[0]})

    while pieces > 1:
        part = part.groupBy("g", "_piece").applyInPandas(reduce_piece, part.schema)
        part = part.withColumn("_piece", F.floor(F.col("_piece") / fan).cast("int"))
        pieces = -(-pieces // fan)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _monotone_chain(pdf[["x", "y"]].to_numpy())
        ring = [{"x": float(a), "y": float(b)} for a, b in h]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "ring": [[*ring, ring[0]]], "n_vertices": [len(h)], "n_last": [len(pdf)]})

    hulls = part.groupBy("g").applyInPandas(
        final, "g string, ring array<struct<x:double,y:double>>, n_vertices int, n_last long")
    j = counts.where(F.col("n_points") >= min_points).join(hulls, "g")
    return j.select(F.col("g").alias(group), "n_points", "n_vertices", "ring", "cx", "cy", "n_last")
