"""Stage 5 queries: spatial join, basin / county fill, hulls."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquifer import catalog
from aquifer.operators import spatial
from aquifer.plans import sql as S
from aquifer.plans.registry import query
from aquifer.sources import fixtures as fx


@query("j_basin", S.with_(S.SITES, S.BASINS) + f"""
SELECT s.site_id, arg_min(b.basin, b.basin_id) AS basin, count(b.basin_id) > 0 AS matched
FROM sites s LEFT JOIN basins b ON {S.INSIDE} GROUP BY s.site_id""")
def j_basin(spark, d):
    """Every site with the basin polygon that strictly contains it (boundary points unmatched)."""
    s = fx.site_points(spark, d)
    b = fx.basins(spark, d)
    m = spatial.point_in_polygon_join(s, b, "lon_c", "lat_c", "basin_id", keep=["basin"], point_id="site_id")
    return m.select("site_id", "basin", F.col("basin_id").isNotNull().alias("matched"))


@query("j_basin_fill", S.with_(S.SITES, S.BASINS) + f"""
, m AS (SELECT s.site_id, arg_min(b.basin, b.basin_id) AS mb, arg_min(b.region, b.basin_id) AS mr
        FROM sites s LEFT JOIN basins b ON {S.INSIDE} WHERE s.basin = 'unknown' GROUP BY s.site_id)
SELECT s.site_id, CASE WHEN s.basin = 'unknown' THEN coalesce(m.mb, 'OUTSIDE OF KNOWN REGION') ELSE s.basin END AS basin,
  CASE WHEN s.basin = 'unknown' THEN coalesce(m.mr, 'OUTSIDE OF KNOWN REGION') END AS region
FROM sites s LEFT JOIN m USING (site_id)""")
def j_basin_fill(spark, d):
    """Fill unknown basins (and regions) from the polygon join; unmatched -> outside sentinel."""
    s = fx.sites(spark, d).select("site_id", "lon_c", "lat_c", "basin")
    out = spatial.fill_basins(s, fx.basins(spark, d), "lon_c", "lat_c", point_id="site_id")
    return out.select("site_id", "basin", "region")


@query("j_county_fill", S.with_(S.SITES) + """
, addr AS (SELECT n_nationkey AS nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN n_name || ' County' END AS county,
           CASE WHEN n_nationkey % 4 = 0 THEN n_name END AS city FROM nation)
SELECT s.site_id, CASE WHEN s.county IN ('unknown', 'NO COUNTY FOUND') AND coalesce(a.county, a.city) IS NOT NULL
  THEN trim(replace(upper(coalesce(a.county, a.city)), ' COUNTY', '')) ELSE s.county END AS county
FROM sites s LEFT JOIN addr a USING (nationkey)""")
def j_county_fill(spark, d):
    """Reverse-geocoding re-aimed as a lookup join with the county/city/... fallback chain."""
    s = fx.sites(spark, d).select("site_id", "nationkey", "county")
    return spatial.fill_counties(s, fx.address_lookup(spark, d), "nationkey").select("site_id", "county")


@query("j_county_at", S.with_(S.SITES) + """
, spot AS (SELECT *, floor(lat_c / 100.0 * 10 + 0.5)::BIGINT AS klat, floor(lon_c / 100.0 * 10 + 0.5)::BIGINT AS klon FROM sites)
, addr AS (SELECT klat, klon, min(county) AS name FROM spot WHERE county NOT IN ('unknown', 'NO COUNTY FOUND') AND trim(county) <> '' GROUP BY klat, klon)
SELECT site_id, CASE WHEN county IN ('unknown', 'NO COUNTY FOUND') AND name IS NOT NULL
  THEN trim(replace(upper(name), ' COUNTY', '')) ELSE county END AS county FROM spot LEFT JOIN addr USING (klat, klon)""")
def j_county_at(spark, d):
    """Missing counties from the addresses stored for the site's coordinates rounded to a tenth of a degree (here those of
    the sites whose county is known)."""
    s = fx.sites(spark, d).select("site_id", "county", (F.col("lat_c") / 100.0).alias("lat"), (F.col("lon_c") / 100.0).alias("lon"))
    none = [F.lit(None).cast("string").alias(c) for c in ["city", "town", "municipality", "state_district"]]
    address = s.where(~F.col("county").isin(*catalog.MISSING_COUNTY_VALUES)).select("lat", "lon", "county", *none)
    return spatial.fill_counties_at(s, address, "lat", "lon", digits=1).select("site_id", "county")


@query("g_hull")
def g_hull(spark, d):
    """Convex hull per basin of the matched sites (rows-only; geometry property-tested)."""
    s = fx.site_points(spark, d)
    m = spatial.point_in_polygon_join(s, fx.basins(spark, d), "lon_c", "lat_c", "basin_id", keep=["basin"],
                                      point_id="site_id")
    return spatial.convex_hulls(m.where(F.col("basin").isNotNull()), "basin", "lon_c", "lat_c").drop("n_last")
