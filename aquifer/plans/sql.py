"""DuckDB oracle fragments: the fixture views (FIXTURES.md) as SQL CTEs."""

OBS = "obs AS (SELECT event_id AS sample_id, user_id AS well_id, ts, event_type AS analyte, value AS conc FROM events)"

THR = ("thr AS (SELECT * FROM (VALUES ('click', 40.0::DOUBLE), ('error', 40.0::DOUBLE), "
       "('purchase', 100.0::DOUBLE), ('signup', 20.0::DOUBLE)) t(analyte, lim))")

LABELLED = ("labelled AS (SELECT o.*, CASE WHEN o.conc >= t.lim THEN 1.0::DOUBLE WHEN o.conc < t.lim THEN 0.0::DOUBLE "
            "END AS y FROM obs o LEFT JOIN thr t ON o.analyte = t.analyte)")

WIDE = (
    "wide AS (SELECT well_id*100000 + date_diff('day', DATE '2024-01-01', ts::DATE) AS sample_id, well_id, "
    "ts::DATE AS day, "
    "max(CASE WHEN analyte='click' THEN conc END) AS click, max(CASE WHEN analyte='error' THEN conc END) AS error, "
    "max(CASE WHEN analyte='purchase' THEN conc END) AS purchase, "
    "max(CASE WHEN analyte='signup' THEN conc END) AS signup, max(CASE WHEN analyte='view' THEN conc END) AS view "
    "FROM obs GROUP BY well_id, ts::DATE)"
)

ENV = (
    "env AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS TDS, l_quantity AS FE, l_discount*100 AS SO4, "
    "l_tax*100 AS MN, p_size::DOUBLE AS NO3N, pow(l_quantity, 3) AS heavy, l_suppkey % 10 AS node_id, "
    "l_shipdate AS date FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"
)

ENV_LONG = (
    "env_long AS (SELECT * FROM (SELECT node_id, TDS, FE, SO4, MN, NO3N, heavy FROM env) "
    "UNPIVOT (x FOR col IN (TDS, FE, SO4, MN, NO3N, heavy)))"
)

SITES = (
    "sites AS (SELECT c_custkey AS site_id, c_nationkey AS nationkey, -12400 + 2*((37*c_custkey) % 500) AS lon_c, "
    "3200 + 2*((91*c_custkey) % 500) AS lat_c, "
    "CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE n_name END AS basin, "
    "CASE WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN c_custkey % 11 = 0 THEN 'NO COUNTY FOUND' ELSE n_name END AS county "
    "FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"
)

BASINS = (
    "basins AS (SELECT n_nationkey AS basin_id, n_name AS basin, r_name AS region, "
    "-12400 + 200*(n_nationkey % 5) AS x0, 3200 + 200*(n_nationkey // 5) AS y0, n_nationkey % 2 = 0 AS is_square "
    "FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 <> 5)"
)

# Strictly-inside test for the fixture polygons (boundary points are outside).
INSIDE = (
    "CASE WHEN b.is_square THEN s.lon_c > b.x0 AND s.lon_c < b.x0 + 200 AND s.lat_c > b.y0 AND s.lat_c < b.y0 + 200 "
    "ELSE abs(s.lon_c - (b.x0 + 100)) + abs(s.lat_c - (b.y0 + 100)) < 100 END"
)

PARAMS = (
    "params AS (SELECT node_id, param, avg(v) AS v FROM (SELECT label AS node_id, "
    "generate_subscripts(embedding, 1) - 1 AS param, unnest(embedding)::DOUBLE AS v FROM embeddings) "
    "GROUP BY node_id, param)"
)

VOLUMES = "volumes AS (SELECT label AS node_id, count(*) AS volume FROM embeddings GROUP BY label)"

TIERS = (
    "tiers AS (SELECT v.node_id, v.volume, CASE WHEN v.volume >= q.q66 THEN 1 WHEN v.volume >= q.q33 THEN 2 ELSE 3 END "
    "AS tier FROM volumes v, (SELECT quantile_cont(volume::DOUBLE, 0.33) AS q33, "
    "quantile_cont(volume::DOUBLE, 0.66) AS q66 FROM volumes) q)"
)

PRED = (
    "pred AS (SELECT l_orderkey, l_linenumber, node_id, analyte, y, m.mode, "
    "CASE WHEN m.mode = 'global' THEN l_discount ELSE l_tax END AS score FROM (SELECT l_orderkey, l_linenumber, "
    "l_suppkey % 10 AS node_id, 'A' || (l_partkey % 4)::VARCHAR AS analyte, "
    "CASE WHEN l_linenumber = 3 THEN NULL WHEN l_suppkey % 10 = 9 AND l_partkey % 4 = 0 THEN 0.0::DOUBLE "
    "ELSE (l_returnflag = 'R')::INT::DOUBLE END AS y, l_discount, l_tax FROM lineitem) b, "
    "(VALUES ('global'), ('personalized')) m(mode))"
)

ROUNDLOG = (
    "roundlog AS (SELECT rnd AS round, node_id, ((node_id + CASE WHEN (7*node_id + 3*rnd) % 4 = 0 THEN rnd ELSE 0 END) "
    "% 4)::INT AS cluster_label, avg(value) / (100.0 * (1 + rnd)) AS loss FROM (SELECT "
    "(date_diff('day', DATE '2024-01-01', ts::DATE) // 5)::INT AS rnd, (user_id % 20)::INT AS node_id, value "
    "FROM events) WHERE (node_id + rnd) % 9 <> 0 GROUP BY rnd, node_id)"
)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
