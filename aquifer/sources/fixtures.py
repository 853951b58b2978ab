"""Domain views (FX1..FX9) over the driver tables.

Each builder is lazy and returns a DataFrame whose work grows with the input
tables: the monitoring domain (observations at wells, environmental covariates,
sites and basins, node parameters, predictions, round logs) is mapped onto the
TPC-H-like tables as documented in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquifer.sources.tables import read_table

# ---------------------------------------------------------------- FIXED VALUES
# Fixture limits for the event types playing analytes ('view' has no limit).
FX_THRESHOLDS = {"click": 40.0, "error": 40.0, "purchase": 100.0, "signup": 20.0}
FX_ANALYTES = ["click", "error", "purchase", "signup", "view"]
# Fixture descriptors (is_pfca, is_pfsa, chain_len, ether); 'view' deliberately absent.
FX_DESCRIPTORS = {"click": (1, 0, 8, 0), "error": (0, 1, 6, 0), "purchase": (1, 0, 6, 1), "signup": (0, 1, 4, 0)}
FX_EPOCH = "2024-01-01"
# ------------------------------------------------------------ END FIXED VALUES


def obs_long(spark: SparkSession, d: str) -> DataFrame:
    """FX1: long observation table (sample_id, well_id, ts, analyte, conc)."""
    ev = read_table(spark, d, "events")
    return ev.select(
        F.col("event_id").alias("sample_id"),
        F.col("user_id").alias("well_id"),
        "ts",
        F.col("event_type").alias("analyte"),
        F.col("value").alias("conc"),
    )


def fx_thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FX_THRESHOLDS.items()), "analyte string, limit double")


def fx_descriptors(spark: SparkSession) -> DataFrame:
    rows = [(a, *v) for a, v in FX_DESCRIPTORS.items()]
    return spark.createDataFrame(rows, "analyte string, is_pfca int, is_pfsa int, chain_len int, ether int")


def wide_samples(spark: SparkSession, d: str) -> DataFrame:
    """FX2: one row per (well, day), one column per analyte (max value), real gaps as NULL."""
    obs = obs_long(spark, d).withColumn("day", F.to_date("ts"))
    wide = obs.groupBy("well_id", "day").pivot("analyte", FX_ANALYTES).agg(F.max("conc"))
    return wide.select(
        (F.col("well_id") * 100000 + F.datediff("day", F.lit(FX_EPOCH).cast("date"))).alias("sample_id"),
        "well_id",
        "day",
        *FX_ANALYTES,
    )


def env_covariates(spark: SparkSession, d: str, with_texture: bool = False) -> DataFrame:
    """FX3: environmental covariates per lineitem row (no unique key); with_texture adds the soil class."""
    li = read_table(spark, d, "lineitem")
    texture = [F.col("p_type").alias("Texture_USDA")] if with_texture else []
    part = read_table(spark, d, "part").select("p_partkey", "p_size", *texture)
    j = li.join(part, li.l_partkey == part.p_partkey, "left")
    return j.select(
        *(["Texture_USDA"] if with_texture else []),
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("TDS"),
        F.col("l_quantity").alias("FE"),
        (F.col("l_discount") * 100).alias("SO4"),
        (F.col("l_tax") * 100).alias("MN"),
        F.col("p_size").cast("double").alias("NO3N"),
        F.pow(F.col("l_quantity"), 3).alias("heavy"),
        (F.col("l_suppkey") % 10).alias("node_id"),
        F.col("l_shipdate").alias("date"),
    )


ENV_COLUMNS = ["TDS", "FE", "SO4", "MN", "NO3N", "heavy"]


def sites(spark: SparkSession, d: str) -> DataFrame:
    """FX4: sites with integer centi-degree coordinates, basin and county placeholders."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
    k = F.col("c_custkey")
    return j.select(
        k.alias("site_id"),
        F.col("c_nationkey").alias("nationkey"),
        (F.lit(-12400) + 2 * ((37 * k) % 500)).alias("lon_c"),
        (F.lit(3200) + 2 * ((91 * k) % 500)).alias("lat_c"),
        F.when(k % 5 == 0, F.lit("unknown")).otherwise(F.col("n_name")).alias("basin"),
        F.when(k % 7 == 0, F.lit("unknown")).when(k % 11 == 0, F.lit("NO COUNTY FOUND"))
        .otherwise(F.col("n_name")).alias("county"),
    )


def site_points(spark: SparkSession, d: str) -> DataFrame:
    """FX4 coordinates only (no name lookup): what the spatial join needs."""
    k = F.col("c_custkey")
    return read_table(spark, d, "customer").select(
        k.alias("site_id"), (F.lit(-12400) + 2 * ((37 * k) % 500)).alias("lon_c"),
        (F.lit(3200) + 2 * ((91 * k) % 500)).alias("lat_c"))


def basins(spark: SparkSession, d: str) -> DataFrame:
    """FX4b: basin polygons as closed-free rings ARRAY<STRUCT<x,y>> (even nation: square, odd: diamond)."""
    n = read_table(spark, d, "nation")
    r = read_table(spark, d, "region")
    n = n.where(F.col("n_nationkey") % 6 != 5)
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    key = F.col("n_nationkey")
    x0 = F.lit(-12400) + 200 * (key % 5)
    y0 = F.lit(3200) + 200 * F.floor(key / 5).cast("int")

    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    square = F.array(pt(x0, y0), pt(x0 + 200, y0), pt(x0 + 200, y0 + 200), pt(x0, y0 + 200))
    diamond = F.array(pt(x0 + 100, y0), pt(x0 + 200, y0 + 100), pt(x0 + 100, y0 + 200), pt(x0, y0 + 100))
    return j.select(
        key.alias("basin_id"),
        F.col("n_name").alias("basin"),
        F.col("r_name").alias("region"),
        F.when(key % 2 == 0, square).otherwise(diamond).alias("ring"),
    )


def address_lookup(spark: SparkSession, d: str) -> DataFrame:
    """FX4a: reverse-geocoding results as a lookup table keyed by nation."""
    n = read_table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.alias("nationkey"),
        F.when(k % 4 != 0, F.concat(F.col("n_name"), F.lit(" County"))).alias("county"),
        F.when(k % 4 == 0, F.col("n_name")).alias("city"),
        F.lit(None).cast("string").alias("town"),
        F.lit(None).cast("string").alias("municipality"),
        F.lit(None).cast("string").alias("state_district"),
    )


def node_params(spark: SparkSession, d: str) -> DataFrame:
    """FX5: long parameter table (node_id, param, v) = per-label mean embedding."""
    e = read_table(spark, d, "embeddings")
    x = e.select(F.col("label").alias("node_id"), F.posexplode("embedding").alias("param", "v"))
    return x.groupBy("node_id", "param").agg(F.avg(F.col("v").cast("double")).alias("v"))


def node_volumes(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.groupBy(F.col("label").alias("node_id")).agg(F.count(F.lit(1)).alias("volume"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """FX6: long predictions (node_id, analyte, mode, y, score) from lineitem; two modes per row."""
    li = read_table(spark, d, "lineitem")
    node = F.col("l_suppkey") % 10
    analyte = F.concat(F.lit("A"), (F.col("l_partkey") % 4).cast("string"))
    y = (
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("double"))
        .when((node == 9) & (analyte == "A0"), F.lit(0.0))
        .otherwise((F.col("l_returnflag") == "R").cast("double"))
    )
    base = li.select(
        "l_orderkey", "l_linenumber", node.alias("node_id"), analyte.alias("analyte"), y.alias("y"),
        "l_discount", "l_tax",
    )
    modes = F.array(
        F.struct(F.lit("global").alias("mode"), F.col("l_discount").alias("score")),
        F.struct(F.lit("personalized").alias("mode"), F.col("l_tax").alias("score")),
    )
    return base.select("l_orderkey", "l_linenumber", "node_id", "analyte", "y",
                       F.inline(modes))


def round_log(spark: SparkSession, d: str) -> DataFrame:
    """FX7: (round, node_id, cluster_label, loss) from events."""
    ev = read_table(spark, d, "events")
    r = F.floor(F.datediff(F.to_date("ts"), F.lit(FX_EPOCH).cast("date")) / 5).cast("int")
    node = (F.col("user_id") % 20).cast("int")
    x = ev.select(r.alias("round"), node.alias("node_id"), "value").where((F.col("node_id") + F.col("round")) % 9 != 0)
    g = x.groupBy("round", "node_id").agg(F.avg("value").alias("mv"))
    label = (F.col("node_id") + F.when((7 * F.col("node_id") + 3 * F.col("round")) % 4 == 0, F.col("round"))
             .otherwise(F.lit(0))) % 4
    return g.select("round", "node_id", label.cast("int").alias("cluster_label"),
                    (F.col("mv") / (100.0 * (1 + F.col("round")))).alias("loss"))


def categories(spark: SparkSession, d: str) -> DataFrame:
    """FX8: categorical attributes (p_brand, p_type) and slug input p_name."""
    return read_table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")


# ---------------------------------------------------------------- FIXED VALUES
# Class map of the FX6 prediction analytes.
FX6_CLASSES = {"A": ["A0", "A1"], "B": ["A2"], "C": ["A3"]}
# ------------------------------------------------------------ END FIXED VALUES


def fx6_analytes(spark: SparkSession) -> DataFrame:
    rows = [(a, c, i) for i, (c, a) in enumerate((c, a) for c, lst in FX6_CLASSES.items() for a in lst)]
    return spark.createDataFrame(rows, "analyte string, class string, ord int")


def eval_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node dimension for evaluation: supplier-derived ids 0..10 (node 10 has no prediction rows)."""
    s = read_table(spark, d, "supplier")
    return s.select((F.col("s_suppkey") % 11).alias("node_id")).distinct()


MODEL_TARGETS = ["click", "error", "purchase", "signup"]
MODEL_FEATURES = ["f_well", "f_dow", "f_events", "f_hour"]


def model_frame(spark: SparkSession, d: str) -> DataFrame:
    """Model rows: one per (well, day) sample with non-label features, node id and exceedance labels
    (NULL where the analyte was not measured that day)."""
    obs = obs_long(spark, d).withColumn("day", F.to_date("ts"))
    lim = F.create_map(*[x for a, v in FX_THRESHOLDS.items() for x in (F.lit(a), F.lit(v))])
    y = F.when(F.col("conc") >= lim[F.col("analyte")], 1.0).when(F.col("conc") < lim[F.col("analyte")], 0.0)
    lab = obs.withColumn("y", y)
    g = lab.groupBy("well_id", "day").agg(
        F.count(F.lit(1)).alias("n_ev"), F.min(F.hour("ts")).alias("h"),
        *[F.max(F.when(F.col("analyte") == a, F.col("y"))).alias(f"y_{a}") for a in MODEL_TARGETS])
    return g.select(
        (F.col("well_id") * 100000 + F.datediff("day", F.lit(FX_EPOCH).cast("date"))).alias("sample_id"),
        "well_id", "day", (F.col("well_id") % 10).alias("node_id"),
        ((F.col("well_id") % 7) / 6.0).alias("f_well"), (F.dayofweek("day") / 7.0).alias("f_dow"),
        F.log1p("n_ev").alias("f_events"), (F.col("h") / 23.0).alias("f_hour"),
        *[f"y_{a}" for a in MODEL_TARGETS])
