"""Dimension tables of the monitoring domain.

Everything between the FIXED VALUES markers must equal the values used by the
analysis this library reproduces (regulatory limits, analyte classes,
molecular descriptors, feature weight tiers, column-role tokens, lab-code
names). They are data, not logic; the DataFrame builders below turn them into
small dimension tables that are broadcast into joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------- FIXED VALUES
# Regulatory limit per analyte, ppt (label is 1.0 when concentration >= limit).
THRESHOLDS = {
    "PFOS": 4.0, "PFOA": 4.0,
    "PFNA": 10.0, "PFDA": 10.0, "PFUnA": 10.0, "PFDoA": 10.0,
    "PFTrDA": 10.0, "PFTA": 10.0, "PFHpS": 10.0, "PFNS": 10.0,
    "PFDS": 10.0, "PFHxS": 10.0, "HFPO_DA": 10.0, "PFHxDA": 10.0,
    "PFODA": 10.0, "PFHpA": 10.0, "ADONA": 10.0,
    "11ClPF3OUDS": 10.0, "9ClPF3ONS": 10.0,
    "PFHxA": 10.0,
    "FOSA": 100.0, "8:2FTS": 100.0, "NETFOSAA": 100.0, "NMEFOSAA": 100.0,
    "6:2FTS": 200.0, "4:2FTS": 500.0,
    "PFBS": 2000.0, "PFBA": 2000.0, "PFPeS": 2000.0, "PFPeA": 2000.0,
    "10:2FTS": 100.0,
    "ETFOSE": 100.0,
    "ETFOSA": 100.0,
    "MEFOSE": 100.0,
    "MEFOSA": 100.0,
}

# Analyte classes, dense -> sparse; list order is the chain order.
ANALYTE_CLASSES = {
    "A": ["PFHxA", "PFHpA", "PFOA", "PFNA", "PFDA", "PFUnA", "PFDoA", "PFTrDA", "PFTA",
          "PFBS", "PFHxS", "PFOS", "NETFOSAA", "NMEFOSAA"],
    "B": ["ADONA", "HFPO_DA", "11ClPF3OUDS", "9ClPF3ONS"],
    "C": ["PFBA", "PFPeA", "4:2FTS", "6:2FTS", "8:2FTS", "PFPeS", "PFHpS", "PFNS", "PFDS", "FOSA"],
    "D": ["PFHxDA", "PFODA", "10:2FTS", "ETFOSE", "ETFOSA", "MEFOSE", "MEFOSA"],
}

GLOBAL_CHAIN = ["PFOA", "PFHxA", "PFOS", "PFHxS"]

# Molecular descriptors: (is_pfca, is_pfsa, chain_len, ether).
DESCRIPTORS = {
    "PFHxA": (1, 0, 6, 0), "PFHpA": (1, 0, 7, 0), "PFOA": (1, 0, 8, 0), "PFNA": (1, 0, 9, 0),
    "PFDA": (1, 0, 10, 0), "PFUnA": (1, 0, 11, 0), "PFDoA": (1, 0, 12, 0), "PFTrDA": (1, 0, 13, 0),
    "PFTA": (1, 0, 14, 0),
    "PFBS": (0, 1, 4, 0), "PFHxS": (0, 1, 6, 0), "PFOS": (0, 1, 8, 0), "NETFOSAA": (0, 1, 8, 0),
    "NMEFOSAA": (0, 1, 8, 0),
    "ADONA": (1, 0, 9, 1), "HFPO_DA": (1, 0, 6, 1), "11ClPF3OUDS": (0, 1, 11, 1), "9ClPF3ONS": (0, 1, 9, 1),
    "PFBA": (1, 0, 4, 0), "PFPeA": (1, 0, 5, 0), "4:2FTS": (0, 1, 4, 0), "6:2FTS": (0, 1, 6, 0),
    "8:2FTS": (0, 1, 8, 0), "PFPeS": (0, 1, 5, 0), "PFHpS": (0, 1, 7, 0), "PFNS": (0, 1, 9, 0),
    "PFDS": (0, 1, 10, 0), "FOSA": (0, 1, 8, 0),
    "PFHxDA": (1, 0, 6, 1), "PFODA": (1, 0, 8, 1), "10:2FTS": (0, 1, 10, 0), "ETFOSE": (0, 1, 8, 0),
    "ETFOSA": (0, 1, 8, 0), "MEFOSE": (0, 1, 8, 0), "MEFOSA": (0, 1, 8, 0),
}

# Lab code -> standard column name.
RENAME_MAP = {
    "PFHA": "PFHxA", "PFHPA": "PFHpA", "PFOA": "PFOA", "PFNA": "PFNA", "PFNDCA": "PFDA",
    "PFUNDCA": "PFUnA", "PFDOA": "PFDoA", "PFTRIDA": "PFTrDA", "PFTEDA": "PFTA", "PFBSA": "PFBS",
    "PFHXSA": "PFHxS", "PFOS": "PFOS", "S6NETFOSAA": "NETFOSAA", "NMEFOSAA": "NMEFOSAA",
    "HFPA-DA": "HFPO_DA", "11ClPF3OUDS": "11ClPF3OUDS", "9ClPF3ONS": "9ClPF3ONS", "ADONA": "ADONA",
    "PFBTA": "PFBA", "PFPA": "PFPeA", "4:2FTS": "4:2FTS", "6:2FTS": "6:2FTS", "8:2FTS": "8:2FTS",
    "PFPES": "PFPeS", "PFHPSA": "PFHpS", "PFNS": "PFNS", "PFDSA": "PFDS", "PFOSA": "FOSA",
    "PFHXDA": "PFHxDA", "PFODA": "PFODA", "10:2FTS": "10:2FTS", "ETFOSE": "ETFOSE", "ETFOSA": "ETFOSA",
    "MEFOSE": "MEFOSE", "MEFOSA": "MEFOSA",
    "Ratio_15_Bar_Water_to_Clay_<2mm": "Ratio_Water_Clay",
}

# Columns whose name matches this pattern are concentrations and get coerced to numbers.
ANALYTE_NAME_PATTERN = (
    r"(?i)^(PF|[0-9]+:[0-9]+FTS|HFPO|(NET|NME)FOSAA|FOSA$|(ET|ME)FOS|ADONA|[0-9]+Cl|[0-9]+:2FTS)"
)

# Upper-cased name tokens that mark a column as target-related (never a feature).
TARGET_TOKENS = ["PF", "FTS", "MCL", "HFPO", "ADONA", "PFAS", "11CL", "9CL", "NETFO", "NMEFO", "FOSA", "ETFO", "MEFO"]

# Admin / geo columns kept for plotting but never used as features.
ADMIN_COLS = ["cluster_id", "gm_well_id", "node_tier", "basin_cluster_id",
              "latitude", "longitude", "gm_gis_dwr_basin", "gm_gis_county"]

GLOBAL_FEATS = [
    "Facility_1km", "Facility_3km", "TDS", "SO4", "FE", "MN", "NO3N", "GW_recharge", "Precipitation_mm",
    "Soil_Moisture_mm", "Evapotranspiration_mm", "Texture_USDA", "%Pass_2_Micron_Sieve",
    "Gradation_Uniformity", "redox_proxy", "leaching_index", "env_ionic_strength", "env_redox_reducing",
    "Ratio_Water_Clay", "atm_loading", "Fac_Conf_type", "years_since_2016",
    "Weight_%_0.05_2mm_Clay_Free", "Weight_%_0.25_0.5mm_Clay_Free_<2mm",
]

# Feature weight tiers for site clustering; tier k has weight TIER_WEIGHTS[k], others 1.0.
TIER_1 = ["Facility_50km", "Facility_1km", "Facility_3km", "Facility_10km"]
TIER_2 = ["Weight_%_0.25_0.5mm_Clay_Free_<2mm", "Weight_%_0.02_0.05mm_Clay_Free_<2mm",
          "Weight_%_0.05_2mm_Clay_Free", "Gradation_Uniformity"]
TIER_3 = ["Ratio_Water_Clay", "GW_Runoff_mm", "Silt_Total", "Sand_Total", "Evapotranspiration_mm"]
TIER_4 = ["air_humidity", "pm10_atm", "air_NO2", "air_SO2", "pm2_5_atm", "air_pm1", "air_Ozone", "Temp",
          "WindSpeed"]
TIER_WEIGHTS = {1: 4.0, 2: 3.0, 3: 2.0, 4: 1.0}
# One-hot columns weighted by a lower-case name substring (checked in this order).
ONEHOT_WEIGHT_TOKENS = [("texture_usda", 2.0), ("gm_well_category", 4.0), ("gm_gis_dwr_basin", 2.0)]

UNKNOWN_BASIN = "unknown"
OUTSIDE_REGION = "OUTSIDE OF KNOWN REGION"
MISSING_COUNTY_VALUES = ["unknown", "NO COUNTY FOUND"]
EPOCH_START = "2016-01-01"
HAZARD_LIMIT = 4.0
# ------------------------------------------------------------ END FIXED VALUES


def all_analytes() -> list[str]:
    return [a for cls in ANALYTE_CLASSES.values() for a in cls]


def threshold_table(spark: SparkSession, limits: dict[str, float] | None = None) -> DataFrame:
    limits = THRESHOLDS if limits is None else limits
    schema = T.StructType([T.StructField("analyte", T.StringType()), T.StructField("limit", T.DoubleType())])
    return spark.createDataFrame([(k, float(v)) for k, v in limits.items()], schema)


def analyte_table(spark: SparkSession, classes: dict[str, list[str]] | None = None) -> DataFrame:
    classes = ANALYTE_CLASSES if classes is None else classes
    rows, ord_ = [], 0
    for cls, names in classes.items():
        for a in names:
            rows.append((a, cls, ord_))
            ord_ += 1
    schema = "analyte string, class string, ord int"
    return spark.createDataFrame(rows, schema)


def descriptor_table(spark: SparkSession, descriptors: dict | None = None) -> DataFrame:
    descriptors = DESCRIPTORS if descriptors is None else descriptors
    rows = [(a, *map(int, v)) for a, v in descriptors.items()]
    return spark.createDataFrame(rows, "analyte string, is_pfca int, is_pfsa int, chain_len int, ether int")


def weight_table(spark: SparkSession) -> DataFrame:
    tiers = {1: TIER_1, 2: TIER_2, 3: TIER_3, 4: TIER_4}
    rows = [(f, TIER_WEIGHTS[t]) for t, feats in tiers.items() for f in feats]
    return spark.createDataFrame(rows, "feature string, w double")
