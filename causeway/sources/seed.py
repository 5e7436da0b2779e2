"""The example that comes with the engine: a registry of weather variables and what seven models claim of its nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.sources import registry as R

#: Nodes (comp_id, name, description): fixed values.
NODES = [
    ("C0001", "SolarRad", "Solar radiation level"),
    ("C0002", "Temp", "Ambient temperature"),
    ("C0003", "Pressure", "Atmospheric pressure"),
    ("C0004", "Humidity", "Relative humidity"),
    ("C0005", "WindSpeed", "Wind speed"),
    ("C0006", "Precip", "Precipitation amount"),
    ("C0007", "CloudCover", "Cloud cover percentage"),
    ("C0008", "Evap", "Evaporation rate"),
    ("C0009", "Runoff", "Surface runoff"),
    ("C0010", "SoilMoist", "Soil moisture content"),
    ("C0011", "Elevation", "Terrain elevation"),
    ("C0012", "Latitude", "Latitude coordinate"),
    ("C0013", "SeasonIdx", "Seasonal index"),
    ("C0014", "AirDensity", "Air density"),
    ("C0015", "DewPoint", "Dew point temperature"),
    ("C0016", "Visibility", "Visibility distance"),
]
#: Edges (comp_id, source, direction, target, description): fixed values.
EDGES = [
    ("C0017", "SolarRad", "->", "Temp", "Solar radiation drives temperature"),
    ("C0018", "Temp", "->", "Pressure", "Temperature affects pressure"),
    ("C0019", "Temp", "->", "Evap", "Temperature drives evaporation"),
    ("C0020", "Humidity", "->", "Precip", "Humidity leads to precipitation"),
    ("C0021", "WindSpeed", "->", "Evap", "Wind speed increases evaporation"),
    ("C0022", "Temp", "<->", "DewPoint", "Temperature and dew point interact"),
    ("C0023", "Pressure", "->", "WindSpeed", "Pressure gradient drives wind"),
    ("C0024", "Elevation", "->", "Temp", "Elevation affects temperature"),
    ("C0025", "CloudCover", "<->", "SolarRad", "Cloud cover and solar radiation interact"),
    ("C0026", "Precip", "->", "SoilMoist", "Precipitation increases soil moisture"),
    ("C0027", "SoilMoist", "<->", "Evap", "Soil moisture and evaporation feedback"),
    ("C0028", "Temp", "<->", "Humidity", "Temperature and humidity interact"),
]
#: Claims (model_id, comp_id, status, timing): fixed values.
CLAIMS = [
    ("M0001", "C0001", "causal", 1),
    ("M0001", "C0002", "causal", 2),
    ("M0001", "C0003", "causal", 3),
    ("M0001", "C0004", "unknown", None),
    ("M0001", "C0007", "unknown", None),
    ("M0001", "C0008", "causal", 4),
    ("M0001", "C0011", "causal", 5),
    ("M0002", "C0001", "unknown", None),
    ("M0002", "C0002", "causal", 2),
    ("M0002", "C0004", "causal", 3),
    ("M0002", "C0005", "causal", 4),
    ("M0002", "C0006", "causal", 5),
    ("M0002", "C0007", "causal", 1),
    ("M0002", "C0008", "unknown", None),
    ("M0002", "C0011", "causal", 6),
    ("M0003", "C0001", "causal", 1),
    ("M0003", "C0002", "causal", 2),
    ("M0003", "C0003", "causal", 3),
    ("M0003", "C0007", "unknown", None),
    ("M0003", "C0011", "causal", 4),
    ("M0003", "C0014", "causal", 5),
    ("M0004", "C0001", "causal", 1),
    ("M0004", "C0002", "causal", 2),
    ("M0004", "C0005", "causal", 3),
    ("M0004", "C0006", "causal", 4),
    ("M0004", "C0007", "causal", 4),
    ("M0004", "C0008", "unknown", None),
    ("M0005", "C0001", "unknown", None),
    ("M0005", "C0002", "causal", 2),
    ("M0005", "C0004", "non-causal", None),
    ("M0005", "C0015", "causal", 5),
    ("M0005", "C0016", "causal", 6),
    ("M0006", "C0001", "unknown", None),
    ("M0006", "C0002", "causal", 2),
    ("M0006", "C0004", "unknown", None),
    ("M0006", "C0007", "unknown", None),
    ("M0006", "C0011", "causal", 3),
    ("M0006", "C0013", "causal", 4),
    ("M0007", "C0001", "causal", 1),
    ("M0007", "C0002", "causal", 2),
    ("M0007", "C0004", "causal", 3),
    ("M0007", "C0006", "non-causal", None),
    ("M0007", "C0010", "causal", 4),
]


def registry() -> R.Registry:
    """The registry; nothing is fixed, and all nodes are observed."""
    nodes = [{"comp_id": c, "type": "node", "source": n, "target": None, "direction": None, "description": d} for c, n, d in NODES]
    edges = [{"comp_id": c, "type": "edge", "source": s, "target": t, "direction": arrow, "description": d} for c, s, arrow, t, d in EDGES]
    return R.from_rows(nodes + edges)


def claims(spark: SparkSession) -> DataFrame:
    return R.claims_frame(spark, [{"model_id": m, "comp_id": c, "status": s, "timing": t} for m, c, s, t in CLAIMS])


def write(spark: SparkSession, folder: str) -> None:
    """Both as Parquet tables below a folder."""
    registry().write(spark, f"{folder}/registry")
    claims(spark).coalesce(1).write.mode("overwrite").parquet(f"{folder}/claims")
