"""The fixture table of cities: longitudes are positive there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Name, longitude, latitude of the 26 rows of the vector tests.
CITIES = (
    ("Allentown,PA", 75.43, 40.65),
    ("Altoona,PA", 78.32, 40.3),
    ("Beaver Falls,PA", 80.33, 40.75),
    ("Blairsville,PA", 79.09, 40.27),
    ("Bradford,PA", 78.63, 41.8),
    ("Dubois,PA", 78.9, 41.18),
    ("Erie,PA", 80.18, 42.08),
    ("Franklin,PA", 79.87, 41.38),
    ("Harrisburg,PA", 76.85, 40.22),
    ("Harrisburg,PA", 77.42, 40.37),
    ("Johnstown,PA", 78.83, 40.32),
    ("Lancaster,PA", 76.3, 40.13),
    ("Latrobe,PA", 79.4, 40.28),
    ("Middletown,PA", 76.77, 40.2),
    ("Muir,PA", 76.57, 40.43),
    ("Nth Philadel,PA", 75.02, 40.08),
    ("Philadelphia,PA", 75.25, 39.88),
    ("Philipsburg,PA", 78.13, 41.47),
    ("Pittsburgh,PA", 79.93, 40.35),
    ("Pittsburgh,PA", 80.22, 40.5),
    ("Reading,PA", 75.97, 40.38),
    ("Site R,PA", 77.43, 39.73),
    ("State Colleg,PA", 77.83, 40.85),
    ("Wilkes-Barre,PA", 75.73, 41.33),
    ("Williamsport,PA", 76.92, 41.25),
    ("Willow Grove,PA", 75.15, 40.2),
)

SQL = "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {x}e0, {y}e0)" for i, (n, x, y) in enumerate(CITIES, 1)) + ") t(id, name, x, y))"


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, x, y) for i, (n, x, y) in enumerate(CITIES, 1)], "id int, name string, x double, y double")
