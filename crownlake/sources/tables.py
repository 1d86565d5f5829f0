"""CSV tables with fixed schemas, parameter files and the log of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GPS = "Name string, Longitude double, Latitude double"
CLUSTERS = "n_points long, height double, width_x double, width_y double, radius double, x_pos double, y_pos double, density double, file int"
#: Columns of a sweep's parameter rows.
CLUSTER_PARAMETERS = ["eps", "green_threshold", "max_radius", "max_distance", "min_points", "voxel_size", "min_peak_distance", "k", "min_height", "search_radius_m", "gps_sigma", "smooth_sigma"]
MODEL_PARAMETERS = ["mode", "alpha", "gamma", "confidence_threshold", "eval_random_state", "smote", "weighting", "selection", "tuning"]


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV files with a header; a missing path raises."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def parameters(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Rows of a parameter file as strings by name: fields between white space, # begins a comment."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    rows = spark.read.text(path).select(F.split(line, r"\s+").alias("f"), (line != "").alias("full")).filter("full")
    return rows.select(*(F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)))


def flag(column: str):
    """true, 1, yes, y or t in any case are true; null stays null."""
    return F.lower(F.trim(F.col(column))).isin("true", "1", "yes", "y", "t")


def results_log(spark: SparkSession, path: str) -> DataFrame:
    """line, fields (doubles), score (the last field): rows of a log whose lines differ in length.

    Headers, comments and empty lines have no number in front and go.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double")).alias("fields"))
    return rows.filter(F.get("fields", F.lit(0)).isNotNull()).select("line", "fields", F.element_at("fields", -1).alias("score"))


def append_results(row: DataFrame, path: str) -> None:
    """Adds rows to the log, a Parquet table."""
    row.write.mode("append").parquet(path)
