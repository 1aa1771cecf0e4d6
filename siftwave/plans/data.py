"""The test tables as recordings: embeddings become the features of seven channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave.functions.paths import fault_from_path
from siftwave.sources.readers import blocks_of_concat, channels_of_cells, channels_of_columns, channels_of_lists

FAULTS = ("normal", "dry", "lean", "loose", "screwdrop")
LOADS = ("heavy", "med", "light")
VELS = ("80", "90", "100", "120")
NOISES = ("clean", "noiseA", "noiseB")


def _pick(values, index) -> object:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, id, normal, label (the fault in the id) and embedding."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = F.col("vec_id")
    fault, load, vel, noise = _pick(FAULTS, F.col("label") % 5), _pick(LOADS, v % 3), _pick(VELS, F.floor(v / 3) % 4), _pick(NOISES, F.floor(v / 12) % 3)
    tail = F.concat(load, F.lit("_vel"), vel, F.lit("_"), noise, F.lit("_"), F.format_string("%04d", v))
    id_ = F.when(fault == "normal", F.concat(F.lit("normal/"), tail)).otherwise(F.concat(F.lit("abnormal/"), fault, F.lit("/"), tail))
    out = e.select(v.alias("ord"), id_.alias("id"), (fault == "normal").alias("normal"), F.col("embedding").cast("array<double>").alias("x"))
    return out.withColumn("label", fault_from_path(F.col("id"))).withColumn("fault", F.col("label"))


def concat_features(rows: DataFrame) -> DataFrame:
    """Long features of all 64 dimensions and six zeros, ten for each channel."""
    return blocks_of_concat(rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), 6))))


def _parts() -> list:
    """All 64 dimensions: ten for the first channel and nine for each other."""
    return [F.slice("x", 1, 10)] + [F.slice("x", 2 + 9 * c, 9) for c in range(1, 7)]


def list_features(rows: DataFrame) -> DataFrame:
    """Long features of a list of seven vectors."""
    return channels_of_lists(rows.withColumn("per_channel", F.array(*_parts())).drop("x"))


def column_features(rows: DataFrame) -> DataFrame:
    """The same of seven columns."""
    return channels_of_columns(rows.withColumns({f"X_ch{c}": p for c, p in enumerate(_parts())}).drop("x"))


def cell_features(rows: DataFrame) -> DataFrame:
    """The same of seven cells, each a matrix of one row."""
    return channels_of_cells(rows.withColumn("X_per_channel", F.array(*[F.array(p) for p in _parts()])).drop("x"))
