"""Leakage-safe train and test splits at the level of operating conditions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.functions.paths import CLASSIFICATION_ID, DETECTION_ID, LOADS, NOISES, combos, parse_id


def with_condition(samples: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """samples with load, vel, noise and noise_cls, read from their ids."""
    return samples.withColumns(parse_id(samples["id"], patterns))


def split_detection(samples: DataFrame, leave_vel: str = "100", train_leave_combos: str = "all") -> DataFrame:
    """samples with `part`: train, test_normal, test_abnormal, or null for normal ones of the held velocity outside the grid.

    samples: id and normal (boolean). Normal samples of other velocities train; of the held velocity,
    the listed (load, noise) combos train and the others of the grid are tested; abnormal ones are tested.
    """
    df = with_condition(samples, DETECTION_ID)
    held = F.col("vel") == leave_vel
    pair = F.concat_ws("-", "load", "noise_cls")
    chosen = ["-".join(c) for c in combos(train_leave_combos)]
    grid = [f"{load}-{noise}" for load in LOADS for noise in NOISES]
    part = (
        F.when(~F.col("normal"), "test_abnormal")
        .when(~held, "train")
        .when(pair.isin(chosen) if chosen else F.lit(False), "train")
        .when(pair.isin(grid), "test_normal")
    )
    return df.withColumn("part", part)


def missing_combos(samples: DataFrame, leave_vel: str, train_leave_combos: str) -> DataFrame:
    """Listed (load, noise_cls) pairs that no normal sample of the held velocity has."""
    spark = samples.sparkSession
    wanted = spark.createDataFrame(combos(train_leave_combos), "load string, noise_cls string")
    there = with_condition(samples, DETECTION_ID).where(F.col("normal") & (F.col("vel") == leave_vel)).select("load", "noise_cls").distinct()
    return wanted.join(there, ["load", "noise_cls"], "left_anti")


def _ranked(conditions: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "load", "noise_cls", "vel"))
    return conditions.withColumn("place", F.row_number().over(Window.partitionBy("load", "noise_cls").orderBy(key, "vel")))


def _ranked_mt19937(conditions: DataFrame, seed: int) -> DataFrame:
    """Conditions shuffled stratum by stratum in order of first appearance; as many rows as there are conditions."""
    rows = conditions.orderBy("first").collect()
    strata: dict[tuple, list] = {}
    for r in rows:
        strata.setdefault((r["load"], r["noise_cls"]), []).append(r)
    rng, out = np.random.RandomState(seed), []
    for members in strata.values():
        order = np.arange(len(members))
        rng.shuffle(order)
        out += [(members[j]["load"], members[j]["noise_cls"], members[j]["vel"], place) for place, j in enumerate(order.tolist(), 1)]
    return conditions.sparkSession.createDataFrame(out, "load string, noise_cls string, vel string, place int")


def split_classification(
    samples: DataFrame,
    leave_vel: str = "100",
    train_frac: float = 0.5,
    seed: int = 0,
    exclude_noise: bool = False,
    exclude_loads: tuple[str, ...] = (),
    hard_labels: tuple[str, ...] = (),
    hard_vels: tuple[str, ...] = (),
    shuffle: str = "md5",
) -> DataFrame:
    """samples with `part`: train, test_leave, test_base or test_hard; excluded base samples are left out of both sides.

    samples: id, ord and fault. Base conditions (vel, load, noise_cls) are put in random order within
    each (load, noise_cls) stratum; the first floor(n * train_frac) train. Training samples of hard
    labels at hard velocities then move to the test side. shuffle: md5 (a hash order that SQL can
    express) or mt19937 (numpy's generator).
    """
    df = with_condition(samples, CLASSIFICATION_ID)
    base = df.where(F.col("vel") != leave_vel.strip())
    if exclude_noise:
        base = base.where("noise_cls = 'clean'")
    loads = [x for x in exclude_loads if x in LOADS]
    if loads:
        base = base.where(~F.col("load").isin(loads))
    keys = ["load", "noise_cls", "vel"]
    conditions = base.groupBy(*keys).agg(F.min("ord").alias("first"))
    ranked = (_ranked if shuffle == "md5" else _ranked_mt19937)(conditions, seed)
    size = F.count(F.lit(1)).over(Window.partitionBy("load", "noise_cls"))
    train = ranked.withColumn("size", size).where(F.col("place") <= F.floor(F.col("size") * train_frac)).select(*keys, F.lit(True).alias("_train"))
    hard = F.col("fault").isin(list(hard_labels)) & F.col("vel").isin(list(hard_vels)) if hard_labels and hard_vels else F.lit(False)
    placed = base.join(train, keys, "left").withColumn("part", F.when(F.col("_train").isNull(), "test_base").when(F.coalesce(hard, F.lit(False)), "test_hard").otherwise("train")).drop("_train")
    return placed.unionByName(df.where(F.col("vel") == leave_vel.strip()).withColumn("part", F.lit("test_leave")))


def check_split(split: DataFrame, leave_vel: str) -> None:
    """ValueError if an id lies on both sides, or the held velocity trains a classification split."""
    side = F.when(F.col("part") == "train", "train").otherwise("test")
    both = split.where(F.col("part").isNotNull()).groupBy("id").agg(F.count_distinct(side).alias("n")).where("n > 1").limit(5).collect()
    if both:
        raise ValueError(f"ids on both sides: {[r['id'] for r in both]}")
    held = split.where((F.col("part") == "train") & (F.col("vel") == leave_vel)).select("id").limit(5).collect()
    if held:
        raise ValueError(f"training ids of the held velocity: {[r['id'] for r in held]}")


def ordered_ids(split: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Ids of some parts, each once at its first place: part by part, then in source order."""
    place = F.array_position(F.lit(list(parts)), F.col("part"))
    return split.where(F.col("part").isin(list(parts))).groupBy("id").agg(F.min(F.struct(place.alias("p"), F.col("ord"))).alias("o")).orderBy("o").select("id")


def distribution(split: DataFrame) -> DataFrame:
    """Samples per side, label and condition."""
    side = F.when(F.col("part") == "train", "train").otherwise("test").alias("side")
    return split.where(F.col("part").isNotNull()).groupBy(side, F.col("fault").alias("label"), "vel", "load", "noise_cls").agg(F.count(F.lit(1)).alias("n"))


def detection_counts(split: DataFrame, leave_vel: str = "100") -> DataFrame:
    """side (train or test), n_combos (of normality, load, velocity and noise), n_rows, n_ids, the normal and abnormal ones of these, and the normal rows of the held velocity."""
    side = F.when(F.startswith("part", F.lit("test")), "test").otherwise(F.col("part"))
    held = F.col("normal") & (F.col("vel") == leave_vel)
    return (
        split.where("part IS NOT NULL")
        .groupBy(side.alias("side"))
        .agg(
            F.count_distinct("normal", "load", "vel", "noise_cls").alias("n_combos"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_distinct("id").alias("n_ids"),
            F.count_distinct(F.when(F.col("normal"), F.col("id"))).alias("n_normal"),
            F.count_distinct(F.when(~F.col("normal"), F.col("id"))).alias("n_abnormal"),
            F.count_if(held).alias("n_held_normal"),
        )
    )


def split_counts(split: DataFrame) -> DataFrame:
    """Samples and distinct conditions of every part."""
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("vel", "load", "noise_cls").alias("n_conditions"))
