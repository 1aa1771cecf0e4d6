"""Anomaly scores from neighbour distances, their normalization and their fusion over views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.model import views_table
from siftwave.operators.metric_index import nearest_any
from siftwave.operators.neighbours import scaler_stats, standardize
from siftwave.operators.running import Ordered
from siftwave.tables import stored

DIGITS = 12  # fused values are rounded before they are ranked or compared


def _mean_distance(hits: DataFrame) -> DataFrame:
    """channel, ord, near (distances in order) and raw, their mean; added up in that order, so that equal distances give equal means."""
    near = hits.groupBy("channel", "ord").agg(F.sort_array(F.collect_list("dist")).alias("near"))
    return near.withColumn("raw", mean_of("near"))


def mean_of(distances: str) -> Column:
    return F.aggregate(distances, F.lit(0.0), lambda a, d: a + d) / F.size(distances)


def train_neighbours(train: DataFrame, k: int = 11, metric: str = "l2") -> DataFrame:
    """channel, ord, near, raw of training vectors among themselves, a vector's own hit aside."""
    return _mean_distance(nearest_any(train, train, k, metric, skip_first=True))


def train_scores(train: DataFrame, k: int = 11, metric: str = "l2") -> DataFrame:
    """channel, ord, raw of training vectors among themselves, a vector's own hit aside."""
    return train_neighbours(train, k, metric).drop("near")


def tested_scores(train: DataFrame, test: DataFrame, k: int = 11, metric: str = "l2") -> DataFrame:
    """channel, ord, raw of test vectors: the mean distance to the k nearest training vectors."""
    return _mean_distance(nearest_any(test, train, k, metric)).drop("near")


def channel_scores(train: DataFrame, test: DataFrame, k: int = 11, metric: str = "l2", scale: bool = True) -> DataFrame:
    """channel, ord, is_train, raw: mean distances to the k nearest training vectors, as a stored table, since several steps read it."""
    if scale:
        stats = stored(scaler_stats(train), "stats")
        train, test = standardize(train, stats), standardize(test, stats)
    train = stored(train.select("channel", "ord", "vec"), "train")
    own = train_scores(train, k, metric).withColumn("is_train", F.lit(True))
    return stored(own.unionByName(tested_scores(train, test, k, metric).withColumn("is_train", F.lit(False))), "scores")


def require_normals(train: DataFrame, least: int = 2) -> DataFrame:
    """train, after checking that it has at least `least` samples."""
    if train.select("ord").distinct().limit(least).count() < least:
        raise ValueError(f"training needs at least {least} normal samples")
    return train


def clipped_share(upto: Column, total: Column) -> Column:
    """(upto + .5) / (total + 1), kept off 0 and 1."""
    return F.greatest(F.least((upto + 0.5) / (total + 1), F.lit(1 - 1e-6)), F.lit(1e-6))


def normalize_quantile(scores: DataFrame) -> DataFrame:
    """Test scores as clipped shares of training scores that are not larger: (k + .5) / (n + 1).

    Training scores are counted per distinct score and summed over range partitions.
    """
    per_value = scores.groupBy("channel", "raw").agg(F.sum(F.col("is_train").cast("long")).alias("at"), F.count_if(~F.col("is_train")).alias("tested"))
    placed = Ordered(per_value, "channel", "raw").sums(k=F.col("at")).where("tested > 0")
    share = clipped_share(F.col("k"), F.col("total_k")).alias("score")
    return scores.where("not is_train").join(placed.select("channel", "raw", share), ["channel", "raw"]).select("channel", "ord", "raw", "score")


def normalize_zscore(scores: DataFrame) -> DataFrame:
    """Test scores standardized by training scores and then scaled to 0..1 over the test scores of the channel."""
    train = scores.where("is_train").groupBy("channel").agg(F.avg("raw").alias("mu"), (F.stddev_samp("raw") + 1e-12).alias("sd"))
    z = scores.where("not is_train").join(F.broadcast(train), "channel").withColumn("z", (F.col("raw") - F.col("mu")) / F.col("sd"))
    ends = z.groupBy("channel").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("z") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    return z.join(F.broadcast(ends), "channel").select("channel", "ord", "raw", scaled.alias("score"))


NORMALIZERS = {"quantile": normalize_quantile, "zscore": normalize_zscore}


def normalize(scores: DataFrame, how: str = "quantile") -> DataFrame:
    if how not in NORMALIZERS:
        raise ValueError(f"normalization must be one of {sorted(NORMALIZERS)}, not {how!r}")
    return NORMALIZERS[how](scores)


def fuse_scores(scores: DataFrame, views) -> DataFrame:
    """view, ord, score: the mean over a view's channels."""
    table = F.broadcast(views_table(scores.sparkSession, views))
    return scores.join(table, "channel").groupBy("view", "ord").agg(F.round(F.avg("score"), DIGITS).alias("score"))


def per_channel_table(scores: DataFrame, view: str) -> DataFrame:
    """ord, ch1..chN (numbered within the view) and score_mean."""
    table = views_table(scores.sparkSession, [view])
    n = table.first()["n_channels"]
    placed = scores.join(F.broadcast(table), "channel")
    cells = [F.max(F.when(F.col("place") == i, F.col("score"))).alias(f"ch{i}") for i in range(1, n + 1)]
    return placed.groupBy("ord").agg(*cells, F.round(F.avg("score"), DIGITS).alias("score_mean"))
