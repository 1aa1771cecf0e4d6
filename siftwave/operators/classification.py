"""Votes of neighbours, probabilities fused over views, predictions, and the neighbour audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.model import views_table
from siftwave.operators.detection import DIGITS


def class_table(train: DataFrame) -> DataFrame:
    """label and class_idx, by label; as many rows as there are classes."""
    labels = train.where(F.col("label").isNotNull()).select("label").distinct()
    return labels.withColumn("class_idx", F.row_number().over(Window.orderBy("label")) - 1)


def unseen(test: DataFrame, classes: DataFrame, mode: str = "ignore") -> DataFrame:
    """Test samples whose label no training sample has; an error in mode `error` if there are any."""
    out = test.where(F.col("label").isNotNull()).join(classes, "label", "left_anti").select("id", F.concat(F.lit("UNSEEN:"), "label").alias("y_true"))
    if mode not in ("ignore", "error"):
        raise ValueError(f"mode must be ignore or error, not {mode!r}")
    if mode == "error" and (some := out.limit(5).collect()):
        raise ValueError(f"test labels that training lacks: {[r['y_true'] for r in some]}")
    return out


def channel_probabilities(neighbours: DataFrame, vote: str = "weighted", eps: float = 1e-12) -> DataFrame:
    """channel, ord, train_label, p: shares of the neighbours' votes; labels without a vote have no row."""
    if vote not in ("hard", "weighted"):
        raise ValueError(f"vote must be hard or weighted, not {vote!r}")
    weight = F.lit(1.0) if vote == "hard" else 1 / (F.col("dist") + eps)
    votes = neighbours.groupBy("channel", "ord", "train_label").agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(Window.partitionBy("channel", "ord"))
    return votes.withColumn("total", total).select("channel", "ord", "train_label", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(F.col("w")).alias("p"))


def view_probabilities(probabilities: DataFrame, views) -> DataFrame:
    """view, ord, label, p: sums over a view's channels by their number, since absent votes count as 0."""
    table = F.broadcast(views_table(probabilities.sparkSession, views))
    placed = probabilities.join(table, "channel")
    return placed.groupBy("view", "ord", F.col("train_label").alias("label")).agg(F.round(F.sum("p") / F.max("n_channels"), DIGITS).alias("p"))


def predictions(view_probs: DataFrame) -> DataFrame:
    """view, ord, y_pred, p: the most probable label; of equals the first by name."""
    best = F.min(F.struct((-F.col("p")).alias("p"), "label")).alias("b")
    return view_probs.groupBy("view", "ord").agg(best).select("view", "ord", F.col("b.label").alias("y_pred"), (-F.col("b.p")).alias("p"))


def inspect_neighbours(neighbours: DataFrame, preds: DataFrame, test: DataFrame, view: str, labels=(), mode: str = "all", topk: int = 11) -> DataFrame:
    """The nearest training samples, channel by channel, of tested samples that were predicted right, wrong or at all."""
    chosen = preds.where(F.col("view") == view).join(test.select("ord", F.col("id").alias("test_id"), F.col("label").alias("test_true")), "ord")
    if labels:
        chosen = chosen.where(F.col("test_true").isin(list(labels)))
    right = F.col("test_true") == F.col("y_pred")
    chosen = chosen.where({"all": F.lit(True), "correct": right, "wrong": ~right}[mode])
    channels = F.broadcast(views_table(preds.sparkSession, [view]).select("channel"))
    hits = neighbours.where(F.col("rank") <= max(1, topk)).join(channels, "channel").join(chosen.select("ord", "test_id", "test_true", "y_pred"), "ord")
    return hits.select(F.lit(view).alias("inspect_view"), F.lit(mode).alias("inspect_mode"), "test_id", F.col("test_true").alias("test_label"), "test_true", F.col("y_pred").alias("test_pred"), "channel", "rank", F.col("dist").alias("distance"), "train_id", "train_label")


def hit_counts(inspected: DataFrame) -> DataFrame:
    """How often each training sample is a neighbour."""
    return inspected.groupBy("train_id", "train_label").agg(F.count(F.lit(1)).alias("hit_count"))
