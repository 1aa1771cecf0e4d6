"""Result tables in the layout that other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.model import VIEWS
from siftwave.operators.evaluation import class_report, multiclass_metrics

SPLIT_NAME = "combo_condition_balanced_fc"


def split_meta(split: DataFrame, leave_vel: str = "100", seed: int = 0, train_frac: float = 0.5, exclude_noise: bool = False, exclude_load: str = "", hard_labels: tuple[str, ...] = (), hard_vels: tuple[str, ...] = ()) -> DataFrame:
    """One row that describes a classification split and its options."""
    train, test = F.col("part") == "train", F.col("part").isNotNull() & (F.col("part") != "train")
    condition = F.struct("vel", "load", "noise_cls")
    some = lambda test_: F.sort_array(F.collect_set(F.when(test_, F.col("fault"))))
    fixed = {"split_name": SPLIT_NAME, "leave_vel": leave_vel, "seed": seed, "task": "fault_classification", "partition_level": "condition_level", "condition_def": "(vel, load, noise_cls)", "train_frac_per_stratum": float(train_frac), "exclude_noise_from_base": exclude_noise, "exclude_load_from_base": exclude_load}
    lists = {"hard_labels": sorted(hard_labels), "hard_vels": sorted(hard_vels)}
    counted = split.agg(
        F.count_distinct(F.when(F.col("part") == "test_hard", F.col("id"))).alias("N_extra_test_from_base_train_moved"),
        F.count_distinct(F.when(train, F.col("id"))).alias("N_train"),
        F.count_distinct(F.when(test, F.col("id"))).alias("N_test"),
        F.count_distinct(F.when(train, condition)).alias("N_train_conditions"),
        F.count_distinct(F.when(test, condition)).alias("N_test_conditions"),
        some(train).alias("train_labels"),
        some(test).alias("test_labels"),
        some(train | test).alias("all_labels"),
    )
    return counted.select(*[F.lit(v).alias(k) for k, v in fixed.items()], *[F.array(*[F.lit(x) for x in v]).cast("array<string>").alias(k) for k, v in lists.items()], *counted.columns)


def detection_views(areas: DataFrame, n_train: int, metric: str = "l2", normalization: str = "quantile", standardized: bool = True, k: int = 11, per_channel: bool = False) -> DataFrame:
    """The comparison of detection views: AUROC, sample counts and settings, a row for each view."""
    used = F.element_at(F.create_map(*[F.lit(x) for v, c in VIEWS.items() for x in (v, len(c))]), F.col("view"))
    settings = {"metric": metric, "fusion_norm": normalization, "standardize": standardized, "knn_k": k}
    return areas.select(
        "view",
        F.col("auroc").alias("AUROC"),
        F.lit(n_train).cast("long").alias("N_train_norm"),
        F.col("n_test").alias("N_test"),
        F.col("n_pos").alias("N_test_pos"),
        *[F.lit(v).alias(n) for n, v in settings.items()],
        used.alias("num_channels_used"),
        F.lit(per_channel).alias("per_channel"),
    )


def class_probabilities(preds: DataFrame, view_probs: DataFrame, classes: list[str]) -> DataFrame:
    """preds with p_<class> for every class; a class without a vote has 0."""
    cells = [F.coalesce(F.max(F.when(F.col("label") == c, F.col("p"))), F.lit(0.0)).alias(f"p_{c}") for c in classes]
    return preds.join(view_probs.groupBy("view", "ord").agg(*cells), ["view", "ord"])


def confusion_matrix(table: DataFrame, classes: list[str]) -> DataFrame:
    """A confusion table with one row for each view and true class, and a column for each predicted one."""
    cells = [F.sum(F.when(F.col("y_pred") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in classes]
    return table.groupBy("view", F.concat(F.lit("true_"), "y_true").alias("true")).agg(*cells)


def classification_views(table: DataFrame, classes: list[str], n_train: int, k: int = 11, metric: str = "l2", vote: str = "weighted", standardized: bool = True, per_channel: bool = False) -> DataFrame:
    """The comparison of classification views: metrics, counts, settings and F1_<class>, a row for each view."""
    scores = class_report(table).groupBy("view").agg(*[F.max(F.when(F.col("label") == c, F.col("f1"))).alias(f"F1_{c}") for c in classes])
    settings = {"knn_k": k, "metric": metric, "vote": vote, "standardize": standardized, "per_channel": per_channel}
    m = multiclass_metrics(table).join(scores, "view")
    return m.select("view", "raw_acc", "balanced_acc", "macro_f1", F.lit(n_train).cast("long").alias("N_train"), F.col("n_test_eval").alias("N_test_eval"), *[F.lit(v).alias(n) for n, v in settings.items()], *[f"F1_{c}" for c in classes])
