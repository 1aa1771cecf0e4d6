"""AUROC, ROC curves, thresholds, confusion tables and the metrics made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwave.model import VIEWS
from siftwave.operators.running import Ordered



def _per_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("view", "score").agg(F.sum(F.col("y_true").cast("long")).alias("pos"), F.sum(1 - F.col("y_true").cast("long")).alias("neg"))


def auroc(scored: DataFrame) -> DataFrame:
    """view, auroc, n_test, n_pos: the share of (positive, negative) pairs in right order, ties half; null for one class."""
    placed = Ordered(_per_score(scored), "view", "score").sums(below=F.col("neg"))
    wins = placed.withColumn("wins", F.col("pos") * (F.col("below") - F.col("neg") / 2))
    sums = wins.groupBy("view").agg(F.sum("wins").alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select("view", F.try_divide("wins", F.col("n_pos") * F.col("n_neg")).alias("auroc"), (F.col("n_pos") + F.col("n_neg")).alias("n_test"), "n_pos")


def roc_curve(scored: DataFrame) -> DataFrame:
    """view, place, fpr, tpr, thr: the curve from its origin (threshold infinity), without points inside straight runs.

    A point lies inside a straight run if the next one adds as many positives and negatives as it
    does itself. A rate without samples is null.
    """
    ordered = Ordered(_per_score(scored), "view", "score", descending=True)
    every = ordered.sums(ordered.following(ordered.rows, "pos", "neg"), tp=F.col("pos"), fp=F.col("neg"), seen=F.lit(1))
    bends = (F.col("seen") == 1) | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = ordered.sums(every.withColumn("bend", bends.cast("int")), place=F.col("bend")).where("bend = 1")
    origin = F.struct(F.lit(1).alias("place"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("tp"), F.lit(float("inf")).alias("thr"))
    point = F.struct((F.col("place") + 1).cast("int").alias("place"), "fp", "tp", F.col("score").alias("thr"))
    points = F.explode(F.when(F.col("seen") == 1, F.array(origin, point)).otherwise(F.array(point)))
    p = kept.select("view", "total_fp", "total_tp", points.alias("p"))
    return p.select("view", "p.place", F.try_divide("p.fp", "total_fp").alias("fpr"), F.try_divide("p.tp", "total_tp").alias("tpr"), "p.thr")


def percentile(scored: DataFrame, q: float) -> DataFrame:
    """view, thr: the score at share q of each view's order, between two scores in proportion."""
    counts = scored.groupBy("view", "score").agg(F.count(F.lit(1)).alias("n"))
    placed = Ordered(counts, "view", "score").sums(upto=F.col("n"))
    at = F.lit(q) * (F.col("total_upto") - 1)
    first = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("score")))
    ends = placed.groupBy("view").agg(first(F.floor(at)).alias("low"), first(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("rest"))
    return ends.select("view", (F.col("low") + (F.col("high") - F.col("low")) * F.col("rest")).alias("thr"))


def pick_threshold(scored: DataFrame, mode: str, target: float | None = None, curve: DataFrame | None = None) -> DataFrame:
    """view, thr and, in a map `about`, what the choice says of itself.

    Modes: youden, fpr_at (target rate), percentile (target share) and score (target itself). curve:
    the ROC curve of the same scores, where it has been made already.
    """
    about = lambda **values: F.map_from_arrays(F.array(*[F.lit(n) for n in values]), F.array(*[v.cast("double") for v in values.values()])).alias("about")
    if mode in ("youden", "fpr_at"):
        curve = roc_curve(scored) if curve is None else curve
        point = F.struct("thr", "fpr", "tpr", (F.col("tpr") - F.col("fpr")).alias("j"))
        if mode == "youden":
            best = F.max_by(point, F.struct(F.col("tpr") - F.col("fpr"), -F.col("place")))
        else:
            within = F.col("fpr") <= float(target)
            best = F.max_by(point, F.struct(within, F.when(within, F.col("place")).otherwise(-F.col("place"))))
        b = curve.groupBy("view").agg(best.alias("b"), F.count(F.lit(1)).alias("points"))
        extra = {"youden_index": F.col("b.j")} if mode == "youden" else {"achieved_fpr": F.col("b.fpr"), "achieved_tpr": F.col("b.tpr")}
        return b.select("view", F.col("b.thr").alias("thr"), about(roc_points=F.col("points"), **extra))
    if mode == "percentile":
        q = min(max(float(target), 1e-6), 1 - 1e-6)
        return percentile(scored, q).select("view", "thr", about(percentile=F.lit(q)))
    if mode == "score" and target is not None:
        return scored.select("view").distinct().select("view", F.lit(float(target)).alias("thr"), F.create_map().cast("map<string,double>").alias("about"))
    raise ValueError(f"mode must be youden, fpr_at, percentile or score (with a target), not {mode!r}")


def binary_metrics(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """view, thr, tn, fp, fn, tp, acc, precision, recall, f1; a ratio without a denominator is 0."""
    y, hit = F.col("y_true") == 1, F.col("score") >= F.col("thr")
    cells = {"tn": ~y & ~hit, "fp": ~y & hit, "fn": y & ~hit, "tp": y & hit}
    c = scored.join(thresholds.select("view", "thr"), "view").groupBy("view", "thr").agg(*[F.count_if(x).alias(n) for n, x in cells.items()])
    return c.select("*", *[_ratio(n, d).alias(a) for a, (n, d) in {"acc": ("tp + tn", "tp + tn + fp + fn"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn")}.items()])


def _ratio(n: str, d: str) -> Column:
    return F.coalesce(F.try_divide(F.expr(n), F.expr(d)), F.lit(0.0))


MAX_CLASSES = 1000


def class_names(classes: DataFrame) -> list[str]:
    """Labels in order; an error for more than MAX_CLASSES, since confusion tables are dense."""
    names = [r["label"] for r in classes.orderBy("label").limit(MAX_CLASSES + 1).collect()]
    if len(names) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return names


def confusion(preds: DataFrame, classes: list[str], views=tuple(VIEWS)) -> DataFrame:
    """view, y_true, y_pred, n for every view and pair of classes; predictions of other labels are left out."""
    listed = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    if not classes:
        return preds.groupBy("view", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")).limit(0)
    grid = preds.sparkSession.range(1).select(listed(views).alias("view")).select("view", listed(classes).alias("y_true")).select("*", listed(classes).alias("y_pred"), F.lit(0).cast("long").alias("n"))
    counts = preds.where(F.col("y_true").isin(classes) & F.col("y_pred").isin(classes)).select("view", "y_true", "y_pred", F.lit(1).cast("long").alias("n"))
    return counts.unionByName(grid).groupBy("view", "y_true", "y_pred").agg(F.sum("n").alias("n"))


def class_report(table: DataFrame) -> DataFrame:
    """view, label, support, predicted, recall, precision, f1 from a confusion table, which is read once."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    side = lambda label, support, predicted, tp: F.struct(label.alias("label"), support.alias("support"), predicted.alias("predicted"), tp.alias("tp"))
    n, none = F.col("n"), F.lit(0).cast("long")
    sides = F.explode(F.array(side(F.col("y_true"), n, none, hit), side(F.col("y_pred"), none, n, none))).alias("s")
    sums = table.select("view", sides).groupBy("view", "s.label").agg(*[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "tp")])
    return sums.select("view", "label", "support", "predicted", _ratio("tp", "predicted").alias("precision"), _ratio("tp", "support").alias("recall"), _ratio("2 * tp", "support + predicted").alias("f1"), "tp")


def multiclass_metrics(table: DataFrame) -> DataFrame:
    """view, raw_acc, balanced_acc (over true classes), macro_f1 (over true and predicted classes), n_test_eval."""
    r = class_report(table)
    seen, any_ = F.col("support") > 0, (F.col("support") > 0) | (F.col("predicted") > 0)
    return r.groupBy("view").agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("raw_acc"), F.avg(F.when(seen, F.col("recall"))).alias("balanced_acc"), F.avg(F.when(any_, F.col("f1"))).alias("macro_f1"), F.sum("support").alias("n_test_eval"))
