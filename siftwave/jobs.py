"""The six jobs from a dataset tree to evaluated results, as functions and as `python -m siftwave.jobs NAME --option value`.

Features are long Parquet tables (id, ord, label, split, channel, vec) or .npz files; results are
folders of CSV files and small JSON files.
"""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwave.functions.paths import condition_from_path, csv_options, fault_from_path, json_options
from siftwave.model import require_columns, require_single_dim, resolve_views
from siftwave.operators import classification as C
from siftwave.operators import detection as D
from siftwave.operators import evaluation as E
from siftwave.operators import reports as R
from siftwave.operators import splits as X
from siftwave.operators.encoders import encoder_factory
from siftwave.operators.matching import match_and_count
from siftwave.operators.metric_index import nearest_any
from siftwave.operators.neighbours import scaler_stats, standardize
from siftwave.operators.signals import encode_blocks, encode_signals, with_layout
from siftwave.sources import readers, writers
from siftwave.tables import stored

ALL_VIEWS = "vibration,audio,fused"


def make_index(spark: SparkSession, root: str, csv: str, vib_sr: int = 100_000) -> None:
    """Index a dataset tree."""
    index = readers.build_index(readers.list_tree(spark, root), readers.sniff_columns(spark, root), vib_sr)
    writers.write_csv(index.orderBy("label", "id").coalesce(1), csv)


def extract_features(spark: SparkSession, index: str, root: str, out: str, encoder: str, class_name: str = "FeatureExtractor", multi_channel_strategy: str = "concatenate", vib_default_sr: int = 0, limit: int = 0, extractor_args: str = "", per_channel: bool = False, form: str = "plain", window: int = 160_000, scan: bool = False, twins: bool = False) -> None:
    """Encode every signal of an index; samples with a failing channel are written to <out>-errors and left out.

    scan: read long recordings in ranges and window by window instead of whole. twins: take the .wav
    file beside a compressed recording, under the same name, where there is one.
    """
    rows = readers.read_index(spark, index).withColumn("ord", F.monotonically_increasing_id())
    rows = stored(readers.first_samples(rows, limit or None), "index")
    make = encoder_factory(encoder, class_name, spark, **json_options(extractor_args))
    if scan:
        blocks, wrong = readers.scan_signals(spark, rows, root, vib_default_sr or None, form, twins)
        encoded = encode_blocks(blocks.select(F.struct("id", "channel").alias("key"), "rate", "start", "samples"), make, window).select("key.id", "key.channel", "vec", "error")
    else:
        signals = readers.read_signals(spark, rows, root, vib_default_sr or None, form, twins)
        encoded, wrong = encode_signals(signals.where("error IS NULL"), make, window), signals.where("error IS NOT NULL")
    wrong = wrong.select("id", "channel", F.lit(None).cast("array<double>").alias("vec"), "error")
    encoded = stored(encoded.unionByName(wrong), "encoded")
    failed = encoded.where("error IS NOT NULL").select("id", "channel", "error")
    writers.write_csv(failed, f"{out}-errors")
    good = encoded.join(failed.select("id").distinct(), "id", "left_anti").drop("error").join(rows.select("id", "ord", "label", "split"), "id")
    if good.isEmpty():
        raise ValueError("no features could be extracted")
    if per_channel:
        writers.write_features(require_single_dim(good), out)
    else:
        whole = with_layout(good.select("id", "ord", "channel", "vec"), False, multi_channel_strategy)
        whole.join(rows.select("ord", "label", "split"), "ord").write.mode("overwrite").parquet(out)


def load_features(spark: SparkSession, path: str, per_channel: bool = False) -> DataFrame:
    """Long features with `normal` of a Parquet table or an .npz file, in any of the known layouts."""
    table = readers.read_npz(spark, path) if path.endswith(".npz") else spark.read.parquet(path)
    if "vec" in table.columns:
        return require_single_dim(readers.with_normality(table))
    table = readers.with_normality(table)
    if not per_channel:
        return readers.blocks_of_concat(require_columns(table, "x", "id").drop("per_channel"))
    return require_single_dim(readers.channels_of_columns(table) if "X_ch0" in table.columns else readers.channels_of_cells(table.drop("x")))


def split_fd(spark: SparkSession, csv: str, outdir: str, leave_vel: str = "100", train_leave_combos: str = "all", seed: int = 0) -> None:
    """Write train.ids and test.ids for detection. seed: kept for callers; nothing is drawn."""
    rows = readers.read_positional(spark, csv).withColumn("ord", F.monotonically_increasing_id()).withColumn("normal", F.col("label") == "normal")
    split = stored(X.split_detection(rows, leave_vel, train_leave_combos), "split")
    X.check_split(split, "")
    writers.write_ids(X.ordered_ids(split, ("train",)), f"{outdir}/train.ids")
    writers.write_csv(X.detection_counts(split, leave_vel).orderBy(F.desc("side")), f"{outdir}/split_counts.csv")
    tested = split.withColumn("part", F.when(F.col("part").startswith("test"), "test").otherwise(F.col("part")))
    writers.write_ids(X.ordered_ids(tested, ("test",)), f"{outdir}/test.ids")


def split_fc(spark: SparkSession, csv: str, outdir: str, seed: int = 0, label_col: int = 2, id_col: int = 0, leave_vel: str = "100", exclude_noise_from_base: bool = False, exclude_load_from_base: str = "", hard_labels: str = "dry,lean", hard_vels: str = "80,100", train_frac: float = 0.5) -> None:
    """Write id lists, distributions and a description for classification, with numpy's order of conditions."""
    rows = readers.read_positional(spark, csv, id_col, label_col).withColumn("ord", F.monotonically_increasing_id())
    fault = F.coalesce(fault_from_path(F.col("id")), F.col("label"))
    labels, vels, load = tuple(csv_options(hard_labels)), tuple(csv_options(hard_vels)), exclude_load_from_base.strip().lower()
    split = X.split_classification(rows.withColumn("fault", fault), leave_vel, train_frac, seed, exclude_noise_from_base, (load,) if load else (), labels, vels, "mt19937")
    split = stored(split, "split")
    X.check_split(split, leave_vel)
    writers.write_ids(X.ordered_ids(split, ("train",)), f"{outdir}/train.ids")
    writers.write_ids(X.ordered_ids(split, ("test_leave", "test_base", "test_hard")), f"{outdir}/test.ids")
    table = X.distribution(split)
    for side in ("train", "test"):
        writers.write_csv(table.where(F.col("side") == side).drop("side").orderBy("label", "vel", "load", "noise_cls"), f"{outdir}/{side}_dist.csv")
    writers.write_json(R.split_meta(split, leave_vel, seed, train_frac, exclude_noise_from_base, load, labels, vels), f"{outdir}/split_meta.json")


def _sides(spark: SparkSession, features: DataFrame, train_ids: str, test_ids: str, splits_dir: str = "", suffix: bool = False, **columns: Column) -> tuple[DataFrame, DataFrame]:
    """The training and the test side as stored tables; what is left out is told."""
    if splits_dir:
        train, test = readers.read_split(spark, splits_dir)
    elif train_ids and test_ids:
        train, test = readers.read_ids(spark, train_ids, suffix), readers.read_ids(spark, test_ids, suffix)
    else:
        raise ValueError("give a split folder, or lists of training and of test ids")
    out = []
    for side, ids in (("train", train), ("test", test)):
        matched = match_and_count(ids, features, side, **columns)
        if matched.n_missing:
            print(f"{matched.n_missing} {side} ids have no features, such as {matched.first_missing}")
        if matched.n_unlabelled:
            print(f"{matched.n_unlabelled} {side} samples have no label")
        out.append(matched.rows)
    return tuple(out)


def detect(spark: SparkSession, features: str, outdir: str, train_ids: str = "", test_ids: str = "", splits_dir: str = "", modal_modes: str = ALL_VIEWS, knn_k: int = 11, metric: str = "l2", fusion_norm: str = "quantile", standardize_features: bool = True, per_channel: bool = False, do_cm: bool = False, cm_mode: str = "youden", cm_fpr: float = 0.1, cm_percentile: float = 0.5, cm_score: str = "") -> None:
    """Score listed test samples against listed normal ones, and evaluate each view."""
    views = resolve_views(modal_modes)
    train, test = _sides(spark, load_features(spark, features, per_channel), train_ids, test_ids, splits_dir, suffix=True)
    train = D.require_normals(train.where("normal"))
    y = test.select("ord", "id", F.when(F.col("normal"), 0).otherwise(1).alias("y_true")).distinct()
    channels = stored(D.normalize(D.channel_scores(train.select("channel", "ord", "vec"), test.select("channel", "ord", "vec"), knn_k, metric, standardize_features), fusion_norm), "normalized")
    scored = stored(D.fuse_scores(channels, views).join(y, "ord"), "scored")
    areas = stored(E.auroc(scored), "areas")
    writers.write_csv(R.detection_views(areas, train.select("ord").distinct().count(), metric, fusion_norm, standardize_features, knn_k, per_channel), f"{outdir}/metrics_compare_views.csv")
    both = {r["view"] for r in areas.where("n_pos > 0 AND n_pos < n_test").collect()}
    target = {"fpr_at": cm_fpr, "percentile": cm_percentile, "score": float(cm_score) if cm_score else None}.get(cm_mode)
    for view in views:
        folder, own = f"{outdir}/view_{view}", scored.where(F.col("view") == view)
        writers.write_csv(D.per_channel_table(channels, view).join(y, "ord").orderBy("ord").drop("ord").select("id", "y_true", F.expr("* EXCEPT (id, y_true)")), f"{folder}/per_channel_scores.csv")
        writers.write_csv(own.orderBy("ord").select("id", "score", "y_true"), f"{folder}/test_scores.csv")
        record = areas.where(F.col("view") == view)
        if do_cm and view in both:
            curve = stored(E.roc_curve(own), "curve")
            threshold = stored(E.pick_threshold(own, cm_mode, target, curve), "threshold")
            m = E.binary_metrics(own, threshold).join(threshold.select("view", "about"), "view")
            writers.write_csv(m.select(F.explode(F.expr("array(named_struct('t', 'True_0', 'p0', tn, 'p1', fp), named_struct('t', 'True_1', 'p0', fn, 'p1', tp))")).alias("c")).select(F.col("c.t").alias(" "), F.col("c.p0").alias("Pred_0"), F.col("c.p1").alias("Pred_1")), f"{folder}/cm_{cm_mode}.csv")
            writers.write_csv(curve.orderBy("place").select(F.col("fpr").alias("FPR"), F.col("tpr").alias("TPR"), F.col("thr").alias("THR")), f"{folder}/roc_curve.csv")
            described = m.select("view", F.lit(cm_mode).alias("mode"), F.col("thr").alias("threshold"), F.col("acc").alias("ACC"), F.col("precision").alias("Precision"), F.col("recall").alias("Recall"), F.col("f1").alias("F1"), "about")
            writers.write_json(described.drop("view"), f"{folder}/threshold_{cm_mode}.json")
            record = record.join(described.select("view", *[F.col(c).alias(f"CM_{c}") for c in described.columns[1:]]), "view")
        writers.write_json(record, f"{folder}/metrics.json")


def classify(spark: SparkSession, features: str, train_ids: str, test_ids: str, outdir: str, knn_k: int = 11, metric: str = "l2", vote: str = "weighted", eps: float = 1e-12, views: str = "audio,vibration,fused", standardize_features: bool = True, unseen_mode: str = "ignore", per_channel: bool = False, inspect_labels: str = "", inspect_view: str = "fused", inspect_topk: int = 0, inspect_mode: str = "all") -> None:
    """Predict the fault of listed test samples from listed training ones, and evaluate each view."""
    wanted, view = resolve_views(views), resolve_views(inspect_view)[0]
    fault = fault_from_path(F.col("id"))
    train, test = _sides(spark, load_features(spark, features, per_channel), train_ids, test_ids, label=fault, fault=fault)
    classes = C.class_table(train)
    names = E.class_names(classes)
    unseen = C.unseen(test.select("ord", "id", "label").distinct(), classes, unseen_mode)
    known = test.join(classes.select("label"), "label", "left_semi")
    fitted = (lambda side, stats=scaler_stats(train): standardize(side, stats)) if standardize_features else (lambda side: side)
    named = fitted(train).withColumns({"train_id": F.col("id"), "train_label": F.col("label")})
    hits = stored(nearest_any(fitted(known), named, knn_k, metric, carry=("train_id", "train_label")), "neighbours")
    probs = stored(C.view_probabilities(C.channel_probabilities(hits, vote, eps), wanted if view in wanted else [*wanted, view]), "probabilities")
    preds = stored(C.predictions(probs), "predictions")
    about = known.select("ord", "id", F.col("label").alias("y_true")).distinct()
    table = stored(E.confusion(preds.join(about, "ord"), names, wanted), "confusion")
    writers.write_csv(R.classification_views(table, names, train.select("ord").distinct().count(), knn_k, metric, vote, standardize_features, per_channel), f"{outdir}/metrics_compare_views_multiclass.csv")
    full = R.class_probabilities(preds.drop("p"), probs, names).join(about, "ord")
    for v in wanted:
        folder, own = f"{outdir}/view_{v}", table.where(F.col("view") == v)
        one = full.where(F.col("view") == v).orderBy("ord").select("id", condition_from_path(F.col("id")).alias("condition"), "y_true", "y_pred", *[f"p_{c}" for c in names])
        writers.write_csv(one, f"{folder}/preds_multiclass.csv")
        writers.write_csv(R.confusion_matrix(own, names).drop("view").orderBy("true"), f"{folder}/cm_multiclass.csv")
        writers.write_csv(R.classification_views(own, names, train.select("ord").distinct().count(), knn_k, metric, vote, standardize_features, per_channel), f"{folder}/metrics_multiclass.csv")
        writers.write_json(R.classification_views(own, names, train.select("ord").distinct().count(), knn_k, metric, vote, standardize_features, per_channel), f"{folder}/metrics.json")
    writers.write_csv(unseen, f"{outdir}/unseen_test_samples.csv")
    if inspect_labels:
        found = C.inspect_neighbours(hits, preds, known.select("ord", "id", "label").distinct(), view, csv_options(inspect_labels), inspect_mode, max(1, min(inspect_topk or knn_k, knn_k)))
        tail = f"{'_'.join(csv_options(inspect_labels))}__{view}.csv"
        writers.write_csv(found, f"{outdir}/inspect_neighbors_{tail}")
        writers.write_csv(C.hit_counts(found).orderBy(F.desc("hit_count"), "train_id"), f"{outdir}/inspect_train_hit_counts_{tail}")


JOBS = {"make-index": make_index, "extract-features": extract_features, "split-fd": split_fd, "split-fc": split_fc, "detect": detect, "classify": classify}


def parser() -> argparse.ArgumentParser:
    """One subcommand for each job; its options are the function's parameters, and flags take no value."""
    top = argparse.ArgumentParser(prog="siftwave.jobs", description=__doc__.splitlines()[0])
    sub = top.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        own = sub.add_parser(name, help=job.__doc__.splitlines()[0], description=job.__doc__)
        for p in list(inspect.signature(job).parameters.values())[1:]:
            option = "--" + p.name.replace("_", "-")
            if p.default is inspect.Parameter.empty:
                own.add_argument(option, required=True)
            elif isinstance(p.default, bool):
                own.add_argument(option, default=p.default, action=argparse.BooleanOptionalAction)
            else:
                own.add_argument(option, default=p.default, type=type(p.default))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    options = vars(parser().parse_args(argv))
    spark = spark or SparkSession.builder.appName("siftwave").getOrCreate()
    JOBS[options.pop("job")](spark, **options)


if __name__ == "__main__":
    main()
