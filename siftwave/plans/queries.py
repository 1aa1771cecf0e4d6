"""Registered queries over the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwave.functions import paths as P
from siftwave.model import VIEWS, channel_dims, views_table
from siftwave.operators import classification as C
from siftwave.operators import detection as D
from siftwave.operators import evaluation as E
from siftwave.operators import halo as H
from siftwave.operators import reports as R
from siftwave.operators import signals as S
from siftwave.operators import splits as X
from siftwave.operators.encoders import Encoder
from siftwave.operators.matching import drop_unlabelled, match_ids, missing_ids, missing_report
from siftwave.operators.metric_index import MetricIndex
from siftwave.operators.neighbours import merge_moments, nearest, scaler_moments, scaler_stats, standardize, stats_of
from siftwave.operators.rank_index import RankIndex
from siftwave.plans.data import cell_features, column_features, concat_features, list_features, samples
from siftwave.sources.readers import build_index, first_samples, is_monotone
from siftwave.streaming.scoring import drift_of, grow, prepare, score_batch
from siftwave.tables import stored

K = 11
CLEAN = "heavy-clean,med-clean,light-clean"


def _r(c, digits: int = 6):
    """Rounded, with -0.0 as 0.0."""
    return F.round(c, digits) + F.lit(0.0)


# -- ids and paths


def parse_ids(patterns):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("id"))
        ids = samples(spark, sf_dir).select("id").unionByName(urls)
        return ids.select("id", *[c.alias(n) for n, c in P.parse_id(F.col("id"), patterns).items()])

    return query


def fault_condition(spark, sf_dir):
    ids = samples(spark, sf_dir).select(F.concat(F.lit("/data//./"), "id").alias("id"))
    ids = ids.unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("id")))
    return ids.select("id", P.fault_from_path(F.col("id")).alias("fault"), P.condition_from_path(F.col("id")).alias("condition"))


def id_suffixes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", P.id_suffix(F.col("url")).alias("suffix"))


def _tree(spark, sf_dir):
    """Paths of a dataset tree for the samples."""
    s = samples(spark, sf_dir).select("ord", "id")
    folder, idx = F.regexp_extract("id", "^(.*)_([0-9]+)$", 1), F.regexp_extract("id", "^(.*)_([0-9]+)$", 2)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(e).alias("e")) for k, e in (("audio", "wav"), ("ios", "mp4"), ("android", "mp4"), ("vibration", "csv"))]))
    files = s.select("ord", folder.alias("f"), idx.alias("i"), kinds.alias("m"))
    return files.select(F.concat(F.lit("/data/"), "f", F.lit("/"), "m.k", F.lit("/"), "m.k", F.lit("_part_"), "i", F.lit("."), "m.e").alias("path"))


def index_build(spark, sf_dir):
    return build_index(_tree(spark, sf_dir))


def index_paths_decode(spark, sf_dir):
    decoded = build_index(_tree(spark, sf_dir)).select("id", F.posexplode(P.decode_paths(F.col("paths"))).alias("channel", "p"))
    bare, col = P.split_channel(F.col("p"))
    return decoded.select("id", "channel", bare.alias("path"), col.alias("col"), P.extension(bare).alias("ext"))


# -- features


def channel_blocks(spark, sf_dir):
    return concat_features(samples(spark, sf_dir)).select("ord", "channel", F.size("vec").alias("dim"), _r(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def channel_dims_check(spark, sf_dir):
    return channel_dims(list_features(samples(spark, sf_dir)))


# -- splits


def split_fd(spec):
    return lambda spark, sf_dir: X.split_detection(samples(spark, sf_dir), "100", spec).select("id", "part")


def split_fd_counts(spark, sf_dir):
    return X.detection_counts(X.split_detection(samples(spark, sf_dir), "100", CLEAN))


def split_fd_missing(spark, sf_dir):
    return X.missing_combos(samples(spark, sf_dir), "110", "all")


def _fc(spark, sf_dir, **options):
    return X.split_classification(samples(spark, sf_dir), "100", **options)


def split_fc(**options):
    return lambda spark, sf_dir: _fc(spark, sf_dir, **options).select("id", "part")


def split_fc_dist(spark, sf_dir):
    return X.distribution(_fc(spark, sf_dir))


def split_fc_meta_counts(spark, sf_dir):
    return X.split_counts(_fc(spark, sf_dir))


# -- neighbours


def _fd_sides(spark, sf_dir, features=concat_features):
    split = X.split_detection(samples(spark, sf_dir), "100", CLEAN)
    f = features(split.select("ord", "x", "part"))
    return f.where("part = 'train'"), f.where("part != 'train'"), split


def scaler(spark, sf_dir):
    return scaler_stats(_fd_sides(spark, sf_dir)[0]).select("channel", "pos", _r("mu").alias("mu"), _r("sd").alias("sd"))


def standardized(spark, sf_dir):
    train, test, _ = _fd_sides(spark, sf_dir)
    return standardize(test, scaler_stats(train)).select("ord", "channel", F.posexplode("vec").alias("pos", "x")).withColumn("x", _r("x"))


def knn(metric, own=False):
    def query(spark, sf_dir):
        train, test, _ = _fd_sides(spark, sf_dir)
        n = nearest(train, train, K, metric, skip_first=True) if own else nearest(test, train, K, metric)
        return n.select("channel", "ord", "rank", "train_ord", _r("dist").alias("dist"))

    return query


def knn_pruned(metric, own=False):
    """The same rows by an index that measures only what its bounds leave."""

    def query(spark, sf_dir):
        train, test, _ = _fd_sides(spark, sf_dir)
        n = MetricIndex(train, metric).nearest(train if own else test, K, skip_first=own)
        return n.select("channel", "ord", "rank", "train_ord", _r("dist").alias("dist"))

    return query


# -- detection


def _fd_normalized(spark, sf_dir, how="quantile", features=concat_features):
    train, test, split = _fd_sides(spark, sf_dir, features)
    return D.normalize(D.channel_scores(train, test, K), how), split


def fd_channel_scores(how):
    return lambda spark, sf_dir: _fd_normalized(spark, sf_dir, how)[0].select("channel", "ord", _r("raw").alias("raw"), _r("score").alias("score"))


def _scored(spark, sf_dir, features=concat_features):
    scores, split = _fd_normalized(spark, sf_dir, "quantile", features)
    y = split.where("part != 'train'").select("ord", "id", F.when(F.col("normal"), 0).otherwise(1).alias("y_true"))
    return stored(D.fuse_scores(scores, list(VIEWS)).join(y, "ord"), "scored")


def fd_fused_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("view", "id", "y_true", _r("score").alias("score"))


def fd_per_channel_pivot(spark, sf_dir):
    scores, _ = _fd_normalized(spark, sf_dir)
    t = D.per_channel_table(scores, "vibration")
    return t.select("ord", *[_r(c).alias(c) for c in t.columns[1:]])


def fd_auroc(features):
    return lambda spark, sf_dir: E.auroc(_scored(spark, sf_dir, features)).select("view", _r("auroc").alias("auroc"), "n_test", "n_pos")


def fd_roc_curve(spark, sf_dir):
    finite = F.when(F.col("thr") < float("inf"), _r("thr"))
    return E.roc_curve(_scored(spark, sf_dir)).select("view", "place", _r("fpr").alias("fpr"), _r("tpr").alias("tpr"), finite.alias("thr"))


def fd_threshold(mode, target=None):
    def query(spark, sf_dir):
        scored = _scored(spark, sf_dir)
        m = E.binary_metrics(scored, E.pick_threshold(scored, mode, target))
        return m.select("view", *[_r(c).alias(c) for c in ("thr", "acc", "precision", "recall", "f1")], "tn", "fp", "fn", "tp")

    return query


# -- classification


def _fc_sides(spark, sf_dir):
    split = _fc(spark, sf_dir)
    f = concat_features(split.select("ord", "id", "label", "x", "part"))
    train, test = f.where("part = 'train'"), f.where("part != 'train'")
    stats = stored(scaler_stats(train), "stats")
    named = stored(standardize(train, stats).select("channel", "ord", "vec", F.col("id").alias("train_id"), F.col("label").alias("train_label")), "train")
    asked = stored(standardize(test, stats).select("channel", "ord", "vec"), "test")
    return stored(nearest(asked, named, K, carry=("train_id", "train_label")), "neighbours"), split


def fc_probs(vote):
    def query(spark, sf_dir):
        n, _ = _fc_sides(spark, sf_dir)
        return C.channel_probabilities(n, vote).select("channel", "ord", "train_label", _r("p").alias("p"))

    return query


def _fc_preds(spark, sf_dir):
    n, split = _fc_sides(spark, sf_dir)
    preds = stored(C.predictions(C.view_probabilities(C.channel_probabilities(n), list(VIEWS))), "predictions")
    test = split.where("part != 'train'").select("ord", "id", "label")
    return n, preds, test, C.class_table(split.where("part = 'train'"))


def fc_preds_views(spark, sf_dir):
    _, preds, test, _ = _fc_preds(spark, sf_dir)
    return preds.join(test, "ord").select("view", "id", P.condition_from_path(F.col("id")).alias("condition"), F.col("label").alias("y_true"), "y_pred", _r("p").alias("p"))


def _fc_confusion(spark, sf_dir):
    _, preds, test, classes = _fc_preds(spark, sf_dir)
    return E.confusion(preds.join(test.withColumnRenamed("label", "y_true"), "ord"), E.class_names(classes))


def fc_confusion(spark, sf_dir):
    return _fc_confusion(spark, sf_dir)


def fc_metrics_views(spark, sf_dir):
    m = E.multiclass_metrics(_fc_confusion(spark, sf_dir))
    return m.select("view", *[_r(c).alias(c) for c in ("raw_acc", "balanced_acc", "macro_f1")], "n_test_eval")


def fc_per_class_f1(spark, sf_dir):
    r = E.class_report(_fc_confusion(spark, sf_dir))
    return r.select("view", "label", "support", "predicted", *[_r(c).alias(c) for c in ("precision", "recall", "f1")])


def fc_unseen_samples(spark, sf_dir):
    split = _fc(spark, sf_dir)
    train, test = (split.where(side).withColumn("label", F.concat("label", F.lit("/"), "vel")) for side in ("part = 'train'", "part != 'train'"))
    return C.unseen(test, C.class_table(train))


def _inspected(spark, sf_dir):
    n, preds, test, _ = _fc_preds(spark, sf_dir)
    return C.inspect_neighbours(n, preds, test, "fused", ("dry", "lean"), "wrong", 3)


def fc_inspect_neighbors(spark, sf_dir):
    return _inspected(spark, sf_dir).withColumn("distance", _r("distance"))


def fc_hit_counts(spark, sf_dir):
    return C.hit_counts(_inspected(spark, sf_dir))


# -- signals


def _series(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).alias("pos"), F.col("value").alias("x"))


def signal_dc_removed(spark, sf_dir):
    return S.remove_dc(_series(spark, sf_dir)).select("key", "pos", _r("x", 10).alias("x"))


def signal_window_pool(spark, sf_dir):
    return S.pool_windows(S.windows(_series(spark, sf_dir), 8)).select("key", "win", "n", _r("mean").alias("mean"), _r("rms").alias("rms"))


def signal_framed(spark, sf_dir):
    """Every user's events in frames of 6 every 4, cut from blocks of 8 with their neighbours' edges."""
    frames = H.framed(H.blocks_of_series(_series(spark, sf_dir), 8), 6, 4, 8)
    return frames.select("key", "frame", F.posexplode("samples").alias("at", "x")).withColumn("x", _r("x"))


def signal_resampled(spark, sf_dir):
    """Every user's events at two thirds of their rate, filtered in blocks."""
    blocks = H.resampled(H.blocks_of_series(_series(spark, sf_dir), 8), 3, 2, 12)
    return blocks.select("key", "start", F.posexplode("samples").alias("at", "x")).select("key", (F.col("start") + F.col("at")).alias("pos"), _r("x").alias("x"))


def multichannel(how):
    def query(spark, sf_dir):
        v = S.combine_channels(concat_features(samples(spark, sf_dir)).select("ord", "channel", "vec"), how)
        return v.select("ord", F.posexplode("vec").alias("pos", "x")).withColumn("x", _r("x"))

    return query


class Moments(Encoder):
    """Mean, root mean square, largest and smallest value."""

    dim = 4

    def encode(self, signal, rate):
        return np.array([signal.mean(), np.sqrt((signal**2).mean()), signal.max(), signal.min()])


def encoder_host(spark, sf_dir):
    """Every user's events as a series, in windows of 8 that an encoder turns into moments, averaged."""
    v = S.encode_series(_series(spark, sf_dir), Moments, 8, 1000)
    return v.select("key", F.posexplode("vec").alias("pos", "x"), "error").withColumn("x", _r("x"))


# -- id lists


def _lists(spark, sf_dir):
    """Features under their samples' ids, some twice (the later one counts), and a list with repeated and unknown ids."""
    s = samples(spark, sf_dir).select("ord", "id", "x")
    again = s.select((F.col("ord") + 1_000_000).alias("ord"), "id", F.transform("x", lambda v: -v).alias("x")).where("id LIKE '%heavy%'")
    listed = s.select((F.col("ord") * 3).alias("ord"), "id")
    listed = listed.unionByName(listed.where("id LIKE '%vel80%'").withColumn("ord", F.col("ord") + 1)).unionByName(s.select((F.col("ord") * 3 + 2).alias("ord"), F.concat(F.lit("gone/"), "id").alias("id")))
    return listed, concat_features(s.unionByName(again))


def ids_match(spark, sf_dir):
    listed, features = _lists(spark, sf_dir)
    return match_ids(listed, features).select("ord", "id", "source_ord", "channel", _r(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def ids_missing(spark, sf_dir):
    listed, features = _lists(spark, sf_dir)
    return missing_ids(listed, features)


def ids_missing_report(spark, sf_dir):
    r = missing_report(*_lists(spark, sf_dir))
    return r.select("n_missing", F.array_join("first_ids", ",").alias("first_ids"))


def labels_dropped(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("id"))
    ids = samples(spark, sf_dir).select("id").unionByName(urls)
    return drop_unlabelled(ids.withColumn("label", P.fault_from_path(F.col("id"))))[1]


def list_dims(layout):
    """Vectors of another layout with the sums of their numbers."""
    return lambda spark, sf_dir: layout(samples(spark, sf_dir)).select("ord", "channel", F.size("vec").alias("dim"), _r(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"))


def monotone_events(spark, sf_dir):
    return is_monotone(_series(spark, sf_dir))


def first_events(spark, sf_dir):
    return first_samples(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"), "event_type"), 100)


def channel_defaults(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(P.default_paths(F.concat(F.lit("/d/"), F.col("page_id") % 7, F.lit("/")), F.concat(F.lit("s"), "page_id"))).alias("channel", "path"))


# -- result tables


def fd_compare_views(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    train = _fd_sides(spark, sf_dir)[0]
    v = R.detection_views(E.auroc(scored), train.select("ord").distinct().count())
    return v.withColumn("AUROC", _r("AUROC"))


def fc_compare_views(spark, sf_dir):
    _, preds, test, classes = _fc_preds(spark, sf_dir)
    names = E.class_names(classes)
    table = stored(E.confusion(preds.join(test.withColumnRenamed("label", "y_true"), "ord"), names), "confusion")
    v = R.classification_views(table, names, _fc(spark, sf_dir).where("part = 'train'").count())
    return v.select(*[_r(c).alias(c) if c in ("raw_acc", "balanced_acc", "macro_f1") or c.startswith("F1_") else F.col(c) for c in v.columns])


def fc_class_probabilities(spark, sf_dir):
    n, split = _fc_sides(spark, sf_dir)
    probs = stored(C.view_probabilities(C.channel_probabilities(n), list(VIEWS)), "probabilities")
    names = E.class_names(C.class_table(split.where("part = 'train'")))
    p = R.class_probabilities(C.predictions(probs).drop("p"), probs, names)
    return p.select("view", "ord", "y_pred", *[_r(f"p_{c}").alias(f"p_{c}") for c in names])


def fc_confusion_matrix(spark, sf_dir):
    _, preds, test, classes = _fc_preds(spark, sf_dir)
    names = E.class_names(classes)
    return R.confusion_matrix(E.confusion(preds.join(test.withColumnRenamed("label", "y_true"), "ord"), names), names)


def split_fc_meta(spark, sf_dir):
    hard = {"hard_labels": ("dry", "lean"), "hard_vels": ("80", "90")}
    m = R.split_meta(_fc(spark, sf_dir, **hard), **hard)
    return m.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in m.dtypes])


def arrivals(spark, sf_dir):
    """The test side scored as one micro-batch against a prepared training side."""
    train, test, _ = _fd_sides(spark, sf_dir)
    return score_batch(test.select("channel", "ord", "vec"), prepare(train.select("channel", "ord", "vec"), K), list(VIEWS)).withColumn("score", _r("score"))


def arrivals_grown(spark, sf_dir):
    """The same after the training set of two velocities has grown by the rest, under the scaler of the first."""
    train, test, split = _fd_sides(spark, sf_dir)
    first = train.join(split.where("vel IN ('80', '90')").select("ord"), "ord", "left_semi").select("channel", "ord", "vec")
    rest = train.join(first.select("ord").distinct(), "ord", "left_anti").select("channel", "ord", "vec")
    return score_batch(test.select("channel", "ord", "vec"), grow(prepare(first, K), rest), list(VIEWS)).withColumn("score", _r("score"))


def stored_ranks(spark, sf_dir):
    """The rank of every customer's balance among the stored balances of the suppliers of its nation."""
    held = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("channel"), F.col("s_acctbal").alias("raw"))
    asked = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_nationkey").alias("channel"), F.col("c_acctbal").alias("raw"))
    return RankIndex(held, run=8).ranked(asked).select("c_custkey", "n_upto", "n_stored")


def scaler_drift(spark, sf_dir):
    """How far the scaler of two velocities lies from that of the whole training side, by merged moments."""
    train, _, split = _fd_sides(spark, sf_dir)
    early = split.where("vel IN ('80', '90')").select("ord")
    first, rest = (scaler_moments(train.join(early, "ord", how)) for how in ("left_semi", "left_anti"))
    d = drift_of(stats_of(first), merge_moments(first, rest))
    return d.select("channel", _r("shift").alias("shift"), _r("stretch").alias("stretch"))


def views(spark, sf_dir):
    """The channels of each view, with their vectors counted and summed up."""
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    by_channel = concat_features(samples(spark, sf_dir)).groupBy("channel").agg(F.count(F.lit(1)).alias("n_vectors"), _r(F.avg(total)).alias("mean_total"))
    return views_table(spark).join(by_channel, "channel").select("view", "channel", "place", "n_channels", "n_vectors", "mean_total")


def queries() -> dict:
    return {
        "parse_ids_fd": parse_ids(P.DETECTION_ID),
        "parse_ids_fc": parse_ids(P.CLASSIFICATION_ID),
        "fault_condition_from_path": fault_condition,
        "id_suffix_normalize": id_suffixes,
        "index_build": index_build,
        "index_paths_decode": index_paths_decode,
        "channel_blocks_concat": channel_blocks,
        "channel_dims_check": channel_dims_check,
        "split_fd_all": split_fd("all"),
        "split_fd_none": split_fd("none"),
        "split_fd_subset": split_fd(CLEAN),
        "split_fd_missing_combos": split_fd_missing,
        "split_fd_counts": split_fd_counts,
        "split_fc_base": split_fc(),
        "split_fc_exclude_noise": split_fc(exclude_noise=True),
        "split_fc_exclude_load": split_fc(exclude_loads=("heavy",)),
        "split_fc_hard": split_fc(hard_labels=("dry", "lean"), hard_vels=("80", "90")),
        "split_fc_mt19937": split_fc(shuffle="mt19937"),
        "split_fc_dist": split_fc_dist,
        "split_fc_meta_counts": split_fc_meta_counts,
        "scaler_stats": scaler,
        "standardized_features": standardized,
        "knn_l2": knn("l2"),
        "knn_cosine": knn("cosine"),
        "knn_self_excluded": knn("l2", own=True),
        "knn_pruned_l2": knn_pruned("l2"),
        "knn_pruned_cosine": knn_pruned("cosine"),
        "knn_pruned_self_excluded": knn_pruned("l2", own=True),
        "fd_channel_scores_quantile": fd_channel_scores("quantile"),
        "fd_channel_scores_zscore": fd_channel_scores("zscore"),
        "fd_fused_scores": fd_fused_scores,
        "fd_per_channel_pivot": fd_per_channel_pivot,
        "fd_auroc_views": fd_auroc(concat_features),
        "fd_auroc_views_lists": fd_auroc(list_features),
        "fd_roc_curve": fd_roc_curve,
        "fd_threshold_youden": fd_threshold("youden"),
        "fd_threshold_fpr_at": fd_threshold("fpr_at", 0.1),
        "fd_threshold_percentile": fd_threshold("percentile", 0.5),
        "fd_threshold_score": fd_threshold("score", 0.6),
        "fc_probs_hard": fc_probs("hard"),
        "fc_probs_weighted": fc_probs("weighted"),
        "fc_preds_views": fc_preds_views,
        "fc_confusion": fc_confusion,
        "fc_metrics_views": fc_metrics_views,
        "fc_per_class_f1": fc_per_class_f1,
        "fc_unseen_samples": fc_unseen_samples,
        "fc_inspect_neighbors": fc_inspect_neighbors,
        "fc_hit_counts": fc_hit_counts,
        "signal_dc_removed": signal_dc_removed,
        "signal_window_pool": signal_window_pool,
        "signal_framed": signal_framed,
        "signal_resampled": signal_resampled,
        **{f"multichannel_{how}": multichannel(how) for how in ("concatenate", "average", "first", "last")},
        "encoder_host": encoder_host,
        "ids_match": ids_match,
        "ids_missing": ids_missing,
        "ids_missing_report": ids_missing_report,
        "labels_dropped": labels_dropped,
        "channels_of_columns": list_dims(column_features),
        "channels_of_cells": list_dims(cell_features),
        "monotone_events": monotone_events,
        "first_events": first_events,
        "channel_defaults": channel_defaults,
        "fd_compare_views": fd_compare_views,
        "fc_compare_views": fc_compare_views,
        "fc_class_probabilities": fc_class_probabilities,
        "fc_confusion_matrix": fc_confusion_matrix,
        "split_fc_meta": split_fc_meta,
        "score_arrivals": arrivals,
        "score_arrivals_grown": arrivals_grown,
        "stored_ranks": stored_ranks,
        "scaler_drift": scaler_drift,
        "views": views,
    }
