"""Arriving samples scored against a training set that was prepared once, and training sets that grow."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwave.operators.detection import _mean_distance, clipped_share, fuse_scores, mean_of, tested_scores, train_neighbours
from siftwave.operators.metric_index import nearest_any
from siftwave.operators.neighbours import merge_moments, scaler_moments, standardize, stats_of
from siftwave.operators.rank_index import RankIndex
from siftwave.tables import stored


@dataclass(frozen=True)
class Prepared:
    """Stored tables of a training set: what scales it, its scaled vectors, their own distances and scores, and the ranks of these.

    stats are those of the first `prepare` and stay as they are while the set grows: another scale
    would move all distances. moments are those of all vectors so far, for `drift`. version counts
    the growths, recomputed the older vectors whose score the last one changed.
    """

    stats: DataFrame
    moments: DataFrame
    train: DataFrame
    own: DataFrame
    ranks: RankIndex
    k: int
    metric: str
    version: int = 0
    recomputed: int = 0


def prepare(train: DataFrame, k: int = 11, metric: str = "l2", stats: DataFrame | None = None) -> Prepared:
    """What scoring needs of long training features; made once, before the stream starts. stats: a scaler to use instead of the features' own."""
    moments = stored(scaler_moments(train), "moments")
    stats = stored(stats_of(moments) if stats is None else stats, "stats")
    scaled = stored(standardize(train, stats).select("channel", "ord", "vec"), "train")
    own = stored(train_neighbours(scaled, k, metric), "own")
    return Prepared(stats, moments, scaled, own, RankIndex(own), k, metric)


def grow(ready: Prepared, added: DataFrame) -> Prepared:
    """The training set with further long features, under the same scaler.

    New vectors get their neighbours among all. Of the older ones, those change for which a new
    vector is nearer than their k-th neighbour; their distances are merged from what is stored, so
    no older vector is compared with another. The scores are those of a `prepare` of all with these
    stats. A place (channel, ord) that is already taken, or twice in added, is an error.
    """
    new = stored(standardize(added, ready.stats).select("channel", "ord", "vec"), "train")
    taken = new.join(ready.train.select("channel", "ord"), ["channel", "ord"], "left_semi")
    if not taken.isEmpty() or not new.groupBy("channel", "ord").count().where("count > 1").isEmpty():
        raise ValueError("added samples need places (ord) of their own")
    train = ready.train.unionByName(new)
    fresh = _mean_distance(nearest_any(new, train, ready.k, ready.metric, skip_first=True))
    reach = F.when(F.size("near") < ready.k, float("inf")).otherwise(F.element_at("near", -1))
    nearer = nearest_any(ready.train, new, ready.k, ready.metric).join(ready.own.select("channel", "ord", "near", reach.alias("reach")), ["channel", "ord"]).where("dist < reach")
    merged = F.slice(F.sort_array(F.concat(F.first("near"), F.collect_list("dist"))), 1, ready.k)
    changed = stored(nearer.groupBy("channel", "ord").agg(merged.alias("near")).withColumn("raw", mean_of("near")), "changed")
    # A training set of one vector had no neighbour, and so no row of its own.
    lonely = ready.train.select("channel", "ord").join(ready.own.select("channel", "ord"), ["channel", "ord"], "left_anti")
    first = nearest_any(ready.train.join(lonely, ["channel", "ord"], "left_semi"), new, ready.k, ready.metric)
    kept = ready.own.join(changed.select("channel", "ord"), ["channel", "ord"], "left_anti")
    own = stored(kept.unionByName(changed).unionByName(fresh).unionByName(_mean_distance(first)), "own")
    moments = stored(merge_moments(ready.moments, scaler_moments(added)), "moments")
    return replace(ready, moments=moments, train=train, own=own, ranks=RankIndex(own), version=ready.version + 1, recomputed=changed.count())


def drift(ready: Prepared) -> DataFrame:
    """channel, shift, stretch: how far the means of all vectors so far lie from the scaler's in its deviations, and the largest ratio of deviations; at most over positions.

    A large one says when to prepare anew.
    """
    return drift_of(ready.stats, ready.moments)


def drift_of(stats: DataFrame, moments: DataFrame) -> DataFrame:
    """drift of a scaler from the moments of other vectors."""
    now = stats_of(moments).select("channel", "pos", F.col("mu").alias("mu_now"), F.col("sd").alias("sd_now"))
    ratio = F.greatest(F.col("sd_now") / F.col("sd"), F.col("sd") / F.col("sd_now"))
    return stats.join(now, ["channel", "pos"]).groupBy("channel").agg(F.max(F.abs(F.col("mu_now") - F.col("mu")) / F.col("sd")).alias("shift"), F.max(ratio).alias("stretch"))


def score_batch(arrived: DataFrame, prepared: Prepared, views=("fused",)) -> DataFrame:
    """view, ord, score of long features. A sample's score depends on the training set and itself alone, not on its batch.

    Training scores stay where they are: only the runs in which the batch's scores fall are read.
    """
    new = tested_scores(prepared.train, standardize(arrived, prepared.stats).select("channel", "ord", "vec"), prepared.k, prepared.metric)
    ranked = prepared.ranks.ranked(new)
    return fuse_scores(ranked.select("channel", "ord", "raw", clipped_share(F.col("n_upto"), F.col("n_stored")).alias("score")), views)


def score_arrivals(arrivals: DataFrame, prepared: Prepared, sink: str, checkpoint: str, views=("fused",)) -> StreamingQuery:
    """Each micro-batch of long features is scored and written as its own folder of the Parquet table `sink`.

    The folder is named by the batch's number and is overwritten, so a batch that is repeated after
    a failure leaves its rows once. Scores are shares of training scores; z-scores, which would
    depend on the batch, are not offered here.
    """

    def score(batch: DataFrame, number: int) -> None:
        score_batch(batch, prepared, views).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return arrivals.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
