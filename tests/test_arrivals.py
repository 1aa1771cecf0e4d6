"""Ranks among stored scores, and training sets that grow."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F


from siftwave.operators import detection as D
from siftwave.operators import rank_index as R
from siftwave.operators.neighbours import merge_moments, scaler_moments, scaler_stats, standardize, stats_of
from siftwave.streaming.scoring import drift, grow, prepare, score_batch

SCHEMA = "channel int, ord long, vec array<double>"


def features(spark, x, first=0, channels=(0, 1, 2)):
    return spark.createDataFrame([(c, first + i, (v + c).tolist()) for c in channels for i, v in enumerate(x)], SCHEMA)


@pytest.mark.parametrize("run", [7, 4096])
def test_ranks_are_those_of_sorting_again(spark, run):
    rng = np.random.default_rng(run)
    held = {0: rng.integers(0, 20, 300).astype(float), 1: rng.normal(size=250), 3: np.zeros(100), 4: np.array([5.0])}
    asked = [(c, i, float(v)) for c in range(5) for i, v in enumerate([*rng.integers(-2, 22, 30), *rng.normal(size=20), 0.0, 5.0, -1e300, float("inf")])]
    index = R.RankIndex(spark.createDataFrame([(c, float(v)) for c, x in held.items() for v in x] + [(0, None)], "channel int, raw double"), run)
    got = {(r["channel"], r["ord"]): (r["n_upto"], r["n_stored"]) for r in index.ranked(spark.createDataFrame(asked + [(0, 999, None)], "channel int, ord long, raw double")).collect()}
    assert got == {(c, i): (int((held[c] <= v).sum()), len(held[c])) for c, i, v in asked if c in held}


def test_a_lookup_halves_its_run(spark):
    """A run's numbers are not compared one by one, and every place of runs of any length is found."""
    for n in (1, 2, 7, 8, 4096):
        rows = spark.range(2 * n + 1).select((F.col("id") - 0.5).alias("raw")).withColumn("numbers", F.sequence(F.lit(0), F.lit(2 * n - 2), F.lit(2)).cast("array<double>"))
        got = rows.select("raw", R.upto("numbers", "raw", n).alias("n")).collect()
        assert [r["n"] for r in got] == [int((np.arange(0, 2 * n, 2) <= r["raw"]).sum()) for r in got]
    index = R.RankIndex(spark.range(5000).select(F.lit(0).alias("channel"), F.col("id").cast("double").alias("raw")))
    assert index.longest == 4096
    looked = index.ranked(spark.createDataFrame([(0, 77.5)], "channel int, raw double"))
    assert looked.collect() == [(0, 77.5, 78, 5000)] and "filter(numbers" not in looked._jdf.queryExecution().optimizedPlan().toString()


def test_no_stored_scores(spark):
    index = R.RankIndex(spark.createDataFrame([], "channel int, raw double"))
    assert index.ranked(spark.createDataFrame([(0, 1.0)], "channel int, raw double")).collect() == []


def test_a_lookup_reads_only_the_runs_of_its_rows(spark):
    index = R.RankIndex(spark.range(20_000).select((F.col("id") % 2).cast("int").alias("channel"), F.col("id").cast("double").alias("raw")), 100)
    rows = spark.createDataFrame([(0, 5000.5), (1, 17_777.0), (0, 5001.0)], "channel int, raw double")
    want = sorted(map(tuple, index.ranked(rows).collect()))
    kept = {f"{index.folder}/channel={c}/slot={s}" for c, s in ((0, 25), (1, 88))}
    plan = index.runs(spark.createDataFrame([(0, 25), (1, 88)], "channel int, slot int"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "25" in plan[plan.index("PartitionFilters") :]
    for folder in {f.rsplit("/", 1)[0].removeprefix("file://") for f in index.runs().inputFiles()} - kept:
        shutil.rmtree(folder)  # nothing else is needed
    assert sorted(map(tuple, index.ranked(rows).collect())) == want == [(0, 5000.5, 2501, 10_000), (0, 5001.0, 2501, 10_000), (1, 17_777.0, 8889, 10_000)]


def test_batches_are_scored_as_by_sorting_all_scores(spark):
    rng = np.random.default_rng(1)
    train, new = features(spark, rng.normal(size=(60, 3))), features(spark, rng.normal(size=(20, 3)) * 2, 1000)
    ready = prepare(train, k=5)
    raw = D.tested_scores(ready.train, standardize(new, ready.stats), 5)
    both = ready.own.select("channel", "ord", "raw", F.lit(True).alias("is_train")).unionByName(raw.withColumn("is_train", F.lit(False)))
    want = D.fuse_scores(D.normalize_quantile(both), ["audio"])
    assert sorted(map(tuple, score_batch(new, ready, ["audio"]).collect())) == sorted(map(tuple, want.collect()))


def own_scores(ready):
    return {(r["channel"], r["ord"]): (r["near"], r["raw"]) for r in ready.own.collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_grown_set_is_one_prepared_at_once(spark, metric):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(50, 4)), rng.normal(size=(20, 4)) + 8])
    x[60], x[61], x[65] = x[3], x[3], x[62]  # copies of older and of new ones
    old, more, rest = features(spark, x[:50]), features(spark, x[50:62], 50), features(spark, x[62:], 62)
    ready = prepare(old, 5, metric)
    grown = grow(grow(ready, more), rest)
    whole = prepare(features(spark, x), 5, metric, stats=ready.stats)
    got, want = own_scores(grown), own_scores(whole)
    assert got == want and grown.version == 2 and len(got) == 210
    before = own_scores(ready)
    first = grow(ready, more)
    moved = {k for k, v in before.items() if own_scores(first)[k] != v}
    assert first.recomputed == len(moved) and 0 < len(moved) < 150
    asked = features(spark, rng.normal(size=(9, 4)), 900)
    assert sorted(map(tuple, score_batch(asked, grown, ["audio"]).collect())) == sorted(map(tuple, score_batch(asked, whole, ["audio"]).collect()))


def test_growing_from_one_vector_and_places_that_are_taken(spark):
    x = np.arange(12.0).reshape(4, 3)
    ready = prepare(features(spark, x[:1]), 2)
    assert ready.own.count() == 0
    assert own_scores(grow(ready, features(spark, x[1:], 1))) == own_scores(prepare(features(spark, x), 2, stats=ready.stats))
    for added in (features(spark, x[:1]), features(spark, x[:1], 7).unionByName(features(spark, x[1:2], 7))):
        with pytest.raises(ValueError, match="places"):
            grow(ready, added)


def test_moments_merge_and_drift(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(3, 2, (80, 4))
    x[:, 3] = 1
    parts = [features(spark, x[:30]), features(spark, x[30:], 30), features(spark, x[:5], channels=(9,))]
    merged = scaler_moments(parts[0])
    for p in parts[1:]:
        merged = merge_moments(merged, scaler_moments(p))
    got = {(r["channel"], r["pos"]): (r["mu"], r["sd"]) for r in stats_of(merged).collect()}
    want = {(r["channel"], r["pos"]): (r["mu"], r["sd"]) for r in scaler_stats(features(spark, x).unionByName(parts[2])).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
    ready = prepare(parts[0], 3)
    assert all(r["shift"] < 1e-12 and abs(r["stretch"] - 1) < 1e-12 for r in drift(ready).collect())
    far = drift(grow(ready, features(spark, x[:30] + 40, 500))).first()
    assert far["shift"] > 5 and far["stretch"] > 5
