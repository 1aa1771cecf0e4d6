"""Small fixtures with known answers for the recordings side."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.functions import paths as P
from siftwave.model import resolve_views
from siftwave.operators import classification as C
from siftwave.operators import evaluation as E
from siftwave.operators import neighbours
from siftwave.operators import signals as S
from siftwave.operators import splits as X
from siftwave.operators.detection import normalize
from siftwave.operators.encoders import LogSpectrum
from siftwave.operators.neighbours import nearest, scaler_stats, standardize

LONG = "channel int, ord long, vec array<double>"


def scored(spark, values):
    return spark.createDataFrame([("v", float(s), y) for s, y in values], "view string, score double, y_true int")


def test_scaler_uses_population_deviation_and_keeps_constants(spark):
    train = spark.createDataFrame([(0, 0, [1.0, 7.0]), (0, 1, [3.0, 7.0])], LONG)
    stats = {r["pos"]: (r["mu"], r["sd"]) for r in scaler_stats(train).collect()}
    assert stats == {0: (2.0, 1.0), 1: (7.0, 1.0)}
    test = spark.createDataFrame([(0, 9, [2.0, 9.0])], LONG)
    assert standardize(test, scaler_stats(train)).first()["vec"] == [0.0, 2.0]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_equals_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3)).round(1)
    x[7] = x[3]
    frame = spark.createDataFrame([(c, i, x[i].tolist()) for c in (0, 1) for i in range(40)], LONG)
    got = {(r["channel"], r["ord"], r["rank"]): (r["train_ord"], r["dist"]) for r in nearest(frame, frame, 5, metric).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "l2" else 1 - unit @ unit.T
    for c in (0, 1):
        for i in range(40):
            assert np.allclose([got[c, i, r][1] for r in range(1, 6)], np.sort(d[i])[:5])
    if metric == "l2":
        assert got[0, 7, 1][0] == 3


def test_self_exclusion_drops_the_nearest_hit_and_k_may_exceed_the_rows(spark):
    frame = spark.createDataFrame([(0, 0, [0.0]), (0, 1, [0.0]), (0, 2, [5.0])], LONG)
    got = nearest(frame, frame, 9, skip_first=True).groupBy("ord").agg(F.count("*").alias("n"), F.min("dist").alias("d")).collect()
    assert {r["ord"]: (r["n"], r["d"]) for r in got} == {0: (2, 0.0), 1: (2, 0.0), 2: (2, 5.0)}


def test_quantile_normalisation_counts_training_scores_up_to_the_score(spark):
    rows = [(0, i, True, v) for i, v in enumerate([1.0, 2.0, 2.0, 5.0])] + [(0, 10 + i, False, v) for i, v in enumerate([0.5, 2.0, 3.0, 9.0])]
    both = spark.createDataFrame(rows, "channel int, ord long, is_train boolean, raw double")
    got = {r["ord"]: r["score"] for r in normalize(both, "quantile").collect()}
    assert [round(got[10 + i] * 5 - 0.5) for i in range(4)] == [0, 3, 3, 4]


def test_auroc_counts_ties_half_and_is_null_for_one_class(spark):
    values = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)]
    pairs = [(p > n) + 0.5 * (p == n) for p, a in values if a for n, b in values if not b]
    assert math.isclose(E.auroc(scored(spark, values)).first()["auroc"], sum(pairs) / len(pairs))
    assert E.auroc(scored(spark, [(0.1, 1), (0.2, 1)])).first()["auroc"] is None


def test_roc_curve_drops_points_inside_straight_runs(spark):
    got = E.roc_curve(scored(spark, [(5, 1), (4, 1), (3, 1), (2, 0), (1, 1)])).orderBy("place").collect()
    assert [r["thr"] for r in got] == [math.inf, 5.0, 3.0, 2.0, 1.0]


def test_percentile_threshold_interpolates(spark):
    got = E.pick_threshold(scored(spark, [(1, 0), (2, 0), (4, 1), (10, 1)]), "percentile", 0.3).first()["thr"]
    assert math.isclose(got, 1.9)
    with pytest.raises(ValueError):
        E.pick_threshold(scored(spark, [(1, 0)]), "score")


def test_vote_ties_go_to_the_first_class(spark):
    found = spark.createDataFrame([(0, 1, 1, 1.0, "b"), (0, 1, 2, 1.0, "a")], "channel int, ord long, rank int, dist double, train_label string")
    probs = C.view_probabilities(C.channel_probabilities(found, "hard"), ["audio"])
    assert C.predictions(probs).first()["y_pred"] == "a"
    with pytest.raises(ValueError):
        C.channel_probabilities(found, "none")


def test_unseen_labels_are_listed_or_raised(spark):
    test = spark.createDataFrame([("x", "dry"), ("y", "odd"), ("z", None)], "id string, label string")
    classes = C.class_table(spark.createDataFrame([("dry",)], "label string"))
    assert [r["y_true"] for r in C.unseen(test, classes).collect()] == ["UNSEEN:odd"]
    with pytest.raises(ValueError):
        C.unseen(test, classes, "error")


def test_numpy_shuffle_mode_orders_conditions_as_numpy_does(spark):
    rows = [(i, f"normal/heavy_vel{v}_clean_0001", "normal") for i, v in enumerate((80, 90, 110, 120))]
    split = X.split_classification(spark.createDataFrame(rows, "ord long, id string, fault string"), "100", shuffle="mt19937")
    assert {r["vel"] for r in split.where("part = 'train'").collect()} == {"110", "120"}
    X.check_split(split, "100")


def test_leaking_split_is_refused(spark):
    leak = spark.createDataFrame([("a", "train", "80"), ("a", "test_base", "80")], "id string, part string, vel string")
    with pytest.raises(ValueError):
        X.check_split(leak, "100")


def test_fault_and_condition_of_paths(spark):
    ids = ["/d/abnormal/dry/med_vel80_noiseB_0012", "normal/heavy_vel100_clean_1", "abnormal", "a/b", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = [(r[0], r[1]) for r in df.select(P.fault_from_path(F.col("id")), P.condition_from_path(F.col("id"))).collect()]
    assert got[0] == ("dry", "med_vel80_noiseB_0012")
    assert got[1] == ("normal", "heavy_vel100_clean_1")
    assert got[2][0] is None
    assert got[3] == (None, "a")
    assert got[4] == (None, None)


def test_windows_have_an_overlapping_tail(spark):
    series = spark.createDataFrame([("s", p, float(p)) for p in range(10)] + [("t", 0, 1.0)], "key string, pos long, x double")
    got = {(r["key"], r["win"]): (r["n"], r["mean"]) for r in S.pool_windows(S.windows(series, 4)).collect()}
    assert got == {("s", 0): (4, 1.5), ("s", 1): (4, 5.5), ("s", 2): (4, 7.5), ("t", 0): (1, 1.0)}


def test_a_failing_signal_keeps_its_error(spark):
    rows = [("a", 0, 1000, [0.0, 1.0] * 40), ("b", 0, 1000, []), ("c", 0, 1000, None)]
    got = {r["id"]: r for r in S.encode_signals(spark.createDataFrame(rows, "id string, channel int, rate int, samples array<double>"), lambda: LogSpectrum(4), 64).collect()}
    assert len(got["a"]["vec"]) == 4 and got["a"]["error"] is None
    assert got["b"]["vec"] is None and got["b"]["error"]
    assert got["c"]["vec"] is None and got["c"]["error"]


def test_view_names_and_aliases():
    assert resolve_views("vib, fusedmean,audio,vibration") == ["vibration", "fused", "audio"]
    with pytest.raises(ValueError):
        resolve_views("other")
    with pytest.raises(ValueError):
        resolve_views("")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_blocks_give_each_query_k_rows_and_are_those_of_a_whole_reference(spark, monkeypatch, metric):
    """A reference of one block is ranked in its task; several are merged; queries that share a place share their ranks."""
    rng = np.random.default_rng(12)
    made = lambda x, ords: spark.createDataFrame([(c, int(o), v.tolist()) for c in (0, 1) for o, v in zip(ords, x)], "channel int, ord long, vec array<double>")
    x = rng.normal(size=(400, 6))
    x[50:300] = x[3]  # more copies than are wanted
    reference, queries = made(x, range(400)), made(np.vstack([rng.normal(size=(30, 6)), x[:20]]), [*range(48), 47, 47])
    want = sorted(map(tuple, neighbours.nearest(queries, reference, 7, metric, True).collect()))
    for numbers, one in ((2400, True), (500, False)):
        monkeypatch.setattr(neighbours, "BROADCAST", numbers)
        got = neighbours.nearest(queries, reference, 7, metric, True)
        assert ("Window" not in got._jdf.queryExecution().executedPlan().toString()) == one
        assert sorted(map(tuple, got.collect())) == want and len(want) == 7 * 48 * 2


def test_a_product_of_queries_and_vectors_is_held_in_tiles():
    """The memory of a search follows a tile, not the reference."""
    import tracemalloc

    rng = np.random.default_rng(13)
    x, y = rng.normal(size=(600, 4)), rng.normal(size=(40_000, 4))
    tracemalloc.start()
    r, c, d = neighbours.top_pairs(x, y, 5, "l2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = np.sqrt(((x[:40, None] - y[None]) ** 2).sum(2))
    assert (c[: 40 * 5].reshape(40, 5) == np.argsort(exact, axis=1, kind="stable")[:, :5]).all() and len(r) == len(d) == 3000
    assert peak < 30e6
