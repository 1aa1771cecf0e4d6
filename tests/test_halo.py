"""Resampling and framing of series in blocks against the whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.operators import encoders as N
from siftwave.operators import halo as H

SIZES = {"a": 1000, "b": 1, "c": 257, "d": 64, "e": 777, "f": 129}


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(0)
    return {k: rng.normal(1, 1, n) for k, n in SIZES.items()}


@pytest.fixture(scope="module")
def blocks(spark, series):
    """Pieces of odd sizes, out of order, one of them empty."""
    rng, rows = np.random.default_rng(1), [("a", 0, [])]
    for k, x in series.items():
        cuts = np.unique([0, len(x), *rng.integers(0, len(x) + 1, 6)])
        rows += [(k, int(p), x[p:q].tolist()) for p, q in zip(cuts[:-1], cuts[1:], strict=True)]
    return spark.createDataFrame(rows[::-1], "key string, start long, samples array<double>").repartition(5)


def joined(blocks):
    out = {}
    for r in blocks.orderBy("key", "start").collect():
        assert r["start"] == len(out.setdefault(r["key"], []))
        out[r["key"]] += r["samples"]
    return out


@pytest.mark.parametrize(("rate", "target"), [(48_000, 16_000), (44_100, 16_000), (8_000, 16_000), (3, 2), (16_000, 16_000), (2, 3)])
@pytest.mark.parametrize("length", [50, 160_000])
def test_resampled_blocks_equal_the_whole(blocks, series, rate, target, length):
    got = joined(H.resampled(blocks, rate, target, length))
    assert got.keys() == series.keys()
    for k, x in series.items():
        want = N.resample(x, rate, target)
        assert len(got[k]) == len(want) and np.abs(np.array(got[k]) - want).max() < 1e-12


@pytest.mark.parametrize("length", [1, 37, 160_000])
def test_framed_blocks_equal_the_whole(blocks, series, length):
    got = {(r["key"], r["frame"]): r["samples"] for r in H.framed(blocks, 64, 20, length).collect()}
    want = {(k, i): f.tolist() for k, x in series.items() for i, f in enumerate(N.frames(x, 64, 20))}
    assert got == want


@pytest.mark.parametrize("length", [90, 160_000])
def test_spectra_of_blocks_equal_the_whole(blocks, series, length):
    got = {(r["key"], r["frame"]): r["magnitudes"] for r in H.spectra(blocks, 4000, length).collect()}
    want = {(k, i): f for k, x in series.items() for i, f in enumerate(N.spectrum(x, 4000))}
    assert got.keys() == want.keys() and all(np.abs(np.array(got[k]) - want[k]).max() < 1e-12 for k in want)


def test_blocks_of_rows_and_edges(spark, series):
    rows = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "key string, pos long, x double")
    assert joined(H.blocks_of_series(rows, 100)) == {k: x.tolist() for k, x in series.items()}
    halo = {(r["key"], r["n"]): r for r in H.with_halo(H.blocks_of_series(rows, 100), 64, 30, 50).collect()}
    for k, x in series.items():
        assert [n for key, n in sorted(halo) if key == k] == list(range(-(-len(x) // 64)))
    for (k, n), r in halo.items():
        a, z = max(0, 64 * n - 30), min(len(series[k]), 64 * (n + 1) + 50)
        assert (r["lead"], r["own"], r["last"]) == (64 * n - a, min(64, len(series[k]) - 64 * n), 64 * (n + 1) >= len(series[k]))
        assert r["samples"] == series[k][a:z].tolist()
    assert H.with_halo(H.blocks_of_series(rows.limit(0)), 64, 1, 1).collect() == []
    with pytest.raises(ValueError):
        H.with_halo(H.blocks_of_series(rows), 0, 1, 1)


def test_frames_of_a_long_block_series_stay_small(spark):
    long = spark.range(0, 200_000, 1, 4).select(F.lit("k").alias("key"), F.col("id").alias("pos"), (F.col("id") % 97).cast("double").alias("x"))
    got = H.resampled(H.blocks_of_series(long, 1000), 3, 2, 5000)
    assert got.agg(F.sum(F.size("samples"))).first()[0] == 133_334 and got.agg(F.max(F.size("samples"))).first()[0] <= 3336
