"""NumPy archives read in ranges and written by many tasks, against numpy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftwave.sources import npz

N = 500
RNG = np.random.default_rng(0)
IDS = np.array([f"s{i}é" * (1 + i % 3) for i in range(N)])
ABOUT = {"ids": IDS, "labels": np.arange(N) % 3, "splits": np.array(["Normal", "Anomalous"])[np.arange(N) % 2]}
X = RNG.normal(size=(N, 14)).astype(np.float32)
PARTS = RNG.normal(size=(N, 7, 2, 3))
LAYOUTS = {
    "whole": {"X": X, **ABOUT},
    "columns": {**{f"X_ch{c}": PARTS[:, c].reshape(N, -1) for c in range(7)}, **ABOUT},
    "lists": {"per_channel": PARTS, "X": X, **ABOUT},
    "cells": {"X_per_channel": PARTS.astype(np.float16), "ids": IDS},
    "bare": {"X": X},
    "by_column": {"X": np.asfortranarray(X), **ABOUT},
    "big_endian": {"X": X.astype(">f8"), "ids": IDS, "labels": (np.arange(N) % 3).astype(">i2")},
    "none": {"X": np.zeros((0, 14)), "ids": np.zeros(0, "<U3"), "labels": np.zeros(0, int), "splits": np.zeros(0, "<U3")},
}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("range_bytes", [1000, npz.RANGE])
def test_ranges_of_an_archive_equal_the_whole(spark, tmp_path, monkeypatch, layout, save, range_bytes):
    arrays = LAYOUTS[layout]
    save(tmp_path / "a.npz", **arrays)
    df = npz.read_npz(spark, f"{tmp_path}/a.npz", range_bytes)
    rows, n = df.orderBy("ord").collect(), len(arrays["X"]) if "X" in arrays else N
    assert [r["ord"] for r in rows] == list(range(n))
    for key, name in (("id", "ids"), ("label", "labels"), ("split", "splits")):
        assert [r[key] for r in rows] == (arrays[name].tolist() if name in arrays else [None] * n)
    assert [r["x"] for r in rows] == (arrays["X"].astype(float).tolist() if "X" in arrays else [None] * n)
    parts = next((arrays[k] for k in ("per_channel", "X_per_channel") if k in arrays), PARTS if "X_ch0" in arrays else None)
    assert [r["per_channel"] for r in rows] == ([None] * n if parts is None else parts.reshape(n, 7, -1).astype(float).tolist())
    sought = save is np.savez and layout != "by_column" and n and range_bytes == 1000
    assert (df.rdd.getNumPartitions() > 20) == bool(sought)


def test_a_folder_of_archives_and_odd_ones(spark, tmp_path):
    for name in ("a", "b"):
        np.savez(tmp_path / f"{name}.npz", **LAYOUTS["whole"])
    assert npz.read_npz(spark, str(tmp_path)).count() == 2 * N
    odd = {"pickled": {"X": np.array([[1], [2, 3]], dtype=object)}, "short": {"X": X[:3], "ids": IDS}, "flat": {"X": X[:, 0]}, "nothing": {"ids": IDS}, "labels": {"X": X, "labels": np.zeros(2, int)}, "cut": {"X_ch0": X}}
    for name, arrays in odd.items():
        (tmp_path / name).mkdir()
        np.savez(tmp_path / name / "o.npz", **arrays)
        with pytest.raises(PySparkException):
            npz.read_npz(spark, f"{tmp_path}/{name}/o.npz").collect()


def test_many_tasks_write_one_archive(spark, tmp_path):
    n = 200_000
    df = spark.range(n, numPartitions=9).select((F.lit(n) - F.col("id")).alias("ord"), F.concat(F.lit("ü"), F.pmod("id", F.lit(1234))).alias("id"), (F.col("id") % 5).alias("label"), F.when(F.col("id") % 2 == 0, "Normal").otherwise("").alias("split"), F.array([F.col("id") / k for k in range(1, 5)]).alias("x"))
    target = f"{tmp_path}/out.npz"
    npz.write_npz(df.limit(3), target)
    npz.write_npz(df, target)
    i = np.arange(n)[::-1]
    with np.load(target, allow_pickle=False) as z:
        assert sorted(z.files) == ["X", "ids", "labels", "splits"]
        assert (z["X"] == np.stack([i / k for k in range(1, 5)], 1).astype(np.float32)).all() and z["X"].dtype == np.float32
        assert z["ids"].tolist() == [f"ü{k % 1234}" for k in i] and (z["labels"] == i % 5).all() and z["splits"].tolist() == ["Normal" if k % 2 == 0 else "" for k in i]
    assert [p.name for p in tmp_path.iterdir()] == ["out.npz"]
    assert npz.read_npz(spark, target, 100_000).count() == n


def test_archives_that_cannot_be_written(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(i, f"s{i}", 0, "Normal", v) for i, v in enumerate(x)], "ord long, id string, label long, split string, x array<double>")
    npz.write_npz(rows().repartition(2), f"{tmp_path}/empty.npz")
    with np.load(tmp_path / "empty.npz") as z:
        assert z["X"].shape[0] == 0 and len(z["ids"]) == 0
    for bad in (rows([1.0], [1.0, 2.0]), rows([1.0], None), rows([1.0, None])):
        with pytest.raises(PySparkException):
            npz.write_npz(bad, f"{tmp_path}/bad.npz")
    assert [p.name for p in tmp_path.iterdir()] == ["empty.npz"]
