"""Pruned exact neighbours against the comparison of all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from siftwave.operators import metric_index as M
from siftwave.operators import neighbours as N
from siftwave.operators.neighbours import nearest
from siftwave.tables import stored


def frame(spark, x, channels=(0, 1)):
    return spark.createDataFrame([(c, i, v.tolist(), f"n{i}") for c in channels for i, v in enumerate(x)], "channel int, ord long, vec array<double>, name string")


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 5, (20, 9))
    reference = centres[rng.integers(0, 20, 3000)] + rng.normal(0, 0.3, (3000, 9))
    reference[100:140], reference[5], reference[900:1900] = reference[7], 0, reference[8]  # copies, a zero, and a crowded cell
    queries = np.vstack([centres[rng.integers(0, 20, 100)] + rng.normal(0, 0.3, (100, 9)), reference[:30], np.zeros((1, 9)), rng.normal(0, 20, (10, 9)), 1e6 + rng.normal(0, 1e-3, (5, 9))])
    return stored(frame(spark, queries, (0, 1, 3)), "queries"), stored(frame(spark, reference), "reference")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize(("skip", "block"), [(False, 8192), (True, 64)])
def test_rows_are_those_of_all_pairs(sides, monkeypatch, metric, skip, block):
    monkeypatch.setattr(M, "BLOCK", block)
    queries, reference = sides
    index = M.MetricIndex(reference, metric, ("name",))
    got = sorted(map(tuple, index.nearest(queries, 11, skip).collect()))
    assert got == sorted(map(tuple, nearest(queries, reference, 11, metric, skip, ("name",)).collect()))
    assert 0 < index.share < 0.4


def test_more_neighbours_than_vectors_and_no_vectors(spark):
    few = frame(spark, np.eye(3))
    assert sorted(map(tuple, M.MetricIndex(few).nearest(few, 9).collect())) == sorted(map(tuple, nearest(few, few, 9).drop("name").collect()))
    assert M.MetricIndex(few.limit(0)).nearest(few, 9).collect() == [] and M.MetricIndex(few).nearest(few.limit(0), 9).collect() == []


def test_where_bounds_leave_too_much_blocks_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = frame(spark, rng.normal(size=(800, 40)), (0,))
    index = M.MetricIndex(x)
    assert not index.worth(index.plan(x, 6), 800)
    monkeypatch.setattr(M, "BROADCAST", 0)
    assert sorted(map(tuple, M.nearest_any(x, x, 5, skip_first=True).collect())) == sorted(map(tuple, nearest(x, x, 5, skip_first=True).collect()))


def test_a_million_clustered_vectors_need_under_a_tenth_of_all_pairs(spark):
    def made(n, seed):
        def run(batches):
            centres = np.random.default_rng(7).normal(0, 4, (200, 16))
            for b in batches:
                rng = np.random.default_rng([seed, int(b["id"].iloc[0])])
                yield pd.DataFrame({"channel": 0, "ord": b["id"], "vec": list(centres[rng.integers(0, 200, len(b))] + rng.normal(0, 0.4, (len(b), 16)))})

        return stored(spark.range(0, n, 1, 8).mapInPandas(run, "channel int, ord long, vec array<double>"), "made")

    reference, queries = made(1_000_000, 1), made(200, 2)
    index = M.MetricIndex(reference)
    assert sorted(map(tuple, index.nearest(queries, 11).collect())) == sorted(map(tuple, nearest(queries, reference, 11).collect()))
    assert index.share < 0.1


@pytest.mark.parametrize("odd", [float("nan"), float("inf")])
def test_numbers_that_are_not_finite_are_an_error(spark, odd):
    good, bad = frame(spark, np.eye(4)), frame(spark, np.array([[1.0, odd, 0, 0]]))
    for queries, reference in ((good, bad), (bad, good)):
        for find in (lambda q, r: nearest(q, r, 2), lambda q, r: M.MetricIndex(r).nearest(q, 2)):
            with pytest.raises((ValueError, PythonException), match="finite"):
                find(queries, reference).collect()


def test_equal_vectors_have_equal_cosine_distances(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 7)), 9, axis=0)
    x = x[np.argsort(np.arange(len(x)) % 9, kind="stable")]  # copies lie 40 places apart
    got = nearest(frame(spark, rng.normal(size=(30, 7)), (0,)), frame(spark, x, (0,)), 9, "cosine").collect()
    for i in range(30):
        hits = sorted((r["rank"], r["train_ord"], r["dist"]) for r in got if r["ord"] == i)
        assert len({d for _, _, d in hits}) == 1 and [t for _, t, _ in hits] == [hits[0][1] + 40 * k for k in range(9)]


def scattered(spark, n, seed):
    """Vectors that lie in no clusters, so that most cells stay within reach."""
    return stored(frame(spark, np.random.default_rng(seed).normal(size=(n, 10)), (0, 1)).drop("name"), "scattered")


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_a_query_is_stored_once_and_not_for_each_cell_it_reads(spark, monkeypatch, metric, own):
    """Scattered vectors: rows between steps grow with the queries, not with queries times cells."""
    reference = scattered(spark, 1500, 5)
    queries, kept = reference if own else scattered(spark, 700, 6), []
    monkeypatch.setattr(M, "stored", lambda df, name: kept.append(stored(df, name)) or kept[-1])
    index = M.MetricIndex(reference, metric)
    got = sorted(map(tuple, index.nearest(queries, 5, own).collect()))
    assert got == sorted(map(tuple, nearest(queries, reference, 5, metric, own).collect()))
    assert len(got) == 5 * queries.count() and max(t.count() for t in kept) <= (5 + own) * queries.count() + 2


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_cells_of_several_shards(sides, monkeypatch, metric):
    """Small shards: neighbours beyond a query's own shard, and a cell of copies that is several shards."""
    queries, reference = sides
    monkeypatch.setattr(M, "SHARD", 2000)
    monkeypatch.setattr(M, "BLOCK", 50)
    index = M.MetricIndex(reference, metric, ("name",))
    assert not index.whole and max(parts.max() for _, parts in index.shards.values()) > 1
    assert sorted(map(tuple, index.nearest(queries, 11).collect())) == sorted(map(tuple, nearest(queries, reference, 11, metric, carry=("name",)).collect()))
    assert 0 < index.share < 0.6


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("kind", ["scattered", "narrow", "tiny", "huge", "outliers", "lattice", "equal"])
def test_products_of_32_bits_lose_no_neighbour(metric, kind):
    """The rows that measuring every pair in doubles gives, ties included, with queries far beyond the reference too."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(5, 9))
    y = centres[rng.integers(0, 5, 1500)] + rng.normal(0, 1e-7 if kind == "narrow" else 1, (1500, 9))
    y = {"tiny": y * 1e-25, "huge": y * 1e60, "outliers": np.vstack([y, 1e9 * centres]), "lattice": np.round(y), "equal": np.ones((1500, 9))}.get(kind, y)
    y[3] = y[700:704] = y[8]
    x = np.vstack([y[:40], y[40:80] + rng.normal(0, np.abs(y).max() / 100, (40, 9)), np.zeros((1, 9)), 1e7 * y[:2], np.abs(y).max() * 1e30 * centres[:2]])
    r, c, d = N.top_pairs(x, y, 7, metric)
    a, b = (x, y) if metric == "l2" else (N._unit(x), N._unit(y))
    every = np.stack([N.measured(np.repeat(q[None], len(b), 0), b, metric) for q in a])
    wanted = np.argsort(every, axis=1, kind="stable")[:, :7]
    assert r.tolist() == np.repeat(np.arange(len(x)), 7).tolist() and c.tolist() == wanted.ravel().tolist()
    assert d.tolist() == np.take_along_axis(every, wanted, 1).ravel().tolist()


def test_few_pairs_are_measured_again(monkeypatch):
    """Far from the origin, too, products tell pairs apart, since they are of vectors around the mean."""
    rng, again = np.random.default_rng(9), []
    y = 1e8 + rng.normal(size=(6000, 9))
    monkeypatch.setattr(N, "measured", lambda a, b, metric, plain=N.measured: again.append(len(a)) or plain(a, b, metric))
    N.top_pairs(y[:500], y, 11, "l2")
    assert sum(again) < 0.05 * 500 * len(y)


def test_pairs_are_compared_in_32_bits(monkeypatch):
    """Scattered vectors, so that their products take half the memory and doubles are left to a few pairs."""
    rng, kinds = np.random.default_rng(10), []
    y = rng.normal(size=(6000, 9))
    monkeypatch.setattr(N.Best, "_within", lambda self, d, *a, plain=N.Best._within: kinds.append(d.dtype) or plain(self, d, *a))
    N.top_pairs(y[:500], y, 11, "l2")
    assert kinds and set(kinds) == {np.dtype(np.float32)}


def test_queries_in_one_file_are_dealt_over_all_cores(spark, monkeypatch):
    """A reference that is sent to the tasks: queries of one partition are not one task's work."""
    x = frame(spark, np.random.default_rng(11).normal(size=(300, 9))).drop("name")
    plain = sorted(map(tuple, nearest(x.coalesce(1), x, 5).collect()))
    monkeypatch.setattr(N, "LIGHT", 0)
    assert sorted(map(tuple, nearest(x.coalesce(1), x, 5).collect())) == plain
    monkeypatch.setattr(N, "ranked", lambda found, *_: found)
    used = nearest(x.coalesce(1), x, 5).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("indexed", [True, False])
def test_queries_of_a_channel_are_several_blocks(spark, monkeypatch, indexed):
    """Fewer queries than a full block still keep more than one task of a channel busy."""
    rng, groups = np.random.default_rng(12), []
    x, y = (frame(spark, rng.normal(size=(n, 4)), (0,)).drop("name") for n in (8000, 200))
    want = sorted(map(tuple, nearest(x, y, 3).collect()))
    monkeypatch.setattr(N, "BROADCAST", N.BROADCAST if indexed else 799)
    monkeypatch.setattr(M if indexed else N, "met", lambda a, b, keys, n, plain=N.met: groups.append(a.select(*keys).distinct().count()) or plain(a, b, keys, n))
    got = (M.MetricIndex(y).nearest(x, 3) if indexed else nearest(x, y, 3)).collect()
    assert sorted(map(tuple, got)) == want and groups[0] >= 4


def test_settling_keeps_ties_in_order_of_keys():
    """Distances without equals are sorted by counting places; with equals the smaller key stays."""
    rng = np.random.default_rng(13)
    for y in (rng.normal(size=(4000, 3)), np.round(rng.normal(size=(4000, 3)))):
        r, c, d = N.top_pairs(y[:600], y, 7, "l2")
        every = np.sqrt(((y[:600, None] - y[None]) ** 2).sum(2))
        assert c.tolist() == np.argsort(every, axis=1, kind="stable")[:, :7].ravel().tolist() and d.tolist() == np.sort(every, axis=1)[:, :7].ravel().tolist()
