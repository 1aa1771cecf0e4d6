"""Scaling and exact nearest neighbours per channel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.model import N_CHANNELS

BLOCK = 32_768  # queries of one distance block
PARTS, PART = 4, 2048  # blocks of a channel's queries, at least, where each has so many queries
BROADCAST = 4_000_000  # numbers in a reference that is sent to all tasks, and in the reference side of a distance block, at most
MATRIX = 2_000_000  # distances that a task holds at once
SPREAD = 2000  # partitions that pairs of blocks are dealt over, at most
LIGHT = 60_000  # numbers in a reference up to which queries of a sent one are too little work to be dealt out
ROWS, TILE = 512, 1024  # queries and reference vectors of one matrix product
GROUP, BOX = 2048, 1024  # queries that go through boxes together, and reference vectors of a box, at most
IDLE = 0.6  # share of pairs from which boxes save less than their bounds take
EPS = np.finfo(float).eps


def scaler_stats(train: DataFrame) -> DataFrame:
    """Mean and population deviation (1 where it is 0) for each channel and position: channels x dimensions rows."""
    flat = train.select("channel", F.posexplode("vec").alias("pos", "x"))
    sd = F.stddev_pop("x")
    return flat.groupBy("channel", "pos").agg(F.avg("x").alias("mu"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def scaler_moments(train: DataFrame) -> DataFrame:
    """channel, pos, n, mu, m2: what scaler_stats can be made of, and what merges."""
    flat = train.select("channel", F.posexplode("vec").alias("pos", "x"))
    return flat.groupBy("channel", "pos").agg(F.count("x").alias("n"), F.avg("x").alias("mu"), (F.var_pop("x") * F.count("x")).alias("m2"))


def merge_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """The moments of two sets of vectors together, of those of each."""
    sides = [df.select("channel", "pos", *[F.col(c).alias(f"{c}_{x}") for c in ("n", "mu", "m2")]) for x, df in (("a", a), ("b", b))]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_a, n_b, gap = zero("n_a"), zero("n_b"), zero("mu_b") - zero("mu_a")
    n = n_a + n_b
    m2 = zero("m2_a") + zero("m2_b") + F.when((n_a > 0) & (n_b > 0), gap * gap * n_a * n_b / n).otherwise(0.0)
    mu = F.when(n_a == 0, F.col("mu_b")).when(n_b == 0, F.col("mu_a")).otherwise(F.col("mu_a") + gap * n_b / n)
    return sides[0].join(sides[1], ["channel", "pos"], "full").select("channel", "pos", n.alias("n"), mu.alias("mu"), m2.alias("m2"))


def stats_of(moments: DataFrame) -> DataFrame:
    """scaler_stats of moments."""
    sd = F.sqrt(F.col("m2") / F.col("n"))
    return moments.select("channel", "pos", "mu", F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def standardize(features: DataFrame, stats: DataFrame) -> DataFrame:
    """features scaled by stats; those are as many rows as channels and dimensions, so they are broadcast."""
    by_channel = stats.groupBy("channel").agg(F.sort_array(F.collect_list(F.struct("pos", "mu", "sd"))).alias("_s"))
    scaled = F.zip_with("vec", "_s", lambda x, s: (x - s["mu"]) / s["sd"])
    return features.join(F.broadcast(by_channel), "channel").withColumn("vec", scaled).drop("_s")


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two vector columns as an expression, for small inputs and for checks."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    if metric_name(metric) == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return 1 - F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def metric_name(metric: str) -> str:
    if metric.lower() in ("l2", "euclidean"):
        return "l2"
    if metric.lower() in ("cos", "cosine"):
        return "cosine"
    raise ValueError(f"metric must be l2 or cosine, not {metric!r}")


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v**2).sum(1, keepdims=True))
    return v / np.where(n > 0, n, 1)


def squared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all rows of x and y from one matrix product, and how far off they may be for each row of x."""
    xx, yy = (x**2).sum(1), (y**2).sum(1)
    return xx[:, None] + yy - 2 * (x @ y.T), 8 * np.finfo(float).eps * (x.shape[1] + 4) * (xx + yy.max(initial=0))


def measured(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of x and y, pair by pair, so that equal vectors have equal distances wherever they stand.

    Cosine distances are those of rows that _unit has scaled.
    """
    size = max(1, MATRIX // max(1, y.shape[-1]))
    one = (lambda a, b: np.sqrt(((a - b) ** 2).sum(1))) if metric == "l2" else (lambda a, b: 1 - (a * b).sum(1))
    return np.concatenate([np.zeros(0), *[one(x[i : i + size], y[i : i + size]) for i in range(0, len(x), size)]])


def matrix(vectors) -> np.ndarray:
    """Vectors as rows; ValueError where a number is null, infinite or none."""
    x = np.stack(vectors).astype(float)
    if not np.isfinite(x).all():
        raise ValueError("vectors of neighbours must be finite")
    return x


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists as rows, without an object for each; ValueError as in matrix, or where lengths differ."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
    if not len(lists):
        return np.zeros((0, 0))
    numbers, ends = lists.flatten(), np.diff(lists.offsets.to_numpy())
    if lists.null_count or numbers.null_count or (ends != ends[0]).any():
        raise ValueError("vectors of neighbours must be finite and of one length")
    x = numbers.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(lists), ends[0])
    if not np.isfinite(x).all():
        raise ValueError("vectors of neighbours must be finite")
    return x


def reach(distance: np.ndarray, metric: str, dims: int) -> np.ndarray:
    """The Euclidean distance, rounded up, within which all vectors of such a distance lie."""
    if metric == "l2":
        return distance * (1 + 16 * EPS * (dims + 4))
    return np.sqrt(2 * (np.maximum(distance, 0) + 16 * EPS * (dims + 4)))


def boxed(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of x, and where its runs of at most `size` rows begin, and end: halves along the widest dimension, and halves of these."""
    runs, todo = [], [np.arange(len(x))]
    while todo:
        run = todo.pop()
        if len(run) <= size or not x.shape[1]:
            runs.append(run)
            continue
        own, half = x[run], len(run) // 2
        along = np.argpartition(own[:, own.var(0).argmax()], half)
        todo += [run[along[half:]], run[along[:half]]]
    return np.concatenate(runs), np.cumsum([0, *map(len, runs)])


class Sides:
    """Reference vectors y as products need them: for l2 around their mean and scaled to a length of at most 1, so that 32 bits tell them apart.

    wide are doubles for some rows, narrow the same of all rows in 32 bits.
    """

    def __init__(self, y: np.ndarray, metric: str):
        self.y, self.metric, self.middle, self.scale = y, metric, np.zeros(y.shape[1]), 1.0
        if metric == "l2" and len(y):
            self.middle = y.mean(0)
            self.scale = np.sqrt(max(((y[i : i + 65_536] - self.middle) ** 2).sum(1).max() for i in range(0, len(y), 65_536))) or 1.0
        parts = [self.wide(i, i + 65_536).astype(np.float32) for i in range(0, max(1, len(y)), 65_536)]
        self.narrow = np.concatenate(parts)

    def moved(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) / self.scale if self.metric == "l2" else x

    def wide(self, lo: int, hi: int) -> np.ndarray:
        y = self.moved(self.y[lo:hi])
        return np.hstack([-2 * y, (y**2).sum(1)[:, None]]) if self.metric == "l2" else -y


class Best:
    """The `take` nearest so far of some queries x among vectors that are offered range by range.

    A matrix product in 32 bits gives approximate distances; a pair is measured in doubles, pair by
    pair, if its distance is within the product's error bound of a query's limit, an upper bound of
    its take-th distance, which falls as vectors are seen. Where that leaves many pairs, as within
    one narrow cluster, the product is made again in doubles first. Of equal distances the one with
    the smaller key stays. Cosine distances are those of rows that _unit has scaled.
    """

    def __init__(self, x: np.ndarray, sides: Sides, key: np.ndarray, take: int, metric: str, limit: np.ndarray | None = None):
        self.x, self.sides, self.key, self.take, self.metric = x, sides, key, take, metric
        self.limit = np.full(len(x), np.inf) if limit is None else limit.copy()
        moved = sides.moved(x)
        self.xx = (moved**2).sum(1)
        self.left = np.hstack([moved, np.ones((len(x), 1))]) if metric == "l2" else moved
        # Twice the error of a product whose numbers are rounded by 1, over a reference of lengths up to 1.
        self.off = 4 * (x.shape[1] + 4) * (self.xx + 1)
        self.off32 = self.off * np.finfo(np.float32).eps
        beyond = ~(self.xx < 1e12)  # more than 32 bits can hold: all their pairs are left to doubles
        self.off32[beyond] = np.inf
        self.left32 = np.where(beyond[:, None], 0, self.left).astype(np.float32)
        most = len(x) * min(TILE, len(sides.y))
        self.room, self.flags = np.empty(most, np.float32), np.empty(most + 8, bool)
        self.hits = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting, self.n_waiting = [], 0
        self._limited()

    def _limited(self) -> None:
        """What a product may be at most, by queries, in 32 bits and in doubles, rounded up."""
        upto = (self.limit / self.sides.scale) ** 2 - self.xx if self.metric == "l2" else self.limit - 1
        self.upto32 = np.nextafter((upto + self.off32).astype(np.float32), np.float32(np.inf))
        self.upto = np.nextafter(upto + self.off * EPS, np.inf)
        self.open = np.isinf(self.limit).any()

    def offer(self, lo: int, hi: int, rows: np.ndarray | None = None) -> None:
        """Vectors lo to hi for all queries, or for some."""
        for at in range(lo, hi, TILE):
            self._offer(at, min(hi, at + TILE), rows)

    def _within(self, d: np.ndarray, upto: np.ndarray, off: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
        """Flat places of the products, a row for each vector, that are within their error of a query's limit."""
        upto = upto if rows is None else upto[rows]
        if self.open and d.shape[0] > self.take:
            seen = np.partition(d.T, self.take - 1, axis=1)[:, self.take - 1] + (off if rows is None else off[rows])
            upto = np.minimum(upto, np.nextafter(seen.astype(d.dtype), d.dtype.type(np.inf)))
        flags = self.flags[: -(-d.size // 8) * 8]
        flags[d.size :] = False
        np.less_equal(d, upto, out=flags[: d.size].reshape(d.shape))
        words = np.flatnonzero(flags.view(np.uint64))  # few are set, so eight are looked at at once
        bits = np.flatnonzero(flags.reshape(-1, 8)[words])
        return words[bits >> 3] * 8 + (bits & 7)

    def _offer(self, lo: int, hi: int, rows: np.ndarray | None) -> None:
        left = self.left32 if rows is None else self.left32[rows]
        d = np.matmul(self.sides.narrow[lo:hi], left.T, out=self.room[: len(left) * (hi - lo)].reshape(hi - lo, len(left)))
        found = self._within(d, self.upto32, self.off32, rows)
        if len(found) > 4 * self.take * len(left):
            d = self.sides.wide(lo, hi) @ (self.left if rows is None else self.left[rows]).T
            found = self._within(d, self.upto, self.off * EPS, rows)
        if not len(found):
            return
        c, r = np.divmod(found, len(left))
        r, c = r if rows is None else rows[r], c + lo
        dist = measured(self.x[r], self.sides.y[c], self.metric)
        near = np.flatnonzero(dist <= self.limit[r])
        self.waiting.append((r[near], c[near], dist[near]))
        self.n_waiting += len(near)
        if self.n_waiting >= self.take * len(self.x):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x, rows of y and distances of what is best so far, by query, distance and key; limits fall to it."""
        if self.waiting:
            r, c, d = (np.concatenate(a) for a in zip(self.hits, *self.waiting, strict=True))
            self.waiting, self.n_waiting = [], 0
            near = d <= self.limit[r]
            r, c, d = r[near], c[near], d[near]
            order = np.argsort(d)
            order = order[np.argsort(r[order].astype(np.uint16 if len(self.x) <= 65_536 else np.int64), kind="stable")]  # few bits are sorted by counting
            if ((d[order[1:]] == d[order[:-1]]) & (r[order[1:]] == r[order[:-1]])).any():
                order = np.lexsort((self.key[c], d, r))
            r, c, d = r[order], c[order], d[order]
            place = places(r) - 1
            kept = place < self.take
            last = place == self.take - 1
            self.limit[r[last]] = d[last]
            self.hits = r[kept], c[kept], d[kept]
            self._limited()
        return self.hits


class Reference:
    """Reference vectors in boxes that hold BOX of them at most, as they are searched for the `take` nearest of any queries.

    A query meets its nearest box, and then only boxes within its take-th distance so far.
    In ten dimensions or fewer that leaves a part of the pairs that falls as the reference grows; where
    a group met nearly all of them, as in many dimensions, later ones meet all without being told apart.
    """

    def __init__(self, y: np.ndarray, metric: str):
        y = _unit(y) if metric == "cosine" else y
        self.metric, self.boxes, self.met, self.pairs = metric, len(y) > 2 * BOX, 0, 0
        self.order, self.ends = boxed(y, BOX) if self.boxes else (np.arange(len(y)), np.array([0, len(y)]))
        y = y[self.order]
        self.sides = Sides(y, metric)
        self.low, self.high = (np.stack([f(y[i:j], axis=0) for i, j in zip(self.ends[:-1], self.ends[1:], strict=True)], axis=1) for f in (np.min, np.max)) if len(y) else (None, None)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds of the Euclidean distances of the rows of x, for cosine unit vectors, to all vectors of each box, but for rounding that `reach` covers."""
        total, gap, further = np.zeros((len(x), self.low.shape[1])), *np.empty((2, len(x), self.low.shape[1]))
        for at, low, high in zip(x.T, self.low, self.high, strict=True):
            np.subtract(low, at[:, None], out=gap)
            np.subtract(at[:, None], high, out=further)
            np.maximum(gap, further, out=gap)
            np.maximum(gap, 0, out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        return np.sqrt(total, out=total)

    def search(self, x: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of x, rows of y and distances of the `take` nearest of each row of x, in that order; of equals the first in y."""
        take, found = min(take, len(self.order)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        x = _unit(x) if self.metric == "cosine" else x
        near = boxed(x, GROUP)[0] if self.boxes else np.arange(len(x))
        for at in range(0, len(x), GROUP):
            own = near[at : at + GROUP]
            best = Best(x[own], self.sides, self.order, take, self.metric)
            if self.boxes:
                self._by_boxes(best)
            else:
                best.offer(0, len(self.order))
            r, c, d = best.settle()
            found.append((own[r], self.order[c], d))
        r, c, d = (np.concatenate(a) for a in zip(*found, strict=True))
        back = np.argsort(r, kind="stable")
        return r[back], c[back], d[back]

    def _by_boxes(self, best: Best) -> None:
        bound = np.ascontiguousarray(self.bounds(best.x).T)
        # Each query's nearest box comes first, so that its limit is low before it meets any other.
        home, mean = bound.argmin(0), bound.mean(1)
        by_home = np.argsort(home, kind="stable")
        for rows in np.split(by_home, np.flatnonzero(np.diff(home[by_home])) + 1):
            self._meet(best, home[rows[0]], rows)
        best.settle()
        bound[home, np.arange(len(home))] = np.inf
        for k in np.argsort(mean, kind="stable"):
            self._meet(best, k, np.flatnonzero(bound[k] <= np.minimum(reach(best.limit, self.metric, best.x.shape[1]), np.finfo(float).max)))
        self.pairs += len(best.x) * len(self.order)
        self.boxes = self.met < IDLE * self.pairs

    def _meet(self, best: Best, box: int, rows: np.ndarray) -> None:
        if len(rows):
            best.offer(self.ends[box], self.ends[box + 1], None if len(rows) == len(best.x) else rows)
            self.met += len(rows) * int(self.ends[box + 1] - self.ends[box])


def top_pairs(x: np.ndarray, y: np.ndarray, take: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and distances of the `take` nearest of each row of x, in that order; of equals the first in y."""
    return Reference(y, metric).search(x, take)


def places(rows: np.ndarray) -> np.ndarray:
    """The place, from 1, of each entry among the equal ones of sorted rows."""
    if not len(rows):
        return np.zeros(0, np.int64)
    starts = np.append(np.flatnonzero(np.append(True, rows[1:] != rows[:-1])), len(rows))
    return np.arange(1, len(rows) + 1) - np.repeat(starts[:-1], np.diff(starts))


def same_places(asked: np.ndarray, dist: np.ndarray, train: np.ndarray, take: int) -> np.ndarray:
    """Which hits are the `take` nearest of all queries that share a place, in order."""
    at = np.lexsort((train, dist, asked))
    return at[places(asked[at]) <= take]


def by_channel(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each channel of each batch."""
    for batch in batches:
        channels = batch["channel"].to_numpy()
        for c in np.unique(channels):
            yield int(c), pa.table(batch.take(pa.array(np.flatnonzero(channels == c))))


def nearest(queries: DataFrame, reference: DataFrame, k: int, metric: str = "l2", skip_first: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """channel, ord, rank, dist, train_ord (and `carry` columns of the reference) of the k nearest of each query.

    Exact. A reference of at most BROADCAST numbers, which is counted first, is sent to the tasks
    whole, and the queries are dealt over all cores, since their files may be few or uneven; by a
    reference of LIGHT numbers they stay where they are. A larger one is dealt into blocks of as many numbers
    and meets blocks of queries; a pair of blocks of a channel is one task's work and keeps its k
    best. Only where a channel has several blocks are these merged by rank. So neither side has to
    fit anywhere whole, and no pair of vectors becomes a row. Ties go to the smaller train_ord.
    skip_first drops each query's nearest hit (its own copy when the sides are the same) and returns
    at most k of the others. A vector with a number that is not finite is an error. Where vectors lie
    in clusters, metric_index.MetricIndex finds the same rows and measures far fewer pairs.
    """
    metric, take = metric_name(metric), k + skip_first
    spark = queries.sparkSession
    sizes = [r["n"] or 0 for r in reference.groupBy("channel").agg(F.sum(F.size("vec")).alias("n")).collect()]  # a row for each channel
    size = sum(sizes)
    kinds = {f.name: f.dataType.simpleString() for f in reference.schema.fields}
    schema = "channel int, ord long, rank int, dist double, train_ord long" + "".join(f", {c} {kinds[c]}" for c in carry)
    fresh = lambda df, *more: df.select(*[F.col(n).alias(n) for n in ("channel", "ord", "vec", *more)])  # noqa: E731  both sides may come from one frame

    def hits(a: pa.Table, b: pa.Table, y: Reference) -> pa.Table:
        r, c, d = y.search(vectors(a["vec"]), take)
        ords, train = a["ord"].to_numpy(), b["ord"].to_numpy()[c]
        asked, same = ords[r], r
        if len(np.unique(ords)) < len(ords):  # queries that share a place share ranks
            at = same_places(asked, d, train, take)
            r, c, d, asked, train = r[at], c[at], d[at], asked[at], train[at]
            same = asked
        out = {"channel": a["channel"].to_numpy()[r].astype(np.int32), "ord": asked, "rank": places(same).astype(np.int32), "dist": d, "train_ord": train}
        return pa.table(out | {n: b[n].take(pa.array(c)) for n in carry})

    r_blocks = 1
    if size <= BROADCAST:
        table = fresh(reference, *carry).toArrow().sort_by("ord")
        sides = {}
        for ch in table["channel"].unique().to_pylist():
            own = table.filter(pa.compute.equal(table["channel"], ch)).combine_chunks()
            sides[ch] = own.drop_columns(["vec"]), vectors(own["vec"])
        shared = spark.sparkContext.broadcast(sides)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = {}
            for ch, a in by_channel(batches):
                if ch in shared.value:
                    b, y = shared.value[ch]
                    if ch not in ready:
                        ready[ch] = Reference(y, metric)
                    yield from hits(a, b, ready[ch]).to_batches()

        asked = fresh(queries)
        if size > LIGHT:
            asked = asked.repartition(min(SPREAD, 4 * spark.sparkContext.defaultParallelism), "channel", "ord")
        found = asked.mapInArrow(search, schema)
    else:
        n = most(queries, F.lit(1))
        q_blocks = max(1, -(-n // BLOCK), min(PARTS, -(-n // PART)))
        r_blocks = -(-max(sizes) // (BROADCAST or max(sizes)))  # where none is sent, a channel is one block
        deal = lambda n: F.pmod(F.xxhash64("ord"), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = fresh(queries).withColumn("qb", deal(q_blocks)).withColumn("rb", every(r_blocks))
        right = fresh(reference, *carry).withColumn("rb", deal(r_blocks)).withColumn("qb", every(q_blocks))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a) or not len(b):
                return hits(a.slice(0, 0), b.slice(0, 0), Reference(np.zeros((0, 0)), metric))
            b = b.take(pa.array(np.argsort(b["ord"].to_numpy(), kind="stable")))
            return hits(a, b.drop_columns(["vec"]), Reference(vectors(b["vec"]), metric))

        found = met(left, right, ["channel", "qb", "rb"], q_blocks * r_blocks * N_CHANNELS).applyInArrow(run, schema)
    return ranked(found, take, skip_first, size > BROADCAST and r_blocks == 1)


def most(df: DataFrame, weight: Column) -> int:
    """The largest sum of weights of a channel."""
    return df.groupBy("channel").agg(F.sum(weight).alias("n")).agg(F.max("n")).first()[0] or 0


def met(left: DataFrame, right: DataFrame, keys: list[str], groups: int):
    """Both sides by keys, dealt over enough partitions that few groups share one, since each is much work for few bytes."""
    n = min(SPREAD, 4 * groups)
    return left.repartition(n, *keys).groupBy(*keys).cogroup(right.repartition(n, *keys).groupBy(*keys))


def ranked(found: DataFrame, take: int, skip_first: bool, whole: bool) -> DataFrame:
    """The rows of the `take` best of each query; whole: found ranks are those among all the reference."""
    if not whole:
        rank = F.row_number().over(Window.partitionBy("channel", "ord").orderBy("dist", "train_ord"))
        found = found.withColumn("rank", rank).where(F.col("rank") <= take)
    return found.where("rank > 1").withColumn("rank", F.col("rank") - 1) if skip_first else found
