"""Exact nearest neighbours that measure only what the triangle inequality leaves.

Reference vectors lie in cells around pivots, with their distance to the pivot, and neighbouring
cells in shards that a task can hold. A block of queries first meets the shard of their own cell, and
there the cells in order of their lower bounds: each query's k-th distance so far says which cells it
still has to read, and which of their vectors by their distance to the pivot. Only queries that reach
into cells of other shards go on to these. A crowded cell is several shards, and queries of a popular
one are several blocks, so neither is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.operators.neighbours import BROADCAST, EPS, PART, PARTS, ROWS, Best, Sides, _unit, by_channel, matrix, met, metric_name, nearest, places, ranked, reach, same_places, squared, vectors
from siftwave.tables import stored

PIVOTS = 1024  # cells of a channel, at most
SAMPLE = 16  # vectors for each pivot that place the pivots
BLOCK = 32_768  # queries that meet a shard in one task
SHARD = BROADCAST  # numbers of a shard's vectors, at most
WORTH = 0.3  # share of all pairs from which comparing blocks is quicker


def space(x: np.ndarray, metric: str, queries: bool) -> np.ndarray:
    """Vectors as points whose Euclidean distance e orders as the metric: for cosine, unit vectors with e**2 / 2 as distance.

    A zero vector is at cosine distance 1 from all others, so it gets a direction of its own, and
    queries another than reference vectors.
    """
    if metric == "l2":
        return x
    u, zero = _unit(x), ~x.any(1)
    sides = np.zeros((len(x), 2))
    sides[zero, 0 if queries else 1] = 1
    return np.hstack([u, sides])


@dataclass(frozen=True)
class Cells:
    """The pivots of a channel, and for each cell its number of vectors and their smallest and largest distance to the pivot."""

    pivots: np.ndarray
    n: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def __post_init__(self):
        # Distances of the pivots among themselves, a bit too large where they are not exact.
        exact = len(self.pivots) * self.pivots.size <= 4_000_000
        apart = np.sqrt(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(2)) if exact else np.sqrt(np.maximum(squared(self.pivots, self.pivots)[0], 0)) + 1e-6
        object.__setattr__(self, "apart", apart)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For points q: distances to the pivots from below and from above, and lower bounds of the distances to all vectors of each cell."""
        d2, off = squared(q, self.pivots)
        low, high = np.sqrt(np.maximum(d2 - off[:, None], 0)), np.sqrt(np.maximum(d2, 0) + off[:, None])
        bound = np.maximum(np.maximum(low - self.far, self.near - high), 0)
        # Whatever is nearer to another pivot than to the query's own lies beyond the plane between the two.
        home = high.argmin(1)
        apart = self.apart[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (low**2 - high[np.arange(len(q)), home][:, None] ** 2) / (2 * apart * (1 + 1e-9))
        return low, high, np.maximum(bound, np.where(apart > 0, plane, 0) - 1e-9 * (1 + high))


def place_pivots(x: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """At most count pivots among the points x: some of them, moved to the means of what is nearest."""
    points = np.unique(x, axis=0)
    pivots = points[np.random.default_rng(0).permutation(len(points))[:count]]
    for _ in range(rounds):
        near = np.concatenate([squared(x[i : i + 4096], pivots)[0].argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, near, x)
        pivots = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], pivots)
    return pivots


def side_by_side(pivots: np.ndarray) -> np.ndarray:
    """The order in which near pivots stand near: halves along the widest dimension, and halves of these."""
    if len(pivots) <= 2:
        return np.arange(len(pivots))
    along = np.argsort(pivots[:, np.ptp(pivots, axis=0).argmax()], kind="stable")
    return np.concatenate([half[side_by_side(pivots[half])] for half in np.array_split(along, 2)])


class MetricIndex:
    """Cells of a reference (channel, ord, vec and `carry` columns), stored once and searched as often as wanted.

    The driver sees a sample of at most SAMPLE vectors for each pivot, and one row for each cell. A
    vector with a number that is not finite is an error; an empty reference finds nothing.
    """

    def __init__(self, reference: DataFrame, metric: str = "l2", carry: tuple[str, ...] = (), pivots: int = PIVOTS):
        self.metric, self.carry, self.spark = metric_name(metric), tuple(carry), reference.sparkSession
        reference = reference.select(*[F.col(c).alias(c) for c in ("channel", "ord", "vec", *carry)])
        counts = {r["channel"]: r["count"] for r in reference.groupBy("channel").count().collect()}
        wanted = {c: min(pivots, max(1, int(n**0.5))) for c, n in counts.items()}
        # About SAMPLE vectors for each pivot, by hash: the same ones each time.
        share = F.coalesce(*[F.when(F.col("channel") == c, F.lit(min(1.0, SAMPLE * wanted[c] / n))) for c, n in counts.items()], F.lit(0.0))
        drawn = F.pmod(F.xxhash64("ord", F.lit("pivots")), F.lit(1 << 30)) / (1 << 30) < share
        sample = reference.where(drawn).select("channel", "vec").toPandas()
        held = {}
        for c in counts:
            own = sample.loc[sample["channel"] == c, "vec"]
            # A channel of few vectors may leave no sample; its first vector is a pivot then.
            own = own if len(own) else [reference.where(F.col("channel") == c).orderBy("ord").first()["vec"]]
            pivots_of = place_pivots(space(matrix(own), self.metric, False), wanted[c])
            held[c] = pivots_of[side_by_side(pivots_of)]
        shared, metric = self.spark.sparkContext.broadcast(held), self.metric

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, b in by_channel(batches):
                x, at = space(vectors(b["vec"]), metric, False), shared.value[c]
                cell = np.concatenate([squared(x[i : i + 2048], at)[0].argmin(1) for i in range(0, len(x), 2048)])
                yield from b.append_column("cell", pa.array(cell, pa.int32())).append_column("r", pa.array(np.sqrt(((x - at[cell]) ** 2).sum(1)))).to_batches()

        kinds = {f.name: f.dataType.simpleString() for f in reference.schema.fields}
        schema = ", ".join(f"{c} {kinds[c]}" for c in reference.columns) + ", cell int, r double"
        order = ["channel", "cell", "r"]
        assigned = reference.mapInArrow(assign, schema)
        self.cells = stored(assigned.repartitionByRange(*order).sortWithinPartitions(*order), "cells")
        about = self.cells.groupBy("channel", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("near"), F.max("r").alias("far")).toPandas()
        self.about = {}
        for c, at in held.items():
            own = about[about["channel"] == c].sort_values("cell")
            n, near, far = np.zeros(len(at), np.int64), np.full(len(at), np.inf), np.full(len(at), -np.inf)
            n[own["cell"]], near[own["cell"]], far[own["cell"]] = own["n"], own["near"] * (1 - 1e-12), own["far"] * (1 + 1e-12)
            kept = n > 0
            self.about[c] = (Cells(at[kept], n[kept], near[kept], far[kept]), np.flatnonzero(kept))
        self.size = sum(counts.values())
        # For each cell, by its place in about: its first shard, and over how many it is dealt.
        self.shards = {c: _shards(cells.n, max(1, SHARD // max(1, held[c].shape[1]))) for c, (cells, _) in self.about.items()}
        self.whole = all(first[-1] + parts[-1] == 1 for first, parts in self.shards.values())
        self.shared = self.spark.sparkContext.broadcast(self.about)
        rows = [(int(c), int(k), int(f), int(p)) for c, (_, names) in self.about.items() for k, f, p in zip(names, *self.shards[c], strict=True)]
        self.dealt = self.spark.createDataFrame(rows, "channel int, cell int, first int, parts int")

    def _homes(self, queries: DataFrame) -> DataFrame:
        """channel, ord, vec and shard: for the queries of known channels, that of their nearest pivot."""
        shared, shards, metric = self.shared, self.shards, self.metric

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, a in by_channel(batches):
                home, (first, parts) = _home(space(vectors(a["vec"]), metric, True), shared.value[c][0]), shards[c]
                yield from a.append_column("shard", pa.array(first[home] + a["ord"].to_numpy() % parts[home], pa.int32())).to_batches()

        asked = queries.select(*[F.col(c).alias(c) for c in ("channel", "ord", "vec")]).where(F.col("channel").isin([int(c) for c in self.about]))
        if self.whole:
            return asked.withColumn("shard", F.lit(0))
        return stored(asked.mapInArrow(homes, "channel int, ord long, vec array<double>, shard int"), "homes")

    def _met(self, asked: DataFrame, take: int, tell: bool = False) -> DataFrame:
        """channel, ord, rank, dist, train_ord and carried columns of what each shard has for the queries that are sent to it, by `reach` where they have one.

        A row without train_ord tells how many pairs were measured; if tell, one for each query its
        vec, its reach, the other shards within it, and how many vectors lie in the cells within it.
        """
        shared, shards, metric, carry = self.shared, self.shards, self.metric, self.carry
        kinds = {f.name: f.dataType.simpleString() for f in self.cells.schema.fields}
        schema = "channel int, ord long, rank int, dist double, train_ord long" + "".join(f", {c} {kinds[c]}" for c in carry) + ", measured long"
        schema += ", vec array<double>, reach double, others array<int>, inside long" * tell
        known = {"channel": pa.int32(), "ord": pa.int64(), "rank": pa.int32(), "dist": pa.float64(), "train_ord": pa.int64(), "measured": pa.int64(), "vec": pa.list_(pa.float64()), "reach": pa.float64(), "others": pa.list_(pa.int32()), "inside": pa.int64()}
        names = [f.split()[0] for f in schema.split(", ")]

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            types = {n: known[n] if n in known else b.schema.field(n).type for n in names}

            def rows(n: int, **columns) -> pa.Table:
                """n rows with these columns and nulls in the others."""
                filled = {c: columns[c] if isinstance(columns.get(c), pa.ChunkedArray) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()}
                return pa.table({c: v.cast(types[c]) for c, v in filled.items()})

            if not len(a) or not len(b):
                return rows(0)
            channel, shard = a["channel"][0].as_py(), a["shard"][0].as_py()
            (cells, labels), (first, parts) = shared.value[channel], shards[channel]
            r, cell, places_of = b["r"].to_numpy(), b["cell"].to_numpy(), b["ord"].to_numpy()
            order = np.lexsort((r, cell))
            r, cell, places_of, y = r[order], cell[order], places_of[order], vectors(b["vec"])[order]
            held, start = np.unique(np.searchsorted(labels, cell), return_index=True)
            stop, x, ords = np.append(start[1:], len(r)), vectors(a["vec"]), a["ord"].to_numpy()
            points, (x, y) = space(x, metric, True), (x, y) if metric == "l2" else (_unit(x), _unit(y))
            sides, limits = Sides(y, metric), a["reach"].to_numpy() if "reach" in a.column_names else None
            near, hits, told, total = np.argsort(_home(points, cells), kind="stable"), [], [], 0
            for at in range(0, len(x), ROWS):
                own = near[at : at + ROWS]
                low, high, bound = cells.bounds(points[own])
                best = Best(x[own], sides, places_of, take, metric, None if limits is None else limits[own])
                for i in np.argsort(bound[:, held].mean(0), kind="stable"):
                    k, lo, hi = held[i], start[i], stop[i]
                    within = reach(best.limit, metric, x.shape[1])
                    some = np.flatnonzero(bound[:, k] <= within)
                    if len(some):
                        slack = 1e-9 * (1 + high[some, k] + r[hi - 1])
                        ends = (low[some, k] - within[some] - slack).min(), (high[some, k] + within[some] + slack).max()
                        lo, hi = lo + np.searchsorted(r[lo:hi], ends[0], "left"), lo + np.searchsorted(r[lo:hi], ends[1], "right")
                        best.offer(lo, hi, None if len(some) == len(own) else some)
                        total += max(0, hi - lo) * len(some)
                q, c, d = best.settle()
                hits.append((ords[own][q], c, d, places(q)))
                if tell:
                    inside = bound <= reach(best.limit, metric, x.shape[1])[:, None]
                    reached = np.zeros((len(own), first[-1] + parts[-1]), bool)
                    for k in np.flatnonzero(inside.any(0)):
                        reached[:, first[k] : first[k] + parts[k]] |= inside[:, k : k + 1]
                    reached[:, shard] = False
                    others = pa.ListArray.from_arrays(pa.array(np.append(0, reached.sum(1).cumsum()), pa.int32()), pa.array(np.nonzero(reached)[1], pa.int32()))
                    told.append(rows(len(own), channel=np.full(len(own), channel), ord=ords[own], vec=a["vec"].take(pa.array(own)), reach=best.limit, others=pa.chunked_array([others]), inside=inside @ cells.n))
            asked, c, d, rank = (np.concatenate(h) for h in zip(*hits, strict=True))
            if len(np.unique(ords)) < len(ords):
                at = same_places(asked, d, places_of[c], take)
                asked, c, d = asked[at], c[at], d[at]
                rank = places(asked)
            found = rows(len(c), channel=np.full(len(c), channel), ord=asked, rank=rank, dist=d, train_ord=places_of[c], **{n: b[n].take(pa.array(order[c])) for n in carry})
            return pa.concat_tables([found, *told, rows(1, channel=[channel], ord=ords[:1], measured=[total])])

        parts_of = lambda size: F.ceil(F.count(F.lit(1)) / size)
        grid = asked.groupBy("channel", "shard").agg(F.greatest(parts_of(BLOCK), F.least(F.lit(PARTS), parts_of(PART))).cast("int").alias("qs"))
        grid = stored(grid, "grid")  # a row for each shard
        left = asked.join(F.broadcast(grid), ["channel", "shard"]).withColumn("q", F.pmod(F.xxhash64("ord"), F.col("qs")).cast("int"))
        right = self.cells.join(F.broadcast(self.dealt), ["channel", "cell"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("ord"), F.col("parts"))).cast("int"))
        right = right.join(F.broadcast(grid), ["channel", "shard"]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
        # The small tables stand on both sides; columns of its own keep the sides apart.
        left, right = (side.select(*[F.col(c).alias(c) for c in side.columns if c not in ("qs", "first", "parts")]) for side in (left, right))
        return met(left, right, ["channel", "shard", "q"], grid.agg(F.sum("qs")).first()[0] or 1).applyInArrow(search, schema)

    def nearest(self, queries: DataFrame, k: int, skip_first: bool = False) -> DataFrame:
        """The rows of neighbours.nearest. `self.share` is the share of all pairs that were measured."""
        take, columns = k + skip_first, ["channel", "ord", "rank", "dist", "train_ord", *self.carry]
        asked = self._homes(queries)
        found = stored(self._met(asked, take, tell=not self.whole), "found")
        sums = [found.agg(F.sum("measured")).first()[0]]
        hits = found.where("train_ord IS NOT NULL").select(*columns)
        if not self.whole:
            further = found.where("size(others) > 0").select("channel", "ord", "vec", "reach", F.explode("others").alias("shard"))
            more = stored(self._met(further, take), "found")
            sums.append(more.agg(F.sum("measured")).first()[0])
            hits = hits.unionByName(more.where("train_ord IS NOT NULL").select(*columns))
        pairs = sum(r["count"] * int(self.about[r["channel"]][0].n.sum()) for r in asked.groupBy("channel").count().collect())
        self.share = sum(s or 0 for s in sums) / pairs if pairs else 0.0
        return ranked(hits, take, skip_first, self.whole)

    def plan(self, queries: DataFrame, take: int) -> DataFrame:
        """channel, ord, reach and inside, the number of vectors in the cells within it, of queries that have met their own shard."""
        told = self._met(self._homes(queries), take, tell=True).where("inside IS NOT NULL")
        return stored(told.select("channel", "ord", "reach", "inside"), "plan")

    def worth(self, plan: DataFrame, n_queries: int) -> bool:
        """Whether the cells that a plan reads hold less than the share WORTH of all pairs."""
        planned = plan.agg(F.sum("inside")).first()[0] or 0
        return planned < WORTH * n_queries * self.size / max(1, len(self.about))


def _home(points: np.ndarray, cells: Cells) -> np.ndarray:
    """The cell of the nearest pivot of each point."""
    return np.concatenate([np.zeros(0, np.int64), *[squared(points[i : i + 2048], cells.pivots)[0].argmin(1) for i in range(0, len(points), 2048)]])


def _shards(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For cells of n vectors, in order, the first shard of each and the number of shards, where a shard has about `most` vectors."""
    first, parts = np.zeros(len(n), np.int64), np.maximum(1, -(-n // most))
    shard, held = -1, most
    for i, m in enumerate(n):
        if parts[i] > 1 or held + m > most:
            shard, held = shard + int(parts[i]), 0 if parts[i] == 1 else most
        first[i], held = shard - parts[i] + 1, held + m
    return first, parts


def nearest_any(queries: DataFrame, reference: DataFrame, k: int, metric: str = "l2", skip_first: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of neighbours.nearest; a reference that is too large to be sent to all tasks is indexed where that pays."""
    numbers = reference.select(F.sum(F.size("vec"))).first()[0] or 0
    return (nearest if numbers <= BROADCAST else nearest_pruned)(queries, reference, k, metric, skip_first, carry)


def nearest_pruned(queries: DataFrame, reference: DataFrame, k: int, metric: str = "l2", skip_first: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of neighbours.nearest by an index of the reference, or by blocks where the index leaves too many pairs. Both sides are stored, since they are read several times."""
    columns = lambda *more: [F.col(c).alias(c) for c in ("channel", "ord", "vec", *more)]
    queries, reference = stored(queries.select(*columns()), "queries"), stored(reference.select(*columns(*carry)), "reference")
    index = MetricIndex(reference, metric, carry)
    sample = queries.where(F.pmod(F.xxhash64("ord", F.lit("plan")), F.lit(64)) == 0)
    n = sample.count()
    if n and not index.worth(index.plan(sample, k + skip_first), n):
        return nearest(queries, reference, k, metric, skip_first, carry)
    return index.nearest(queries, k, skip_first)
