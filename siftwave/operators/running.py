"""Running sums over an order, dealt over range partitions: no key's rows have to be sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.tables import stored


class Ordered:
    """Rows of df, one per (by, order), in range partitions of that order, stored with the partition's number.

    A running sum inside a partition is a window over that partition; what lies before it is the sum
    of the totals of the earlier partitions, a table of keys times partitions that is broadcast.
    """

    def __init__(self, df: DataFrame, by: str, order: str, descending: bool = False):
        self.by, self.rank = by, -F.col(order) if descending else F.col(order)
        key = F.desc(order) if descending else F.asc(order)
        self.rows = stored(df.repartitionByRange(F.col(by), key).withColumn("_part", F.spark_partition_id()), "ordered")
        self.inside = Window.partitionBy(by, "_part").orderBy(key)

    def before_parts(self, rows: DataFrame, **sums: Column) -> DataFrame:
        """For each key and partition the sums over its earlier partitions, and over all of them as total_<name>."""
        totals = rows.groupBy(self.by, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
        every = Window.partitionBy(self.by)
        earlier = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = [F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums]
        return totals.select(self.by, "_part", *before, *[F.sum(n).over(every).alias(f"total_{n}") for n in sums])

    def sums(self, rows: DataFrame | None = None, **sums: Column) -> DataFrame:
        """rows with <name>, the running sum up to and with each row, and total_<name>."""
        rows = self.rows if rows is None else rows
        before = F.broadcast(self.before_parts(rows, **sums))
        upto = self.inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = rows.select("*", *[F.sum(c).over(upto).alias(f"_{n}") for n, c in sums.items()]).join(before, [self.by, "_part"])
        added = {n: F.col(f"_{n}") + F.col(f"before_{n}") for n in sums}
        return running.withColumns(added).drop(*[f"_{n}" for n in sums], *[f"before_{n}" for n in sums])

    def following(self, rows: DataFrame, *names: str) -> DataFrame:
        """rows with next_<name>, the value in the key's next row, or null in its last."""
        first = rows.groupBy(self.by, "_part").agg(*[F.min_by(n, self.rank).alias(n) for n in names])
        later = Window.partitionBy(self.by).orderBy("_part")
        beyond = first.select(self.by, "_part", *[F.lead(n).over(later).alias(f"_beyond_{n}") for n in names])
        out = rows.withColumns({f"next_{n}": F.lead(n).over(self.inside) for n in names}).join(F.broadcast(beyond), [self.by, "_part"])
        return out.withColumns({f"next_{n}": F.coalesce(f"next_{n}", f"_beyond_{n}") for n in names}).drop(*[f"_beyond_{n}" for n in names])
