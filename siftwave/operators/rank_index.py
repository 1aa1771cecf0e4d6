"""Ranks of new numbers among stored ones: sorted runs with how many numbers lie before each, written once.

A lookup finds a number's run by the runs' lowest values, and joins with the runs of its own rows
only; the stored numbers are neither sorted again nor copied.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.tables import stored

RUN = 4096  # numbers of a run, at least
RUNS = 65_536  # runs of a key, at most: their lowest values are sent to all tasks
SLOTS = 1024  # folders of a key that runs are kept in, at most


class RankIndex:
    """Runs of `scores` (channel, raw), by channel. Null numbers have no rank and are left out."""

    def __init__(self, scores: DataFrame, run: int = RUN):
        spark = self.spark = scores.sparkSession
        scores = scores.where("raw IS NOT NULL").select("channel", "raw")
        ordered = scores.repartitionByRange("channel", "raw").sortWithinPartitions("channel", "raw").withColumn("_at", F.monotonically_increasing_id())
        ordered = stored(ordered, "ordered").withColumn("_part", F.shiftright("_at", 33))
        parts = ordered.groupBy("channel", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
        every = Window.partitionBy("channel")
        before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shifts = parts.select("channel", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(every).alias("_total"))
        placed = ordered.join(shifts, ["channel", "_part"]).withColumn("_place", F.col("_at") + F.col("_shift"))
        size = F.greatest(F.lit(run), F.ceil(F.col("_total") / RUNS)).cast("long")
        placed = placed.withColumn("run", F.floor(F.col("_place") / size).cast("int"))
        per_slot = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("_total") / size) / SLOTS)).cast("int")
        runs = placed.groupBy("channel", "run", F.floor(F.col("run") / per_slot).cast("int").alias("slot")).agg(F.min("_place").alias("before"), F.max("_total").alias("total"), F.sort_array(F.collect_list("raw")).alias("numbers"))
        written = stored(runs, "runs")
        self.folder = f"{written.stored_at}-by-slot"
        written.repartition("channel", "slot").sortWithinPartitions("run").write.partitionBy("channel", "slot").parquet(self.folder)
        self.schema = "run int, before long, total long, numbers array<double>, channel int, slot int"
        heads = written.select("channel", "run", "slot", F.get("numbers", 0).alias("low"), F.size("numbers").alias("n")).orderBy("channel", "run").toPandas()  # a row for each run
        self.heads = {int(c): (h["low"].to_numpy(), h["slot"].to_numpy()) for c, h in heads.groupby("channel")}
        self.longest = int(heads["n"].max()) if len(heads) else 0

    def runs(self, needed: DataFrame | None = None) -> DataFrame:
        """Stored runs; needed: rows with channel and slot, whose folders alone are read."""
        if not self.heads:
            return self.spark.createDataFrame([], self.schema)
        table = self.spark.read.schema(self.schema).parquet(self.folder)
        if needed is None:
            return table
        slots = {}
        for r in needed.select("channel", "slot").distinct().collect():  # SLOTS for each channel, at most
            slots.setdefault(r["channel"], []).append(r["slot"])
        wanted = F.lit(False)
        for c, s in slots.items():
            wanted = wanted | ((F.col("channel") == c) & F.col("slot").isin(s))
        return table.where(wanted)

    def ranked(self, rows: DataFrame) -> DataFrame:
        """rows (with channel and raw) with n_upto, the stored numbers of their channel that are not larger, and n_stored, all of them.

        Rows of channels without stored numbers are left out. The rows are stored once, since they
        say which runs are read.
        """
        shared = self.spark.sparkContext.broadcast(self.heads)

        @F.pandas_udf("run int, slot int")
        def place(channel: pd.Series, raw: pd.Series) -> pd.DataFrame:
            run, slot = np.full(len(raw), -1), np.full(len(raw), -1)
            for c in channel.unique():
                if c in shared.value:
                    own = (channel == c).to_numpy()
                    low, slots = shared.value[c]
                    run[own] = np.maximum(np.searchsorted(low, raw[own].to_numpy(), "right") - 1, 0)
                    slot[own] = slots[run[own]]
            return pd.DataFrame({"run": run, "slot": slot})

        columns = [F.col(c) for c in rows.columns]
        found = stored(rows.where("raw IS NOT NULL").select(*columns, place("channel", "raw").alias("_at")), "lookups").where("_at.run >= 0")
        runs = self.runs(found.select("channel", "_at.slot")).select("channel", F.col("run").alias("_run"), "before", "total", "numbers")
        joined = found.join(runs.withColumnRenamed("channel", "_channel"), (F.col("channel") == F.col("_channel")) & (F.col("_at.run") == F.col("_run")))
        return joined.select(*columns, (F.col("before") + upto("numbers", "raw", self.longest)).alias("n_upto"), F.col("total").alias("n_stored"))


def upto(numbers: str, raw: str, longest: int) -> Column:
    """How many of the sorted numbers, `longest` at most, are not larger than raw, by halving: a few steps for each row, however long the run is."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, longest.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(numbers, at + step - 1) <= F.col(raw), step).otherwise(0))
