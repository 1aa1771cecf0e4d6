"""Long series in blocks that carry their neighbours' edge samples, so that filters and frames know no borders.

Blocks begin at multiples of a length. A filter that looks `left` samples back and `right` ahead gets
them with each block (overlap-save); its phase follows from where the block begins. What comes out
of the blocks is what the whole series gives, and no task holds more than a block and its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.operators.encoders import filter_steps, frame_sizes, frames, resample_filter

LENGTH = 160_000  # samples of a block


def blocks_of_series(series: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, start, samples) of a long series (key, pos, x) whose positions count from 0 without gaps."""
    cut = series.groupBy("key", F.expr(f"pos div {length}").alias("n")).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("s"))
    return cut.select("key", F.get("s", 0)["pos"].alias("start"), F.transform("s", lambda v: v["x"]).alias("samples"))


def with_halo(blocks: DataFrame, length: int, left: int, right: int) -> DataFrame:
    """(key, n, lead, own, last, samples): blocks of `length` samples from n * length on, with edges.

    blocks: key, start and samples, pieces of any sizes that cover a series once; each piece is sent
    to the blocks whose samples or edges it holds. `samples` are the block's `own` samples with
    `lead` (at most left) before and at most right behind them, fewer where the series ends; last
    marks the block that ends it. Empty pieces vanish, and a key without samples has no blocks.
    """
    if min(length, left + 1, right + 1) < 1:
        raise ValueError("blocks need a positive length and edges of no negative one")
    stop = F.col("start") + F.size("samples")
    first = F.greatest(F.floor((F.col("start") - right) / length), F.lit(0)).cast("long")
    final = F.floor((stop - 1 + left) / length).cast("long")
    spread = blocks.where(F.size("samples") > 0).select("key", "start", "samples", F.explode(F.sequence(first, final)).alias("n"))
    a, z = F.greatest(F.col("start"), F.col("n") * length - left), F.least(F.col("start") + F.size("samples"), (F.col("n") + 1) * length + right)
    pieces = spread.where(z > a).select("key", "n", a.alias("a"), F.slice("samples", (a - F.col("start") + 1).cast("int"), (z - a).cast("int")).alias("s"))
    whole = pieces.groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("a", "s"))).alias("g"))
    whole = whole.select("key", "n", F.get("g", 0)["a"].alias("a"), F.flatten(F.transform("g", lambda p: p["s"])).alias("samples"))
    size = F.size("samples")
    lead = (F.col("n") * length - F.col("a")).cast("int")
    own = F.least(size - lead, F.lit(length))
    # A block of edges alone stands behind the end of a series.
    last = F.lead("n").over(Window.partitionBy("key").orderBy("n")).isNull()
    kept = whole.select("key", "n", lead.alias("lead"), own.alias("own"), "samples").where("own > 0")
    return kept.withColumn("last", last).select("key", "n", "lead", "own", "last", "samples")


def resampled(blocks: DataFrame, rate: int, target: int = 16_000, length: int = LENGTH) -> DataFrame:
    """Blocks (key, start, samples) at another rate: encoders.resample of each whole series, whatever its pieces."""
    step, made, width, kernel = resample_filter(rate, target)
    if step == made:
        return blocks.where(F.size("samples") > 0).select("key", "start", "samples")
    # Blocks of whole steps keep the filter's phase: each begins where its first output does.
    length = max(1, -(-max(length, width + step) // step)) * step
    kind = blocks.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, lead, own, x in zip(b["n"], b["lead"], b["own"], b["samples"], strict=True):
                x = np.concatenate([np.zeros(width - lead), np.asarray(x, float)])
                x = np.concatenate([x, np.zeros(max(0, width + own + width + step - len(x)))])[: width + own + width + step]
                out.append((n * (length // step) * made, filter_steps(x, kernel, width, step)[: -(-made * own // step)]))
            yield pd.DataFrame({"key": b["key"], "start": [s for s, _ in out], "samples": [x for _, x in out]})

    halo = with_halo(blocks, length, width, width + step)
    return halo.select("key", "n", "lead", "own", "samples").mapInPandas(run, f"key {kind}, start long, samples array<double>")


def framed(blocks: DataFrame, width: int, hop: int, length: int = LENGTH) -> DataFrame:
    """(key, frame, samples): whole frames of `width` samples every `hop`, numbered over the series."""
    length = max(1, -(-length // hop)) * hop
    halo = with_halo(blocks, length, 0, max(0, width - 1))
    starts = F.sequence(F.lit(0), F.least(F.col("own") - 1, F.size("samples") - width), F.lit(hop))
    able = halo.where(F.size("samples") >= width).select("key", "n", "samples", F.explode(starts).alias("at"))
    return able.select("key", (F.col("n") * (length // hop) + F.expr(f"`at` div {hop}")).alias("frame"), F.slice("samples", F.col("at") + 1, F.lit(width)).alias("samples"))


def spectra(blocks: DataFrame, rate: int, length: int = LENGTH) -> DataFrame:
    """(key, frame, magnitudes): encoders.spectrum of each whole series less its mean."""
    width, hop = frame_sizes(rate)
    length = max(1, -(-length // hop)) * hop
    total = blocks.groupBy("key").agg((F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size("samples"))).alias("mean"))
    kind = blocks.schema["key"].dataType.simpleString()
    window = np.hanning(width + 1)[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, n, own, x, mean in zip(b["key"], b["n"], b["own"], b["samples"], b["mean"], strict=True):
                rows = np.abs(np.fft.rfft(frames(np.asarray(x, float) - mean, width, hop)[: -(-own // hop)] * window))
                if len(rows):
                    yield pd.DataFrame({"key": [key] * len(rows), "frame": n * (length // hop) + np.arange(len(rows)), "magnitudes": list(rows)})

    halo = with_halo(blocks, length, 0, width - 1).join(total, "key")
    return halo.select("key", "n", "own", "samples", "mean").mapInPandas(run, f"key {kind}, frame long, magnitudes array<double>")
