"""Sample windows, pooling, and encoders that turn a channel's signal into a vector."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.operators.encoders import Encoder, segments


def remove_dc(samples: DataFrame) -> DataFrame:
    """samples (key, pos, x) less the mean of their key."""
    mean = samples.groupBy("key").agg(F.avg("x").alias("_m"))
    return samples.join(mean, "key").select("key", "pos", (F.col("x") - F.col("_m")).alias("x"))


def windows(samples: DataFrame, length: int) -> DataFrame:
    """(key, win, pos, x): full windows of `length`, and one over the last `length` samples if some are left over.

    Positions count from 0 without gaps. A series that is not longer than `length` is one short window.
    """
    sizes = samples.groupBy("key").agg(F.count(F.lit(1)).alias("t"))
    full, rest = F.floor(F.col("t") / length), F.col("t") % length
    own = F.when(F.col("pos") < full * length, F.floor(F.col("pos") / length))
    tail = F.when((rest > 0) & (F.col("pos") >= F.greatest(F.col("t") - length, F.lit(0))), full)
    return samples.join(sizes, "key").select("key", F.explode(F.array_compact(F.array(own, tail))).alias("win"), "pos", "x")


def pool_windows(windowed: DataFrame) -> DataFrame:
    """Per window: samples, mean and root mean square."""
    return windowed.groupBy("key", "win").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def combine_channels(features: DataFrame, how: str = "concatenate") -> DataFrame:
    """ord and one vector per sample: concatenate, average, first or last over its channels."""
    g = features.groupBy("ord")
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("channel", "vec"))), lambda s: s["vec"])
    if how == "concatenate":
        return g.agg(F.flatten(in_order).alias("vec"))
    if how == "average":
        flat = features.select("ord", F.posexplode("vec").alias("pos", "x")).groupBy("ord", "pos").agg(F.avg("x").alias("x"))
        return flat.groupBy("ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vec"))
    if how in ("first", "last"):
        return g.agg((F.min_by if how == "first" else F.max_by)("vec", "channel").alias("vec"))
    raise ValueError(f"how must be concatenate, average, first or last, not {how!r}")


def encode_series(samples: DataFrame, make_encoder, length: int, rate: int) -> DataFrame:
    """key, vec, error of long series (key, pos, x): windows are cut, gathered and encoded one by one, then averaged.

    A window is the largest group that is gathered, however long a series is. A key with a failing
    window keeps the error.
    """
    cut = windows(samples, length).groupBy("key", "win").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("samples"))

    return _encoded_windows(cut.withColumn("rate", F.lit(rate)), make_encoder, length, samples.schema["key"].dataType.simpleString())


def encode_blocks(blocks: DataFrame, make_encoder, length: int = 160_000) -> DataFrame:
    """key, vec, error of series in blocks (key, rate, start, samples): encode_signals of each whole series, window by window.

    Pieces of blocks go to the windows that hold them, those at the end also to the overlapping last
    one; a window is all that a task holds of a series. A key with a failing window keeps the error.
    """
    stop, sizes = F.col("start") + F.size("samples"), blocks.groupBy("key").agg(F.sum(F.size("samples")).alias("t"))
    held = blocks.where(F.size("samples") > 0).select("key", "rate", "start", stop.alias("stop"), "samples").join(sizes, "key")
    whole, rest = F.floor(F.col("t") / length), F.col("t") % length
    first, final = F.floor(F.col("start") / length), F.least(F.floor((F.col("stop") - 1) / length), whole - 1)
    window = lambda n, a, z: F.struct(n.cast("long").alias("win"), a.cast("long").alias("a"), z.cast("long").alias("z"))
    full = F.when(final >= first, F.transform(F.sequence(first, final), lambda n: window(n, n * length, (n + 1) * length))).otherwise(F.array())
    tail_from = F.greatest(F.col("t") - length, F.lit(0))
    tail = F.when((rest > 0) & (F.col("stop") > tail_from), F.array(window(whole, tail_from, F.col("t")))).otherwise(F.array())
    cut = held.select("key", "rate", "start", "stop", "samples", F.explode(F.concat(full, tail)).alias("w"))
    a, z = F.greatest("start", "w.a"), F.least("stop", "w.z")
    pieces = cut.where(z > a).select("key", "rate", "w.win", a.alias("a"), F.slice("samples", (a - F.col("start") + 1).cast("int"), (z - a).cast("int")).alias("s"))
    windows_ = pieces.groupBy("key", "rate", "win").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("a", "s"))), lambda p: p["s"])).alias("samples"))
    return _encoded_windows(windows_, make_encoder, length, blocks.schema["key"].dataType.simpleString())


def _encoded_windows(cut: DataFrame, make_encoder, length: int, kind: str) -> DataFrame:
    """key, vec, error of windows (key, rate, samples), averaged by key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for b in batches:
            out = [_encoded(encoder, s, r, length) for s, r in zip(b["samples"], b["rate"], strict=True)]
            yield pd.DataFrame({"key": b["key"], "vec": [v for v, _ in out], "error": [e for _, e in out]})

    encoded = cut.select("key", "rate", "samples").mapInPandas(run, f"key {kind}, vec array<double>, error string")
    flat = encoded.select("key", "error", F.posexplode_outer("vec").alias("at", "x")).groupBy("key", "at").agg(F.avg("x").alias("x"), F.max("error").alias("error"))
    whole = flat.groupBy("key").agg(F.max("error").alias("error"), F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "x")))).alias("v"))
    return whole.select("key", F.when(F.col("error").isNull(), F.transform("v", lambda s: s["x"])).alias("vec"), "error")


def with_layout(encoded: DataFrame, per_channel: bool, how: str = "concatenate") -> DataFrame:
    """Encoded signals (id, ord, channel, vec) as long features, or as one combined vector x for each sample."""
    if per_channel:
        return encoded
    return encoded.select("ord", "id").distinct().join(combine_channels(encoded, how).withColumnRenamed("vec", "x"), "ord")


def encode_signals(signals: DataFrame, make_encoder, length: int = 160_000) -> DataFrame:
    """id, channel, vec, error for signals (id, channel, rate, samples).

    A signal's windows are encoded and averaged. A failing row keeps its error and a null vector, so
    that one bad file does not stop a job. make_encoder: called once in each task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for b in batches:
            out = [_encoded(encoder, s, r, length) for s, r in zip(b["samples"], b["rate"], strict=True)]
            yield pd.DataFrame({"id": b["id"], "channel": b["channel"], "vec": [v for v, _ in out], "error": [e for _, e in out]})

    return signals.select("id", "channel", "rate", "samples").mapInPandas(run, "id string, channel int, vec array<double>, error string")


def _encoded(encoder: Encoder, samples, rate, length: int):
    try:
        x = np.nan_to_num(np.asarray(samples, float), nan=0.0, posinf=0.0, neginf=0.0)
        if not len(x):
            raise ValueError("empty signal")
        return np.mean([encoder.encode(c, int(rate)) for c in segments(x, length)], axis=0), None
    except (TypeError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"
