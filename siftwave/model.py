"""Channels, views, schemas and checks that all operators share.

The canonical form of features is long: one row per sample and channel, with the sample's place
`ord` in its source, so that one job covers all channels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_CHANNELS = 7
VIEWS = {"audio": (0, 1, 2), "vibration": (3, 4, 5, 6), "fused": (0, 1, 2, 3, 4, 5, 6)}
ALIASES = {
    **dict.fromkeys(("audio", "audiomean", "audio_mean"), "audio"),
    **dict.fromkeys(("vib", "vibration", "vib_mean", "vibrationmean", "vibration_mean"), "vibration"),
    **dict.fromkeys(("fused", "fusedmean", "fused_mean"), "fused"),
}
INDEX = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("paths", T.StringType()), T.StructField("split", T.StringType()), T.StructField("label", T.LongType()), T.StructField("vibration_sr", T.IntegerType())]
)


def resolve_views(names: str | list[str]) -> list[str]:
    """View names behind aliases, each once; ValueError for an unknown or empty list."""
    parts = names.split(",") if isinstance(names, str) else names
    wanted = [p.strip().lower() for p in parts if p.strip()]
    unknown = [w for w in wanted if w not in ALIASES]
    if unknown or not wanted:
        raise ValueError(f"views must be some of {sorted(ALIASES)}, not {names!r}")
    return list(dict.fromkeys(ALIASES[w] for w in wanted))


def views_table(spark, names=tuple(VIEWS)) -> DataFrame:
    """(view, channel, place): a table whose size the channel count fixes."""
    rows = [(v, c, i + 1, len(VIEWS[v])) for v in names for i, c in enumerate(VIEWS[v])]
    return spark.createDataFrame(rows, "view string, channel int, place int, n_channels int")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def channel_dims(features: DataFrame) -> DataFrame:
    """Per channel: rows, smallest and largest vector length."""
    size = F.size("vec")
    return features.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))


def require_single_dim(features: DataFrame) -> DataFrame:
    """features, after checking that each of the seven channels has one vector length."""
    bad = channel_dims(features).where("min_dim != max_dim or min_dim < 1").limit(5).collect()
    if bad:
        raise ValueError(f"channels with vectors of several lengths: {[r['channel'] for r in bad]}")
    return features
