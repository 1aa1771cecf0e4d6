"""Writers of result tables."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame

from siftwave.sources.npz import write_npz

__all__ = ["write_csv", "write_features", "write_ids", "write_json", "write_npz"]


def write_csv(df: DataFrame, path: str) -> None:
    """A table with header whose cells double their quotes."""
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_ids(ids: DataFrame, path: str) -> None:
    """One id per line in the order of the frame, which must be sorted; one file."""
    ids.select("id").coalesce(1).write.mode("overwrite").text(path)


def write_features(features: DataFrame, path: str) -> None:
    """Long features, one folder per channel, so that a view reads only its own."""
    features.write.partitionBy("channel").mode("overwrite").parquet(path)


def write_json(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON file of the driver; NaN for a metric without a value."""
    record = row.limit(1).collect()[0].asDict(recursive=True)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump({k: math.nan if v is None else v for k, v in record.items()}, f, indent=2, ensure_ascii=False, default=str)
