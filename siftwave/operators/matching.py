"""Joins of id lists with features: list order and duplicates are kept, of equal feature ids the last counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siftwave.tables import stored


def latest_by_id(features: DataFrame) -> DataFrame:
    """The rows of each id's last sample in source order (all channels of it, where features are long)."""
    last = features.groupBy("id").agg(F.max("ord").alias("ord"))
    return features.join(last, ["id", "ord"], "left_semi")


def match_ids(ids: DataFrame, features: DataFrame) -> DataFrame:
    """features of the listed ids with `ord`, the place in the list, and `source_ord`, the place in the features.

    ids: ord and id. An id that is listed twice comes twice; one without features is left out.
    """
    found = latest_by_id(features).withColumnRenamed("ord", "source_ord")
    return ids.select("ord", "id").join(found, "id")


def missing_ids(ids: DataFrame, features: DataFrame) -> DataFrame:
    """ord and id of listed ids that have no features."""
    return ids.select("ord", "id").join(features.select("id").distinct(), "id", "left_anti")


def missing_report(ids: DataFrame, features: DataFrame, show: int = 5) -> DataFrame:
    """One row: how many listed ids have no features, and the first few of them."""
    numbered = missing_ids(ids, features).select(F.struct("ord", "id").alias("m"))
    first = numbered.orderBy("m").limit(show).select("m", F.lit(0).alias("n"))
    both = numbered.agg(F.count(F.lit(1)).alias("n")).select(F.lit(None).cast(numbered.schema["m"].dataType).alias("m"), F.col("n").cast("long"))
    return first.select("m", F.col("n").cast("long")).unionByName(both).agg(F.sum("n").alias("n_missing"), F.transform(F.sort_array(F.collect_list("m")), lambda x: x["id"]).alias("first_ids"))


def drop_unlabelled(samples: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """samples with a label, and one row with the number of samples without one."""
    return samples.where(F.col(label).isNotNull()), samples.select(F.count_if(F.col(label).isNull()).alias("n_dropped"))


@dataclass(frozen=True)
class Matched:
    """A list's features as a stored table, and what was counted while it was written."""

    rows: DataFrame
    n_missing: int
    first_missing: list[str]
    n_unlabelled: int


def match_and_count(ids: DataFrame, features: DataFrame, name: str, show: int = 5, **columns: Column) -> Matched:
    """match_ids with further columns, stored; listed ids without features and samples with a null `label` are left out.

    Both are counted by the job that writes the table. Only where ids are missing, the first few are
    looked up in it. A sample counts once for each time it is listed.
    """
    found = latest_by_id(features).withColumnRenamed("ord", "source_ord")
    joined = ids.select("ord", "id").join(found, "id", "left").withColumns(columns)
    there, plain = F.col("source_ord").isNotNull(), "label" not in columns
    counted = Observation(name)
    first = F.col("channel") == 0 if "channel" in features.columns else F.lit(True)
    unlabelled = F.lit(False) if plain else there & F.col("label").isNull()
    table = stored(joined.observe(counted, F.count_if(~there).alias("missing"), F.count_if(unlabelled & first).alias("unlabelled")), name)
    lost = counted.get
    missing = [r["id"] for r in table.where(~there).orderBy("ord", "id").limit(show).collect()] if lost["missing"] else []
    return Matched(table.where(there if plain else there & F.col("label").isNotNull()), lost["missing"], missing, lost["unlabelled"])
