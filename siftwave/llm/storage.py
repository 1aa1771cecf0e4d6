"""Small helpers that the operators share; tables in the shared folder cut lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftwave.llm.blocks import trim
from siftwave.tables import delete, discard, release, shared_dir, stored

HELD = 8_000_000  # bytes of a batch that become Python values at once

__all__ = ["delete", "discard", "fold_ascii", "hold_out", "let", "release", "schema_with", "shards", "shared_dir", "stored", "with_computed"]


def shards(docs: DataFrame, text: str = "text", size: int = 32_000_000) -> int:
    """How many pieces keyed binary state is dealt into: one for each `size` bytes of text, the session's shuffle partitions at least."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // size))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, inside a single projection."""
    return F.transform(F.array(value), body)[0]


def fold_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and every other character kept; null becomes empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def hold_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text modulo modulus (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def schema_with(df: DataFrame, **fields: str):
    """df's schema with more fields, given as name=type."""
    return df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in fields.items()]).schema


def with_computed(df: DataFrame, inputs: tuple[str, ...], work: Callable[..., Iterator[tuple]], drop: tuple[str, ...] = (), **fields: str) -> DataFrame:
    """df without the columns in drop, with fields (name=type) that work makes of the input columns.

    work gets a list for each input column of about HELD bytes of rows and yields (rows, values, ...), the places of
    these rows to give out, in any number, and a list for each field. All other columns stay in
    Arrow, so whole numbers beside a null and nested values come out as they went in.
    """
    kept = [c for c in df.columns if c not in fields and c not in drop]
    source = [*kept, *[c for c in inputs if c not in kept]]
    schema = schema_with(df.select(*[df[c] for c in kept]), **fields)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[len(kept) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in filter(len, batches):
            step = max(1, len(whole) * HELD // max(1, whole.nbytes))
            for b in (whole.slice(at, step) for at in range(0, len(whole), step)):
                for rows, *values in work(*[b.column(source.index(c)).to_pylist() for c in inputs]):
                    same = isinstance(rows, range) and rows == range(len(b))
                    held = [b.column(i) if same else b.column(i).take(pa.array(rows, pa.int64())) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*held, *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], [*kept, *fields])
            trim()

    return df.select(*[df[c] for c in source]).mapInArrow(run, schema)
