"""Winnowing: fingerprints of texts that keep a hash for every shared passage of a guaranteed length.

Every run of `k` code points is hashed by a rolling polynomial. Of every `window` consecutive hashes
the smallest is kept, the rightmost of equal ones, with its position. Two texts that share k + window
- 1 consecutive code points therefore keep a common hash, whatever surrounds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.blocks import mix
from siftwave.llm.storage import shards

K = 24  # code points of a hashed run
WINDOW = 41  # consecutive hashes of which one is kept: passages of 64 code points are found
PLACE = 20  # bits of a place; the other 44 are the hash
PIECE = 1 << 18  # hashes that are worked on at once, fewer than 2**PLACE with a window more
SHARD = 16_000_000  # bytes of text in a run of neighbours
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        _POWERS[size] = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b, np.uint64)), dtype=np.uint64) for b in (BASE, inverse))
    up, down = _POWERS[size]
    return up[:n], down[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def run_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """44-bit hashes of all runs of k code points; of the whole text if it is shorter and not empty."""
    k = min(k, len(codes))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.empty(len(codes) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(out), PIECE):
            part = codes[at : at + PIECE + k - 1].astype(np.uint64) + np.uint64(1)
            up, down = _powers(len(part))
            # The sum over c[j] * BASE**-j up to each place; a run is the difference of two, moved to one scale.
            sums = np.append(np.uint64(0), np.cumsum(part * down, dtype=np.uint64))
            n = len(part) - k + 1
            out[at : at + n] = mix((sums[k:] - sums[:-k]) * up[:n]) >> np.uint64(PLACE)
    return out


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ascending positions of the smallest of every `window` consecutive hashes, the rightmost of equal ones.

    Fewer hashes than a window count as one window.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    kept = []
    for at in range(0, n - window + 1, PIECE):
        # Below each hash stands its place from the right, so that the smallest number is the rightmost smallest hash.
        h = hashes[at : at + PIECE + window - 1]
        low, span = h << np.uint64(PLACE) | np.arange(2**PLACE - 1, 2**PLACE - 1 - len(h), -1, dtype=np.uint64), 1
        while span < window:  # the minimum of 2 * span hashes is that of two halves; at last they overlap
            step = min(span, window - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        low = low[np.append(True, low[1:] != low[:-1])] & np.uint64(2**PLACE - 1)
        kept.append(at + 2**PLACE - 1 - low.astype(np.int64))
    out = np.concatenate(kept)
    return out[np.append(True, out[1:] != out[:-1])]


def fingerprint(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in code points) and hashes that the text keeps; none for an empty text."""
    hashes = run_hashes(code_points(text), k)
    at = winnow(hashes, window)
    return at, hashes[at]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared among all of two sets of distinct hashes; 1 for two empty ones."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def written(at: np.ndarray, hashes: np.ndarray) -> str:
    """position:hash for each kept hash, the hash as 11 hexadecimal digits."""
    return " ".join([f"{p}:{h:011x}" for p, h in zip(at.tolist(), hashes.tolist(), strict=True)])


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edited_hashes(codes: np.ndarray, hashes: np.ndarray, next_codes: np.ndarray, next_hashes: np.ndarray, k: int) -> np.ndarray:
    """run_hashes of the edited text: those of both sides are known, only runs across the seam are hashed."""
    keep = len(codes) - len(codes) // 2
    tail = next_codes[: len(codes) // 2]
    if keep + len(tail) < k:
        return run_hashes(np.concatenate([codes[:keep], tail]), k)
    start, beyond = max(0, keep - k + 1), max(0, len(tail) - k + 1)
    seam = np.concatenate([codes[start:keep], tail[: k - 1]])
    return np.concatenate([hashes[:start], run_hashes(seam, k) if len(seam) >= k else hashes[:0], next_hashes[:beyond]])


def with_following(docs: DataFrame, size: int = SHARD) -> DataFrame:
    """Documents dealt so that each partition holds consecutive ones by falling doc_id, in that order.

    Columns doc_id, text and lead. A partition ends with a copy of the next one's first document,
    marked by lead; after the last comes the first. So texts are shuffled once, and no order over all
    documents meets in one task. Null ids come last. Documents of one id stay in the order in which
    docs is read, so docs must be a table, which Spark reads in the same order each time; that order
    also deals a hot id over many partitions.
    """
    spark = docs.sparkSession
    parts = shards(docs, size=size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A key that ascends: null last, complements of ids, and the row's number, which makes it unique.
    rows = rows.withColumns({"none": F.col("doc_id").isNull().cast("int"), "down": F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "row": F.monotonically_increasing_id()})
    keys = rows.select("none", "down", "row").repartitionByRange(parts, "none", "down", "row")
    first = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("none", "down", "row")).alias("key"))
    heads = np.array(sorted(tuple(r["key"]) for r in first.collect()), np.int64).reshape(-1, 3)  # one for each partition
    held = spark.sparkContext.broadcast(heads)

    @F.pandas_udf("long")
    def bucket(none: pd.Series, down: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series(place_keys(none.to_numpy(), down.to_numpy(), row.to_numpy(), held.value))

    at = F.struct(F.shiftright("_b", 1).cast("int").alias("bucket"), F.lit(False).alias("lead"))
    before = F.struct(F.pmod(F.shiftright("_b", 1) - 1, F.lit(max(1, len(heads)))).cast("int").alias("bucket"), F.lit(True).alias("lead"))
    copies = F.when(F.col("_b") % 2 == 1, F.array(at, before)).otherwise(F.array(at))
    dealt = rows.withColumn("_b", bucket("none", "down", "row")).select("doc_id", "none", "down", "row", F.explode(copies).alias("to"), "text").select("doc_id", "none", "down", "row", "to.*", "text")
    return dealt.repartitionById(max(1, len(heads)), "bucket").sortWithinPartitions("lead", "none", "down", "row").select("doc_id", "text", "lead")


def place_keys(none: np.ndarray, down: np.ndarray, row: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Twice the partition of each key, plus 1 for the key that heads it; heads: the first key of each, ascending."""
    known = int((heads[:, 0] == 0).sum())
    low = np.where(none == 0, np.searchsorted(heads[:known, 1], down, "left"), known)
    high = np.where(none == 0, np.searchsorted(heads[:known, 1], down, "right"), len(heads))
    out = low - 1
    head = np.zeros(len(out), bool)
    for a in np.unique(low[high > low]):  # ids that head a partition, so at most as many as there are
        own = (low == a) & (high > low)
        z = high[own][0]
        out[own] = a - 1 + np.searchsorted(heads[a:z, 2], row[own], "right")
        head[own] = np.isin(row[own], heads[a:z, 2])
    return 2 * out + head


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_rows(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """The digest columns of op13 for docs (doc_id, text); other columns are not read.

    A null text is empty; an empty text has no hashes, and two empty fingerprints are alike. A text
    shorter than k code points is one run, one with fewer runs than a window keeps one hash. Very
    long texts are worked on piece by piece. A single document follows itself. An empty table gives
    no rows. Equal texts have equal fingerprints, whatever their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                codes = code_points(text)
                hashes = run_hashes(codes, k)
                at = winnow(hashes, window)
                now = (doc_id, text, codes, hashes, at, written(at, hashes[at]), np.unique(hashes[at]))
                if last is not None:
                    out.append(_row(last, now, k, window))
                last = now
            if out:
                yield pa.RecordBatch.from_pylist(out, NAMED)

    return with_following(docs).mapInArrow(run, SCHEMA)


NAMED = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t]) for n, t in (f.split() for f in SCHEMA.split(", "))])


def _row(own: tuple, following: tuple, k: int, window: int) -> dict:
    doc_id, text, codes, hashes, _, fingerprint, kept = own
    changed = _edited_hashes(codes, hashes, following[2], following[3], k)
    at = winnow(changed, window)
    digest = hashlib.sha256(edited(text, following[1]).encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(kept, np.unique(changed[at])), likeness(kept, following[6])
    return dict(zip(NAMED.names, (doc_id, len(codes), digest, fingerprint, written(at, changed[at]), *near), strict=True))
