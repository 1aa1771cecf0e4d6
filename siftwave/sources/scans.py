"""Split scans of long recordings: many tasks read one file, each a range of its bytes.

Wave files are a data source of their own, whose ranges are aligned to frames. Vibration tables are
read by Spark's text reader, which splits files at line ends; a first pass over their lines finds
each file's dialect and how many rows lie before each split, a second one cuts the lines into numbers
without Python.
"""

from __future__ import annotations

import fnmatch
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwave.tables import stored

SPLIT = 4_000_000  # bytes of a wave file in a range
HEAD = 1 << 16  # bytes of a file that are read at once in search of its first line
FILES = 64  # files whose first lines a task looks for
CHUNK = 1 << 16  # frames in a row of the scan
FEW = 64_000_000  # bytes of a small table that is sent to all tasks, at most

# The format codes of PCM, IEEE float, and the code that says the real one follows.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Wave:
    """Where a wave file keeps its samples, and what they are."""

    code: int
    channels: int
    rate: int
    width: int
    start: int
    stop: int

    @property
    def frame(self) -> int:
        return self.channels * self.width


def wave_header(read: Callable[[int, int], bytes], size: int) -> Wave:
    """The header of a file of `size` bytes, of which read(offset, n) gives n; ValueError where it is none. A cut file ends at its last whole frame."""
    if read(0, 4) != b"RIFF" or read(8, 4) != b"WAVE":
        raise ValueError("no PCM wave file: no RIFF header")
    at, form = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            if length < 16:
                raise ValueError("no PCM wave file: short format chunk")
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if code == EXTENSIBLE and length >= 26:
                code = struct.unpack("<H", read(at + 32, 2))[0]
            form = (code, channels, rate, bits // 8)
        elif name == b"data":
            if form is None:
                raise ValueError("no PCM wave file: samples before their format")
            code, channels, rate, width = form
            if not channels or not rate or (code, width) not in {(PCM, 1), (PCM, 2), (PCM, 3), (PCM, 4), (FLOAT, 4), (FLOAT, 8)}:
                raise ValueError(f"no PCM wave file: format {code} of {8 * width} bits")
            # Streams write no length, or more than there is.
            whole = max(0, min(length, size - at - 8)) // (channels * width)
            return Wave(code, channels, rate, width, at + 8, at + 8 + whole * channels * width)
        at += 8 + length + length % 2
    raise ValueError("no PCM wave file: no samples")


def wave_samples(raw: bytes, w: Wave) -> np.ndarray:
    """Whole frames as the mean of their channels, in -1..1."""
    if w.code == FLOAT:
        x = np.frombuffer(raw, f"<f{w.width}").astype(float)
    elif w.width == 1:
        x = (np.frombuffer(raw, "u1").astype(float) - 128) / 128
    elif w.width == 3:
        b = np.frombuffer(raw, "u1").reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{w.width}") / 2.0 ** (8 * w.width - 1)
    return x.reshape(-1, w.channels).mean(1)


@dataclass
class Ranges(InputPartition):
    """(file, its size, first byte, byte behind the last) of what one task reads."""

    parts: list[tuple[str, int, int, int]]


BLOCKS = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("start", pa.int64()), ("samples", pa.list_(pa.float64())), ("error", pa.string())])


class WaveReader(DataSourceReader):
    suffix = ".wav"

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT))

    def partitions(self) -> list[Ranges]:
        """Only names and sizes are looked up here; headers are read by the tasks."""
        store, top = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        parts, held, size = [], [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(self.suffix)), key=lambda f: f.path):
            for a in range(0, max(f.size, 1), self.split):
                held.append((f.path, f.size, a, min(f.size, a + self.split)))
                size += held[-1][3] - a
                if size >= self.split:
                    parts.append(Ranges(held))
                    held, size = [], 0
        return parts + [Ranges(held)] * bool(held)

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a scan without files
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, size, a, z in partition.parts:
            with store.open_input_file(path) as f:
                try:
                    w = wave_header(lambda at, n, f=f: f.read_at(n, at), size)
                except (ValueError, struct.error) as e:
                    if a == 0:
                        yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], BLOCKS)
                    continue
                # A frame belongs to the range in which it begins.
                first, last = (max(0, -(-(x - w.start) // w.frame)) for x in (a, min(z, w.stop)))
                if a == 0 and w.start == w.stop:
                    yield pa.RecordBatch.from_pylist([{"path": path, "rate": w.rate, "error": "no samples"}], BLOCKS)
                for at in range(first, last, CHUNK):
                    n = min(CHUNK, last - at)
                    raw = f.read_at(n * w.frame, w.start + at * w.frame)
                    yield pa.RecordBatch.from_pylist([{"path": path, "rate": w.rate, "start": at, "samples": wave_samples(raw, w)}], BLOCKS)


HEADS = pa.schema([("path", pa.string()), ("line", pa.binary())])


class HeadReader(WaveReader):
    """The first line of each file that is neither blank nor a comment, or before it the first that is not UTF-8; files are read up to it only."""

    def __init__(self, options: dict):
        self.path, self.pattern = options["path"], options["pattern"]

    def partitions(self) -> list[Ranges]:
        store, top = fs.FileSystem.from_uri(self.path)
        files = [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, self.pattern)]
        return [Ranges([(f.path, f.size, 0, f.size) for f in files[i : i + FILES]]) for i in range(0, len(files), FILES)]

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        found = []
        for path, *_ in partition.parts if partition else []:
            with store.open_input_stream(path) as f:
                found.append({"path": path, "line": _first_line(f)})
        if found:
            yield pa.RecordBatch.from_pylist(found, HEADS)


def _first_line(f) -> bytes | None:
    rest = b""
    while True:
        raw = f.read(HEAD)
        *lines, rest = (rest + raw).split(b"\n") if raw else [rest, b""]
        for line in lines:
            try:
                text = line.decode().strip()
            except UnicodeDecodeError:
                return line
            if text and not text.startswith("#"):
                return line
        if not raw:
            return None


class HeadSource(DataSource):
    """`siftwave_heads`: rows path and line of the files below option path whose names match option pattern."""

    @classmethod
    def name(cls) -> str:
        return "siftwave_heads"

    def schema(self) -> str:
        return "path string, line binary"

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def first_lines(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path and line (bytes, null if there is none) of files below root: the first that is neither blank nor a comment."""
    spark.dataSource.register(HeadSource)
    return spark.read.format(HeadSource.name()).option("path", whole_path(root)).option("pattern", pattern).load()


class WaveSource(DataSource):
    """`siftwave_wave`: rows path, rate, start, samples and error of the .wav files at option path, in ranges of split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "siftwave_wave"

    def schema(self) -> str:
        return "path string, rate int, start long, samples array<double>, error string"

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options)


def whole_path(path: str) -> str:
    """A URI as it is, a local path from the root on."""
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else str(Path(path).absolute())


def scan_waves(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """Blocks of the wave files at a path or URI: path, rate, start (the place of the first sample), samples (mono) and error.

    PCM of 8 to 32 bits and IEEE floats. A file is dealt over as many tasks as it has ranges; small
    files share one. A broken or empty file is one row with its error, a cut one gives the whole
    frames it has. The path must be one that pyarrow opens (local, hdfs, s3, gs).
    """
    spark.dataSource.register(WaveSource)
    return spark.read.format(WaveSource.name()).option("path", whole_path(path)).option("split_bytes", split_bytes).load()


def series_of(blocks: DataFrame) -> DataFrame:
    """(path, pos, x) of blocks."""
    return blocks.where("error IS NULL").select("path", "start", F.posexplode("samples").alias("_n", "x")).select("path", (F.col("start") + F.col("_n")).alias("pos"), "x")


# Vibration tables

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _number(cell: Column) -> Column:
    """A cell as a double; NaN where it is none."""
    bare = F.lower(F.trim(cell))
    odd = F.regexp_replace(bare, "^[+-]", "")
    big = F.when(F.startswith(bare, F.lit("-")), float("-inf")).otherwise(float("inf"))
    return F.when(bare.rlike(NUMBER), bare.try_cast("double")).when(odd.isin("inf", "infinity"), big).otherwise(float("nan"))


def _cells(value: Column, mark: Column) -> Column:
    """The numbers of a line; mark: the delimiter, null for white space."""
    bare = F.regexp_replace(value, "#.*$", "")
    tokens = F.when(mark.isNotNull(), F.split(bare, F.concat(F.lit("\\Q"), mark, F.lit("\\E")))).otherwise(F.split(F.trim(bare), r"\s+"))
    return F.transform(tokens, _number)


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines that are neither blank nor a comment, numbered without gaps within each split of a file."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,tsv,txt,CSV,TSV,TXT}")
    said = reader.text(root).select(F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    said = said.where((F.trim(F.regexp_replace("value", r"\s", " ")) != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))
    return said.withColumn("line", F.monotonically_increasing_id())


def table_dialects(spark: SparkSession, root: str, how) -> DataFrame:
    """What the first pass learns of each split of each file: path, split, first (line), before (rows of earlier splits), skipped (header lines), mark, timed, width, error.

    how: a readers.TableFormat. The delimiter is the first of `how.delimiters` in the first row that
    gives any finite number in the file, else white space.
    """
    lines = _lines(spark, root)
    marks = [*how.delimiters, None]
    place = F.struct("split", "line")
    head = lines.groupBy("path").agg(F.min_by("value", place).alias("head"), F.count(F.lit(1)).alias("n"))
    bare = F.regexp_replace(F.lower("head"), "nan|inf|e", "")
    letters = bare.rlike(r"\p{L}").cast("int")
    skipped = {"skip": F.lit(1), "letters": letters, "fallback": F.when(F.col("n") > 1, 1).otherwise(0)}[how.header]
    head = stored(head.select("path", "head", "n", skipped.alias("skipped")), "heads")
    joined = lines.join(_small(head), "path")
    # The header is the first line of the file: it goes where a line is the head's own place.
    firsts = lines.groupBy("path").agg(F.min(place).alias("first"))
    body = joined.join(_small(stored(firsts, "firsts")), "path").where((F.col("skipped") == 0) | (place != F.col("first")))
    start = body.groupBy("path").agg(F.min_by("value", place).alias("row"))
    tests = [F.max(F.exists(_cells(F.col("value"), F.lit(m)), _finite)).alias(f"any{i}") for i, m in enumerate(marks)]
    usable = body.groupBy("path").agg(*tests).join(start, "path")
    pick, known = F.lit(None).cast("string"), F.col(f"any{len(marks) - 1}")
    for i, m in reversed(list(enumerate(how.delimiters))):
        fits = F.contains(F.col("row"), F.lit(m)) & F.col(f"any{i}")
        pick, known = F.when(fits, F.lit(m)).otherwise(pick), fits | known
    dialect = stored(usable.select("path", pick.alias("mark"), known.alias("known")), "marks")
    rows = body.join(_small(dialect), "path").withColumn("cells", _cells(F.col("value"), F.col("mark")))
    t = F.get("cells", 0)
    step = t - F.lag(t).over(Window.partitionBy("path", "split").orderBy("line")) if how.time == "monotone" else F.lit(None).cast("double")
    seen = rows.select("path", "split", "line", F.size("cells").alias("w"), t.alias("t"), step.alias("d"))
    per = seen.groupBy("path", "split").agg(
        F.min("line").alias("first"), F.count(F.lit(1)).alias("rows"), F.min("w").alias("low_w"), F.max("w").alias("high_w"), F.min("d").alias("low_d"), F.max("d").alias("high_d"), F.min_by("t", "line").alias("t0"), F.max_by("t", "line").alias("t1"), F.max(F.isnan("t")).alias("gap")
    )
    every, order = Window.partitionBy("path"), Window.partitionBy("path").orderBy("split")
    seam = F.col("t0") - F.lag("t1").over(order)
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("*", before.alias("before"), F.least("low_d", seam).alias("l"), F.greatest("high_d", seam).alias("h"))
    rises, falls = F.coalesce(F.min("l").over(every) >= 0, F.lit(True)), F.coalesce(F.max("h").over(every) <= 0, F.lit(True))
    gaps = F.max("gap").over(every) & (F.sum("rows").over(every) > 1)
    timed = {"first": F.lit(True), "none": F.lit(False), "monotone": (rises | falls) & ~gaps}[how.time]
    low, high = F.min("low_w").over(every), F.max("high_w").over(every)
    out = per.select("path", "split", "first", "before", low.alias("low"), high.alias("width"), (timed & (high > 1)).alias("timed"))
    joined = head.select("path", "skipped").join(dialect, "path", "left").join(out, "path", "left")
    error = F.when(F.coalesce(~F.col("known"), F.lit(True)) | F.col("width").isNull(), "no data rows").when(F.col("low") != F.col("width"), "rows of several lengths")
    return stored(joined.select("path", "split", "first", "before", "skipped", "mark", "timed", "width", error.alias("error")), "dialects")


def _small(df: DataFrame) -> DataFrame:
    """df, sent to all tasks if its rows (of about 200 bytes) are few enough; else joined like any other."""
    return F.broadcast(df) if df.count() * 200 <= FEW else df


def scan_tables(spark: SparkSession, root: str, how) -> tuple[DataFrame, DataFrame]:
    """(path, column, pos, x) of the vibration tables below root, and (path, error) of those that can't be read.

    Columns count from 1 behind the column of time, rows from 0 in their order in the file. Numbers
    that are not finite become 0 or are left out, as `how.non_finite` says; then positions close up.
    """
    dialects = table_dialects(spark, root, how)
    good = _small(dialects.where("error IS NULL"))
    rows = _lines(spark, root).join(good, ["path", "split"]).where(F.col("line") >= F.col("first"))
    cells = _cells(F.col("value"), F.col("mark"))
    values = F.when(F.col("timed"), F.slice(cells, 2, F.greatest(F.col("width") - 1, F.lit(0)))).otherwise(cells)
    flat = rows.select("path", (F.col("line") - F.col("first") + F.col("before")).alias("pos"), "split", F.posexplode(values).alias("column", "x")).withColumn("column", F.col("column") + 1)
    if how.non_finite == "zero":
        out = flat.withColumn("x", F.when(_finite(F.col("x")), F.col("x")).otherwise(0.0))
    else:
        kept = flat.where(_finite(F.col("x")))
        within = F.row_number().over(Window.partitionBy("path", "column", "split").orderBy("pos")) - 1
        counts = kept.groupBy("path", "column", "split").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("path", "column").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shifts = counts.select("path", "column", "split", before.alias("shift"))
        out = kept.withColumn("pos", within).join(shifts, ["path", "column", "split"]).withColumn("pos", F.col("pos") + F.col("shift"))
    return out.select("path", "column", "pos", "x"), dialects.where("error IS NOT NULL").select("path", "error")
