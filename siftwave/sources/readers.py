"""Readers of dataset trees, index tables, id lists, feature tables and signals."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwave.functions.paths import CHANNEL_SUFFIX, STRICT_SUFFIX, clean_path, decode_paths, encode_paths, id_suffix, split_channel
from siftwave.model import INDEX, N_CHANNELS, require_columns
from siftwave.operators.halo import blocks_of_series
from siftwave.sources.flac import decode_flac, scan_flacs
from siftwave.sources.npz import read_npz
from siftwave.sources.scans import first_lines, scan_tables, scan_waves, wave_header, wave_samples
from siftwave.tables import stored

COMPRESSED = r"\.(m4a|mp3|mp4)$"  # formats that can't be decoded here
BLOCK = 160_000  # samples of a block of a vibration column
WANTED = 128_000_000  # bytes of listed paths and ids that are sent to all tasks, at most

# Where a dataset tree keeps its four kinds of files.
PART = r"/(normal|abnormal)/(?:([^/]+)/)?([^/]+)/(audio|ios|android|vibration)/\4_part_(\d+)\.(?:wav|mp4|csv)$"


def _path(column: str = "_metadata.file_path"):
    return F.regexp_replace(column, "^file:/+", "/")


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Paths below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_path().alias("path"))


def sniff_columns(spark: SparkSession, root: str) -> DataFrame:
    """path and n_columns of vibration files: the commas in the first line that is neither blank nor a comment.

    0 for a file without such a line, and where that line or one before it is not UTF-8. Each file is
    read up to that line only.
    """
    head = first_lines(spark, root, "vibration_part_*.csv")
    n = F.when(F.is_valid_utf8(F.col("line").cast("string")), F.size(F.split(F.col("line").cast("string"), ",")) - 1)
    return head.select(_path("path").alias("path"), F.coalesce(F.when(F.col("line").isNotNull(), n), F.lit(0)).alias("n_columns"))


def build_index(paths: DataFrame, vibration_columns: DataFrame | None = None, vibration_sr: int = 100_000) -> DataFrame:
    """One INDEX row per (condition, number) that has all four files and at least four vibration columns.

    paths: a column `path`. vibration_columns: path and n_columns; without it every file counts as
    complete. The normal branch has condition folders, the abnormal one fault folders above them.
    """
    part = lambda i: F.regexp_extract("path", PART, i)
    found = paths.select("path", part(1).alias("side"), part(2).alias("fault"), part(3).alias("condition"), part(4).alias("kind"), part(5).alias("idx"))
    found = found.where("(side = 'normal' and fault = '') or (side = 'abnormal' and fault != '')")
    if vibration_columns is not None:
        wide = vibration_columns.where("n_columns >= 4").select("path")
        found = found.where("kind != 'vibration'").unionByName(found.where("kind = 'vibration'").join(wide, "path", "left_semi"))
    kinds = ("audio", "ios", "android", "vibration")
    rows = found.groupBy("side", "fault", "condition", "idx").agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in kinds])
    rows = rows.dropna(subset=list(kinds))
    files = F.array("audio", "ios", "android", *[F.concat("vibration", F.lit(f"::col={c}")) for c in range(1, 5)])
    normal = F.col("side") == "normal"
    id_ = F.concat_ws("_", F.concat_ws("/", "side", F.when(~normal, F.col("fault")), "condition"), "idx")
    return rows.select(id_.alias("id"), encode_paths(files).alias("paths"), F.when(normal, "Normal").otherwise("Anomalous").alias("split"), F.when(normal, 0).otherwise(1).cast("long").alias("label"), F.lit(vibration_sr).alias("vibration_sr"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """An index CSV; its cells double their quotes."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    require_columns(df, "id", "paths", "split", "label")
    rate = F.col("vibration_sr") if "vibration_sr" in df.columns else F.lit(None)
    return df.select("id", "paths", "split", F.col("label").cast("long").alias("label"), rate.try_cast("int").alias("vibration_sr")).to(INDEX)


def read_positional(spark: SparkSession, path: str, id_col: int = 0, label_col: int = 2) -> DataFrame:
    """id and lower-case label of a CSV, by column position."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.select(F.col(f"`{df.columns[id_col]}`").cast("string").alias("id"), F.lower(F.col(f"`{df.columns[label_col]}`").cast("string")).alias("label"))


def read_ids(spark: SparkSession, path: str, suffix: bool = False) -> DataFrame:
    """id and ord of a list file: stripped, without blank lines, duplicates kept. suffix: only the last three path parts.

    ord follows the lines of a single file; monotonically_increasing_id is taken at the scan, before any shuffle.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("id")).where("id != ''")
    return lines.withColumn("id", id_suffix(F.col("id"))) if suffix else lines


def read_split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training and test ids (ord, id) of a folder with dev_source_normal.ids, eval_normal.ids and eval_abn.ids.

    Test ids are the normal ones and then the abnormal ones. A missing file is an error, and so are
    no training or no test ids.
    """
    train, normal, abnormal = (read_ids(spark, f"{folder}/{name}.ids", suffix=True) for name in ("dev_source_normal", "eval_normal", "eval_abn"))
    # monotonically_increasing_id of one file is below 2**62, so abnormal ids come after all normal ones.
    test = normal.unionByName(abnormal.withColumn("ord", F.col("ord") + F.lit(2**62)))
    for side, ids in (("training", train), ("test", test)):
        if ids.isEmpty():
            raise ValueError(f"no {side} ids in {folder}")
    return train, test


def blocks_of_concat(samples: DataFrame, column: str = "x", n_channels: int = N_CHANNELS) -> DataFrame:
    """Long features of concatenated vectors; an error if a length is no multiple of the channel count."""
    size = F.size(column)
    width = F.when(size % n_channels == 0, (size / n_channels).cast("int")).otherwise(F.raise_error(F.lit("vector length is no multiple of the channel count")).cast("int"))
    rest = [c for c in samples.columns if c != column]
    spread = samples.select(*rest, column, width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(n_channels - 1))).alias("channel"))
    return spread.select(*rest, "channel", F.slice(column, F.col("channel") * F.col("_w") + 1, F.col("_w")).alias("vec"))


def channels_of_lists(samples: DataFrame, column: str = "per_channel", n_channels: int = N_CHANNELS) -> DataFrame:
    """Long features of lists of seven vectors; an error for another number or for an empty vector."""
    rest = [c for c in samples.columns if c != column]
    whole = (F.size(column) == n_channels) & F.forall(column, lambda v: F.size(v) > 0)
    checked = F.when(whole, F.col(column)).otherwise(F.raise_error(F.lit("a sample needs one vector for each channel")).cast(samples.schema[column].dataType))
    return samples.select(*rest, F.posexplode(checked).alias("channel", "vec"))


def channels_of_cells(samples: DataFrame, n_channels: int = N_CHANNELS) -> DataFrame:
    """Long features of a cell for each channel, in a column per_channel or else X_per_channel; nested cells are flattened."""
    column = next((c for c in ("per_channel", "X_per_channel") if c in samples.columns), None)
    if column is None:
        raise ValueError("missing columns: per_channel or X_per_channel")
    kind, cell = samples.schema[column].dataType.elementType, F.col(column)
    while kind.elementType.typeName() == "array":
        cell, kind = F.transform(cell, F.flatten), kind.elementType
    rest = [c for c in samples.columns if c not in ("per_channel", "X_per_channel")]
    return channels_of_lists(samples.select(*rest, cell.alias("per_channel")), "per_channel", n_channels)


def channels_of_columns(samples: DataFrame, n_channels: int = N_CHANNELS) -> DataFrame:
    """Long features of vector columns X_ch0, X_ch1, ..."""
    names = [f"X_ch{c}" for c in range(n_channels)]
    rest = [c for c in require_columns(samples, *names).columns if c not in names]
    return channels_of_lists(samples.select(*rest, F.array(*names).alias("per_channel")))


def with_normality(samples: DataFrame) -> DataFrame:
    """samples with boolean `normal`: by split where the table has that column, else by label 0."""
    if "split" in samples.columns:
        return samples.withColumn("normal", F.lower("split") == "normal")
    require_columns(samples, "label")
    return samples.withColumn("normal", F.col("label") == 0)


def first_samples(samples: DataFrame, n: int | None) -> DataFrame:
    """The first n samples in source order; all where n is None."""
    return samples if n is None else samples.orderBy("ord").limit(n)


def is_monotone(samples: DataFrame) -> DataFrame:
    """key and whether its values x, in order of pos, never fall or never rise (as time stamps do)."""
    step = F.col("x") - F.lag("x").over(Window.partitionBy("key").orderBy("pos"))
    return samples.select("key", step.alias("d")).groupBy("key").agg((F.coalesce(F.min("d") >= 0, F.lit(True)) | F.coalesce(F.max("d") <= 0, F.lit(True))).alias("monotone"))


@dataclass(frozen=True)
class TableFormat:
    """How a kind of encoder reads vibration tables.

    header: skip (the first line is none of the data), letters (it is none if it holds letters) or
    fallback (skip, and nothing is skipped where that leaves no numbers). time: first (the first
    column is time), monotone (it is if it never falls or never rises) or none. default_column: taken
    where a path names none; without it a table of several columns is an error. non_finite: zero or
    drop. delimiters: by preference. suffix: how paths name a column. lenient: whether cells of paths
    may be other than a JSON list.
    """

    header: str = "letters"
    time: str = "first"
    default_column: int | None = None
    non_finite: str = "zero"
    delimiters: tuple[str, ...] = (",", "\t", ";")
    suffix: str = CHANNEL_SUFFIX
    lenient: bool = False


FORMATS = {
    "plain": TableFormat(),
    "beats": TableFormat("skip", delimiters=(",",)),
    "ced": TableFormat("letters", default_column=1, non_finite="drop", delimiters=(",",), suffix=STRICT_SUFFIX, lenient=True),
    "dasheng": TableFormat("letters", non_finite="drop", suffix=STRICT_SUFFIX, lenient=True),
    "eat": TableFormat("letters", non_finite="drop", suffix=STRICT_SUFFIX, lenient=True),
    "echo": TableFormat("fallback", time="monotone", lenient=True),
    "fisher": TableFormat("skip", lenient=True),
}


def read_signals(spark: SparkSession, index: DataFrame, root: str, default_rate: int | None = None, form: str = "plain", twins: bool = False) -> DataFrame:
    """id, channel, rate, samples, error for every path of an index: .wav and .flac files, and columns of vibration tables.

    Each file is decoded once, a vibration table for all its channels, as FORMATS says of `form`,
    which also says how cells of paths and column suffixes are read; paths are cleaned. Other audio
    formats, broken and cut files and files that aren't there give an error row for each use, a null cell,
    one that is no list of paths and a null path one with a null channel or file. Contents are
    matched with the index where they are read, and only of listed files: the index goes to all tasks
    if it is at most WANTED bytes. twins: for a compressed recording, the .wav file of the same name
    beside it is read where there is one. A file is one row here; scan_signals reads long ones in ranges.
    """
    how = FORMATS[form]
    wanted, pathless = _wanted(index, how, list_tree(spark, root) if twins else None)
    per_file = stored(wanted.groupBy("file").agg(F.collect_list(F.struct("id", "channel", "col", "vibration_sr")).alias("uses")), "uses")
    size = per_file.agg(F.sum(F.octet_length("file") + F.aggregate("uses", F.lit(0), lambda a, u: a + F.octet_length(F.coalesce(u["id"], F.lit(""))) + 32))).first()[0] or 0
    binary = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^file:/+", "/").alias("file")
    missing = per_file.join(binary().select(path), "file", "left_anti").select(F.explode("uses").alias("u"), F.concat(F.lit("no file "), "file").alias("error"))
    lost = missing.select("u.id", "u.channel", "error").unionByName(pathless)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                table = error = None
                try:
                    table = _decoded(r.content, r.file, how)
                except ValueError as e:
                    error = str(e)
                for u in r.uses:
                    rows.append(_signal(u, table, error, default_rate, how))
            yield pd.DataFrame(rows, columns=["id", "channel", "rate", "samples", "error"])

    signals = binary().select(path, "content").join(F.broadcast(per_file) if size <= WANTED else per_file, "file")
    nothing = {"rate": F.lit(None).cast("int"), "samples": F.lit(None).cast("array<double>")}
    return signals.mapInPandas(run, "id string, channel int, rate int, samples array<double>, error string").unionByName(lost.withColumns(nothing))


def scan_signals(spark: SparkSession, index: DataFrame, root: str, default_rate: int | None = None, form: str = "plain", twins: bool = False) -> tuple[DataFrame, DataFrame]:
    """read_signals for long recordings: blocks (id, channel, rate, start, samples) of all that can be read, and (id, channel, error) of the rest.

    Files are read in ranges and splits, so no task holds a whole one. A file with an error in any
    range gives no blocks; recordings are decoded a second time to know that before.
    """
    how = FORMATS[form]
    wanted, lost = _wanted(index, how, list_tree(spark, root) if twins else None)
    wanted = stored(wanted, "wanted")
    waves = scan_waves(spark, root).unionByName(scan_flacs(spark, root))
    tables, unread = scan_tables(spark, root, how)
    path = F.regexp_replace("path", "^file:/+", "/").alias("file")
    errors = stored(waves.where("error IS NOT NULL").select(path, "error").unionByName(unread.withColumnRenamed("path", "file")).groupBy("file").agg(F.min("error").alias("error")), "errors")
    is_wave = F.lower("file").rlike(r"\.(wav|flac)$")
    sound = wanted.where(is_wave).join(errors, "file", "left_anti").join(waves.where("error IS NULL").select(path, "rate", "start", "samples"), "file").select("id", "channel", "rate", "start", "samples")
    blocks = blocks_of_series(tables.select(F.struct("path", "column").alias("key"), "pos", "x"), BLOCK).select(F.col("key.path").alias("file"), F.col("key.column").alias("column"), "start", "samples")
    widths = stored(blocks.groupBy("file").agg(F.max("column").alias("width")), "widths")
    rate = F.coalesce("vibration_sr", F.lit(default_rate))
    uses = wanted.where(~is_wave).join(widths, "file", "left")
    pick = F.coalesce("col", F.when(F.col("width") == 1, 1).otherwise(how.default_column or 0))
    uses = uses.select("id", "channel", "file", rate.alias("rate"), "col", "width", pick.alias("column"))
    able = F.col("rate").isNotNull() & F.col("column").between(1, F.col("width"))
    vibration = uses.where(able).join(blocks, ["file", "column"]).select("id", "channel", "rate", "start", "samples")
    known = list_tree(spark, root).withColumnRenamed("path", "file")
    # Spark lists no empty files, the scans of recordings do.
    no_file = wanted.join(known, "file", "left_anti").join(errors, "file", "left_anti").select("id", "channel", F.concat(F.lit("no file "), "file").alias("error"))
    broken = wanted.join(errors, "file").select("id", "channel", "error")
    other = wanted.where(~F.lower("file").rlike(r"\.(wav|flac|csv|tsv|txt)$")).join(known, "file", "left_semi").select("id", "channel", F.lit("this audio format can't be decoded here").alias("error"))
    why = F.when(F.col("rate").isNull() & F.col("column").between(1, F.col("width")), "no sampling rate").otherwise(F.concat(F.lit("no signal column "), F.coalesce(F.col("col").cast("string"), F.lit("None")), F.lit(" of "), "width"))
    columnless = uses.where(F.col("width").isNotNull() & ~able).select("id", "channel", why.alias("error"))
    return sound.unionByName(vibration), lost.unionByName(no_file).unionByName(broken).unionByName(other).unionByName(columnless)


def _wanted(index: DataFrame, how: TableFormat, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """id, vibration_sr, channel, file and col of every path of an index, and (id, channel, error) of cells and paths that are none.

    known: paths of files; a compressed recording's .wav twin among them takes its place.
    """
    wanted = index.select("id", "vibration_sr", F.posexplode_outer(decode_paths(F.col("paths"), how.lenient)).alias("channel", "p"))
    bare, column = split_channel(clean_path(F.col("p")), how.suffix)
    wanted = wanted.select("id", "vibration_sr", "channel", F.regexp_replace(bare, "^file:/+", "/").alias("file"), column.alias("col"))
    pathless = wanted.where("file IS NULL").select("id", "channel", F.when(F.col("channel").isNull(), "no list of paths").otherwise("no path").alias("error"))
    wanted = wanted.where("file IS NOT NULL")
    if known is not None:
        twin = F.when(F.lower("file").rlike(COMPRESSED), F.regexp_replace("file", r"\.[^./]+$", ".wav"))
        wanted = wanted.withColumn("twin", twin).join(known.select(F.col("path").alias("twin"), F.lit(True).alias("there")), "twin", "left")
        wanted = wanted.select("id", "vibration_sr", "channel", F.when(F.col("there"), F.col("twin")).otherwise(F.col("file")).alias("file"), "col")
    return wanted, pathless


def _signal(use, table, error, default_rate, how):
    head = (use["id"], use["channel"])
    if error:
        return (*head, None, None, error)
    rate, x = table
    if x.ndim == 2:
        k = use["col"] if not pd.isna(use["col"]) else 1 if x.shape[1] == 1 else how.default_column or 0
        if not 1 <= k <= x.shape[1]:
            return (*head, None, None, f"no signal column {None if pd.isna(use['col']) else int(use['col'])} of {x.shape[1]}")
        x, rate = x[:, int(k) - 1], use["vibration_sr"] if not pd.isna(use["vibration_sr"]) else default_rate
    if rate is None:
        return (*head, None, None, "no sampling rate")
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) if how.non_finite == "zero" else x[np.isfinite(x)]
    if not len(x):
        return (*head, None, None, "no finite values")
    return (*head, int(rate), x, None)


def _decoded(raw: bytes, name: str, how: TableFormat) -> tuple[int | None, np.ndarray]:
    """A file's rate (null for tables) and samples, by what its name says it is."""
    by_suffix = {".wav": decode_wav, ".flac": decode_flac}
    suffix = name[name.rfind(".") :].lower()
    return by_suffix[suffix](raw) if suffix in by_suffix else decode_table(raw, name, how)


def decode_wav(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in -1..1 of a file of PCM or IEEE floats."""
    try:
        w = wave_header(lambda at, n: raw[at : at + n], len(raw))
    except struct.error as e:
        raise ValueError(f"no PCM wave file: {e}") from e
    return w.rate, wave_samples(raw[w.start : w.stop], w)


def decode_table(raw: bytes, name: str, how: TableFormat = FORMATS["plain"]) -> tuple[None, np.ndarray]:
    """Signal columns of a delimited text, without the column of time."""
    if not name.lower().endswith((".csv", ".tsv", ".txt")):
        raise ValueError("this audio format can't be decoded here")
    lines = [x for x in raw.decode("utf-8", "replace").splitlines() if x.strip() and not x.lstrip().startswith("#")]
    letters = bool(lines) and any(c.isalpha() for c in lines[0].lower().replace("nan", "").replace("inf", "").replace("e", ""))
    for skipped in {"skip": (1,), "letters": (int(letters),), "fallback": (1, 0)}[how.header]:
        x = _numbers(lines[skipped:], how.delimiters)
        if x is not None:
            break
    else:
        raise ValueError("no data rows")
    steps = np.diff(x[:, 0])
    timed = how.time == "first" or (how.time == "monotone" and ((steps >= 0).all() or (steps <= 0).all()))
    return None, x[:, 1:] if x.shape[1] > 1 and timed else x


def _numbers(lines: list[str], delimiters: tuple[str, ...]) -> np.ndarray | None:
    """A matrix by the first delimiter of the lines that gives a finite number, white space being the last."""
    for mark in [d for d in delimiters if lines and d in lines[0]] + [None]:
        try:
            x = np.genfromtxt(lines, delimiter=mark, ndmin=2) if lines else np.zeros((0, 0))
        except ValueError as e:
            raise ValueError("rows of several lengths") from e
        if x.size and np.isfinite(x).any():
            return x
    return None
