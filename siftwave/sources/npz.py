"""NumPy archives as a data source: ranges of samples are read by many tasks, and many tasks write one archive.

An archive is a zip file of arrays. Its directory and the arrays' headers are read when a scan is
planned. Arrays that are stored as they are get sought; compressed ones are read in one pass, in
chunks. A writer's tasks leave bodies of arrays beside the target, and the commit writes headers and
streams the bodies behind them.
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from siftwave.model import N_CHANNELS
from siftwave.sources.scans import whole_path

RANGE = 32_000_000  # bytes of samples that a task reads
BATCH = 4_000_000  # bytes of samples that it holds at once

SCHEMA = "id string, ord long, label long, split string, x array<double>, per_channel array<array<double>>"
ARROW = pa.schema([("id", pa.string()), ("ord", pa.int64()), ("label", pa.int64()), ("split", pa.string()), ("x", pa.list_(pa.float64())), ("per_channel", pa.list_(pa.list_(pa.float64())))])


@dataclass(frozen=True)
class Member:
    """An array of an archive: where its body begins in the archive (None if it is compressed), its type and shape."""

    name: str
    body: int | None
    dtype: np.dtype
    shape: tuple[int, ...]
    fortran: bool

    @property
    def row(self) -> int:
        return int(self.dtype.itemsize * np.prod(self.shape[1:], dtype=np.int64))


def archive_members(file) -> dict[str, Member]:
    """The arrays of an archive by name; ValueError for pickled ones. Only headers are read."""
    out = {}
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            with z.open(info) as f:
                version = npy.read_magic(f)
                shape, fortran, dtype = (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
                header = f.tell()
            name = info.filename.removesuffix(".npy")
            if dtype.hasobject:
                raise ValueError(f"array {name} is pickled")
            body = None
            if info.compress_type == zipfile.ZIP_STORED:
                file.seek(info.header_offset)
                local = file.read(30)
                body = info.header_offset + 30 + sum(struct.unpack("<HH", local[26:30])) + header
            out[name] = Member(name, body, dtype, shape, fortran and len(shape) > 1)
    return out


def features_of(members: dict[str, Member]) -> tuple[int, list[str], list[str]]:
    """How many samples there are, and the names of the arrays that give x and per_channel; ValueError where shapes don't fit."""
    if not members:
        raise ValueError("an archive without arrays")
    n = (members.get("ids") or next(iter(members.values()))).shape[0]
    parts = [f"X_ch{c}" for c in range(N_CHANNELS)] if "X_ch0" in members else [k for k in ("per_channel", "X_per_channel") if k in members][:1]
    given = ["X"] if "X" in members else []
    fits = all(k in members and members[k].shape[0] == n and len(members[k].shape) >= (3 if "per_channel" in k else 2) for k in parts + given)
    flat = all(len(members[k].shape) == 2 for k in given + parts if "per_channel" not in k) if fits else False
    if not (fits and flat and (parts or given)):
        raise ValueError("features must be matrices with a row for each id")
    for k in ("ids", "labels", "splits"):
        if k in members and members[k].shape != (n,):
            raise ValueError(f"{k} must have one value for each id")
    return n, given, parts


@dataclass
class Samples(InputPartition):
    """Samples from first to stop of an archive."""

    path: str
    first: int
    stop: int


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("range_bytes", RANGE))

    def partitions(self) -> list[Samples]:
        store, top = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(top)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        out = []
        for f in sorted((f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npz"))):
            with store.open_input_file(f) as file:
                members = archive_members(file)
            n, given, parts = features_of(members)
            used = [members[k] for k in (*given, *parts, "ids", "labels", "splits") if k in members]
            # A compressed array, or one in column order, can't be sought: one task reads such an archive.
            step = max(1, self.range // max(1, sum(m.row for m in used))) if all(m.body is not None and not m.fortran for m in used) else max(1, n)
            out += [Samples(f, a, min(n, a + step)) for a in range(0, n, step)]
        return out

    def read(self, partition: Samples | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a scan without samples
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.path) as file:
            members = archive_members(file)
            _, given, parts = features_of(members)
            names = [k for k in (*given, *parts, "ids", "labels", "splits") if k in members]
            step = max(1, BATCH // max(1, sum(members[k].row for k in names)))
            columns = [_rows(store, partition, members[k], step) for k in names]
            for at, *values in zip(range(partition.first, partition.stop, step), *columns, strict=False):
                yield _batch(at, dict(zip(names, values, strict=True)), given, parts)


def _rows(store, p: Samples, m: Member, step: int) -> Iterator[np.ndarray]:
    """Rows of one array, step by step."""
    with store.open_input_file(p.path) as file:
        if m.fortran:
            with zipfile.ZipFile(file) as z:
                whole = np.load(io.BytesIO(z.read(f"{m.name}.npy")), allow_pickle=False)
            yield from (whole[a : min(p.stop, a + step)] for a in range(p.first, p.stop, step))
            return
        if m.body is None:
            with zipfile.ZipFile(file) as z, z.open(f"{m.name}.npy") as f:
                version = npy.read_magic(f)
                (npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0)(f)
                for a in range(p.first, p.stop, step):
                    yield _array(f.read((min(p.stop, a + step) - a) * m.row), m)
            return
        for a in range(p.first, p.stop, step):
            file.seek(m.body + a * m.row)
            yield _array(file.read((min(p.stop, a + step) - a) * m.row), m)


def _array(raw: bytes, m: Member) -> np.ndarray:
    rows = len(raw) // m.row if m.row else 0
    return np.frombuffer(raw, m.dtype, rows * int(np.prod(m.shape[1:], dtype=np.int64))).reshape(rows, *m.shape[1:])


def _batch(at: int, values: dict[str, np.ndarray], given: list[str], parts: list[str]) -> pa.RecordBatch:
    n = len(next(iter(values.values())))
    text = lambda k: pa.array(values[k].astype(str).tolist(), pa.string()) if k in values else pa.nulls(n, pa.string())
    lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.astype(float).reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
    x = lists(values[given[0]]) if given else pa.nulls(n, ARROW.field("x").type)
    held = [values[k] for k in parts]
    held = [held[0][:, c].reshape(n, -1) for c in range(held[0].shape[1])] if parts and "per_channel" in parts[0] else held
    per = pa.array([[v[i].astype(float) for v in held] for i in range(n)], ARROW.field("per_channel").type) if held else pa.nulls(n, ARROW.field("per_channel").type)
    label = pa.array(values["labels"].astype(np.int64)) if "labels" in values else pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([text("ids"), pa.array(np.arange(at, at + n)), label, text("splits"), x, per], schema=ARROW)


@dataclass
class Part(WriterCommitMessage):
    """What a task has left: its partition, folder, number of samples, their length (None without any), and the longest id and split in code points."""

    number: int
    folder: str
    n: int
    width: int | None
    longest: dict[str, int]


class NpzWriter(DataSourceArrowWriter):
    """Tasks write bodies in their own order; the commit joins them in order of partitions and removes them."""

    def __init__(self, options: dict):
        self.path, self.parts = options["path"], f"{options['path']}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, top = fs.FileSystem.from_uri(self.parts)
        number = TaskContext.get().partitionId()
        # An attempt that is repeated or doubled writes a folder of its own; only the committed one is read.
        folder = f"{top}/{number}-{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        n, width, longest = 0, None, {"id": 0, "split": 0}
        files = {k: store.open_output_stream(f"{folder}/{k}") for k in ("x", "id", "label", "split")}
        for b in iterator:
            if not len(b):
                continue
            x = b.column("x")
            if x.null_count or x.flatten().null_count or b.column("id").null_count or b.column("label").null_count or b.column("split").null_count:
                raise ValueError("an archive holds no nulls")
            sizes = np.diff(x.offsets.to_numpy())
            if (sizes != (width := sizes[0] if width is None else width)).any():
                raise ValueError("vectors of several lengths")
            files["x"].write(x.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes())
            files["label"].write(b.column("label").to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            for k in ("id", "split"):
                texts = [t.encode() for t in b.column(k).to_pylist()]
                longest[k] = max([longest[k], *(len(t.decode()) for t in texts)])
                files[k].write(b"".join(struct.pack("<I", len(t)) + t for t in texts))
            n += len(b)
        for f in files.values():
            f.close()
        return Part(number, folder, n, None if width is None else int(width), longest)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.number)
        if len(widths := {m.width for m in parts}) > 1:
            self.abort(messages)
            raise ValueError("vectors of several lengths")
        store, target = fs.FileSystem.from_uri(self.path)
        n, width = sum(m.n for m in parts), widths.pop() if widths else 0
        longest = {k: max([1, *(m.longest[k] for m in parts)]) for k in ("id", "split")}
        with store.open_output_stream(f"{target}.new") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, key, dtype, shape in (("X", "x", "<f4", (n, width)), ("ids", "id", f"<U{longest['id']}", (n,)), ("labels", "label", "<i8", (n,)), ("splits", "split", f"<U{longest['split']}", (n,))):
                with z.open(f"{name}.npy", "w", force_zip64=True) as body:
                    npy.write_array_header_1_0(body, {"descr": dtype, "fortran_order": False, "shape": shape})
                    for m in parts:
                        with store.open_input_stream(f"{m.folder}/{key}") as f:
                            for chunk in _texts(f, longest[key]) if key in longest else iter(lambda f=f: f.read(1 << 22), b""):
                                body.write(chunk)
        store.move(f"{target}.new", target)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.parts)
        if store.get_file_info(top).type == fs.FileType.Directory:
            store.delete_dir(top)


def _texts(f, width: int) -> Iterator[bytes]:
    """Texts of a part as fixed-width rows of an array."""
    while head := f.read(4):
        (size,) = struct.unpack("<I", head)
        yield f.read(size).decode().encode("utf-32-le").ljust(4 * width, b"\0")


class NpzSource(DataSource):
    """`siftwave_npz`: samples of the archives at option path, in ranges of range_bytes; or one archive written of id, label, split and x."""

    @classmethod
    def name(cls) -> str:
        return "siftwave_npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options)


def read_npz(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """id, ord, label, split, x and per_channel of the .npz files at a path or URI that pyarrow opens. Pickled arrays are refused.

    Features: X (one vector for each sample, in x), or X_ch0..X_ch6, per_channel or X_per_channel
    (numeric, with samples and channels as its first two dimensions; vectors in per_channel). ord is
    a sample's place in its archive. Arrays that are stored uncompressed are read by as many tasks as
    they have ranges, compressed archives by one task each, a few MB at a time.
    """
    spark.dataSource.register(NpzSource)
    return spark.read.format(NpzSource.name()).option("path", whole_path(path)).option("range_bytes", range_bytes).load()


def write_npz(samples: DataFrame, path: str) -> None:
    """Concatenated features (ord, id, label, split, x) as one .npz file, in order of ord, in place of one that is there.

    Tasks write their samples; the driver only streams what they wrote into one file, so any number
    of rows will do. Nulls and vectors of several lengths are an error, and then nothing is written.
    """
    samples.sparkSession.dataSource.register(NpzSource)
    samples.orderBy("ord").selectExpr("id", "cast(label AS long) AS label", "split", "cast(x AS array<double>) AS x").write.format(NpzSource.name()).option("path", whole_path(path)).mode("overwrite").save()
