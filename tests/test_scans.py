"""Split scans of recordings against whole-file decoding, and signals of an index for each form of encoder."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.operators import signals as S
from siftwave.operators.encoders import Encoder
from siftwave.sources import readers, scans


def wave(x, code=1, bits=16, rate=8000, extra=b"", extensible=False, length=None):
    """A file of samples x (frames, channels) in -1..1; extra: chunks before the samples."""
    kinds = {(1, 8): lambda v: (v * 127 + 128).astype("u1").tobytes(), (1, 16): lambda v: (v * 32767).astype("<i2").tobytes(), (1, 32): lambda v: (v * (2**31 - 1)).astype("<i4").tobytes(), (3, 32): lambda v: v.astype("<f4").tobytes(), (3, 64): lambda v: v.astype("<f8").tobytes()}
    kinds[1, 24] = lambda v: b"".join(int(s * (2**23 - 1)).to_bytes(3, "little", signed=True) for s in v.reshape(-1))
    data = kinds[code, bits](x)
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else code, x.shape[1], rate, 0, x.shape[1] * bits // 8, bits)
    form += struct.pack("<HHIH14x", 22, bits, 0, code) if extensible else b""
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + extra + b"data" + struct.pack("<I", len(data) if length is None else length) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


CASES = {
    "a16": {}, "b8": {"bits": 8}, "c24": {"bits": 24}, "d32": {"bits": 32}, "e_float": {"code": 3, "bits": 32}, "f_double": {"code": 3, "bits": 64},
    "g_list": {"extra": b"LIST" + struct.pack("<I", 5) + b"abcde\0"}, "h_extensible": {"extensible": True, "bits": 24}, "i_stream": {"length": 0xFFFFFFFF},
}


@pytest.fixture(scope="module")
def waves(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("waves"), np.random.default_rng(0)
    for n, (name, how) in enumerate(CASES.items()):
        (root / f"{name}.wav").write_bytes(wave(rng.uniform(-1, 1, (1000 + 7 * n, 1 + n % 3)), **how))
    (root / "cut.wav").write_bytes((root / "c24.wav").read_bytes()[:-301])
    (root / "bad.WAV").write_bytes(b"RIFF....")
    (root / "none.wav").write_bytes(b"")
    (root / "silent.wav").write_bytes(wave(np.zeros((0, 1))))
    (root / "mulaw.wav").write_bytes((root / "b8.wav").read_bytes().replace(b"fmt \x10\0\0\0\1\0", b"fmt \x10\0\0\0\7\0"))
    return root


@pytest.mark.parametrize("size", [500, 4_000_000])
def test_ranges_of_waves_equal_the_whole_files(spark, waves, size):
    blocks = scans.scan_waves(spark, str(waves), size)
    got = {}
    for r in scans.series_of(blocks).orderBy("path", "pos").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], []).append((r["pos"], r["x"]))
    for name in [*(f"{c}.wav" for c in CASES), "cut.wav"]:
        _, x = readers.decode_wav((waves / name).read_bytes())
        assert [p for p, _ in got[name]] == list(range(len(x))) and [v for _, v in got[name]] == x.tolist(), name
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in blocks.where("error IS NOT NULL").collect()}
    assert set(errors) == {"bad.WAV", "none.wav", "silent.wav", "mulaw.wav"} and errors["silent.wav"] == "no samples"
    assert (blocks.rdd.getNumPartitions() > 40) == (size == 500)


def test_a_long_wave_is_read_by_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (6_000_000, 1))
    (tmp_path / "long.wav").write_bytes(wave(x))
    blocks = scans.scan_waves(spark, f"{tmp_path}/long.wav", 1_000_000)
    tasks = blocks.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.size("samples")).alias("n"))
    counts = [r["n"] for r in tasks.collect()]
    assert len(counts) == 13 and max(counts) <= 500_000 and sum(counts) == 6_000_000
    whole = readers.decode_wav((tmp_path / "long.wav").read_bytes())[1]
    total = blocks.agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)).alias("s"), F.sum(F.aggregate(F.transform("samples", lambda v, i: v * (F.col("start") + i)), F.lit(0.0), lambda a, v: a + v)).alias("w")).first()
    assert np.allclose([total["s"], total["w"]], [whole.sum(), (whole * np.arange(len(whole))).sum()], rtol=1e-9)


TABLES = {
    "plain.csv": "timestamp_s,ch1,ch2\n" + "".join(f"{i / 100},{i * 0.5},{-i}\n" for i in range(900)),
    "bare.csv": "".join(f"{i},{i * 0.25}\n" for i in range(700)),
    "tab.tsv": "".join(f"{i}\t{i % 7}\t{i % 5}\n" for i in range(500)),
    "semi.txt": "a;b\n" + "".join(f"{i};{i % 11}\n" for i in range(300)),
    "space.txt": "\n# made\n" + "".join(f" {i}   {i * 1e-3:.6e} {i}\n" for i in range(400)),
    "odd.csv": "t,x\n0,nan\n1,5\n\n# c\n2,inf\n3,-inf\n4,7 # end\n5,oops\n6,\n7,8\n" * 1 + "".join(f"{i},{'nan' if i % 9 == 0 else i}\n" for i in range(8, 400)),
    "falling.csv": "x,y\n" + "".join(f"{400 - i},{i}\n" for i in range(400)),
    "restless.csv": "x,y\n" + "".join(f"{i * 37 % 101},{i}\n" for i in range(400)),
    "one.csv": "1,7\n",
    "single.csv": "h\n" + "".join(f"{i}\n" for i in range(50)),
    "ragged.csv": "a,b\n" + "1,2\n" * 300 + "1,2,3\n" + "1,2\n" * 300,
    "head.csv": "a,b\n",
    "words.csv": "a,b\nx,y\nz,w\n",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    for name, text in TABLES.items():
        (root / name).write_text(text)
    return root


@pytest.mark.parametrize("form", sorted(readers.FORMATS))
def test_tables_in_splits_equal_the_whole_files(spark, tables, form):
    how = readers.FORMATS[form]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        flat, failed = scans.scan_tables(spark, str(tables), how)
        assert scans._lines(spark, str(tables)).rdd.getNumPartitions() > 3
        got = {}
        for r in flat.orderBy("path", "column", "pos").collect():
            got.setdefault((r["path"].rsplit("/", 1)[1], r["column"]), []).append((r["pos"], r["x"]))
        errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in failed.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, wrong = {}, {}
    for name, text in TABLES.items():
        try:
            _, x = readers.decode_table(text.encode(), name, how)
        except ValueError as e:
            wrong[name] = str(e)
            continue
        for c in range(x.shape[1]):
            v = x[:, c]
            v = np.nan_to_num(v, nan=0.0, posinf=0.0, neginf=0.0) if how.non_finite == "zero" else v[np.isfinite(v)]
            if len(v):
                want[name, c + 1] = list(enumerate(v.tolist()))
    assert errors == wrong
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] for k in want), [k for k in want if got[k] != want[k]]


def test_tables_are_cut_without_python(spark, tables):
    plan = scans.scan_tables(spark, str(tables), readers.FORMATS["plain"])[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange hashpartitioning" not in plan


# Signals of an index


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root = tmp_path_factory.mktemp("signals")
    (root / "v.csv").write_text("t,a,b\n" + "".join(f"{i},{i},{10 * i}\n" for i in range(5)))
    (root / "w.wav").write_bytes(wave(np.full((4, 1), 0.5)))
    (root / "unlisted.wav").write_bytes(wave(np.full((4, 1), 0.5)))
    return root


def signals(spark, root, form, *cells):
    index = spark.createDataFrame([(f"s{i}", c, 100) for i, c in enumerate(cells)], "id string, paths string, vibration_sr int")
    return {(r["id"], r["channel"]): (r["error"] or list(r["samples"])) for r in readers.read_signals(spark, index, str(root), None, form).collect()}


def test_cells_that_are_no_list_give_error_rows(spark, recordings):
    got = signals(spark, recordings, "plain", None, "what", json.dumps([f"{recordings}/w.wav", None]), "[]")
    assert got["s0", None] == got["s1", None] == got["s3", None] == "no list of paths" and got["s2", 1] == "no path" and len(got["s2", 0]) == 4
    assert signals(spark, recordings, "ced", "", None)["s0", None] == "no list of paths"


@pytest.mark.parametrize("form", sorted(readers.FORMATS))
def test_each_form_reads_cells_and_suffixes_in_its_way(spark, recordings, form):
    v, how = f"{recordings}/v.csv", readers.FORMATS[form]
    marks = [f"'{v}::col=2； '", f"{v}|col=2", f"{v}#col=2"]
    got = signals(spark, recordings, form, json.dumps(marks), f"['{v}::col=1', \"{v}::col=2\"]", json.dumps({"a": f"{v}::col=1"}))
    assert got["s0", 0] == [0, 10, 20, 30, 40]
    for c in (1, 2):
        assert got["s0", c] == [0, 10, 20, 30, 40] if how.suffix == readers.CHANNEL_SUFFIX else "no file" in got["s0", c]
    if how.lenient:
        assert got["s1", 0] == [0, 1, 2, 3, 4] and got["s1", 1] == [0, 10, 20, 30, 40] and got["s2", 0] == [0, 1, 2, 3, 4]
    else:
        assert got["s1", None] == got["s2", None] == "no list of paths"


@pytest.mark.parametrize("form", ["plain", "ced", "echo"])
def test_scanned_signals_equal_those_read_whole(spark, recordings, form):
    rng = np.random.default_rng(0)
    (recordings / "long.wav").write_bytes(wave(rng.uniform(-1, 1, (5003, 2)), bits=24))
    (recordings / "long.csv").write_text("t,a,b\n" + "".join(f"{i},{v},{'nan' if i % 50 == 7 else -v}\n" for i, v in enumerate(rng.normal(size=3001))))
    (recordings / "single.tsv").write_text("h\n" + "".join(f"{v}\n" for v in rng.normal(size=70)))
    (recordings / "bad.wav").write_bytes(b"RIFF")
    (recordings / "p.mp4").write_bytes(b"x")
    cells = [["long.wav", "long.csv::col=1", "long.csv::col=2", "w.wav"], ["long.wav", "v.csv", "v.csv::col=7", "single.tsv"], ["bad.wav", "p.mp4", "gone.wav", "long.csv::col=2"]]
    index = spark.createDataFrame([(f"s{i}", json.dumps([f"{recordings}/{p}" for p in c]), 100 if i else None) for i, c in enumerate(cells)] + [("none", None, 1)], "id string, paths string, vibration_sr int")
    whole = readers.read_signals(spark, index, str(recordings), 50, form)
    want = {(r["id"], r["channel"]): r["error"] or (r["vec"]) for r in signals_of(whole.where("error IS NULL"))} | {(r["id"], r["channel"]): r["error"] for r in whole.where("error IS NOT NULL").collect()}
    blocks, lost = readers.scan_signals(spark, index, str(recordings), 50, form)
    found = S.encode_blocks(blocks.select(F.struct("id", "channel").alias("key"), "rate", "start", "samples"), Shape, 1000).collect()
    got = {(r["key"]["id"], r["key"]["channel"]): r["error"] or r["vec"] for r in found} | {(r["id"], r["channel"]): r["error"] for r in lost.collect()}
    assert got.keys() == want.keys() and sum(isinstance(v, list) for v in got.values()) >= 7
    for k, v in want.items():
        assert (np.allclose(got[k], v, rtol=1e-12, atol=1e-12) if isinstance(v, list) else got[k] == v), (k, got[k], v)


def signals_of(signals):
    return S.encode_signals(signals, Shape, 1000).collect()


class Shape(Encoder):
    """Numbers that tell windows and their order apart."""

    dim = 4

    def encode(self, signal, rate):
        return np.array([rate, len(signal), signal @ np.arange(len(signal)), signal[0] - 2 * signal[-1]])


def test_contents_of_recordings_are_not_shuffled(spark, recordings):
    index = spark.createDataFrame([("s", json.dumps([f"{recordings}/w.wav"]), 100)], "id string, paths string, vibration_sr int")
    plan = readers.read_signals(spark, index, str(recordings))._jdf.queryExecution().executedPlan().toString()
    contents = plan[plan.index("MapInPandas") : plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in contents and "binaryFile" in contents and "Exchange hashpartitioning" not in contents
