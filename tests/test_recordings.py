"""Dataset trees, readers, writers, encoders, streaming and the chained jobs, on small files."""

import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave import jobs
from siftwave.functions import paths as P
from siftwave.operators import detection as D
from siftwave.operators import encoders as N
from siftwave.operators import evaluation as E
from siftwave.operators import splits as X
from siftwave.operators.matching import latest_by_id, match_and_count, match_ids, missing_report
from siftwave.operators.neighbours import nearest
from siftwave.operators.running import Ordered
from siftwave.operators.signals import encode_signals
from siftwave.sources import readers, writers
from siftwave.streaming.scoring import prepare, score_arrivals, score_batch


def write_wav(path, x, rate=16_000, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())


def write_sample(folder, idx, tone, rng, columns=4, before=""):
    for kind, end in (("audio", "wav"), ("ios", "mp4"), ("android", "mp4"), ("vibration", "csv")):
        (folder / kind).mkdir(parents=True, exist_ok=True)
        path = folder / kind / f"{kind}_part_{idx}.{end}"
        t = np.arange(1600) / 16_000
        if end == "csv":
            values = np.sin(2 * np.pi * tone * t[:200, None]) + rng.normal(0, 0.05, (200, columns))
            path.write_text(before + "timestamp_s," + ",".join(f"ch{c + 1}" for c in range(columns)) + "\n" + "\n".join(",".join(map(str, [i, *v])) for i, v in enumerate(values)))
        elif end == "wav":
            write_wav(path, 0.4 * np.sin(2 * np.pi * tone * t) + rng.normal(0, 0.01, len(t)))
        else:
            path.write_bytes(b"no audio here")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("tree"), np.random.default_rng(0)
    for v in (80, 90, 100, 120):
        for load in ("heavy", "light"):
            for noise in ("clean", "noiseA"):
                for i in range(2):
                    write_sample(root / f"normal/{load}_vel{v}_{noise}", f"{i:04d}", 100, rng, before="# made\n\n" * (i == 0))
                    for fault, tone in (("dry", 700), ("lean", 1500)):
                        write_sample(root / f"abnormal/{fault}/{load}_vel{v}_{noise}", f"{i:04d}", tone, rng)
    odd = root / "normal/odd_vel80_clean"
    write_sample(odd, "0001", 100, rng, columns=3)
    write_sample(odd, "x1", 100, rng)
    write_sample(odd, "0002", 100, rng)
    (odd / "android/android_part_0002.mp4").unlink()
    write_sample(odd, "0003", 100, rng)
    (odd / "vibration/vibration_part_0003.csv").write_bytes(b"\xff\xfe,1,2,3,4\n")
    write_sample(odd, "0004", 100, rng)
    (odd / "vibration/vibration_part_0004.csv").write_bytes(b"# only\n\n   \n")
    write_sample(odd, "0005", 100, rng)
    (odd / "vibration/vibration_part_0005.csv").write_bytes(b"")  # Spark lists no empty files
    write_sample(odd, "0006", 100, rng, before="#" * 200_000 + "\n")
    return root


def test_vibration_columns_are_sniffed(spark, tree):
    got = {r["path"].rsplit("/", 1)[1]: r["n_columns"] for r in readers.sniff_columns(spark, str(tree / "normal/odd_vel80_clean")).collect()}
    assert got == {f"vibration_part_{i}.csv": n for i, n in (("0001", 3), ("x1", 4), ("0002", 4), ("0003", 0), ("0004", 0), ("0005", 0), ("0006", 4))}


def test_index_of_a_tree(spark, tree):
    index = readers.build_index(readers.list_tree(spark, str(tree)), readers.sniff_columns(spark, str(tree)))
    rows = {r["id"]: r for r in index.collect()}
    assert len(rows) == 16 * 2 * 3 + 1 and "normal/odd_vel80_clean_0006" in rows
    r = rows["abnormal/dry/heavy_vel80_clean_0001"]
    assert (r["split"], r["label"], r["vibration_sr"]) == ("Anomalous", 1, 100_000)
    files = json.loads(r["paths"])
    assert len(files) == 7 and files[0] == f"{tree}/abnormal/dry/heavy_vel80_clean/audio/audio_part_0001.wav" and files[6].endswith("vibration_part_0001.csv::col=4")


def test_index_round_trip_and_positional_columns(spark, tmp_path):
    paths = json.dumps(["/a,b.wav", '/q"x.csv::col=1'])
    df = spark.createDataFrame([("i1", paths, "Normal", 0, None), ("i2", "[]", "Anomalous", 1, 50)], "id string, paths string, split string, label long, vibration_sr int")
    writers.write_csv(df, f"{tmp_path}/index.csv")
    assert sorted(readers.read_index(spark, f"{tmp_path}/index.csv").collect()) == sorted(df.collect())
    got = readers.read_positional(spark, f"{tmp_path}/index.csv").collect()
    assert sorted((r["id"], r["label"]) for r in got) == [("i1", "normal"), ("i2", "anomalous")]
    writers.write_csv(df.drop("split"), f"{tmp_path}/short.csv")
    with pytest.raises(ValueError, match="split"):
        readers.read_index(spark, f"{tmp_path}/short.csv")


def test_id_lists(spark, tmp_path):
    ids = spark.createDataFrame([(2, "b"), (1, "a"), (3, "a")], "ord long, id string").orderBy("ord")
    writers.write_ids(ids, f"{tmp_path}/list")
    assert [r["id"] for r in readers.read_ids(spark, f"{tmp_path}/list").orderBy("ord").collect()] == ["a", "b", "a"]
    (tmp_path / "s").mkdir()
    for name, text in (("dev_source_normal", "/x/y/normal/n1\n\n n2 \n"), ("eval_normal", "z\n"), ("eval_abn", "/d/abnormal/dry/q\n/d/abnormal/dry/q\n")):
        (tmp_path / f"s/{name}.ids").write_text(text)
    train, test = readers.read_split(spark, f"{tmp_path}/s")
    assert [r["id"] for r in train.orderBy("ord").collect()] == ["y/normal/n1", "n2"]
    assert [r["id"] for r in test.orderBy("ord").collect()] == ["z", "abnormal/dry/q", "abnormal/dry/q"]
    (tmp_path / "s/dev_source_normal.ids").write_text("\n")
    with pytest.raises(ValueError, match="training"):
        readers.read_split(spark, f"{tmp_path}/s")


def test_lists_keep_order_and_duplicates_and_the_last_features_count(spark):
    features = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0]), (2, "a", [3.0])], "ord long, id string, vec array<double>")
    ids = spark.createDataFrame([(0, "b"), (1, "a"), (2, "gone"), (3, "a")], "ord long, id string")
    got = [(r["ord"], r["id"], r["source_ord"], r["vec"]) for r in match_ids(ids, features).orderBy("ord").collect()]
    assert got == [(0, "b", 1, [2.0]), (1, "a", 2, [3.0]), (3, "a", 2, [3.0])]
    assert latest_by_id(features).count() == 2
    assert tuple(missing_report(ids, features).first()) == (1, ["gone"])
    assert tuple(missing_report(ids.where("id != 'gone'"), features).first()) == (0, [])


def test_npz_layouts(spark, tmp_path):
    x = np.arange(28.0).reshape(2, 14)
    own = {"ids": np.array(["a", "b"]), "labels": np.array([0, 1]), "splits": np.array(["NORMAL", "Anomalous"])}
    np.savez(tmp_path / "x.npz", X=x, **own)
    np.savez(tmp_path / "c.npz", **{f"X_ch{c}": x[:, 2 * c : 2 * c + 2] for c in range(7)}, **own)
    np.savez(tmp_path / "p.npz", X_per_channel=x.reshape(2, 7, 1, 2), **own)
    want = [(i, c, x[i, 2 * c : 2 * c + 2].tolist()) for i in range(2) for c in range(7)]
    for name in ("x", "c", "p"):
        long = jobs.load_features(spark, f"{tmp_path}/{name}.npz", name != "x")
        assert sorted((r["ord"], r["channel"], r["vec"]) for r in long.collect()) == want
        assert {(r["id"], r["normal"]) for r in long.select("id", "normal").collect()} == {("a", True), ("b", False)}
    writers.write_npz(readers.read_npz(spark, f"{tmp_path}/x.npz"), f"{tmp_path}/again.npz")
    assert np.array_equal(np.load(tmp_path / "again.npz")["X"], x.astype("f4"))
    np.savez(tmp_path / "bad.npz", X=np.array([[1], [2, 3]], dtype=object), **own)
    with pytest.raises(Exception, match="pickle"):
        readers.read_npz(spark, f"{tmp_path}/bad.npz").collect()


def test_layout_checks(spark):
    lists = spark.createDataFrame([(0, [[1.0]] * 6)], "ord long, per_channel array<array<double>>")
    with pytest.raises(Exception, match="one vector for each channel"):
        readers.channels_of_lists(lists).collect()
    with pytest.raises(ValueError, match="per_channel"):
        readers.channels_of_cells(lists.drop("per_channel"))
    with pytest.raises(Exception, match="multiple"):
        readers.blocks_of_concat(spark.createDataFrame([(0, [1.0] * 8)], "ord long, x array<double>")).collect()
    both = spark.createDataFrame([(0, "Normal", 1), (1, "x", 0)], "ord long, split string, label long")
    assert [r["normal"] for r in readers.with_normality(both).collect()] == [True, False]
    assert [r["normal"] for r in readers.with_normality(both.drop("split")).collect()] == [False, True]
    with pytest.raises(ValueError):
        readers.with_normality(both.select("ord"))


def test_tables_are_decoded_as_each_encoder_wants():
    plain = b"t,a,b\n0,1,nan\n1,2,5\n"
    assert readers.decode_table(plain, "v.csv")[1][:, 0].tolist() == [1, 2]
    assert readers.decode_table(b"0\t1\n1\t2\n", "v.tsv", readers.FORMATS["beats"])[1].tolist() == [[2.0]]
    assert readers.decode_table(b"h,i\n3,1\n1,2\n2,3\n", "v.csv", readers.FORMATS["echo"])[1].shape == (3, 2)
    assert readers.decode_table(b"1,7\n", "v.csv", readers.FORMATS["echo"])[1].tolist() == [[7.0]]
    assert readers.decode_table(b"0 1\n1 2\n", "v.txt")[1].tolist() == [[1.0], [2.0]]
    assert readers.decode_table(b"5\n6\n", "v.csv")[1].tolist() == [[5.0], [6.0]]
    for bad in (b"", b"# x\n", b"a,b\n"):
        with pytest.raises(ValueError):
            readers.decode_table(bad, "v.csv")
    with pytest.raises(ValueError):
        readers.decode_table(plain, "v.mp4")


def test_wav_widths_and_mixdown(tmp_path):
    write_wav(tmp_path / "a.wav", np.repeat([0.5, -0.5], [1, 1]), channels=2)
    rate, x = readers.decode_wav((tmp_path / "a.wav").read_bytes())
    assert rate == 16_000 and np.allclose(x, [0.0], atol=1e-4)
    with pytest.raises(ValueError):
        readers.decode_wav(b"RIFF")


def test_signals_of_an_index(spark, tree):
    index = readers.build_index(readers.list_tree(spark, str(tree)), readers.sniff_columns(spark, str(tree))).where("id = 'abnormal/dry/heavy_vel80_clean_0001'")
    gone = index.withColumn("id", F.lit("gone")).withColumn("paths", F.lit(json.dumps([f"{tree}/none.wav", f"{tree}/abnormal/dry/heavy_vel80_clean/vibration/vibration_part_0001.csv::col=9"])))
    got = {(r["id"], r["channel"]): r for r in readers.read_signals(spark, index.unionByName(gone), str(tree)).collect()}
    whole = {c: got["abnormal/dry/heavy_vel80_clean_0001", c] for c in range(7)}
    assert (whole[0]["rate"], len(whole[0]["samples"]), whole[0]["error"]) == (16_000, 1600, None)
    assert all(whole[c]["error"] and whole[c]["samples"] is None for c in (1, 2))
    assert all((whole[c]["rate"], len(whole[c]["samples"])) == (100_000, 200) for c in range(3, 7))
    assert "no file" in got["gone", 0]["error"] and "column 9" in got["gone", 1]["error"]


@pytest.mark.parametrize(
    "cell,want",
    [
        ('["a", "b"]', ["a", "b"]),
        ('"[\\"a\\", \\"b\\"]"', ["a", "b"]),
        ("['a', 'b']", ["a", "b"]),
        ("[a, 'b']", ["a", "b"]),
        ("one.wav", ["one.wav"]),
        ('"one.wav"', ["one.wav"]),
        ('{"x": "a", "y": "b"}', ["a", "b"]),
        ("{'x': 'a'}", ["a"]),
        ('[{"path": "a", "col": 2}, {"file": "b"}, {"src": "c", "ch": 1}]', ["a::col=2", "b", "c::col=1"]),
        ("", []),
        ("None", []),
        (None, []),
    ],
)
def test_lenient_path_cells(spark, cell, want):
    df = spark.createDataFrame([(cell,)], "c string")
    assert df.select(P.decode_paths(F.col("c"), lenient=True)).first()[0] == want


def test_strict_path_cells_and_names(spark):
    df = spark.createDataFrame([('["a"]',), ("a",), ("{}",), (None,)], "c string")
    assert [r[0] for r in df.select(P.decode_paths(F.col("c"))).collect()] == [["a"], None, None, None]
    odd = spark.createDataFrame([("﻿'/a/b.WAV； '", "a/b\\c")], "p string, i string")
    assert tuple(odd.select(P.clean_path(F.col("p")), P.extension(P.clean_path(F.col("p"))), P.file_name(F.col("i"))).first()) == ("/a/b.WAV", ".wav", "a__b__c")
    assert odd.select(P.default_paths(F.lit("/r/"), F.lit("s"))).first()[0][:4:3] == ["/r/audio/s_recorder.wav", "/r/vibration/s_vibration.csv::col=1"]
    assert P.json_options('{"a": 1}') == {"a": 1} and P.json_options("") == {}
    with pytest.raises(ValueError):
        P.json_options("[1]")
    assert P.csv_options(" A, ,b ") == ["a", "b"]


def test_monotone_and_first_rows(spark):
    df = spark.createDataFrame([("up", 0, 1.0), ("up", 1, 1.0), ("down", 0, 2.0), ("down", 1, 1.0), ("no", 0, 1.0), ("no", 1, 2.0), ("no", 2, 1.0), ("one", 0, 1.0)], "key string, pos long, x double")
    assert {r["key"]: r["monotone"] for r in readers.is_monotone(df).collect()} == {"up": True, "down": True, "no": False, "one": True}
    rows = spark.range(10).select(F.col("id").alias("ord"))
    assert readers.first_samples(rows, None).count() == 10 and [r[0] for r in readers.first_samples(rows, 3).collect()] == [0, 1, 2]


def test_resampling_keeps_tones():
    for rate, target in ((100_000, 16_000), (44_100, 16_000), (8_000, 16_000), (16_000, 16_000)):
        t, u = np.arange(rate // 2) / rate, np.arange(target // 2) / target
        got = N.resample(np.sin(2 * np.pi * 440 * t), rate, target)
        assert len(got) == -(-target * len(t) // rate)
        assert np.abs(got - np.sin(2 * np.pi * 440 * u))[200:-200].max() < 5e-3
    assert np.abs(N.resample(np.sin(2 * np.pi * 12_000 * np.arange(50_000) / 100_000), 100_000))[200:-200].max() < 0.02
    assert len(N.resample(np.zeros(0), 8_000)) == 0


def test_spectra_segments_and_bands():
    x = np.random.default_rng(0).normal(size=700)
    width, hop = N.frame_sizes(8_000)
    s = N.spectrum(x, 8_000)
    assert (width, hop) == (200, 80) and s.shape == (1 + (700 - 200) // 80, 101)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(200) / 200)
    direct = [abs(sum((x - x.mean())[80 + n] * window[n] * np.exp(-2j * np.pi * k * n / 200) for n in range(200))) for k in (0, 7, 100)]
    assert np.allclose(s[1, [0, 7, 100]], direct)
    rows = np.arange(10)[:, None]
    assert [p[:, 0].tolist() for p in N.segments(rows, 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [6, 7, 8, 9]]
    assert len(N.segments(rows, 5)) == 2 and len(N.segments(rows[:0], 4)) == 1 and N.segments(rows[:0], 4, short=False) == []
    assert N.pad_bands(np.ones((2, 3)), 5).shape == (2, 5) and N.pad_bands(np.ones((2, 9)), 5).shape == (2, 9)
    assert N.band_count(16_000) == 7 and N.band_count(100) == 1


def test_mel_image():
    bank = N.mel_bank(128, 512, 16_000)
    assert bank.shape == (256, 128) and (bank >= 0).all() and bank.max() <= 1 and (bank[0] == 0).all()
    image = N.MelSpectrum().image(np.sin(2 * np.pi * 1000 * np.arange(16_000) / 16_000), 16_000)
    assert image.shape == (1024, 128) and np.allclose(image[98:], 4.268 / 4.569)
    centre = 1127 * np.log1p(1000 / 700)
    edges = np.linspace(1127 * np.log1p(20 / 700), 1127 * np.log1p(8000 / 700), 130)[1:-1]
    assert abs(image[:98].mean(0).argmax() - np.abs(edges - centre).argmin()) <= 1
    x = np.random.default_rng(1).normal(size=400)
    f = x - x.mean()
    f = np.append(f[0] - 0.97 * f[0], f[1:] - 0.97 * f[:-1]) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 399))
    power = np.abs(np.fft.fft(np.pad(f, (0, 112))))[:256] ** 2
    assert np.allclose(N.log_mel(x, 16_000)[0], np.log(np.maximum(power @ bank, np.finfo(np.float32).eps)))


@pytest.mark.parametrize("encoder", [N.LogSpectrum(8), N.SegmentSpectrum("echo", 64), N.SegmentSpectrum("fisher", 128), N.MelSpectrum()])
def test_encoders_keep_their_dimension(encoder):
    x = np.random.default_rng(0).normal(size=5000)
    assert all(encoder.encode(x, rate).shape == (encoder.dim,) for rate in (8_000, 16_000))


def test_encoders_are_loaded_by_name_or_file(tmp_path):
    (tmp_path / "own.py").write_text("class FeatureExtractor:\n    dim = 1\n    def __init__(self, gain=1):\n        self.gain = gain\n    def encode(self, signal, rate):\n        return signal[:1] * self.gain\n")
    made = N.encoder_factory(f"{tmp_path}/own.py", gain=3)()
    assert made.encode(np.ones(4), 1).tolist() == [3]
    assert N.encoder_factory("siftwave.operators.encoders", "LogSpectrum", dim=5)().dim == 5
    for source, name in ((f"{tmp_path}/own.py", "Other"), (f"{tmp_path}/none.py", "X"), ("siftwave.operators.encoders", "Nothing")):
        with pytest.raises(ValueError):
            N.encoder_factory(source, name)()


def test_encoder_files_are_sent_to_the_workers(spark, tmp_path):
    source = "import numpy as np\nclass FeatureExtractor:\n    dim = 1\n    def __init__(self, gain):\n        self.gain = gain\n    def encode(self, signal, rate):\n        return np.array([signal.sum() * self.gain])\n"
    signals = spark.createDataFrame([("a", 0, 1, [1.0, 2.0])], "id string, channel int, rate int, samples array<double>")
    made = []
    for gain in (2, 3):
        (tmp_path / "own.py").write_text(source.replace("self.gain])", f"self.gain + {gain}])"))
        made.append(N.encoder_factory(f"{tmp_path}/own.py", spark=spark, gain=10))
    (tmp_path / "own.py").unlink()  # workers have what was sent, each time under a name of its own
    assert [encode_signals(signals, m).first()["vec"] for m in made] == [[32.0], [33.0]]


def test_counts_are_taken_while_sides_are_stored(spark):
    features = spark.createDataFrame([(i, x, c, [1.0]) for i, x in enumerate(("normal/a_1", "b/c_2", "abnormal/dry/d_3")) for c in range(7)], "ord long, id string, channel int, vec array<double>")
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(("normal/a_1", "gone", "b/c_2", "b/c_2", "also/gone", "normal/a_1"))], "ord long, id string")
    got = match_and_count(ids, features, "side", label=P.fault_from_path(F.col("id")))
    assert (got.n_missing, got.first_missing, got.n_unlabelled) == (2, ["gone", "also/gone"], 2)
    assert {(r["ord"], r["label"]) for r in got.rows.collect()} == {(0, "normal"), (5, "normal")} and got.rows.count() == 14
    plain = match_and_count(ids.where("id = 'b/c_2'"), features, "plain")
    assert (plain.n_missing, plain.first_missing, plain.n_unlabelled, plain.rows.count()) == (0, [], 0, 14)


def test_blocks_and_broadcast_find_the_same_neighbours(spark, monkeypatch):
    import siftwave.operators.neighbours as M

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(150, 6)), rng.integers(0, 2, (150, 6)).astype(float), 1e6 + rng.normal(size=(100, 6)) * 1e-3])
    frame = spark.createDataFrame([(c, i, v.tolist()) for c in (0, 1) for i, v in enumerate(x)], "channel int, ord long, vec array<double>")
    rows = lambda: sorted(map(tuple, nearest(frame, frame, 7, "l2", skip_first=True).collect()))
    one = rows()
    monkeypatch.setattr(M, "BROADCAST", 0)
    monkeypatch.setattr(M, "BLOCK", 64)
    assert rows() == one
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for c, i, rank, dist, train, *_ in one:
        order = np.lexsort((np.arange(len(x)), d[i]))
        assert train == order[rank] and dist == d[i][order[rank]]
        assert c in (0, 1)


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(2)
    values = rng.permutation(500).astype(float)
    df = spark.createDataFrame([(k, float(v), int(rng.integers(0, 5))) for k in ("a", "b") for v in values], "k string, v double, n long").repartition(5)
    for down in (False, True):
        o = Ordered(df, "k", "v", descending=down)
        got = o.sums(o.following(o.rows, "n"), s=F.col("n")).toPandas()
        for _, g in got.groupby("k"):
            g = g.sort_values("v", ascending=not down)
            assert g["s"].tolist() == g["n"].cumsum().tolist() and set(g["total_s"]) == {g["n"].sum()}
            assert g["next_n"].tolist()[:-1] == g["n"].tolist()[1:] and np.isnan(g["next_n"].tolist()[-1])


def test_percentile_is_clipped_and_interpolated(spark):
    scored = spark.createDataFrame([("v", float(s), 0) for s in (1, 2, 2, 4, 10)], "view string, score double, y_true int")
    for q in (0.0, 0.3, 0.5, 0.9, 1.0):
        r = E.pick_threshold(scored, "percentile", q).first()
        assert np.isclose(r["thr"], np.quantile([1, 2, 2, 4, 10], min(max(q, 1e-6), 1 - 1e-6))) and 0 < r["about"]["percentile"] < 1


def test_training_needs_two_normals(spark):
    with pytest.raises(ValueError, match="at least 2"):
        D.require_normals(spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0])], "channel int, ord long, vec array<double>"))


def test_arrivals_are_scored_as_they_come(spark, tmp_path):
    rng = np.random.default_rng(5)
    schema = "channel int, ord long, vec array<double>"
    train = spark.createDataFrame([(c, i, rng.normal(size=3).tolist()) for c in range(7) for i in range(30)], schema)
    new = [spark.createDataFrame([(c, 100 * b + i, (rng.normal(size=3) + b).tolist()) for c in range(7) for i in range(5)], schema) for b in (1, 2)]
    ready = prepare(train, k=5)
    for n in range(2):
        new[n].write.mode("append").parquet(f"{tmp_path}/in")
        score_arrivals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ready, f"{tmp_path}/out", f"{tmp_path}/check", ["audio", "fused"]).awaitTermination()
    got = {(r["view"], r["ord"]): r["score"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["view"], r["ord"]): r["score"] for r in score_batch(new[0].unionByName(new[1]), ready, ["audio", "fused"]).collect()}
    assert got == want and len(got) == 20


def test_jobs_from_a_tree_to_results(spark, tree, tmp_path):
    run = lambda *args: jobs.main(list(args), spark)
    for p in tree.rglob("*.mp4"):  # stand-ins for the two phones' recordings, which this library can't decode
        wav = p.parent.parent / "audio" / p.name.replace(p.parent.name, "audio").replace(".mp4", ".wav")
        p.with_suffix(".wav").write_bytes(wav.read_bytes())
    run("make-index", "--root", str(tree), "--csv", f"{tmp_path}/raw")
    common = ("--twins", "--index", f"{tmp_path}/raw", "--root", str(tree), "--encoder", "siftwave.operators.encoders", "--class-name", "LogSpectrum", "--extractor-args", '{"dim": 6}')
    run("extract-features", *common, "--out", f"{tmp_path}/whole", "--limit", "90")
    run("extract-features", *common, "--out", f"{tmp_path}/parts", "--per-channel")
    assert spark.read.parquet(f"{tmp_path}/whole").select(F.size("x")).distinct().collect() == [(42,)] and spark.read.parquet(f"{tmp_path}/whole").count() == 90
    run("extract-features", *common, "--out", f"{tmp_path}/scanned", "--per-channel", "--scan")
    both = [{(r["id"], r["channel"]): r["vec"] for r in spark.read.parquet(f"{tmp_path}/{n}").collect()} for n in ("parts", "scanned")]
    assert both[0].keys() == both[1].keys() and all(np.allclose(v, both[1][k], atol=1e-9) for k, v in both[0].items())
    run("split-fd", "--csv", f"{tmp_path}/raw", "--outdir", f"{tmp_path}/fd", "--train-leave-combos", "heavy-clean")
    run("split-fc", "--csv", f"{tmp_path}/raw", "--outdir", f"{tmp_path}/fc", "--hard-labels", "", "--hard-vels", "")
    counts = {r["side"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/fd/split_counts.csv").collect()}
    assert counts["train"]["n_abnormal"] == "0" and int(counts["train"]["n_rows"]) + int(counts["test"]["n_rows"]) == 97
    meta = json.loads((tmp_path / "fc/split_meta.json").read_text())
    assert len(meta) == 19 and meta["N_train"] + meta["N_test"] == 97 and meta["all_labels"] == ["dry", "lean", "normal"]
    for features, more in (("parts", ["--per-channel"]), ("whole", [])):
        out = f"{tmp_path}/{features}-fd"
        run("detect", "--features", f"{tmp_path}/{features}", "--outdir", out, "--train-ids", f"{tmp_path}/fd/train.ids", "--test-ids", f"{tmp_path}/fd/test.ids", "--knn-k", "3", "--do-cm", *more)
        table = spark.read.option("header", True).csv(f"{out}/metrics_compare_views.csv")
        areas = {r["view"]: float(r["AUROC"]) for r in table.collect()}
        assert len(table.columns) == 11 and len(areas) == 3 and areas["vibration"] > 0.95 and areas["fused"] > 0.9, areas
        metrics = json.loads((tmp_path / f"{features}-fd/view_vibration/metrics.json").read_text())
        assert metrics["CM_mode"] == "youden" and metrics["CM_ACC"] > 0.9
        per = spark.read.option("header", True).csv(f"{out}/view_vibration/per_channel_scores.csv")
        assert per.columns == ["id", "y_true", "ch1", "ch2", "ch3", "ch4", "score_mean"]
        assert spark.read.option("header", True).csv(f"{out}/view_audio/cm_youden.csv").count() == 2
    run("classify", "--features", f"{tmp_path}/parts", "--outdir", f"{tmp_path}/out", "--train-ids", f"{tmp_path}/fc/train.ids", "--test-ids", f"{tmp_path}/fc/test.ids", "--knn-k", "3", "--inspect-labels", "dry", "--inspect-topk", "9", "--per-channel")
    table = spark.read.option("header", True).csv(f"{tmp_path}/out/metrics_compare_views_multiclass.csv")
    assert {"F1_dry", "F1_lean", "F1_normal", "N_train", "vote"} <= set(table.columns) and {r["view"]: float(r["raw_acc"]) for r in table.collect()}["vibration"] > 0.8
    preds = spark.read.option("header", True).csv(f"{tmp_path}/out/view_fused/preds_multiclass.csv")
    assert preds.columns == ["id", "condition", "y_true", "y_pred", "p_dry", "p_lean", "p_normal"]
    inspected = spark.read.option("header", True).csv(f"{tmp_path}/out/inspect_neighbors_dry__fused.csv")
    assert inspected.count() > 0 and {r["rank"] for r in inspected.collect()} == {"1", "2", "3"}
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/inspect_train_hit_counts_dry__fused.csv").columns == ["train_id", "train_label", "hit_count"]
    one = spark.read.option("header", True).csv(f"{tmp_path}/out/view_audio/metrics_multiclass.csv").collect()
    assert [r["view"] for r in one] == ["audio"] and one[0]["knn_k"] == "3"
    with pytest.raises(ValueError, match="split folder"):
        run("detect", "--features", f"{tmp_path}/parts", "--outdir", "x")


def test_ordered_ids_and_hash_order(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "a", "x"), (3, "c", "x")], "ord long, id string, part string")
    assert [r["id"] for r in X.ordered_ids(rows, ("y", "x")).collect()] == ["b", "a", "c"]
