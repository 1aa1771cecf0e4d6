"""FLAC decoding against samples that a small encoder writes, in all subframe kinds, whole and in ranges."""

import hashlib
import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwave.sources import flac, readers
from tests.test_scans import wave

SIDES = {8: lambda x: np.stack([x[:, 0], x[:, 0] - x[:, 1]], 1), 9: lambda x: np.stack([x[:, 0] - x[:, 1], x[:, 1]], 1), 10: lambda x: np.stack([x[:, 0] + x[:, 1] >> 1, x[:, 0] - x[:, 1]], 1)}


def bits(value, n):
    return format(int(value) & ((1 << n) - 1), f"0{n}b") if n else ""


def rice(r, k):
    z = int(r) << 1 if r >= 0 else (-int(r) << 1) - 1
    return "0" * (z >> k) + "1" + bits(z, k)


def residuals(r, size, order, method=0, parts=0, escape=False):
    out, width, at = bits(method, 2) + bits(parts, 4), 4 + method, 0
    for i in range(1 << parts):
        n = (size >> parts) - (order if i == 0 else 0)
        some, at = r[at : at + n], at + n
        if escape:
            w = max([int(abs(v)).bit_length() + 1 for v in some] + [0]) if np.any(some) else 0
            out += bits(-1, width) + bits(w, 5) + "".join(bits(v, w) for v in some)
        else:
            k = min((1 << width) - 2, max(0, int(np.mean(np.abs(some)) if len(some) else 0).bit_length()))
            out += bits(k, width) + "".join(rice(v, k) for v in some)
    return out


def subframe(x, width, kind, wasted=0, coefficients=None, shift=0, **how):
    """kind: constant, verbatim, an order of a fixed predictor, or lpc."""
    x, width = x >> wasted, width - wasted
    mark = bits(1, 1) + "0" * (wasted - 1) + "1" if wasted else "0"
    if kind == "constant":
        return "0" + bits(0, 6) + mark + bits(x[0], width)
    if kind == "verbatim":
        return "0" + bits(1, 6) + mark + "".join(bits(v, width) for v in x)
    c = flac.FIXED[kind] if kind != "lpc" else coefficients
    order = len(c)
    r = [int(x[i]) - (sum(a * int(x[i - 1 - j]) for j, a in enumerate(c)) >> shift) for i in range(order, len(x))]
    head = bits(8 + kind, 6) if kind != "lpc" else bits(31 + order, 6)
    said = bits(13, 4) + bits(shift, 5) + "".join(bits(a, 14) for a in c) if kind == "lpc" else ""
    return "0" + head + mark + "".join(bits(v, width) for v in x[:order]) + said + residuals(np.array(r, object), len(x), order, **how)


def coded(n):
    if n < 0x80:
        return bytes([n])
    more = next(m for m in range(1, 7) if n < 1 << (6 * m + 6 - m))
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> 6 * more, *[0x80 | n >> 6 * (more - 1 - i) & 0x3F for i in range(more)]])


def frame(x, number, width, kinds, sides=None, variable=False):
    code = {8: 1, 12: 2, 16: 4, 20: 5, 24: 6, 32: 7}[width]
    head = bytes([0xFF, 0xF8 | variable, 0x70, (sides or x.shape[1] - 1) << 4 | code << 1]) + coded(number) + (len(x) - 1).to_bytes(2, "big")
    head += bytes([flac.crc8(head)])
    y = SIDES[sides](x) if sides else x
    body = "".join(subframe(y[:, c], width + (sides in (8, 10) and c == 1 or sides == 9 and c == 0), **kinds[c % len(kinds)]) for c in range(x.shape[1]))
    body += "0" * (-len(body) % 8)
    whole = head + int(body, 2).to_bytes(len(body) // 8, "big")
    return whole + flac.crc16(whole).to_bytes(2, "big")


def stream(x, width=16, block=256, kinds=({"kind": 2},), sides=None, variable=False, rate=8000, known=True, tag=b"", digest=None):
    """A file of whole numbers x (places, channels); a list of blocks makes frames of several sizes."""
    sizes, frames, at = block if isinstance(block, list) else [block] * -(-len(x) // block), [], 0
    for n, size in enumerate(sizes):
        frames.append(frame(x[at : at + size], at if variable else n, width, kinds, sides, variable))
        at += size
    raw = x.astype("<i8").reshape(-1, 1).view("u1")[:, : (width + 7) // 8].tobytes()
    md5 = digest or (hashlib.md5(raw).digest() if known else bytes(16))
    word = rate << 44 | (x.shape[1] - 1) << 41 | (width - 1) << 36 | (len(x) if known else 0)
    info = sizes[0].to_bytes(2, "big") * 2 + bytes(6) + word.to_bytes(8, "big") + md5
    return tag + b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x81\0\0\5extra" + b"".join(frames)


def sound(n, channels=1, width=16, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)[:, None]
    x = np.sin(t * (0.05 + 0.01 * np.arange(channels))) * 2.0 ** (width - 3) + rng.normal(0, 2.0 ** (width - 9), (n, channels))
    return np.clip(x.round(), -(2 ** (width - 1)), 2 ** (width - 1) - 1).astype(np.int64)


LPC = {"kind": "lpc", "coefficients": [3900, -1000, -2000, 500, 777, -1, 0, 3], "shift": 11}
CASES = {
    "verbatim": {"kinds": ({"kind": "verbatim"},)},
    **{f"fixed{o}_{w}": {"kinds": ({"kind": o},), "width": w} for o in range(5) for w in (16, 24)},
    "lpc16": {"kinds": (LPC,)}, "lpc24": {"kinds": (LPC,), "width": 24}, "eight": {"width": 8}, "twelve": {"width": 12}, "twenty": {"width": 20, "channels": 3},
    "thirty_two": {"width": 32, "kinds": ({"kind": "verbatim"},)}, "thirty_two_sides": {"width": 32, "channels": 2, "sides": 10, "kinds": ({"kind": 2, "method": 1}, {**LPC, "method": 1})},
    "parts": {"kinds": ({"kind": 2, "parts": 3, "method": 1}, LPC), "channels": 2},
    "escape": {"kinds": ({"kind": 1, "parts": 2, "escape": True},), "width": 24}, "wasted": {"kinds": ({"kind": 1, "wasted": 3}, {"kind": "verbatim", "wasted": 1}), "channels": 2, "step": 8},
    "mixed": {"kinds": ({"kind": 0}, {"kind": 4}, LPC, {"kind": "verbatim"}), "channels": 7},
    **{f"sides{m}_{w}": {"sides": m, "channels": 2, "width": w, "kinds": ({"kind": 2}, LPC)} for m in (8, 9, 10) for w in (16, 24)},
    "variable": {"variable": True, "block": [256, 16, 400, 128, 200]}, "unknown": {"known": False}, "tag": {"tag": b"ID3\4\0\0\0\0\1\2" + bytes(130)},
    "constant": {"kinds": ({"kind": "constant"},), "flat": True}, "one": {"n": 1, "kinds": ({"kind": 0},)}, "one_channel_of_sides": {"n": 300, "block": 7, "channels": 2, "sides": 10},
}


def case(name):
    how = dict(CASES[name])
    n, channels, step = how.pop("n", 1000), how.pop("channels", 1), how.pop("step", 1)
    x = sound(n, channels, how.get("width", 16), len(name)) // step * step
    if how.pop("flat", False):
        x[:] = -77
    return x, stream(x, **how), how.get("width", 16)


@pytest.mark.parametrize("name", CASES)
def test_decoded_samples_are_those_written(name):
    x, raw, width = case(name)
    rate, found = flac.decode_flac(raw)
    assert rate == 8000
    np.testing.assert_array_equal(found, (x / 2.0 ** (width - 1)).mean(1))


def test_a_recording_equals_its_wave_twin():
    for width in (16, 24):
        x = sound(3000, 2, width)
        top = 2 ** (width - 1) - 1
        twin = readers.decode_wav(wave(x / top, bits=width)[:])
        ours = flac.decode_flac(stream(np.stack([(x[:, c] / top * top).astype(np.int64) for c in range(2)], 1), width, sides=10))
        assert ours[0] == twin[0]
        np.testing.assert_array_equal(ours[1], twin[1])


@pytest.mark.parametrize(("change", "error"), [
    (lambda r: r[:-1], "cut frame"), (lambda r: r[:-300], "cut"), (lambda r: r[:30], "short"), (lambda r: b"", "marker"), (lambda r: b"RIFF" + r[4:], "marker"),
    (lambda r: r[:700] + bytes([r[700] ^ 16]) + r[701:], "frame"), (lambda r: r[:57], "samples|cut"), (lambda r: r + b"TAG" + bytes(125), None),
])
def test_broken_files_are_errors(change, error):
    raw = change(stream(sound(1000)))
    if error is None:
        assert len(flac.decode_flac(raw)[1]) == 1000
    else:
        with pytest.raises(ValueError, match=error):
            flac.decode_flac(raw)


def test_a_wrong_digest_and_a_lost_frame_are_errors():
    x = sound(1000)
    with pytest.raises(ValueError, match="digest"):
        flac.decode_flac(stream(x, digest=bytes(range(16))))
    whole = stream(x)
    second = whole.index(frame(x[256:512], 1, 16, ({"kind": 2},)))
    with pytest.raises(ValueError, match="not the next"):
        flac.decode_flac(whole[:second] + whole[second + len(frame(x[256:512], 1, 16, ({"kind": 2},))) :])


def test_ranges_of_every_size_give_every_frame_once():
    x = sound(2000, 2)
    raw = stream(x, sides=8, block=128)
    s = flac.stream_header(lambda at, n: raw[at : at + n], len(raw))
    for step in (1000, 397, 90, 11):
        found = {}
        for a in range(0, len(raw), step):
            for f, _ in flac.frames_between(lambda at, n: raw[at : at + n], a, min(len(raw), a + step), len(raw), s):
                assert f.place not in found
                found[f.place] = f.size
        assert sorted(found) == list(range(0, 2000, 128)) and sum(found.values()) == 2000


def test_a_broken_frame_at_a_border_is_an_error_of_some_range():
    raw = bytearray(stream(sound(2000), block=128))
    s = flac.stream_header(lambda at, n: bytes(raw[at : at + n]), len(raw))
    at = s.start
    starts = []
    while at < len(raw):
        starts.append(at)
        at += flac.unpack_frame(bytes(raw[at:]), s)[2]
    for border in starts[3], starts[3] - 1, starts[3] + 1:
        for hit in starts[3] + 1, starts[3] + 40:
            broken = bytes(raw[:hit]) + bytes([raw[hit] ^ 4]) + bytes(raw[hit + 1 :])
            errors = 0
            for a, z in ((0, border), (border, len(raw))):
                try:
                    list(flac.frames_between(lambda at, n: broken[at : at + n], a, z, len(raw), s))
                except ValueError:
                    errors += 1
            assert errors


@pytest.fixture(scope="module")
def recordings(tmp_path_factory):
    root = tmp_path_factory.mktemp("flac")
    for name in CASES:
        (root / f"{name}.flac").write_bytes(case(name)[1])
    long = stream(np.tile(sound(4096, 1), (12, 1)), block=512)
    (root / "long.FLAC").write_bytes(long)
    (root / "cut.flac").write_bytes(long[:-7])
    (root / "empty.flac").write_bytes(b"")
    return root


def test_scanned_blocks_equal_whole_files(spark, recordings):
    blocks = flac.scan_flacs(spark, str(recordings), split_bytes=5000).orderBy("path", "start").collect()
    names = {r["path"].rsplit("/", 1)[1] for r in blocks}
    assert names == {p.name for p in recordings.iterdir()}
    for p in recordings.iterdir():
        own = [r for r in blocks if r["path"].endswith("/" + p.name)]
        if p.name in ("cut.flac", "empty.flac"):
            assert [r["error"] for r in own if r["error"]]
            continue
        assert not any(r["error"] for r in own)
        assert [r["start"] for r in own] == [sum(len(b["samples"]) for b in own[:i]) for i in range(len(own))]
        np.testing.assert_array_equal(np.concatenate([r["samples"] for r in own]), flac.decode_flac(p.read_bytes())[1])
    assert len([r for r in blocks if r["path"].endswith("long.FLAC")]) > 5


def test_signals_of_an_index(spark, recordings):
    files = ["long.FLAC", "cut.flac", "sides10_24.flac", "empty.flac", "no.flac"]
    index = spark.createDataFrame([(f, json.dumps([str(recordings / f)]), None) for f in files], "id string, paths string, vibration_sr int")
    whole = {r["id"]: r for r in readers.read_signals(spark, index, str(recordings)).collect()}
    assert {i: r["error"] is None for i, r in whole.items()} == {f: f in ("long.FLAC", "sides10_24.flac") for f in files}
    blocks, errors = readers.scan_signals(spark, index, str(recordings))
    assert sorted(r["id"] for r in errors.select("id").collect()) == ["cut.flac", "empty.flac", "no.flac"]
    for r in blocks.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("start", "samples"))), lambda b: b["samples"])).alias("x")).collect():
        assert r["x"] == whole[r["id"]]["samples"]


def test_a_minute_is_decoded_in_seconds():
    part = stream(sound(4096, 2, 16), block=4096, kinds=(LPC,))
    s = flac.stream_header(lambda at, n: part[at : at + n], len(part))
    frames = [flac.unpack_frame(part[s.start :], s)[:2] for _ in range(flac.BATCH)]
    began = time.perf_counter()
    assert all((x == sound(4096, 2, 16)).all() for x in flac.samples_of(frames))
    assert time.perf_counter() - began < 5
