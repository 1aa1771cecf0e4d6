"""ISO media containers: writing payloads as sample tracks, and reading their metadata without decoding.

`mux` stores a payload in one track of 8-bit samples; `probe` walks the nested boxes of any
container, decodes the sample tables and fragment runs of every track, and reports codec, duration
and the byte ranges of keyframes. Both run inside tasks on one row at a time and keep no state between rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from siftwave.llm.storage import with_computed

SAMPLE, PER_CHUNK, KEY_EVERY, RATE = 64, 128, 16, 8000
TRACK = "struct<track:int,handler:string,codec:string,timescale:long,duration:long,n_samples:long,media_bytes:long,keyframes:array<struct<start:long,stop:long>>>"


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 2**32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes) -> bytes:
    """A container whose only track holds payload (a positive multiple of SAMPLE bytes) as raw 8-bit samples.

    Each access unit has SAMPLE bytes, each chunk PER_CHUNK units, and every KEY_EVERY-th unit is
    marked as a keyframe.
    """
    n = len(payload) // SAMPLE
    units = n * SAMPLE
    chunks = -(-n // PER_CHUNK)
    last = n - (chunks - 1) * PER_CHUNK
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, RATE, units), struct.pack(">IH10x", 0x10000, 0x100), matrix, bytes(24), struct.pack(">I", 2), version=1)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, units), struct.pack(">8xhhHxx", 0, 0, 0x100), matrix, bytes(8), version=1, flags=7)
    mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, units, 0x55C4, 0), version=1)
    hdlr = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"payload\0")
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    stsd = _full(b"stsd", struct.pack(">I", 1), entry)
    stts = _full(b"stts", struct.pack(">III", 1, n, SAMPLE))
    runs = [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    stsc = _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs])
    stsz = _full(b"stsz", struct.pack(">II", SAMPLE, n))
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    stss = _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes())

    def moov(offsets: bytes) -> bytes:
        co64 = _full(b"co64", struct.pack(">I", chunks), offsets)
        stbl = _box(b"stbl", stsd, stts, stss, stsc, stsz, co64)
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    large = len(payload) + 8 >= 2**32
    start = len(ftyp) + len(moov(bytes(8 * chunks))) + (16 if large else 8)
    offsets = start + np.arange(chunks, dtype=">u8") * (PER_CHUNK * SAMPLE)
    return ftyp + moov(offsets.astype(">u8").tobytes()) + _box(b"mdat", payload)


def walk(data, start: int = 0, stop: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body stop) of the boxes at one level; ValueError where a box doesn't fit."""
    stop = len(data) if stop is None else stop
    while start < stop:
        if stop - start < 8:
            raise ValueError("cut box header")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if stop - start < 16:
                raise ValueError("cut box header")
            (size,) = struct.unpack_from(">Q", data, start + 8)
            head = 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, start + head, start + size
        start += size


def _children(data, start: int, stop: int) -> dict[bytes, tuple[int, int]]:
    out: dict[bytes, tuple[int, int]] = {}
    for kind, a, b in walk(data, start, stop):
        out.setdefault(kind, (a, b))
    return out


def _find(data, place: tuple[int, int], *path: bytes) -> tuple[int, int]:
    for kind in path:
        found = _children(data, *place)
        if kind not in found:
            raise ValueError(f"no {kind.decode('latin-1')} box")
        place = found[kind]
    return place


def _table(data, place: tuple[int, int], columns: int, kind: str = ">u4", at: int = 4) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, place[0] + at)
    width = np.dtype(kind).itemsize * columns
    if place[0] + at + 4 + n * width > place[1]:
        raise ValueError("sample table does not fit")
    return np.frombuffer(data, kind, n * columns, place[0] + at + 4).reshape(n, columns).astype(np.int64)


def _sizes(data, stbl: dict[bytes, tuple[int, int]]) -> np.ndarray:
    if b"stsz" in stbl:
        a, b = stbl[b"stsz"]
        size, n = struct.unpack_from(">II", data, a + 4)
        return np.full(n, size, np.int64) if size else _table(data, (a, b), 1, at=8)[:, 0]
    if b"stz2" in stbl:
        a, b = stbl[b"stz2"]
        bits, (n,) = data[a + 7], struct.unpack_from(">I", data, a + 8)
        if bits == 16:
            return _table(data, (a, b), 1, ">u2", at=8)[:, 0]
        raw = np.frombuffer(data, np.uint8, (n * bits + 7) // 8, a + 12).astype(np.int64)
        return raw[:n] if bits == 8 else np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n]
    raise ValueError("no sample sizes")


def sample_places(data, stbl: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of every sample, from the chunk offsets, chunk runs and sizes."""
    sizes = _sizes(data, stbl)
    offsets = _table(data, stbl[b"co64"], 1, ">u8")[:, 0] if b"co64" in stbl else _table(data, stbl[b"stco"], 1)[:, 0] if b"stco" in stbl else None
    if offsets is None or b"stsc" not in stbl:
        raise ValueError("no chunk table")
    runs = _table(data, stbl[b"stsc"], 3)
    if not len(sizes):
        return sizes, sizes
    lasting = np.diff(np.append(runs[:, 0], len(offsets) + 1))
    per_chunk = np.repeat(runs[:, 1], lasting)
    if len(per_chunk) != len(offsets) or per_chunk.sum() != len(sizes):
        raise ValueError("chunk table does not fit the sample sizes")
    chunk = np.repeat(np.arange(len(offsets)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    return offsets[chunk] + before - before[first][chunk], sizes


NOT_SYNC = 0x10000  # the flag of samples that are no keyframes


@dataclass
class Track:
    """What headers, sample tables and movie fragments say of a track, all of its samples in order."""

    track: int
    handler: str
    codec: str
    timescale: int
    duration: int
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # numbers of its keyframes

    def extend(self, starts: np.ndarray, sizes: np.ndarray, sync: np.ndarray, duration: int) -> None:
        self.keys = np.append(self.keys, len(self.sizes) + np.flatnonzero(sync))
        self.starts, self.sizes = np.append(self.starts, starts), np.append(self.sizes, sizes)
        self.duration += duration


def _track(data, place: tuple[int, int]) -> Track:
    mdia = _find(data, place, b"mdia")
    tkhd, mdhd, hdlr = _find(data, place, b"tkhd"), _find(data, mdia, b"mdhd"), _find(data, mdia, b"hdlr")
    stbl = _children(data, *_find(data, mdia, b"minf", b"stbl"))
    timescale, duration = struct.unpack_from(">IQ", data, mdhd[0] + 20) if data[mdhd[0]] == 1 else struct.unpack_from(">II", data, mdhd[0] + 12)
    (number,) = struct.unpack_from(">I", data, tkhd[0] + (20 if data[tkhd[0]] == 1 else 12))
    codec = bytes(data[stbl[b"stsd"][0] + 12 : stbl[b"stsd"][0] + 16]).decode("latin-1") if b"stsd" in stbl else ""
    starts, sizes = sample_places(data, stbl)
    keys = _table(data, stbl[b"stss"], 1)[:, 0] - 1 if b"stss" in stbl else np.arange(len(sizes))
    if len(keys) and not 0 <= keys.min() <= keys.max() < len(sizes):
        raise ValueError("keyframe table names samples that aren't there")
    return Track(number, bytes(data[hdlr[0] + 8 : hdlr[0] + 12]).decode("latin-1"), codec, timescale, duration, starts, sizes, keys)


def _optional(data, at: int, flags: int, *fields: tuple[int, str]) -> tuple[dict[int, int], int]:
    """The fields whose flag is set, by flag, and the place behind them."""
    found = {}
    for flag, kind in fields:
        if flags & flag:
            (found[flag],) = struct.unpack_from(kind, data, at)
            at += struct.calcsize(kind)
    return found, at


def _fragment(data, begin: int, place: tuple[int, int], tracks: dict[int, Track], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Add the samples of one movie fragment, whose box begins at `begin`, to their tracks."""
    behind = begin
    for kind, a, b in walk(data, *place):
        if kind != b"traf":
            continue
        head, _ = _find(data, (a, b), b"tfhd")
        version_flags, number = struct.unpack_from(">II", data, head)
        flags = version_flags & 0xFFFFFF
        own, _ = _optional(data, head + 8, flags, (0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I"))
        if number not in tracks:
            raise ValueError("fragment of a track that isn't there")
        lasting, size, marks = (own.get(f, d) for f, d in zip((0x8, 0x10, 0x20), defaults.get(number, (0, 0, 0)), strict=True))
        base = own.get(0x1, begin if flags & 0x20000 else behind)
        behind = base
        for run, x, y in walk(data, a, b):
            if run != b"trun":
                continue
            run_flags, n = struct.unpack_from(">II", data, x)
            first, at = _optional(data, x + 8, run_flags, (0x1, ">i"), (0x4, ">I"))
            columns = [f for f in (0x100, 0x200, 0x400, 0x800) if run_flags & f]
            if at + 4 * n * len(columns) > y:
                raise ValueError("fragment run does not fit")
            table = dict(zip(columns, np.frombuffer(data, ">u4", n * len(columns), at).reshape(n, len(columns)).astype(np.int64).T, strict=True))
            sizes, flagged = table.get(0x200, np.full(n, size)), table.get(0x400, np.full(n, marks))
            if 0x4 in first and n:
                flagged = np.append(first[0x4], flagged[1:])
            start = base + first[0x1] if 0x1 in first else behind
            ends = start + np.cumsum(sizes)
            tracks[number].extend(ends - sizes, sizes, flagged & NOT_SYNC == 0, int(table.get(0x100, np.full(n, lasting)).sum()))
            behind = int(ends[-1]) if n else start


def probe(data: bytes) -> list[Track]:
    """Every track, from headers, sample tables and movie fragments alone; ValueError for what does not fit together."""
    boxes, begin = [], 0
    for kind, a, b in walk(data):
        boxes.append((kind, begin, (a, b)))
        begin = b
    moov = next((place for kind, _, place in boxes if kind == b"moov"), None)
    if moov is None:
        raise ValueError("no moov box")
    tracks, defaults = {}, {}
    for kind, a, b in walk(data, *moov):
        if kind == b"trak":
            t = _track(data, (a, b))
            tracks[t.track] = t
        elif kind == b"mvex":
            for inner, x, _ in walk(data, a, b):
                if inner == b"trex":
                    number, _, *rest = struct.unpack_from(">5I", data, x + 4)
                    defaults[number] = tuple(rest)
    for kind, begin, place in boxes:
        if kind == b"moof":
            _fragment(data, begin, place, tracks, defaults)
    for t in tracks.values():
        if len(t.starts) and (t.starts.min() < 0 or (t.starts + t.sizes).max() > len(data)):
            raise ValueError("samples beyond the end")
    return list(tracks.values())


def read_samples(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, in sample order; neighbouring samples are read together."""
    a, n = track.starts, track.sizes
    if not len(a):
        return b""
    cut = np.flatnonzero(a[1:] != a[:-1] + n[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(a)) - 1
    return b"".join(data[x:y] for x, y in zip(a[first].tolist(), (a[last] + n[last]).tolist(), strict=True))


def add_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """df with a binary column: the text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as a container.

    A null or empty text gives 64 zero bytes, a very long one is stored whole. Equal texts and
    repeated rows give equal containers, an empty table gives no rows. A column already named `out`
    is replaced; all others stay.
    """

    def work(texts: list[str | None]) -> Iterator[tuple]:
        yield range(len(texts)), [mux(padded(t)) for t in texts]

    return with_computed(df, (text,), work, **{out: "binary"})


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(-len(raw) % SAMPLE, SAMPLE * (not raw)))


def probe_media(df: DataFrame, media: str = "media", out: str = "tracks") -> DataFrame:
    """df without its containers, with `out` (array of track records) and `media_error`.

    A null container gives null for both; one that is broken, empty or cut gives its error and no
    tracks. Samples of movie fragments count like those of sample tables. Keyframes are byte ranges
    in the container; very long containers are walked without reading their payloads. Existing
    columns of these names are replaced, all others stay, and an empty table gives no rows.
    """

    def tracks(data):
        if data is None:
            return None, None
        try:
            return [_record(t) for t in probe(data)], None
        except (ValueError, struct.error, IndexError) as e:
            return None, str(e)

    def work(cells: list[bytes | None]) -> Iterator[tuple]:
        found = [tracks(x) for x in cells]
        yield range(len(cells)), [x[0] for x in found], [x[1] for x in found]

    return with_computed(df, (media,), work, drop=(media,), **{out: f"array<{TRACK}>", "media_error": "string"})


def _record(t: Track) -> dict:
    start, size = t.starts[t.keys].tolist(), t.sizes[t.keys].tolist()
    keyframes = [{"start": a, "stop": a + n} for a, n in zip(start, size, strict=True)]
    return {k: getattr(t, k) for k in ("track", "handler", "codec", "timescale", "duration")} | {"n_samples": len(t.sizes), "media_bytes": int(t.sizes.sum()), "keyframes": keyframes}


def media_rows(df: DataFrame) -> DataFrame:
    """The digest columns of op2: every text is stored, read back from its container, and described."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def digest(data: bytes) -> tuple:
        (t,) = probe(data)
        payload = read_samples(data, t)
        r = _record(t)
        ranges = np.array([(k["start"], k["stop"]) for k in r["keyframes"]], "<i8")
        feature = f"codec={r['codec'].strip()};handler={r['handler']};timescale={r['timescale']};duration={r['duration']};samples={r['n_samples']};keyframes={len(ranges)};ranges={zlib.crc32(ranges.tobytes()):08x}"
        return len(payload), sha(payload), zlib.crc32(payload[-SAMPLE:]), len(data), sha(data), feature

    def work(cells: list[bytes]) -> Iterator[tuple]:
        yield range(len(cells)), *map(list, zip(*map(digest, cells), strict=True))

    stored = add_media(df.selectExpr("cast(doc_id AS long) AS doc_id", "cast(coalesce(octet_length(text), 0) AS long) AS n_bytes", "text"))
    fields = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return with_computed(stored.select("doc_id", "n_bytes", "media"), ("media",), work, drop=("media",), **fields)
