"""FLAC recordings as a data source: many tasks read one file, each the frames that begin in its range of bytes.

Frames say their own place and size and carry checksums, so a task finds the first one in its range
without those before it. Residuals are unpacked frame by frame; the recurrence of linear prediction
runs over all subframes of a batch of frames at once, one step of numpy for each sample's place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

from siftwave.sources.scans import BLOCKS, SPLIT, Ranges, WaveReader, whole_path

BATCH = 64  # frames whose samples are restored together
WINDOW = 1 << 16  # bytes in which a frame's start is searched at once

# Fixed values of the format: sample sizes by code, coefficients of the fixed predictors by order.
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
LEFT_SIDE, SIDE_RIGHT, MID_SIDE = 8, 9, 10


def _crc_table(polynomial: int, width: int) -> list[int]:
    top, out = 1 << (width - 1), []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & (2 * top - 1)
        out.append(c)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = CRC8[c ^ b]
    return c


def crc16(raw: bytes) -> int:
    c = 0
    for b in raw:
        c = (c << 8 & 0xFFFF) ^ CRC16[c >> 8 ^ b]
    return c


class CutError(ValueError):
    """More bytes are needed than are there."""


@dataclass(frozen=True)
class Stream:
    """What a file says of all its frames; total (samples of a channel) is 0 and md5 zeros where it isn't known."""

    rate: int
    channels: int
    bits: int
    block: int
    total: int
    md5: bytes
    start: int


def stream_header(read: Callable[[int, int], bytes], size: int) -> Stream:
    """The header of a file of `size` bytes, of which read(offset, n) gives n; ValueError where it is none."""
    at = 0
    if read(0, 3) == b"ID3":  # a tag before the stream says its size in four times seven bits
        tag = read(0, 10)
        at = 10 + (tag[6] << 21 | tag[7] << 14 | tag[8] << 7 | tag[9]) if len(tag) == 10 else size
    if read(at, 4) != b"fLaC":
        raise ValueError("no FLAC file: no stream marker")
    at, found, last = at + 4, None, False
    while not last:
        head = read(at, 4)
        if len(head) < 4:
            raise ValueError("no FLAC file: cut metadata")
        last, kind, length = bool(head[0] & 0x80), head[0] & 0x7F, int.from_bytes(head[1:], "big")
        if kind == 0:
            raw = read(at + 4, 34)
            if length < 34 or len(raw) < 34:
                raise ValueError("no FLAC file: short stream information")
            word = int.from_bytes(raw[10:18], "big")
            found = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, int.from_bytes(raw[2:4], "big"), word & (1 << 36) - 1, raw[18:34]
        at += 4 + length
    if found is None or not found[0]:
        raise ValueError("no FLAC file: no stream information")
    return Stream(*found, at)


@dataclass(frozen=True)
class Frame:
    """A frame's place (of its first sample), samples, channel assignment, sample size and header length."""

    place: int
    size: int
    channels: int
    bits: int
    length: int


def frame_header(raw: bytes, s: Stream) -> Frame | None:
    """The header at the start of raw; None where there is none of stream s, CutError where raw ends within it."""
    if len(raw) >= 2 and (raw[0] != 0xFF or raw[1] & 0xFE != 0xF8):
        return None
    if len(raw) < 6:
        raise CutError("cut frame")
    size_code, rate_code, assignment, bits_code = raw[2] >> 4, raw[2] & 15, raw[3] >> 4, raw[3] >> 1 & 7
    channels = 2 if LEFT_SIDE <= assignment <= MID_SIDE else assignment + 1
    bits = BITS.get(bits_code, s.bits if bits_code == 0 else 0)
    if size_code == 0 or rate_code == 15 or assignment > MID_SIDE or channels != s.channels or bits != s.bits or raw[3] & 1:
        return None
    # The number's first byte says by its leading ones how many follow, as in UTF-8, but up to 36 bits.
    more = 0 if raw[4] < 0x80 else 8 - (~raw[4] & 0xFF).bit_length() - 1
    if raw[4] >= 0x80 and not 1 <= more <= 6:
        return None
    after = 5 + more + {6: 1, 7: 2}.get(size_code, 0) + {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if len(raw) < after + 1:
        raise CutError("cut frame")
    number = raw[4] & (0x7F if more == 0 else (1 << (6 - more)) - 1)
    for b in raw[5 : 5 + more]:
        if b & 0xC0 != 0x80:
            return None
        number = number << 6 | b & 0x3F
    if crc8(raw[:after]) != raw[after]:
        return None
    at = 5 + more
    if size_code in (6, 7):
        size = int.from_bytes(raw[at : at + size_code - 5], "big") + 1
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    by_samples = raw[1] & 1
    return Frame(number if by_samples else number * s.block, size, assignment, bits, after + 1)


class Bits:
    """Bits of bytes, most significant first."""

    def __init__(self, raw: bytes):
        self.size = 8 * len(raw)
        self.bytes = np.frombuffer(raw + bytes(8), np.uint8)
        ones = np.unpackbits(self.bytes[: len(raw)]).astype(bool)
        places = np.where(ones, np.arange(self.size), self.size)
        self.next_one = np.minimum.accumulate(places[::-1])[::-1]
        self._list: list[int] | None = None
        self.at = 0

    def uint(self, n: int) -> int:
        out = int(self.many(np.array([self.at]), n)[0]) if n else 0
        self.at += n
        return out

    def int(self, n: int) -> int:
        out = self.uint(n)
        return out - (1 << n) if n and out >> (n - 1) else out

    def many(self, at: np.ndarray, n: int) -> np.ndarray:
        """Unsigned numbers of n bits (at most 56) at several places."""
        if len(at) and at[-1] + n > self.size:
            raise CutError("cut frame")
        first, word = at >> 3, np.zeros(len(at), np.uint64)
        for i in range(8):
            word = word << np.uint64(8) | self.bytes[first + i].astype(np.uint64)
        return (word << (at & 7).astype(np.uint64) >> np.uint64(64 - n)).astype(np.int64) if n else np.zeros(len(at), np.int64)

    def ints(self, count: int, n: int) -> np.ndarray:
        """Signed numbers of n bits, one after the other."""
        at = self.at + n * np.arange(count)
        self.at += n * count
        out = self.many(at, n)
        return np.where(out >> (n - 1) == 1, out - (1 << n), out) if n else out

    def unary(self) -> int:
        """The zeros before the next one."""
        end = int(self.next_one[self.at]) if self.at < self.size else self.size
        if end >= self.size:
            raise CutError("cut frame")
        out, self.at = end - self.at, end + 1
        return out

    def rice(self, count: int, k: int) -> np.ndarray:
        """Numbers of a unary quotient and k low bits, signs folded into the lowest bit."""
        if self._list is None:
            self._list = self.next_one.tolist()
        ones, at, step, starts = self._list, self.at, k + 1, []
        try:
            for _ in range(count):
                starts.append(at)
                at = ones[at] + step
        except IndexError as e:
            raise CutError("cut frame") from e
        if at > self.size:
            raise CutError("cut frame")
        self.at, start = at, np.array(starts, np.int64)
        one = self.next_one[start]
        folded = one - start << k | self.many(one + 1, k)
        return folded >> 1 ^ -(folded & 1)


@dataclass(frozen=True)
class Subframe:
    """A channel of a frame before prediction: its first samples, then residuals; coefficients go from the newest sample back."""

    values: np.ndarray
    coefficients: list[int]
    shift: int
    wasted: int


def _residual(b: Bits, size: int, order: int) -> np.ndarray:
    method = b.uint(2)
    if method > 1:
        raise ValueError("broken frame: unknown residual coding")
    width, parts = 4 + method, 1 << b.uint(4)
    if size % parts or size // parts < order:
        raise ValueError("broken frame: residuals don't fill the frame")
    out = []
    for i in range(parts):
        count, k = size // parts - (order if i == 0 else 0), b.uint(width)
        out.append(b.ints(count, b.uint(5)) if k == (1 << width) - 1 else b.rice(count, k))
    return np.concatenate(out)


def _subframe(b: Bits, size: int, bits: int) -> Subframe:
    if b.uint(1):
        raise ValueError("broken frame: no subframe")
    kind, wasted = b.uint(6), 0
    if b.uint(1):
        wasted = b.unary() + 1
    bits -= wasted
    if bits < 1:
        raise ValueError("broken frame: no bits left")
    if kind == 0:
        return Subframe(np.full(size, b.int(bits), np.int64), [], 0, wasted)
    if kind == 1:
        return Subframe(b.ints(size, bits), [], 0, wasted)
    if 8 <= kind <= 12:
        order, shift = kind - 8, 0
    elif kind >= 32:
        order, shift = kind - 31, None
    else:
        raise ValueError("broken frame: reserved subframe")
    if order > size:
        raise ValueError("broken frame: more predictors than samples")
    first = b.ints(order, bits)
    coefficients = FIXED[order] if shift == 0 else None
    if coefficients is None:
        precision, shift = b.uint(4) + 1, b.int(5)
        if precision == 16 or shift < 0:
            raise ValueError("broken frame: reserved predictor")
        coefficients = b.ints(order, precision).tolist()
    return Subframe(np.concatenate([first, _residual(b, size, order)]), coefficients, shift, wasted)


def unpack_frame(raw: bytes, s: Stream) -> tuple[Frame, list[Subframe], int]:
    """The frame at the start of raw, its subframes and its bytes; CutError where raw ends within it, ValueError where it is broken."""
    f = frame_header(raw, s)
    if f is None:
        raise ValueError("no frame where one should begin")
    b, out = Bits(raw[f.length :]), []
    side = {LEFT_SIDE: 1, SIDE_RIGHT: 0, MID_SIDE: 1}.get(f.channels)
    for c in range(s.channels):
        out.append(_subframe(b, f.size, f.bits + (c == side)))
    end = f.length + (b.at + 7) // 8
    if len(raw) < end + 2:
        raise CutError("cut frame")
    if crc16(raw[:end]) != int.from_bytes(raw[end : end + 2], "big"):
        raise ValueError("broken frame: wrong checksum")
    return f, out, end + 2


def predicted(subframes: list[Subframe]) -> np.ndarray:
    """Samples of subframes of one size, as columns."""
    order = max(len(x.coefficients) for x in subframes)
    values = np.stack([x.values for x in subframes], 1)
    if order:
        own, shift = np.array([len(x.coefficients) for x in subframes]), np.array([x.shift for x in subframes])
        # The oldest sample first, as they stand in the columns; shorter predictors don't see the older ones.
        c = np.array([[0] * (order - len(x.coefficients)) + x.coefficients[::-1] for x in subframes]).T
        held = np.concatenate([np.zeros((order, len(subframes)), np.int64), values])
        for i in range(len(values)):
            step = (held[i : i + order] * c).sum(0) >> shift
            held[order + i] += step if i >= order else np.where(i >= own, step, 0)
        values = held[order:]
    return values << np.array([x.wasted for x in subframes])


def samples_of(frames: list[tuple[Frame, list[Subframe]]]) -> list[np.ndarray]:
    """Samples (places, channels) of frames; those of one size are restored together."""
    out: list[np.ndarray] = [np.zeros(0)] * len(frames)
    for size in {f.size for f, _ in frames}:
        some = [i for i, (f, _) in enumerate(frames) if f.size == size]
        restored = predicted([x for i in some for x in frames[i][1]])
        channels = len(frames[some[0]][1])
        for n, i in enumerate(some):
            x = restored[:, n * channels : (n + 1) * channels]
            kind = frames[i][0].channels
            if kind >= LEFT_SIDE:
                a, b = x[:, 0], x[:, 1]
                if kind == LEFT_SIDE:
                    x = np.stack([a, a - b], 1)
                elif kind == SIDE_RIGHT:
                    x = np.stack([a + b, b], 1)
                else:
                    mid = a << 1 | b & 1
                    x = np.stack([mid + b >> 1, mid - b >> 1], 1)
            out[i] = x
    return out


def _grown(read: Callable[[int, int], bytes], at: int, size: int, s: Stream) -> tuple[Frame, list[Subframe], int]:
    """unpack_frame at a place of the file, with as many bytes as that takes."""
    n = min(WINDOW, max(64, s.block * s.channels * s.bits // 8 + 64))
    while True:
        raw = read(at, min(n, size - at))
        try:
            return unpack_frame(raw, s)
        except CutError as e:
            if n >= size - at:
                raise ValueError("cut frame") from e
            n *= 2


def _first_frame(read: Callable[[int, int], bytes], a: int, z: int, size: int, s: Stream) -> int | None:
    """Where the first whole frame that begins in [a, z) begins."""
    for at in range(a, z, WINDOW):
        raw = read(at, min(WINDOW + 1, size - at))
        here = raw.find(b"\xff")
        while 0 <= here < min(WINDOW, z - at):
            if len(raw) > here + 1 and raw[here + 1] & 0xFE == 0xF8:
                try:
                    if frame_header(read(at + here, min(32, size - at - here)), s):
                        _grown(read, at + here, size, s)
                        return at + here
                except ValueError:
                    pass  # other data that look like a frame; the task before checks the frame that it expects here
            here = raw.find(b"\xff", here + 1)
    return None


def frames_between(read: Callable[[int, int], bytes], a: int, z: int, size: int, s: Stream) -> Iterator[tuple[Frame, list[Subframe]]]:
    """Frames that begin in [a, z), in order; ValueError at the first that is broken, cut or not where it should be.

    The frame behind the last one is checked too, so that none is lost between two ranges. Bytes
    behind the last sample that the header counts are no frames.
    """
    at, place = (s.start, 0) if a <= s.start < z else (None, None)
    if at is None:
        at = _first_frame(read, max(a, s.start), z, size, s)
    if at is None:
        return
    while True:
        if at >= size or (s.total and place is not None and place >= s.total):
            if s.total and place != s.total:
                raise ValueError(f"cut file: {place} of {s.total} samples")
            return
        f, subframes, length = _grown(read, at, size, s)
        if place is not None and f.place != place:
            raise ValueError("broken frame: not the next one")
        if at >= z:
            return
        yield f, subframes
        at, place = at + length, f.place + f.size


def _batches(frames: Iterator[tuple[Frame, list[Subframe]]]) -> Iterator[tuple[int, np.ndarray]]:
    """Place and samples (places, channels) of consecutive frames, some at once; an error of frames comes after those before it."""
    held, error = [], None
    while error is None:
        try:
            f = next(frames, None)
            if f is not None:
                held.append(f)
        except ValueError as e:
            f, error = None, e
        if held and (f is None or len(held) == BATCH):
            yield held[0][0].place, np.concatenate(samples_of(held))
            held = []
        if f is None:
            break
    if error is not None:
        raise error


def decode_flac(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in -1..1 of a whole file, checked by the digest of its samples where it has one."""
    read = lambda at, n: raw[at : at + n]
    s = stream_header(read, len(raw))
    parts = [x for _, x in _batches(frames_between(read, 0, len(raw), len(raw), s))]
    if not parts:
        raise ValueError("no samples")
    if any(s.md5):
        width, digest = (s.bits + 7) // 8, hashlib.md5(usedforsecurity=False)
        for x in parts:
            digest.update(x.astype("<i8").reshape(-1, 1).view("u1")[:, :width].tobytes())
        if digest.digest() != s.md5:
            raise ValueError("broken file: wrong digest")
    return s.rate, np.concatenate([_mono(x, s) for x in parts])


def _mono(x: np.ndarray, s: Stream) -> np.ndarray:
    return (x / 2.0 ** (s.bits - 1)).mean(1)


class FlacReader(WaveReader):
    suffix = ".flac"

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a scan without files
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        for path, size, a, z in partition.parts:
            with store.open_input_file(path) as f:
                read = lambda at, n, f=f, size=size: f.read_at(max(0, min(n, size - at)), at) if at < size else b""
                some = False
                try:
                    try:
                        s = stream_header(read, size)
                    except ValueError:
                        if a == 0:  # one row of a file, not one of each range
                            raise
                        continue
                    for place, x in _batches(frames_between(read, a, z, size, s)):
                        some = True
                        yield pa.RecordBatch.from_pylist([{"path": path, "rate": s.rate, "start": place, "samples": _mono(x, s)}], BLOCKS)
                    if s.start >= size and a == 0 and not some:
                        raise ValueError("no samples")
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], BLOCKS)


class FlacSource(DataSource):
    """`siftwave_flac`: rows path, rate, start, samples and error of the .flac files at option path, in ranges of split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "siftwave_flac"

    def schema(self) -> str:
        return "path string, rate int, start long, samples array<double>, error string"

    def reader(self, schema) -> FlacReader:
        return FlacReader(self.options)


def scan_flacs(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """Blocks of the FLAC files at a path or URI, as scans.scan_waves gives those of wave files.

    A file that is broken, cut or empty gives one or more rows with an error, beside the blocks of
    frames that could be read. Every frame is checked by its checksums, those at the border of two
    ranges by both tasks; the digest over all samples is only checked by decode_flac.
    """
    spark.dataSource.register(FlacSource)
    return spark.read.format(FlacSource.name()).option("path", whole_path(path)).option("split_bytes", split_bytes).load()
