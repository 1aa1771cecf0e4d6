"""Encoders that turn one channel's signal into a vector, and the spectra and resampling that they share."""

from __future__ import annotations

import hashlib
import importlib
import importlib.util
import re
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession


class Encoder(ABC):
    """Turns one channel's signal into a vector of `dim` numbers; built once in each worker."""

    dim: int

    @abstractmethod
    def encode(self, signal: np.ndarray, rate: int) -> np.ndarray: ...


def frame_sizes(rate: int) -> tuple[int, int]:
    """Samples of a 25 ms frame (16 at least) and of a 10 ms step."""
    return max(round(0.025 * rate), 16), max(round(0.010 * rate), 1)


def band_count(rate: int, band: int = 32) -> int:
    """How many bands of `band` bins a frame's spectrum fills, the last one perhaps in part."""
    return max(1, -(-(frame_sizes(rate)[0] // 2 + 1) // band))


def frames(x: np.ndarray, width: int, hop: int) -> np.ndarray:
    """Whole frames of a signal, one in a row; none if the signal is shorter than one."""
    if len(x) < width:
        return np.zeros((0, width))
    return np.lib.stride_tricks.sliding_window_view(x, width)[::hop]


def spectrum(signal: np.ndarray, rate: int) -> np.ndarray:
    """Magnitudes of Hann-windowed frames of a signal less its mean, one frame in a row."""
    width, hop = frame_sizes(rate)
    x = signal - signal.mean() if len(signal) else signal
    return np.abs(np.fft.rfft(frames(x, width, hop) * np.hanning(width + 1)[:-1]))


def segments(rows: np.ndarray, length: int, short: bool = True) -> list[np.ndarray]:
    """Full runs of `length` rows, and one over the last `length` rows if some are left over.

    Fewer rows than that are one short segment, or none if `short` is off and there are no rows.
    """
    if len(rows) <= length:
        return [rows] if short or len(rows) else []
    full = [rows[a : a + length] for a in range(0, len(rows) - length + 1, length)]
    return full + [rows[-length:]] * (len(rows) % length > 0)


def pad_bands(rows: np.ndarray, width: int) -> np.ndarray:
    """rows with zero columns on the right, so that there are `width` at least."""
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))


def resample_filter(rate: int, target: int = 16_000, zeros: int = 6, rolloff: float = 0.99) -> tuple[int, int, int, np.ndarray]:
    """Samples read and made in a step, samples that the filter looks back, and the filter of each phase: a Hann-windowed sinc with `zeros` zero crossings on each side.

    Rates are divided by their common divisor, and each of the target's phases is one filter.
    """
    common = int(np.gcd(rate, target))
    old, new = rate // common, target // common
    base = min(old, new) * rolloff
    width = int(np.ceil(zeros * old / base))
    offsets = np.arange(-width, width + old) / old
    t = np.clip((offsets - np.arange(new)[:, None] / new) * base, -zeros, zeros)
    return old, new, width, np.sinc(t) * np.cos(t * np.pi / zeros / 2) ** 2 * base / old


def filter_steps(padded: np.ndarray, kernel: np.ndarray, width: int, step: int) -> np.ndarray:
    """All phases of each step of a signal that has `width` samples before and width + step behind, by one matrix product."""
    return (frames(padded, 2 * width + step, step) @ kernel.T).reshape(-1)


def resample(x: np.ndarray, rate: int, target: int = 16_000) -> np.ndarray:
    """A whole signal at another rate; halo.resampled does the same for series in blocks."""
    if rate == target or not len(x):
        return np.asarray(x, float)
    old, new, width, kernel = resample_filter(rate, target)
    return filter_steps(np.pad(np.asarray(x, float), (width, width + old)), kernel, width, old)[: -(-new * len(x) // old)]


def mel_bank(n_mels: int, n_fft: int, rate: int, low: float = 20.0) -> np.ndarray:
    """Triangles of equal width on the mel scale 1127 ln(1 + f / 700), from `low` to half the rate; a row for each bin."""
    mel = lambda f: 1127.0 * np.log1p(np.asarray(f) / 700.0)
    edges = np.linspace(mel(low), mel(rate / 2), n_mels + 2)
    at = mel(np.arange(n_fft // 2) * rate / n_fft)[:, None]
    rise, fall = (at - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - at) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, rate: int, n_mels: int = 128) -> np.ndarray:
    """Log mel energies of 25 ms frames every 10 ms, each less its mean, pre-emphasised by 0.97 and Hanning-windowed."""
    width, hop = round(0.025 * rate), round(0.010 * rate)
    f = frames(np.asarray(x, float), width, hop)
    f = f - f.mean(1, keepdims=True)
    f = f - 0.97 * np.concatenate([f[:, :1], f[:, :-1]], 1)
    n_fft = 1 << (width - 1).bit_length()
    power = np.abs(np.fft.rfft(f * np.hanning(width), n_fft)[:, : n_fft // 2]) ** 2
    return np.log(np.maximum(power @ mel_bank(n_mels, n_fft, rate), np.finfo(np.float32).eps))


class LogSpectrum(Encoder):
    """Mean log magnitude in equal bands of frames of 25 ms every 10 ms; a signal shorter than a frame is padded."""

    def __init__(self, dim: int = 32, mean: float = 0.0, scale: float = 1.0):
        self.dim, self.mean, self.scale = dim, mean, scale

    def encode(self, signal: np.ndarray, rate: int) -> np.ndarray:
        x = signal - signal.mean() if len(signal) else signal
        bands = np.array_split(np.log(spectrum(np.pad(x, (0, max(0, frame_sizes(rate)[0] - len(x)))), rate) + 1e-9), self.dim, axis=1)
        return np.array([(b.mean() - self.mean) / self.scale if b.size else 0.0 for b in bands])


class SegmentSpectrum(Encoder):
    """Normalized log magnitudes, cut into segments of frames, each averaged over time, averaged over segments.

    The spectrum is padded to `bins` bins or cut there, so that `dim` does not depend on the rate.
    """

    # Floor, mean, deviation, frames and least bins of the two known settings.
    SETTINGS = {"echo": (1e-9, -5.874158, 5.223174, 2000, 0), "fisher": (1e-10, -3.017344307886898, 2.1531635155379805, 1024, 100)}

    def __init__(self, setting: str = "fisher", bins: int = 1024):
        self.floor, self.mean, self.deviation, self.length, self.least = self.SETTINGS[setting]
        self.dim = bins

    def rows(self, signal: np.ndarray, rate: int) -> list[np.ndarray]:
        s = (np.log(spectrum(signal, rate) + self.floor) - self.mean) / (2 * self.deviation)
        return [pad_bands(x, self.least) for x in segments(s, self.length, short=False)]

    def encode(self, signal: np.ndarray, rate: int) -> np.ndarray:
        parts = self.rows(signal, rate)
        if not parts:
            raise ValueError("signal is shorter than a frame")
        return pad_bands(np.mean([p.mean(0) for p in parts], axis=0)[None], self.dim)[0, : self.dim]


class MelSpectrum(Encoder):
    """A signal at 16 kHz as a mel image of fixed length, normalized, averaged over time."""

    # Mel bins, frames of the image, mean and deviation.
    MELS, FRAMES, MEAN, DEVIATION = 128, 1024, -4.268, 4.569

    def __init__(self):
        self.dim = self.MELS

    def image(self, signal: np.ndarray, rate: int) -> np.ndarray:
        x = signal - signal.mean() if len(signal) else signal
        mel = log_mel(resample(x, rate), 16_000, self.MELS)[: self.FRAMES]
        return (np.pad(mel, ((0, self.FRAMES - len(mel)), (0, 0))) - self.MEAN) / self.DEVIATION

    def encode(self, signal: np.ndarray, rate: int) -> np.ndarray:
        return self.image(signal, rate).mean(0)


def ship(spark: SparkSession, source: str) -> str:
    """Send a .py file of the driver to all workers, and the name by which they import it, which its content makes unique."""
    raw = Path(source).read_bytes()
    name = f"{re.sub(r'[^0-9a-zA-Z_]', '_', Path(source).stem)}_{hashlib.sha256(raw).hexdigest()[:16]}"
    copy = Path(tempfile.mkdtemp(prefix="siftwave-")) / f"{name}.py"  # of the driver alone, which serves it
    copy.write_bytes(raw)
    spark.addArtifacts(str(copy), pyfile=True)
    return name


def encoder_factory(source: str, name: str = "FeatureExtractor", spark: SparkSession | None = None, **options) -> Callable[[], Encoder]:
    """A function that builds an encoder in a worker: a class of a module, or of a .py file.

    spark: a session to whose workers the file is sent; without one every worker must have it.
    ValueError, when the function is called, where there is no such class.
    """
    shipped = ship(spark, source) if spark is not None and source.endswith(".py") and Path(source).is_file() else None

    def make() -> Encoder:
        if shipped is not None:
            module = importlib.import_module(shipped)
        elif source.endswith(".py"):
            spec = importlib.util.spec_from_file_location(Path(source).stem, source)
            if spec is None or not Path(source).is_file():
                raise ValueError(f"no file {source}")
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
        else:
            module = importlib.import_module(source)
        found = getattr(module, name, None)
        if found is None:
            raise ValueError(f"{source} has no class {name}")
        return found(**options)

    return make
