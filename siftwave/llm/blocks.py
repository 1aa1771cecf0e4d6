"""Blocks of texts as integer arrays: words, their hashes, and packed binary cells for shuffles."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

BLOCK = 6_000_000  # bytes of text in a block, unless one text is longer
ROWS = 2**20 - 1  # texts in a block, so that a place in it fits 20 bits


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Give memory that is free back to the system; allocators keep it, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_blocks(batches: Iterator[pd.DataFrame], text: str, size: int = BLOCK) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about `size` bytes of text and at most ROWS rows, across batch borders."""
    held, held_size, held_rows = [], 0, 0
    for b in batches:
        ends = np.cumsum([len(t or "") for t in b[text]])
        at = 0
        while at < len(b):
            done = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, done + size - held_size, "right"))), at + ROWS - held_rows)
            held.append(b.iloc[at:to])
            held_size += int(ends[to - 1] - done)
            held_rows += to - at
            at = to
            if held_size >= size or held_rows >= ROWS:
                yield pd.concat(held, ignore_index=True)
                held, held_size, held_rows = [], 0, 0
    if held:
        yield pd.concat(held, ignore_index=True)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Local ids of words, the distinct words, and their 64-bit hashes; ids run in order of hash."""
    return _numbered(pa.array(words, pa.large_binary()))


def text_words(texts, ends: bool = False) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """word_ids of all words of texts, one text after the other, and the number of words of each.

    A null text has no words. ends: an empty word stands behind each text and counts as one of its words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array([t or "" for t in texts], pa.large_string())))
    flat = lists.flatten()
    # White space at a text's beginning or end leaves an empty word there.
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    sizes = np.diff(np.append(0, np.cumsum(real))[lists.offsets.to_numpy()])
    ids, distinct, hashes = _numbered(flat.filter(pa.array(real)).cast(pa.large_binary()))
    if ends:
        end = np.uint64(xxhash.xxh64_intdigest(b""))
        at = int(np.searchsorted(hashes, end))
        ids += ids >= at
        distinct, hashes = [*distinct[:at], b"", *distinct[at:]], np.insert(hashes, at, end)
        ids, sizes = np.insert(ids, np.cumsum(sizes), at), sizes + 1
    return ids, distinct, hashes, sizes


def _numbered(words: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    coded = words.dictionary_encode()
    # Words hold no line ends, and one split is far quicker than one object at a time.
    listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.binary()))
    distinct = pc.binary_join(listed, b"\n")[0].as_py().split(b"\n") if len(coded.dictionary) else []
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ids = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    return ids, list(map(distinct.__getitem__, order.tolist())), hashes[order]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def put(a: np.ndarray, kind: str) -> bytes:
    """An array as a compressed cell: first all lowest bytes, then all second ones, and so on."""
    raw = np.ascontiguousarray(a, kind)
    return _PACK.compress(raw.view("u1").reshape(-1, raw.itemsize).T.tobytes())


def take(cell: bytes, kind: str) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(_UNPACK.decompress(cell), "u1").reshape(kind.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).reshape(-1)


def put_sorted(a: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    first, gaps = a[:1].astype("<u8").tobytes(), np.diff(a)
    narrow = not len(gaps) or gaps.max() < 2**32
    return (b"4" if narrow else b"8") + first + (put(gaps, "<u4" if narrow else "<u8") if len(gaps) else b"")


def take_sorted(cell: bytes) -> np.ndarray:
    first = np.frombuffer(cell[1:9], "<u8")
    gaps = take(cell[9:], f"<u{cell[:1].decode()}").astype(np.uint64) if len(cell) > 9 else first[:0]
    return np.cumsum(np.concatenate([first, gaps]), dtype=np.uint64)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def distinct(a: np.ndarray) -> np.ndarray:
    """Ascending distinct values; by sorting, which is quicker here than numpy's hash table."""
    a = np.sort(a)
    return a[runs(a)]
