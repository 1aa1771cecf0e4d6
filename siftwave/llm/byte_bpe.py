"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their border."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.storage import with_computed

CACHE = 500_000  # matches, and pairs of ids, that a worker remembers


class Pieces(dict):
    """Packed ids of the pattern's matches; a missing one is encoded, and kept unless it is long."""

    def __init__(self, bpe: TreeBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        cell = np.array(self.bpe.encode_bytes(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = cell
        return cell


class TreeBPE:
    """Encodes with ranks as a reduction tree.

    encode(xy) = join(encode(x), encode(y)). A token sequence is the merge result of its bytes
    exactly when every two neighbours, merged alone, stay as they are; join therefore re-encodes a
    window around the border and widens it until its outer neighbours pass that test on both sides,
    after which no token outside it can change.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.pieces = Pieces(self)

    def merge(self, raw: bytes) -> list[int]:
        """The plain merge loop: the lowest-ranked pair first, leftmost among equals."""
        if len(raw) > 64:
            return self._merge_long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, raw: bytes) -> list[int]:
        """merge() with a heap of neighbouring pairs, for windows that had to grow."""
        n, ranks = len(raw), self.ranks
        stop, before = list(range(1, n + 1)), list(range(-1, n))

        def rank(i: int) -> int | None:
            return ranks.get(raw[i : stop[stop[i]]]) if stop[i] < n else None

        heap = [(r, i, i + 2) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if stop[i] == -1 or stop[i] >= n or stop[stop[i]] != end:
                continue
            gone = stop[i]
            stop[i], stop[gone] = end, -1
            if end < n:
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, stop[stop[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : stop[i]]])
            i = stop[i]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when only their own bytes are merged."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) >= CACHE:
                self.stable.clear()
            known = self.stable[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            more_left = i < len(left) and not self.fits(left[len(left) - i - 1], window[0])
            more_right = j < len(right) and not self.fits(window[-1], right[j])
            if not more_left and not more_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = min(len(left), 2 * i) if more_left else i, min(len(right), 2 * j) if more_right else j

    def encode_bytes(self, raw: bytes, leaf: int = 16) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) <= leaf:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join(self.encode_bytes(raw[:half], leaf), self.encode_bytes(raw[half:], leaf))

    def encode_cell(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_cell(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        """Concatenation up a balanced tree."""
        parts = list(map(self.bytes_of.__getitem__, ids))
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 64]) for i in range(0, len(parts), 64)]
        return parts[0] if parts else b""


_LOADED: dict[tuple[str, str], TreeBPE] = {}


def load(path: str, pattern: str) -> TreeBPE:
    """The encoder of a rank file, once per worker process."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path, pattern] = TreeBPE(ranks, pattern)
    return _LOADED[path, pattern]


def encode_column(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with an array<int> column of token ids. path: a rank file that is installed on every executor.

    A null or empty text gives an empty array, a very long one is encoded whole, equal texts and
    repeated rows get equal ids, and an empty table gives no rows. A column already named `out` is
    replaced; all others stay.
    """

    def work(texts: list[str | None]) -> Iterator[tuple]:
        bpe = load(path, pattern)
        yield range(len(texts)), [np.frombuffer(bpe.encode_cell(t or ""), "<i4") for t in texts]

    return with_computed(df, (text,), work, **{out: "array<int>"})


def decode_column(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for.

    Null ids give null, no ids no bytes, and an unknown id is an error. A column already named `out`
    is replaced; all others stay. An empty table gives no rows.
    """

    def work(column: list[list[int] | None]) -> Iterator[tuple]:
        bpe = load(path, pattern)
        yield range(len(column)), [None if x is None else bpe.decode(x) for x in column]

    return with_computed(df, (ids,), work, **{out: "binary"})


def bpe_rows(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """The digest columns of op10: counts and hashes of the ids and of the bytes they decode to.

    Null ids of documents stay null, null texts are empty, and an empty table gives no rows.
    """

    def work(texts: list[str | None]) -> Iterator[tuple]:
        bpe = load(path, pattern)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        cells = [bpe.encode_cell(t or "") for t in texts]
        yield range(len(texts)), [len(c) // 4 for c in cells], [sha(c) for c in cells], [sha(bpe.decode(np.frombuffer(c, "<u4").tolist())) for c in cells]

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_computed(rows, ("text",), work, drop=("text",), n_tokens="long", ids_sha256="string", decoded_sha256="string")
