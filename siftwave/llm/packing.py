"""Best-fit packing of token pieces, improved by swap-based local search between underfull sequences."""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.blocks import trim
from siftwave.llm.storage import stored, with_computed

CAPACITY = 2048
GROUP = 4096  # pieces that are packed together
CACHE = 1_000_000  # words and runs whose ids a worker remembers
SLICE = 4_000_000  # characters of text that a worker splits into words at once


class Numbers(dict):
    """Words in order of first sight; a missing one gets the next number and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


class Rows:
    """Id lists of numbered items, appended in order of number."""

    def __init__(self):
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def sizes(self, items: np.ndarray) -> np.ndarray:
        return self.ends[items + 1] - self.ends[items]

    def of(self, items: np.ndarray) -> np.ndarray:
        """The lists of some items, one after the other."""
        sizes = self.sizes(items)
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.ends[items] - before, sizes) + np.arange(sizes.sum())]


class WordIds:
    """Token ids of texts for a tokenizer that folds case, drops white space and codes the runs of a pattern on their own.

    A plain text (PLAIN characters, for which folding is that of Python and composition does nothing)
    is folded and split into words, a new word into runs, and new runs are coded together: the last id
    of a run carries the end-of-word mark, so the ids of many runs can be told apart. Every other
    text is split at ASCII white space alone and each of its new words is coded by the tokenizer.
    """

    PLAIN = re.compile("[\\t-\\r -~\u00a0-\u024f\u2010-\u2027\u20ac]*")
    SPECIAL = "<|"  # begins the special strings, which the tokenizer finds before it folds
    # The tokenizer's pattern over plain characters: contractions, letters, single digits, all else but white space.
    RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9²³¹¼½¾]|[^\\sa-z0-9ªµº²³¹¼½¾\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.odd_words, self.runs = Numbers(), Numbers(), Numbers()
        self.word_ids, self.odd_ids, self.run_ids = Rows(), Rows(), Rows()

    def _code(self, items: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(items, add_special_tokens=False)]

    def _learn_odd(self) -> None:
        new, self.odd_words.new = self.odd_words.new, []
        for i in range(0, len(new), 20_000):
            coded = self._code(new[i : i + 20_000])
            self.odd_ids.append(np.fromiter(chain.from_iterable(coded), np.int32), np.fromiter(map(len, coded), np.int64))

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        split = list(map(self.RUNS.findall, new))
        run = np.fromiter(map(self.runs.__getitem__, chain.from_iterable(split)), np.int64)
        runs, self.runs.new = self.runs.new, []
        for i in range(0, len(runs), 20_000):
            some = runs[i : i + 20_000]
            ids = np.fromiter(chain.from_iterable(self._code([" ".join(some[k : k + 500]) for k in range(0, len(some), 500)])), np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't end each run of characters with an end-of-word token")
            self.run_ids.append(ids, np.diff(np.append(0, ends)))
        ends = np.append(0, np.cumsum(self.run_ids.sizes(run)))
        self.word_ids.append(self.run_ids.of(run), np.diff(ends[np.cumsum([0, *map(len, split)])]))

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """One id array for each text."""
        if len(self.words) + len(self.odd_words) + len(self.runs) > CACHE:
            self.clear()
        plain = [self.SPECIAL not in t and self.PLAIN.fullmatch(t) is not None for t in texts]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for wanted, numbers, rows, learn in ((True, self.words, self.word_ids, self._learn), (False, self.odd_words, self.odd_ids, self._learn_odd)):
            some = [i for i, p in enumerate(plain) if p is wanted]
            if not some:
                continue
            words = pc.ascii_split_whitespace(pa.array([texts[i].lower() if wanted else texts[i] for i in some], pa.large_string()))
            coded = words.flatten().dictionary_encode()
            listed = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
            distinct = pc.binary_join(listed, "\n")[0].as_py().split("\n")  # far quicker than one object at a time
            number = np.fromiter(map(numbers.__getitem__, distinct), np.int64, len(distinct))
            learn()
            word = number[coded.indices.to_numpy(zero_copy_only=False)]
            ids, ends = rows.of(word), np.append(0, np.cumsum(rows.sizes(word)))
            cuts = ends[words.offsets.to_numpy()]
            for i, a, b in zip(some, cuts, cuts[1:], strict=False):
                out[i] = ids[a:b]
        return out


_LOADED: dict[str, WordIds] = {}


def load(path: str) -> WordIds:
    """The tokenizer of a file, once per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _slices(texts: list[str]) -> Iterator[list[int]]:
    some, size = [], 0
    for i, t in enumerate(texts):
        some.append(i)
        size += len(t)
        if size >= SLICE:
            yield some
            some, size = [], 0
    if some:
        yield some


def cut_pieces(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece of at most `capacity` ids: key, piece, start, length, ids_crc32 (and ids).

    A document's ids are its text's and then id 0, so a null or empty text is one piece of length 1.
    Only documents longer than `capacity` are cut; the last piece may be shorter. path: a tokenizer
    file that is installed on every executor. Rows with equal or null keys are cut each on its own,
    very long texts are coded whole, and an empty table gives no rows.
    """
    fields = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", **({"ids": "array<int>"} if keep_ids else {})}

    def work(column: list[str | None]) -> Iterator[tuple]:
        coder, texts = load(path), [t or "" for t in column]
        for some in _slices(texts):
            rows = []
            for i, ids in zip(some, coder.texts([texts[i] for i in some]), strict=True):
                whole = np.append(ids, 0).astype("<u4")
                for p, at in enumerate(range(0, len(whole), capacity)):
                    part = whole[at : at + capacity]
                    rows.append((i, p, at, len(part), zlib.crc32(part.tobytes())) + (part.astype(np.int32),) * keep_ids)
            yield tuple(map(list, zip(*rows, strict=True)))

    named = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return with_computed(named, ("_text",), work, drop=("_text",), **fields).withColumnRenamed("_key", key)


class Bins:
    """Bins of item sizes; the search raises the sum of squared fills, so light bins run empty."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []
        self.clock = 0  # exchanges so far
        self.sorted: dict[int, tuple[list, list, list, list]] = {}

    def best_fit(self) -> None:
        """Largest items first, each into the fullest bin that still takes it."""
        free: list[tuple[int, int]] = []
        for item in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            size = self.sizes[item]
            at = bisect_left(free, (size, -1))
            if at < len(free):
                room, b = free.pop(at)
            else:
                room, b = self.capacity, len(self.bins)
                self.bins.append([])
                self.fill.append(0)
            self.bins[b].append(item)
            self.fill[b] += size
            if room > size:
                insort(free, (room - size, b))

    def _apply(self, a: int, out: list[int], b: int, back: list[int]) -> None:
        """Items `out` go from a to b, items `back` from b to a."""
        moved = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + out
        self.fill[a] -= moved
        self.fill[b] += moved
        self.clock += 1
        for x in (a, b):
            self.state[:, x] = self.fill[x], len(self.bins[x]), self.clock
        self.sorted.pop(a, None)
        self.sorted.pop(b, None)

    def _items(self, b: int) -> tuple[list, list, list, list]:
        """A bin's distinct sizes with an item of each, and its distinct sizes of pairs with a pair of each, ascending.

        Items of equal size are interchangeable, and a bin's distinct sizes add up to its capacity at
        most, so there are at most about sqrt(2 * capacity) of them, however many items it holds.
        """
        if b not in self.sorted:
            by_size: dict[int, list[int]] = {}
            for j in self.bins[b]:
                by_size.setdefault(self.sizes[j], []).append(j)
            ones = sorted(by_size)
            pairs: dict[int, list[int]] = {}
            for n, s in enumerate(ones):
                for t in ones[: n + 1]:
                    if s != t:
                        pairs.setdefault(s + t, [by_size[s][0], by_size[t][0]])
                    elif len(by_size[s]) > 1:
                        pairs.setdefault(2 * s, by_size[s][:2])
            twos = sorted(pairs)
            self.sorted[b] = ones, [[by_size[s][0]] for s in ones], twos, [pairs[s] for s in twos]
        return self.sorted[b]

    def _best(self, a: int, b: int) -> tuple[int, list[int], list[int]]:
        """The best move, one-for-one, two-for-one or one-for-two exchange from a to b: the tokens it moves and its items.

        With b at least as full as a, the squared fills grow with every token that b gains, so the
        best exchange is the one that moves the most tokens that b has room for.
        """
        best, found = 0, ([], [])
        room = self.capacity - self.fill[b]
        sizes, items, pair_sizes, pairs = self._items(b)
        n_items, n_pairs = len(sizes), len(pairs)
        own, own_items, own_pair_sizes, own_pairs = self._items(a)
        for n in range(len(own) - 1, -1, -1):
            s = own[n]
            if s <= best:
                break
            if s <= room:
                best, found = s, (own_items[n], [])
            k = bisect_left(sizes, s - room)
            if k < n_items and s - sizes[k] > best:
                best, found = s - sizes[k], (own_items[n], items[k])
            k = bisect_left(pair_sizes, s - room)
            if k < n_pairs and s - pair_sizes[k] > best:
                best, found = s - pair_sizes[k], (own_items[n], pairs[k])
        for n in range(len(own_pairs) - 1, -1, -1):
            if best == room or own_pair_sizes[n] - sizes[0] <= best:
                break
            t = own_pair_sizes[n]
            k = bisect_left(sizes, t - room)
            if k < n_items and t - sizes[k] > best:
                best, found = t - sizes[k], (own_pairs[n], items[k])
        return best, *found

    def search(self) -> None:
        """Improve until no exchange between two underfull bins raises the squared fills.

        A pair that gave nothing is not compared again before one of its bins has changed. A fuller
        bin of one item gives nothing back for less, so it is compared only where it has room for
        the lighter bin's smallest item.
        """
        seen = np.full((len(self.bins), len(self.bins)), -1, np.int32)
        self.state = fill, items, changed_at = np.array([self.fill, [len(b) for b in self.bins], [0] * len(self.bins)], np.int64)
        lighter = lambda: sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: (self.fill[b], b))
        changed = True
        while changed:
            changed = False
            order = np.array(lighter(), np.int64)
            for n, a in enumerate(order.tolist()):
                rest = order[:n:-1]
                while len(rest) and self.bins[a]:
                    smallest = min(self.sizes[i] for i in self.bins[a])
                    able = (fill[rest] >= fill[a]) & (seen[a, rest] < np.maximum(changed_at[a], changed_at[rest])) & ((items[rest] > 1) | (fill[rest] + smallest <= self.capacity))
                    for k in np.flatnonzero(able).tolist():
                        b = int(rest[k])
                        moved, out, back = self._best(a, b)
                        seen[a, b] = self.clock
                        if moved > 0:
                            self._apply(a, out, b, back)
                            changed = True
                            rest = rest[k + 1 :]
                            break
                    else:
                        break
        kept = [b for b in range(len(self.bins)) if self.bins[b]]
        self.bins, self.fill = [self.bins[b] for b in kept], [self.fill[b] for b in kept]


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with `sequence_id` and `offset`; in each sequence offsets run from 0 without a gap.

    Pieces are dealt evenly into groups of about `group` rows, and each group is packed on its own.
    Pieces of sequences that are not full are then dealt anew, into as many fewer groups, and so on.
    Where most of the pieces don't fill a sequence, those of sequences that still have room for the
    smallest piece are dealt anew instead. This ends with all of them in one group, or with a round
    that needed as many sequences as the one before. Lengths must be from 1 to capacity; a null or
    other length is an error. Equal pieces and repeated rows are told apart by their place in the
    input, an empty input gives no rows, and columns that already have the new names are replaced.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    fits = F.when(F.col(length).between(1, capacity), F.monotonically_increasing_id())
    left = stored(pieces.select(*columns, F.coalesce(fits, F.raise_error(F.lit("a piece's length is not from 1 to the capacity")).cast("long")).alias("_n")), "pieces")
    schema = left.select("*", *[F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset", "_room")]).schema

    def solve(g: pa.Table) -> pa.Table:
        trim()  # what the group before has left
        g = g.sort_by("_n")
        bins = Bins(g[length].to_pylist(), capacity)
        bins.best_fit()
        bins.search()
        order = np.array([i for b in bins.bins for i in b])
        sequence = np.repeat(np.arange(len(bins.bins)), [len(b) for b in bins.bins])
        sizes = g[length].to_numpy()[order].astype(np.int64)
        before = np.cumsum(sizes) - sizes
        first = np.append(0, np.flatnonzero(np.diff(sequence)) + 1)
        out = g.select([*columns, "_n"]).take(pa.array(order))
        made = {"sequence_id": (g["_g"][0].as_py() << 24) + sequence, "offset": before - before[first][sequence], "_room": capacity - np.array(bins.fill)[sequence]}
        for name, values in made.items():
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    n, parts, needed, deal, any_room = left.count(), [], None, 0, True
    while True:
        groups = max(1, -(-n // group))
        number = (F.pmod(F.xxhash64("_n", F.lit(deal)), F.lit(groups)) + F.lit(deal << 34)).cast("long")
        solved = left.withColumn("_g", number).groupBy("_g").applyInArrow(solve, schema)
        if groups == 1:
            parts.append(solved)
            break
        solved = stored(solved, "packed")
        under = solved.agg(F.count_if(F.col("offset") == 0).alias("sequences"), F.count_if(F.col("_room") > 0).alias("n"), F.min(F.when(F.col("_room") > 0, F.col(length))).alias("smallest")).first()
        more = needed is not None and under["sequences"] >= needed
        if more and not any_room:
            parts.append(solved)
            break
        any_room = any_room and not more and under["n"] <= n // 2
        still = F.col("_room") >= (1 if any_room else F.coalesce(F.lit(under["smallest"]), F.lit(capacity)))
        again = solved.agg(F.count_if(still).alias("n"), F.count_if(still & (F.col("offset") == 0)).alias("sequences")).first()
        parts.append(solved.where(~still))
        left, n, needed, deal = solved.where(still).drop("sequence_id", "offset", "_room"), again["n"], again["sequences"], deal + 1
        if not n:
            break
    return reduce(DataFrame.unionByName, parts).select(*columns, "sequence_id", "offset")


def packed_rows(df: DataFrame, path: str) -> DataFrame:
    """The digest columns of op8 for a table of documents."""
    return pack(cut_pieces(df.select("doc_id", "text"), path))
