"""LM scoring: a hierarchical Pitman-Yor model whose seating is sampled by Gibbs sweeps on shards.

Restaurants form a tree. Every word has a restaurant for what follows it; all words that end in the
same two bytes share the parent restaurant of that ending; all endings share the root, whose base is
uniform over the known words and one unknown word. A table of a restaurant is a customer of its
parent. A restaurant is named by its word's ending and 32 bits of the word's hash, so within an
ending two of about four thousand million words may share one.

All customers of a word sit in one shard (those of very frequent words are split by ending), so a
sweep changes shards independently, given what the last exchange told of the others. What all words
of a restaurant share, its tables and customers, goes by keyed rows through Spark: every shard sends
its part of each context's totals to the context's owner and gets the sums back. The endings' totals
are vectors of fixed length, which are summed on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.blocks import distinct, mix, put, put_sorted, runs, take, take_sorted, text_blocks, text_words
from siftwave.llm.storage import delete, discard, hold_out, shards, shared_dir, stored

ENDINGS = 65_537  # two last bytes of the word before, or the start of a text
START = ENDINGS - 1
LEAF, ENDING, ROOT = 2, 1, 0
HEAVY = 16_384  # most frequent words whose customers may be split over shards, at most
SHARD = 12_000_000  # bytes of text for each shard
EXACT = 128  # customers of a dish up to which its tables are drawn from their exact distribution
PARTICLES = 8  # seatings of a dish with more customers, of which one is kept
DISCOUNTS = np.linspace(0.05, 0.95, 37)
STRENGTHS = 10.0 ** np.linspace(-2, 4, 19)


def ending(word: bytes) -> int:
    """The restaurant of a word's last two bytes; that of the end token, which is before every text, for no word."""
    return START if not word else (word[-2] << 8 if len(word) > 1 else 0) | word[-1]


@dataclass
class Heavy:
    """Words that are split over shards: hashes in ascending order and numbers of parts."""

    hashes: np.ndarray
    parts: np.ndarray

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


@dataclass
class Block:
    """Distinct (word, context, document) of some texts with their counts, in that order; contexts by key."""

    hashes: np.ndarray
    keys: np.ndarray  # of the contexts: ending, then 32 bits of the word's hash
    word: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    n: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(texts) -> Block:
        ids, known, hashes, sizes = text_words(texts, ends=True)
        keys = np.fromiter(map(ending, known), np.uint64, len(known)) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        # An end stands before each text, and so does one before the first.
        context = place[np.append(ids[-1:], ids[:-1])]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        bits_w, bits_d = len(hashes).bit_length(), len(sizes).bit_length()
        if 2 * bits_w + bits_d <= 63:
            key = np.sort((ids << bits_w | context) << bits_d | doc)
            at = runs(key)
            key, n = key[at], np.diff(np.append(at, len(key)))
            ids, context, doc = key >> (bits_w + bits_d), key >> bits_d & ((1 << bits_w) - 1), key & ((1 << bits_d) - 1)
        else:
            by = np.lexsort((doc, context, ids))
            ids, context, doc = ids[by], context[by], doc[by]
            at = np.flatnonzero(np.append(True, (np.diff(ids) != 0) | (np.diff(context) != 0) | (np.diff(doc) != 0)))
            n = np.diff(np.append(at, len(ids)))
            ids, context, doc = ids[at], context[at], doc[at]
        return Block(hashes, keys[order], ids, context, doc, n, sizes)

    def shard(self, heavy: Heavy, total: int) -> np.ndarray:
        parts = np.ones(len(self.hashes), np.uint64)
        own = heavy.index(self.hashes)
        parts[own >= 0] = heavy.parts[own[own >= 0]]
        salt = mix(self.keys[self.context] >> np.uint64(32)) % parts[self.word]
        return (mix(mix(self.hashes)[self.word] + salt) % np.uint64(total)).astype(np.int64)


def _heavy_words(docs: DataFrame, total: int) -> Heavy:
    """Words with more than an eighth of a shard's share of all tokens, HEAVY at most.

    A word with such a share of all tokens has it in some block, so each block only tells of those.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in text_blocks(batches, "text"):
            ids, _, hashes, _ = text_words(b["text"], ends=True)
            counts = np.bincount(ids)
            some = np.flatnonzero(counts * 8 * total > len(ids))
            some = some[np.argsort(-counts[some], kind="stable")[:HEAVY]]
            yield pd.DataFrame({"h": pd.array([None, *hashes[some].view(np.int64)], "Int64"), "c": [len(ids), *counts[some]]})

    counted = docs.mapInPandas(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counted.orderBy(F.col("h").isNotNull(), F.desc("c"), "h").limit(HEAVY + 1).collect()
    tokens = rows[0]["c"] if rows else 0
    found = sorted((np.int64(r["h"]).astype(np.uint64), -(-8 * total * r["c"] // tokens)) for r in rows[1:] if 8 * total * r["c"] > tokens)
    return Heavy(np.array([h for h, _ in found], np.uint64), np.array([n for _, n in found], np.uint64))


OCCURRENCES = "shard int, block long, n_train int, w binary, per_w binary, keys binary, context binary, doc binary, n binary, ids binary, no_id binary, sizes binary"


def _occurrences(docs: DataFrame, heavy: Heavy, total: int) -> DataFrame:
    """Counts of (word, context, document), as one row for each block and shard; one row of each block also describes its documents.

    Training documents come first in a block.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 24
        for number, b in enumerate(text_blocks(batches, "text")):
            b = b.sort_values("train", ascending=False, kind="stable", ignore_index=True)
            k = Block.of(b["text"])
            shard = k.shard(heavy, total)
            order = np.argsort(shard, kind="stable")
            word, context, doc, n, shard = k.word[order], k.context[order], k.doc[order], k.n[order], shard[order]
            cuts = np.append(runs(shard), len(shard))
            about = (put(b["doc_id"], "<i8"), put(b["no_id"], "u1"), put(k.sizes, "<u4"))
            rows = []
            for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                w, some = runs(word[a:z]), distinct(context[a:z])
                cells = put_sorted(k.hashes[word[a:z][w]]), put(np.diff(np.append(w, z - a)), "<u4"), put_sorted(k.keys[some]), put(np.searchsorted(some, context[a:z]), "<u4"), put(doc[a:z], "<u4"), put(n[a:z], "<u4")
                rows.append((int(shard[a]), task + number, int(b["train"].sum()), *cells, *(about if i == 0 else (None, None, None))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OCCURRENCES.split(", ")])

    return docs.mapInPandas(run, OCCURRENCES)


SEATED = "shard int, words binary, keys binary, per_w binary, context binary, c binary, seen array<struct<block:long,at:binary,doc:binary,n:binary,ids:binary,no_id:binary,sizes:binary>>"


def _seated(occurrences: DataFrame) -> DataFrame:
    """One row for each shard: its distinct (word, context) with their training customers, and where blocks' documents have them."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        hashes, keys = [take_sorted(x) for x in g["w"]], [take_sorted(x) for x in g["keys"]]
        words, contexts = distinct(np.concatenate(hashes)), distinct(np.concatenate(keys))
        pair = []
        for h, k, per, c in zip(hashes, keys, g["per_w"], g["context"], strict=True):
            pair.append(np.repeat(np.searchsorted(words, h), take(per, "<u4")) << 32 | np.searchsorted(contexts, k)[take(c, "<u4")])
        every = distinct(np.concatenate(pair))
        customers, seen = np.zeros(len(every), np.int64), []
        for r, p in zip(g.itertuples(), pair, strict=True):
            at, doc, n = np.searchsorted(every, p), take(r.doc, "<u4"), take(r.n, "<u4")
            np.add.at(customers, at, np.where(doc < r.n_train, n, 0))
            seen.append({"block": r.block, "at": put_sorted(at), "doc": r.doc, "n": r.n, "ids": r.ids, "no_id": r.no_id, "sizes": r.sizes})
        per_w = np.bincount(every >> 32, minlength=len(words))
        return pd.DataFrame([(int(g["shard"].iloc[0]), put_sorted(words), put_sorted(contexts), put(per_w, "<u4"), put(every & 0xFFFFFFFF, "<u4"), put(customers, "<u8"), seen)], columns=[c.split()[0] for c in SEATED.split(", ")[:7]])

    return occurrences.groupBy("shard").applyInPandas(run, SEATED)


@dataclass
class Seats:
    """A shard's customers: pairs (word, context) in order, grouped into pairs (word, ending) in order."""

    words: np.ndarray  # hashes
    own: np.ndarray  # place among the heavy words, or -1
    keys: np.ndarray  # of contexts
    word: np.ndarray
    context: np.ndarray
    c: np.ndarray
    leaf_end: np.ndarray  # row in the ending pairs
    end_word: np.ndarray
    end: np.ndarray
    tokens: np.ndarray  # of each word

    @staticmethod
    def read(row, heavy: Heavy) -> Seats:
        words, keys, per_w = take_sorted(row["words"]), take_sorted(row["keys"]), take(row["per_w"], "<u4")
        return Seats.of(words, keys, np.repeat(np.arange(len(words)), per_w), take(row["context"], "<u4").astype(np.int64), take(row["c"], "<u8").astype(np.int64), heavy)

    @staticmethod
    def of(words, keys, word, context, c, heavy: Heavy) -> Seats:
        end = (keys >> np.uint64(32)).astype(np.int64)[context]
        first = runs(word << 17 | end)
        leaf_end = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
        return Seats(words, heavy.index(words), keys, word, context, c, leaf_end, word[first], end[first], np.bincount(word, c, len(words)).astype(np.int64))

    def first_tables(self) -> list[np.ndarray]:
        """One table for each dish that has customers, in the leaves, the endings and the root."""
        leaf = np.minimum(self.c, 1).astype(float)
        end = np.minimum(np.bincount(self.leaf_end, leaf, len(self.end)), 1)
        return [leaf, end, np.minimum(np.bincount(self.end_word, end, len(self.words)), 1)]


@dataclass
class Totals:
    """What shards share of one sample: discounts and strengths by level, the endings' and the root's tables and customers, the heavy words' root seats and tokens."""

    known: int
    tokens: int
    d: np.ndarray
    strength: np.ndarray
    end_t: np.ndarray
    end_c: np.ndarray
    root_t: float
    root_c: float
    word_c: np.ndarray
    word_t: np.ndarray
    word_n: np.ndarray

    def p(self, level: int, c, t, all_c, all_t, parent):
        """The predictive probability of a dish with c customers at t tables, in a restaurant with all_c at all_t."""
        d, strength = self.d[level], self.strength[level]
        return (c - d * t + (strength + d * all_t) * parent) / (strength + all_c)


def log_stirling(d: np.ndarray) -> np.ndarray:
    """log of the generalized Stirling numbers S(c, t) of discounts d, up to EXACT: an array by discount, c and t."""
    out = np.full((len(d), EXACT + 1, EXACT + 1), -np.inf)
    out[:, 1, 1] = 0
    t = np.arange(EXACT + 1)
    for c in range(1, EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - d[:, None] * t, 1e-300)), -np.inf) + out[:, c]
        out[:, c + 1] = np.logaddexp(stay, np.concatenate([np.full((len(d), 1), -np.inf), out[:, c, :-1]], 1))
    return out


def draw_tables(c: np.ndarray, free: np.ndarray, base: np.ndarray, d: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with 2..EXACT customers, from their exact distribution given all other seats.

    free: strength + d * (the restaurant's tables of other dishes); base: the parent's probability.
    t tables have the weight S(c, t) * base**t * free * (free + d) * ... * (free + (t - 1) d).
    """
    out = np.ones(len(c))
    for k in np.unique(c):
        rows = np.flatnonzero(c == k)
        for at in range(0, len(rows), max(1, 2_000_000 // int(k))):
            some = rows[at : at + max(1, 2_000_000 // int(k))]
            weight = np.cumsum(np.log(free[some, None] + d * np.arange(k)) + np.log(base[some, None]), axis=1) + stirling[k, 1 : k + 1]
            chance = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            out[some] = 1 + (chance < rng.random((len(some), 1)) * chance[:, -1:]).sum(1)
    return np.minimum(out, np.maximum(c, 1))


def draw_many(c: np.ndarray, free: np.ndarray, base: np.ndarray, d: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with more than EXACT customers, for which the sum over t would not be bounded.

    The weight that customers n + 1 to c give to t tables at the n-th grows very nearly as a**t, with
    a = x / (1 + base x) and x = (n / c)**d / (1 - base). So seatings of the first EXACT customers,
    PARTICLES of them, are drawn from their exact distribution times a**t. Further customers join in
    groups of a sixteenth of those seated, opening tables by chances that look ahead in the same way;
    what these miss is the weight by which the seatings are drawn anew after each group.
    """
    order = np.argsort(-c, kind="stable")
    c, free, base = c[order], free[order, None], np.minimum(base[order, None], 1 - 1e-9)

    def ahead(n, m):
        x = (n / c[:m, None]) ** d / (1 - base[:m])
        return x / (1 + base[:m] * x)

    every = lambda x: np.broadcast_to(x, (len(c), PARTICLES)).reshape(-1)
    t = draw_tables(every(np.full((len(c), 1), EXACT)), every(free), every(base * ahead(EXACT, len(c))), d, stirling, rng).reshape(len(c), PARTICLES)
    n = EXACT
    while m := int(np.searchsorted(-c, -n, "left")):  # those with more than n customers
        k = np.minimum(n // 16, c[:m, None] - n)
        after = ahead(n + k, m)
        new, stay = (free[:m] + d * t[:m]) * base[:m] * after, n - d * t[:m]
        weight = k * np.log(new + stay) + t[:m] * np.log(after / ahead(n, m))
        joined = t[:m] + rng.binomial(k, np.clip(new / (new + stay), 0, 1))
        chance = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
        # One random number for each row, and equal steps: a seating survives as often as its share says.
        at = (np.arange(PARTICLES) + rng.random((m, 1))) / PARTICLES * chance[:, -1:]
        picked = np.minimum((chance[:, None, :] < at[:, :, None]).sum(2), PARTICLES - 1)
        t[:m] = np.take_along_axis(joined, picked, 1)
        n += n // 16
    out = np.empty(len(c))
    out[order] = t[np.arange(len(c)), rng.integers(0, PARTICLES, len(c))]
    return out


def seat(c: np.ndarray, free: np.ndarray, base: np.ndarray, d: float, stirling: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of every dish given all other seats; none and one customer have as many tables."""
    c = c.astype(np.int64)
    out = np.minimum(c, 1).astype(float)
    few, many = np.flatnonzero((c > 1) & (c <= EXACT)), np.flatnonzero(c > EXACT)
    out[few] = draw_tables(c[few], free[few], base[few], d, stirling, rng)
    out[many] = draw_many(c[many], free[many], base[many], d, stirling, rng)
    return out


def sweep(s: Seats, tables: list[np.ndarray], all_t: np.ndarray, all_c: np.ndarray, g: Totals, stirling: np.ndarray, rng: np.random.Generator) -> tuple[list[np.ndarray], np.ndarray]:
    """New tables of the leaf pairs, the ending pairs and the words, and the contexts' tables with this shard's changes.

    all_t, all_c: tables and customers of the contexts, in order of s.keys.
    """
    leaf_t, end_t, word_t = tables
    uniform = 1 / (g.known + 1)

    def root_chances(end_tables):
        c, t = np.bincount(s.end_word, end_tables, len(s.words)), word_t.copy()
        c[s.own >= 0], t[s.own >= 0] = g.word_c[s.own[s.own >= 0]], g.word_t[s.own[s.own >= 0]]
        return g.p(ROOT, c, t, g.root_c, g.root_t, uniform)

    draw = lambda level, c, old, total, base: seat(c, np.maximum(g.strength[level] + g.d[level] * (total - old), 1e-9), np.maximum(base, 1e-300), g.d[level], stirling[level], rng)
    shared = np.bincount(s.leaf_end, leaf_t, len(s.end))
    above = g.p(ENDING, shared, end_t, g.end_c[s.end], g.end_t[s.end], root_chances(end_t)[s.end_word])
    new = draw(LEAF, s.c, leaf_t, all_t[s.context], above[s.leaf_end])
    all_t = all_t + np.bincount(s.context, new - leaf_t, len(s.keys))
    shared = np.bincount(s.leaf_end, new, len(s.end))
    end_t = draw(ENDING, shared, end_t, g.end_t[s.end], root_chances(end_t)[s.end_word])
    c = np.bincount(s.end_word, end_t, len(s.words))
    word_t = draw(ROOT, np.where(s.own < 0, c, 0), word_t, np.full(len(c), g.root_t), np.full(len(c), uniform))
    return [new, end_t, word_t], all_t


def _packed(rows: np.ndarray) -> dict[str, bytes]:
    some = np.flatnonzero(rows.any(0))
    return {"totals_at": put(some, "<u4"), "totals": put(rows[:, some], "<f8")}


def _add(sums: np.ndarray, cells) -> np.ndarray:
    for at, values in cells:
        sums[:, take(at, "<u4")] += take(values, "<f8").reshape(len(sums), -1)
    return sums


def _summed(rows: DataFrame, samples: int, size: int, total: int) -> np.ndarray:
    """Packed vectors, added level by level, each in about as many groups as the root of the one before, and the last few on the driver."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"g": g["g"].iloc[0]} | _packed(_add(np.zeros((samples, size)), zip(g["totals_at"], g["totals"], strict=True)))])

    groups, parts = total, rows.select(F.col("shard").cast("long").alias("g"), "totals_at", "totals")
    while groups > LAST:
        groups = max(1, round(groups**0.5))
        parts = parts.withColumn("g", F.col("g") % groups).groupBy("g").applyInPandas(run, "g long, totals_at binary, totals binary")
    return _add(np.zeros((samples, size)), parts.select("totals_at", "totals").collect())


LAST = 16  # vectors that the driver adds, at most
TABLE = (EXACT + 1) ** 2
PARTS = lambda heavy: (ENDINGS,) * 4 + (heavy,) * 2 + (TABLE,) * 3 + (6,)


def _totals(s: Seats, samples, n: int) -> dict[str, bytes]:
    """Sums over a shard for each sample: the endings' tables and customers, both also of dishes with more than EXACT customers; the heavy words' root customers and tokens; how many dishes have c customers at t tables, by level; and root tables and customers, the informative ones of these, tokens and known words."""
    rows = []
    for leaf_t, end_t, word_t in samples:
        shared, root = np.bincount(s.leaf_end, leaf_t, len(s.end)), np.bincount(s.end_word, end_t, len(s.words))
        plain, own = s.own < 0, s.own[s.own >= 0]
        count = lambda c, t: np.bincount((c * (EXACT + 1) + t)[(c > 1) & (c <= EXACT)].astype(np.int64), minlength=TABLE)
        few = plain & (root <= EXACT)
        ends = [np.bincount(s.end, v, ENDINGS) for v in (end_t, shared, np.where(shared > EXACT, end_t, 0), np.where(shared > EXACT, shared, 0))]
        heavy = [np.bincount(own, v[s.own >= 0], n) for v in (root, s.tokens)]
        levels = [count(np.where(plain, root, 0), word_t), count(shared, end_t), count(s.c, leaf_t)]
        rows.append(np.concatenate([*ends, *heavy, *levels, [word_t[plain].sum(), root.sum(), word_t[few].sum(), root[few].sum(), s.tokens.sum(), (plain & (s.tokens > 0)).sum()]]))
    return _packed(np.array(rows, float))


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def seating_weights(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Over DISCOUNTS and STRENGTHS, the sum over restaurants of the log weight of having c customers at t tables, dishes aside."""
    (t, n_t), (c, n_c) = (np.unique(x[x > 0], return_counts=True) for x in (t, c))
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    for i, d in enumerate(DISCOUNTS):
        for j, s in enumerate(STRENGTHS):
            out[i, j] = (n_t * ((t - 1) * np.log(d) + _lgamma(s / d + t) - _lgamma(np.array(s / d + 1)))).sum() - (n_c * (_lgamma(s + c) - _lgamma(np.array(s + 1)))).sum()
    return out


ROUND = "shard int, owner int, cells array<binary>, totals_at binary, totals binary"
_COLUMNS = ["shard", "owner", "cells", "totals_at", "totals"]


def _sent(shard: int, s: Seats, samples, heavy: Heavy, total: int) -> pd.DataFrame:
    """A shard's tables and totals, and for the owner of every context in it: keys, customers and tables; those of big dishes as places and values."""
    n = len(heavy.hashes)
    flat = [put(x, "<u8") for sample in samples for x in sample]
    rows = [(shard, None, flat, *_totals(s, samples, n).values())]
    size = len(s.keys)
    tables = [np.bincount(s.context, leaf_t, size) for leaf_t, _, _ in samples]
    customers, big = np.bincount(s.context, s.c, size), s.c > EXACT
    big_t, big_c = np.bincount(s.context[big], samples[-1][0][big], size), np.bincount(s.context[big], s.c[big], size)
    owner = (s.keys & np.uint64(0xFFFFFFFF)) * np.uint64(total) >> np.uint64(32)
    order = np.argsort(owner, kind="stable")
    cuts = np.append(runs(owner[order]), size)
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:z]
        some = np.flatnonzero(big_c[at])
        rows.append((shard, int(owner[at[0]]), [put_sorted(s.keys[at]), put(customers[at], "<u8"), put_sorted(some), put(big_t[at][some], "<u8"), put(big_c[at][some], "<u8"), *[put(t[at], "<u8") for t in tables]], None, None))
    return pd.DataFrame(rows, columns=_COLUMNS)


def _exchanged(sent: DataFrame, samples: int) -> DataFrame:
    """What each shard gets back of each owner: sums of its contexts, in the order sent; and, with shard -1, an owner's seating weights."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        keys = [take_sorted(c[0]) for c in g["cells"]]
        every = distinct(np.concatenate(keys))
        at = [np.searchsorted(every, k) for k in keys]
        sums = np.zeros((1 + samples, len(every)), np.int64)
        few = np.zeros((2, len(every)), np.int64)
        for c, i in zip(g["cells"], at, strict=True):
            sums[0, i] += take(c[1], "<u8").astype(np.int64)
            for k in range(samples):
                sums[1 + k, i] += take(c[5 + k], "<u8").astype(np.int64)
            if len(c[2]) > 1:
                some = i[take_sorted(c[2]).astype(np.int64)]
                few[0, some] -= take(c[3], "<u8").astype(np.int64)
                few[1, some] -= take(c[4], "<u8").astype(np.int64)
        few[0] += sums[-1]
        few[1] += sums[0]
        owner = int(g["owner"].iloc[0])
        rows = [(int(shard), owner, [put(x[i], "<u8") for x in sums], None, None) for shard, i in zip(g["shard"], at, strict=True)]
        rows.append((-1, owner, None, *_packed(seating_weights(few[0], few[1]).reshape(1, -1)).values()))
        return pd.DataFrame(rows, columns=_COLUMNS)

    return sent.where("owner IS NOT NULL").groupBy("owner").applyInPandas(run, ROUND)


def _received(s: Seats, rows: pd.DataFrame, samples: int, total: int) -> tuple[list[list[np.ndarray]], list[np.ndarray], np.ndarray]:
    """A shard's own samples of tables, and the tables (by sample) and customers of its contexts."""
    flat = [take(x, "<u8").astype(float) for x in rows.loc[rows["owner"].isna(), "cells"].iloc[0]]
    owner = (s.keys & np.uint64(0xFFFFFFFF)) * np.uint64(total) >> np.uint64(32)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(total + 1).astype(np.uint64))
    sums = np.zeros((1 + samples, len(s.keys)))
    for r in rows[rows["owner"].notna()].itertuples():
        at = order[starts[int(r.owner)] : starts[int(r.owner) + 1]]
        for k in range(1 + samples):
            sums[k, at] = take(r.cells[k], "<u8")
    return [flat[i : i + 3] for i in range(0, len(flat), 3)], list(sums[1:]), sums[0]


def _draw(weights: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    """A discount and a strength in proportion to their weights."""
    chance = np.exp(weights - weights.max()).reshape(-1)
    at = int(rng.choice(len(chance), p=chance / chance.sum()))
    return DISCOUNTS[at // len(STRENGTHS)], STRENGTHS[at % len(STRENGTHS)]


def _share(sent: DataFrame, back: DataFrame, heavy: Heavy, before: Totals | None, samples: int, total: int, stirling: np.ndarray, rng: np.random.Generator) -> list[Totals]:
    """The totals of every sample, with discounts and strengths drawn given the last one's seats."""
    n = len(heavy.hashes)
    sizes = PARTS(n)
    sums = _summed(sent.where("owner IS NULL"), samples, sum(sizes), total)
    leaves = _summed(back.where("shard = -1").withColumn("shard", F.col("owner")), 1, len(DISCOUNTS) * len(STRENGTHS), total)[0].reshape(len(DISCOUNTS), -1)
    out = []
    for row in sums:
        end_t, end_c, big_t, big_c, word_c, word_n, roots, ends, leaf, rest = np.split(row, np.cumsum(sizes)[:-1])
        root_t, root_c, few_t, few_c, tokens, known = rest
        weights = [seating_weights(np.array([few_t]), np.array([few_c])), seating_weights(end_t - big_t, end_c - big_c), leaves]
        drawn = [_draw(w + (np.where(h > 0, stirling.reshape(len(DISCOUNTS), -1), 0) @ h)[:, None], rng) for w, h in zip(weights, (roots, ends, leaf), strict=True)]
        d, strength = (np.array(x) for x in zip(*drawn, strict=True))
        word_t = np.minimum(word_c, 1.0) if before is None else np.minimum(before.word_t, word_c)
        known = int(known + (word_n > 0).sum())
        all_t = root_t + word_t.sum()
        level = stirling[int(np.argmin(abs(DISCOUNTS - d[ROOT])))]
        drawn_t = seat(word_c, strength[ROOT] + d[ROOT] * (all_t - word_t), np.full(n, 1 / (known + 1)), d[ROOT], level, rng)
        out.append(Totals(known, int(tokens), d, strength, end_t, end_c, all_t + drawn_t.sum() - word_t.sum(), root_c, word_c, drawn_t, word_n))
    return out


def _levels(g: Totals) -> np.ndarray:
    return log_stirling(np.array(g.d))


def _first(seated: DataFrame, heavy: Heavy, total: int) -> DataFrame:
    """What shards send with each dish at one table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                s = Seats.read(row, heavy)
                yield _sent(int(row["shard"]), s, [s.first_tables()], heavy, total)

    return seated.mapInPandas(run, ROUND)


def _round(seated: DataFrame, rows: DataFrame, heavy: Heavy, g: Totals, burn: int, keep: int, total: int, seed: int) -> DataFrame:
    """What shards send after `burn` sweeps, or after `keep` more, whose tables are all kept."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        shard = int(left["shard"].iloc[0])
        rng, stirling = np.random.default_rng([seed, shard]), _levels(g)
        s = Seats.read(left.iloc[0], heavy)
        samples, all_t, all_c = _received(s, right, 1, total)
        tables, all_t, kept = samples[-1], all_t[-1], []
        for i in range(burn + keep):
            tables, all_t = sweep(s, tables, all_t, all_c, g, stirling, rng)
            kept += [tables] * (i >= burn)
        return _sent(shard, s, kept or [tables], heavy, total)

    return seated.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(run, ROUND)


def probabilities(s: Seats, samples, tables: list[np.ndarray], customers: np.ndarray, totals: list[Totals]) -> np.ndarray:
    """The predictive probability of every pair's word after its context, averaged over the samples."""
    out = np.zeros(len(s.c))
    for (leaf_t, end_t, word_t), all_t, g in zip(samples, tables, totals, strict=True):
        root_c, root_t = np.bincount(s.end_word, end_t, len(s.words)), word_t.copy()
        own = s.own >= 0
        root_c[own], root_t[own] = g.word_c[s.own[own]], g.word_t[s.own[own]]
        p = g.p(ROOT, root_c, root_t, g.root_c, g.root_t, 1 / (g.known + 1))[s.end_word]
        p = g.p(ENDING, np.bincount(s.leaf_end, leaf_t, len(s.end)), end_t, g.end_c[s.end], g.end_t[s.end], p)[s.leaf_end]
        out += g.p(LEAF, s.c, leaf_t, customers[s.context], all_t[s.context], p)
    return out / len(samples)


def _partial_scores(seated: DataFrame, rows: DataFrame, heavy: Heavy, totals: list[Totals], total: int) -> DataFrame:
    """For each block and shard, the documents' sums over the words of that shard."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        s = Seats.read(left.iloc[0], heavy)
        score = np.log10(probabilities(s, *_received(s, right, len(totals), total), totals))
        tokens = s.tokens.astype(float)
        tokens[s.own >= 0] = totals[-1].word_n[s.own[s.own >= 0]]
        base, known = np.log10(tokens + 0.1)[s.word], (tokens > 0)[s.word]
        out = []
        for r in left["seen"].iloc[0]:
            at, doc, n = take_sorted(r["at"]).astype(np.int64), take(r["doc"], "<u4").astype(np.int64), take(r["n"], "<u4").astype(np.int64)
            docs = distinct(doc)
            to = np.searchsorted(docs, doc)
            add = lambda v: np.bincount(to, v[at] * n, len(docs))  # noqa: B023, E731
            out.append((r["block"], put_sorted(docs), put(add(score), "<f8"), put(add(base), "<f8"), put(add(known), "<u4"), r["ids"], r["no_id"], r["sizes"]))
        return pd.DataFrame(out, columns=["block", "doc", "score", "base", "known", "ids", "no_id", "sizes"])

    schema = "block long, doc binary, score binary, base binary, known binary, ids binary, no_id binary, sizes binary"
    return seated.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(run, schema)


def _gathered(parts: DataFrame, tokens: int, known: int) -> DataFrame:
    """A row for each document of every block."""
    floor = np.log10(tokens + 0.1 * (known + 1))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        about = b[b["ids"].notna()].iloc[0]
        ids, sizes = take(about["ids"], "<i8"), take(about["sizes"], "<u4").astype(np.int64)
        score, base, seen = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for r in b.itertuples():
            doc = take_sorted(r.doc).astype(np.int64)
            score[doc] += take(r.score, "<f8")
            base[doc] += take(r.base, "<f8")
            seen[doc] += take(r.known, "<u4")
        doc_id = pd.array(ids, "Int64")
        doc_id[take(about["no_id"], "u1").astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "n_tokens": sizes, "n_known": seen, "train_tokens": tokens, "base_score": base - sizes * floor, "score": score})

    return parts.groupBy("block").applyInPandas(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, rounds: int = 2, burn: int = 2, keep: int = 3, seed: int = 7, shard_bytes: int = SHARD) -> DataFrame:
    """Every document's log10 probability: n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Documents (doc_id, text) whose crc32(doc_id) mod 10 is not 0 train the model. Each of `rounds`
    rounds makes `burn` sweeps of every shard between two exchanges; the last keeps `keep` further
    sweeps, whose predictive probabilities are averaged. Discounts and strengths are drawn at every
    exchange, on a grid, from what dishes of at most EXACT customers say. A null or empty text is one
    end token, a very long one is taken whole; a null doc_id counts as an empty id. Repeated rows are
    scored one by one, other columns are not read, an empty table gives no rows, and without training
    rows all tokens are unknown.
    """
    spark, rng = docs.sparkSession, np.random.default_rng(seed)
    key = F.col("doc_id").cast("long")
    # In pandas a column of ids with a null would be one of doubles.
    docs = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("no_id"), F.col("text").cast("string").alias("text"), (hold_out(F.col("doc_id"), 10) != 0).alias("train"))
    total = shards(docs, size=shard_bytes)
    heavy, grid = _heavy_words(docs, total), log_stirling(DISCOUNTS)
    # The shards' seats are a bucketed table: every round reads them where they are, and only what changes is shuffled.
    name = f"siftwave_seats_{uuid.uuid4().hex}"
    seats = f"{shared_dir(spark)}/{name}"
    try:
        _seated(_occurrences(docs, heavy, total)).write.bucketBy(min(total, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard").option("path", seats).saveAsTable(name)
        return _scored(spark.table(name), heavy, grid, rng, rounds, burn, keep, seed, total)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(spark, seats)


def _scored(seated: DataFrame, heavy: Heavy, grid: np.ndarray, rng: np.random.Generator, rounds: int, burn: int, keep: int, seed: int, total: int) -> DataFrame:
    """The rounds of score_texts over the stored seats of all shards."""
    samples, g, previous = 1, None, ()
    pairs = seated.drop("seen")
    for r in range(rounds + 1):
        last = r == rounds
        made = _first(pairs, heavy, total) if r == 0 else _round(pairs, rows, heavy, g, burn, keep if last else 0, total, seed + r)
        samples = keep if last and r else 1
        sent = stored(made, "sent")
        back = stored(_exchanged(sent, samples), "back")
        totals = _share(sent, back, heavy, g, samples, total, grid, rng)
        g = totals[-1]
        rows = sent.where("owner IS NULL").unionByName(back.where("shard >= 0")).drop("totals_at", "totals")
        discard(*previous)
        previous = (sent, back)
    scores = stored(_gathered(_partial_scores(seated, rows, heavy, totals, total), g.tokens, g.known), "scores")
    discard(*previous)
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def lm_rows(docs: DataFrame) -> DataFrame:
    """The digest columns of op1."""
    s = score_texts(docs.select("doc_id", "text"))
    return s.select("doc_id", (hold_out(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
