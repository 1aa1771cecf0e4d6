"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwave.llm.blocks import mix, word_ids
from siftwave.llm.storage import hold_out, with_computed

PASSAGE = 96  # words
SAMPLE = 6000  # labelled documents that a model is fitted on, at most
# One class for each kind of character that the encoder tells apart.
KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\n\x0b\x0c\r ", ".", ",", "!?", "#", "$", "%", "&", "*", "|", "<>", "-_=+~^", "'\"`()[]{}:;/\\@")
CLASS = np.full(256, len(KINDS), np.uint8)
for _k, _chars in enumerate(KINDS):
    CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
STYLE = len(KINDS) + 1 + 6
LEXICAL = 128  # buckets of hashed words and word pairs
WIDTH = STYLE + LEXICAL
SLICE = 1_000_000  # bytes of text that are encoded at once, unless one text is longer


def passages(text: str) -> list[list[bytes]]:
    """Runs of PASSAGE words; a last run of under half that length joins the one before it. No words: one empty run."""
    words = text.encode().split()
    cuts = list(range(0, len(words), PASSAGE)) or [0]
    if len(cuts) > 1 and len(words) - cuts[-1] < PASSAGE // 2:
        cuts.pop()
    return [words[a:b] for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True)]


def _lexical(parts: list[list[bytes]]) -> np.ndarray:
    """Signed counts of each passage's lower-case words and word pairs by hash bucket, over the root of its length."""
    sizes = np.array([len(p) for p in parts])
    ids, _, hashes = word_ids([w.lower() for p in parts for w in p])
    if not len(ids):
        return np.zeros((len(parts), LEXICAL))
    word, at = mix(hashes)[ids], np.repeat(np.arange(len(parts)), sizes)
    with np.errstate(over="ignore"):
        pair = mix(word[:-1] * np.uint64(3) + word[1:])
    near = at[1:] == at[:-1]
    h, at = np.append(word, pair[near]), np.append(at, at[1:][near])
    bucket = (h % np.uint64(LEXICAL)).astype(np.int64)
    sums = np.bincount(at * LEXICAL + bucket, np.where(h >> np.uint64(63), 1.0, -1.0), len(parts) * LEXICAL)
    return sums.reshape(len(parts), LEXICAL) / np.sqrt(np.maximum(sizes, 1))[:, None]


def encode_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for every passage of the texts, and the number of passages of each.

    Shares of character kinds, repetition and lengths, and hashed words and word pairs.
    """
    split = [passages(t) for t in texts]
    parts = list(chain.from_iterable(split))
    out = np.empty((len(parts), WIDTH))
    for row, words in zip(out, parts, strict=True):
        n = len(words)
        raw = b" ".join(words)
        counts = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=len(KINDS) + 1)
        row[: len(counts)] = np.sqrt(counts / max(1, len(raw)))
        pairs, triples = set(zip(words, words[1:])), set(zip(words, words[1:], words[2:]))  # noqa: B905
        row[len(counts) : STYLE] = (len(set(words)) / max(1, n), len(pairs) / max(1, n - 1), len(triples) / max(1, n - 2), np.log1p(n), len(raw) / max(1, n) / 10, 0)
    sizes = np.array([len(s) for s in split], np.int64)
    out[:, STYLE - 1] = np.log1p(np.repeat(sizes, sizes))
    out[:, STYLE:] = _lexical(parts)
    return out, sizes


def _slices(texts: list[str]) -> Iterator[slice]:
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i == len(texts) - 1:
            yield slice(at, i + 1)
            at, size = i + 1, 0


@dataclass
class GatedAttention:
    """score = sigmoid(c . z + b), z = sum a_k h_k, a = softmax(w . (tanh(V h_k) * sigmoid(U h_k))), h = relu(E x + e)."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.maximum(x @ w["E"] + w["e"], 0)
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (t * s) @ w["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, logit)
        a = np.exp(logit - top[bag])
        a /= np.bincount(bag, a, bags)[bag]
        z = np.zeros((bags, h.shape[1]))
        np.add.at(z, bag, a[:, None] * h)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["c"] + w["b"])}

    def score(self, x: np.ndarray, bag: np.ndarray, bags: int) -> np.ndarray:
        return self.forward(x, bag, bags)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gradients(m: GatedAttention, f: dict, bag: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
    w = m.weights
    dz = error[:, None] * w["c"]
    da = (f["h"] * dz[bag]).sum(1)
    dlogit = f["a"] * (da - np.bincount(bag, f["a"] * da, len(error))[bag])
    dts = dlogit[:, None] * w["w"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["a"][:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (f["h"] > 0)
    return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dlogit, "c": f["z"].T @ error, "b": error.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 30, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 0) -> GatedAttention:
    """Adam on the class-balanced log loss. With one class only, or no rows, the score is the smoothed share of label 1."""
    rng = np.random.default_rng(seed)
    make = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"E": make(WIDTH, hidden), "e": np.zeros(hidden), "V": make(hidden, attention), "U": make(hidden, attention), "w": make(attention), "c": make(hidden), "b": np.zeros(())}
    x = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    model = GatedAttention(w, x.mean(0), x.std(0) + 1e-3)
    ones = float(np.sum(labels))
    if ones in (0.0, float(len(labels))):
        share = (ones + 0.5) / (len(labels) + 1)
        w["c"], w["b"] = np.zeros(hidden), np.array(np.log(share / (1 - share)))
        return model
    cost = np.where(labels == 1, len(labels) / (2 * ones), len(labels) / (2 * (len(labels) - ones)))
    first, second, step = {k: 0 * v for k, v in w.items()}, {k: 0 * v for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            bag = np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])
            f = model.forward(np.concatenate([bags[i] for i in some]), bag, len(some))
            g = _gradients(model, f, bag, (f["p"] - labels[some]) * cost[some] / len(some))
            step += 1
            for k in w:
                d = g[k] + decay * w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d**2
                w[k] = w[k] - rate * 0.97**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def training_bags(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, held_out: int = 1, modulus: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Encoded passages and labels of at most `sample` labelled documents, none of them held out.

    The sample is the labelled ids with the smallest hashes; it bounds what reaches the driver. Null
    labels or ids and a second label of an id are left out; null texts are empty. Without labelled
    documents the lists are empty.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (hold_out(F.col("doc_id"), modulus) != held_out)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for some in _slices(texts):
                x, sizes = encode_texts(texts[some])
                cells = [p.astype("<f4").tobytes() for p in np.split(x, np.cumsum(sizes)[:-1])]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[some], "_y": b["_y"].iloc[some], "x": cells})

    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = found.mapInPandas(run, "doc_id long, _y int, x binary").orderBy("doc_id", "x").limit(sample).collect()
    return [np.frombuffer(r["x"], "<f4").reshape(-1, WIDTH).astype(float) for r in rows], np.array([r["_y"] for r in rows], float)


def score_documents(df: DataFrame, model: GatedAttention, text: str = "text", out: str = "score") -> DataFrame:
    """df with a double column `out` in 0..1; a null or empty text is one passage without words.

    Every passage of every text is encoded, however long the text. Equal texts and repeated rows get
    equal scores, and an empty table gives no rows. A column already named `out` is replaced; others
    stay.
    """

    def work(column: list[str | None]) -> Iterator[tuple]:
        scores, texts = np.empty(len(column)), [t or "" for t in column]
        for some in _slices(texts):
            x, sizes = encode_texts(texts[some])
            scores[some] = model.score(x, np.repeat(np.arange(len(sizes)), sizes), len(sizes))
        yield range(len(column)), scores

    return with_computed(df, (text,), work, **{out: "double"})


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of op6: every document scored by a model that has seen no held-out label."""
    model = fit(*training_bags(docs, labels))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (hold_out(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
