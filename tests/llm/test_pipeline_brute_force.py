"""The classifier's scores and the whole pipeline against plain versions over small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftwave.llm import mil_quality as Q
from siftwave.llm.quality_rules import STOP_WORDS

WORD = re.compile("[^\x20\x09-\x0d]+")


def sigmoid(x):
    return 1 / (1 + math.exp(-min(40, max(-40, x))))


def score(model, text):
    """One passage and one number at a time, by the formulas."""
    w = model.weights
    x, _ = Q.encode_texts([text])
    hidden, logits = [], []
    for row in x:
        row = [min(8, max(-8, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        h = [max(0, sum(v * w["E"][i][j] for i, v in enumerate(row)) + w["e"][j]) for j in range(len(w["e"]))]
        gate = [math.tanh(sum(v * w["V"][i][j] for i, v in enumerate(h))) * sigmoid(sum(v * w["U"][i][j] for i, v in enumerate(h))) for j in range(len(w["w"]))]
        hidden.append(h)
        logits.append(sum(a * b for a, b in zip(gate, w["w"], strict=True)))
    a = [math.exp(v - max(logits)) for v in logits]
    z = [sum(p * h[j] for p, h in zip(a, hidden, strict=True)) / sum(a) for j in range(len(hidden[0]))]
    return sigmoid(sum(p * q for p, q in zip(z, w["c"], strict=True)) + float(w["b"]))


def good(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {x for x, n in Counter(windows).items() if n > 1}
    repeated = {i + k for i, x in enumerate(windows) if x in often for k in range(3)}
    lines = [s for s in (text or "").split("\n") if WORD.search(s)]
    n, m = len(words), len(lines)
    share = lambda a, b, low, high: not b or low * b <= a <= high * b
    return (
        n >= 50
        and len(repeated) <= 0.5 * n
        and share(sum(map(len, words)), n, 2, 14)
        and sum(text.count(c) for c in "#*$%&|<>") <= 0.1 * n
        and sum(x in STOP_WORDS for x in words) >= 0.02 * n
        and m - len(set(lines)) <= 0.5 * m
        and sum(bool(re.match(r"[\x20\x09-\x0d]*[-*•][\x20\x09-\x0d]", s)) for s in lines) <= 0.9 * m
        and sum(bool(re.search(r"(\.\.\.|…)[\x20\x09-\x0d]*$", s)) for s in lines) <= 0.5 * m
    )


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    """The rows with the smallest id of each group of linked texts."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x]}:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
        for x in s:
            holders[x].append(i)
    first = {}
    for i, (doc_id, _) in enumerate(rows):
        key = root(i) if sets[i] else ("alone", i)
        first[key] = min(first.get(key, (doc_id, i)), (doc_id, i))
    return sorted(rows[i] for _, i in first.values())


@pytest.fixture(scope="module")
def model(spark, sf):
    return Q.fit(*Q.training_bags(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))


def test_scores_equal_the_formulas(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where(F.length("text") < 4000).limit(40)
    docs = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "é")], docs.schema))
    for r in Q.score_documents(docs, model).collect():
        assert abs(r["score"] - score(model, r["text"] or "")) < 1e-9


def test_pipeline_equals_its_plain_version(spark, sf, model, tmp_path):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = source.select("doc_id", "text", "lang", "source", "n_chars")
    long = " ".join(r["text"] for r in docs.orderBy("doc_id").limit(60).collect() if r["text"])
    copies = docs.orderBy("doc_id").limit(40).select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat(F.upper("text"), F.lit(" and a little more")).alias("text"), "lang", "source", "n_chars")
    planted = spark.createDataFrame([(200_000, long, "en", "s", 1), (200_001, long + " end", "en", None, None), (200_002, None, None, None, None), (200_003, "a few words", "en", "s", 3)], docs.schema)
    docs.unionByName(copies).unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() if r["text"] is not None)
    fitted = Q.fit(*Q.training_bags(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")))
    kept = [(i, t) for i, t in rows if good(t)]
    kept = [(i, t) for i, t in kept if fitted.score(*(lambda x, n: (x, np.zeros(n[0], int), 1))(*Q.encode_texts([t])))[0] >= 0.5]
    before, kept = len(kept), one_of_each(kept)
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, sizes = set(), []
    for doc_id, text in kept:
        n = len(coder.encode(text, add_special_tokens=False).ids) + 1
        for p, at in enumerate(range(0, n, 2048)):
            sizes.append(min(2048, n - at))
            want.add((doc_id, p, at, sizes[-1]))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in got} == want and len(got) == len(want)
    assert before > len(kept) > 20 and 200_001 not in {i for i, _ in kept}
    # The sequences are gapless and full to capacity, and no more than plain best fit needs.
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    rooms = []
    for s in sorted(sizes, reverse=True):
        best = min((x for x in rooms if x >= s), default=None)
        if best is not None:
            rooms.remove(best)
        rooms.append((2048 if best is None else best) - s)
    assert max(ends.values()) <= 2048 and -(-sum(sizes) // 2048) <= len(ends) <= len(rooms)
