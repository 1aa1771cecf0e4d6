"""Language model, classifier, near duplicates, packing and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwave.llm import blocks, mil_quality, packing, pitman_yor, prefix_join
from siftwave.llm.queries import queries

SPACE = "[^\x20\x09-\x0d]+"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    extra = [(9_001, None), (9_002, ""), (9_003, " \n"), (9_004, "short text"), (9_005, "SHORT\ttext"), (None, "no id here at all today"), (9_006, "w " * 9000), (9_006, "w " * 9000)]
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("shard", F.lit("x")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def shingles(text):
    w = re.findall(SPACE, fold(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, sets):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    up[root(i)] = root(j)
    low = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            low[root(i)] = min(doc, low.get(root(i), doc))
    return [low.get(root(i)) for i in range(len(ids))]


def test_near_duplicates_equal_brute_force(docs, texts):
    sets = [shingles(t) for _, t in texts]
    want = sorted(((i, len(s), c) for (i, _), s, c in zip(texts, sets, components([i for i, _ in texts], sets), strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in prefix_join.near_duplicate_rows(docs).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("seed", [0, 1])
def test_near_duplicates_of_edited_copies(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for family in range(12):
        base = [f"w{rng.integers(60)}" for _ in range(int(rng.integers(6, 60)))]
        for _ in range(int(rng.integers(1, 12))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"w{rng.integers(60)}"
            rows.append((len(rows), " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    want = dict(zip((i for i, _ in rows), components([i for i, _ in rows], sets), strict=True))
    got = {r["doc_id"]: r["component_id"] for r in prefix_join.near_duplicate_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_text_blocks_hold_fewer_rows_than_20_bits_number():
    import pandas as pd

    n = 2**20 + 7
    batches = (pd.DataFrame({"i": np.arange(a, min(a + 300_000, n)), "text": ""}) for a in range(0, n, 300_000))
    got = list(blocks.text_blocks(batches, "text"))
    assert max(map(len, got)) < 2**20 and np.concatenate([b["i"] for b in got]).tolist() == list(range(n))


def test_language_model_base_score_and_gain(docs, texts):
    out = pitman_yor.lm_rows(docs).toPandas()
    tokens = [[*re.findall(SPACE, fold(t)), None] for _, t in texts]
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i, _ in texts]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _), ws, h in zip(texts, tokens, held, strict=True):
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want.append((i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 4)))
    got = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out.itertuples()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(a, b, c, d, e, float(f)) for a, b, c, d, e, f in want]))
    assert np.isfinite(out["score"]).all() and (out["score"] < 0).all()
    unseen = out[out["held_out"]]
    assert unseen["score"].sum() > unseen["base_score"].sum()


def test_frequent_followers_score_higher_than_unseen_words(spark):
    rng = np.random.default_rng(3)
    words = [f"v{i}" for i in range(12)]
    train = [(i, " ".join(rng.choice(words, 30, p=np.arange(12, 0, -1) / 78))) for i in range(60) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(3000, 9000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    probes = list(zip(held, ["v0 v1", "v0 v11", "v0 neverseen", "v1 v0"], strict=True))
    got = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(spark.createDataFrame(train + probes, "doc_id long, text string")).collect()}
    common, rare, unseen, _ = (got[i] for i in held)
    assert common > rare > unseen and np.isfinite(unseen)


def seatings(c, free, base, d):
    """Weights by number of tables, over every way to seat c customers of one dish one after the other."""
    out = np.zeros(c + 1)

    def place(sizes, weight, left):
        if not left:
            out[len(sizes)] += weight
            return
        place((*sizes, 1), weight * (free + d * len(sizes)) * base, left - 1)
        for i, n in enumerate(sizes):
            place((*sizes[:i], n + 1, *sizes[i + 1 :]), weight * (n - d), left - 1)

    place((), 1.0, c)
    return out / out.sum()


@pytest.mark.parametrize("c,free,base,d", [(2, 1.0, 0.3, 0.5), (5, 0.7, 0.05, 0.8), (7, 20.0, 0.4, 0.25), (8, 3.0, 0.9, 0.9)])
def test_tables_are_drawn_as_enumeration_says(c, free, base, d):
    stirling = pitman_yor.log_stirling(np.array([d]))[0]
    n = 40_000
    t = pitman_yor.seat(np.full(n, c), np.full(n, free), np.full(n, base), d, stirling, np.random.default_rng(c))
    assert np.allclose(np.bincount(t.astype(int), minlength=c + 1) / n, seatings(c, free, base, d), atol=0.012)


def test_seating_keeps_between_one_table_and_all_customers():
    c = np.array([0, 1, 2, 50, 128, 129, 5000, 3])
    t = pitman_yor.seat(c, np.full(8, 2.0), np.full(8, 0.1), 0.5, pitman_yor.log_stirling(np.array([0.5]))[0], np.random.default_rng(0))
    assert (t >= np.minimum(c, 1)).all() and (t <= c).all()


@pytest.mark.parametrize("c,free,base,d", [(200, 2.0, 0.1, 0.5), (500, 1.0, 0.002, 0.85), (1000, 30.0, 0.4, 0.8)])
def test_many_customers_sit_as_the_recursion_says(c, free, base, d):
    """The exact distribution by the recursion of the weights over customers, for numbers of tables that matter."""
    top = min(c, 900)
    weight, t = np.full(top + 1, -np.inf), np.arange(top + 1)
    weight[1] = 0
    for n in range(1, c):
        with np.errstate(divide="ignore"):
            stay = weight + np.log(np.maximum(n - d * t, 1e-300))
            opened = np.append(-np.inf, weight[:-1] + np.log((free + d * t[:-1]) * base))
        weight = np.logaddexp(stay, opened)
    p = np.exp(weight - weight.max())
    p /= p.sum()
    mean = (p * t).sum()
    drawn = pitman_yor.seat(np.full(1500, c), np.full(1500, free), np.full(1500, base), d, pitman_yor.log_stirling(np.array([d]))[0], np.random.default_rng(c))
    assert abs(drawn.mean() - mean) < 0.05 * mean + 0.05, (drawn.mean(), mean)
    assert abs(drawn.std() - np.sqrt((p * (t - mean) ** 2).sum())) < 0.25 * mean**0.5 + 0.1


def seated_words(seed):
    """Six words, one of them unseen, after three contexts of two endings, with every pair of them."""
    rng = np.random.default_rng(seed)
    heavy = pitman_yor.Heavy(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    keys = np.array([5 << 32 | 1, 5 << 32 | 2, 9 << 32 | 1], np.uint64)
    c = rng.integers(0, 5, 18) * (np.repeat(np.arange(6), 3) < 5)
    return pitman_yor.Seats.of(np.arange(6, dtype=np.uint64), keys, np.repeat(np.arange(6), 3), np.tile(np.arange(3), 6), c, heavy)


def totals_of(s, tables, d=(0.4, 0.6, 0.5), strength=(3.0, 2.0, 0.7)):
    leaf, end, word = tables
    shared, root, none = np.bincount(s.leaf_end, leaf, len(s.end)), np.bincount(s.end_word, end, len(s.words)), np.zeros(0)
    return pitman_yor.Totals(int((s.tokens > 0).sum()), int(s.c.sum()), np.array(d), np.array(strength), np.bincount(s.end, end, pitman_yor.ENDINGS), np.bincount(s.end, shared, pitman_yor.ENDINGS), word.sum(), root.sum(), none, none, none)


@pytest.mark.parametrize("seed", [0, 1])
def test_predictive_probabilities_sum_to_one(seed):
    s = seated_words(seed)
    rng, tables = np.random.default_rng(seed), s.first_tables()
    for _ in range(5):
        g = totals_of(s, tables)
        all_t, all_c = np.bincount(s.context, tables[0], 3), np.bincount(s.context, s.c, 3)
        tables, moved = pitman_yor.sweep(s, tables, all_t, all_c, g, pitman_yor.log_stirling(g.d), rng)
        assert np.allclose(moved, np.bincount(s.context, tables[0], 3))
        assert (tables[0][s.c > 0] >= 1).all() and (tables[0] <= s.c).all()
    samples, g = [tables, s.first_tables()], [totals_of(s, tables), totals_of(s, s.first_tables())]
    p = pitman_yor.probabilities(s, samples, [np.bincount(s.context, x[0], 3) for x in samples], np.bincount(s.context, s.c, 3), g)
    assert (p > 0).all()
    # The words that training has, and one of those that it lacks.
    assert np.allclose(np.bincount(s.context, np.where(s.tokens[s.word] > 0, p, 0), 3) + p[s.word == 5], 1)


def test_discounts_are_drawn_near_those_of_the_data():
    rng = np.random.default_rng(4)
    stirling = pitman_yor.log_stirling(pitman_yor.DISCOUNTS)
    for d, strength in ((0.2, 10.0), (0.8, 1.0)):
        counts, t, c = np.zeros(pitman_yor.TABLE), [], []
        for _ in range(300):  # restaurants of 60 customers whose every table has one of 5 dishes
            tables = []
            for n in range(60):
                if rng.random() * (strength + n) < strength + d * len(tables):
                    tables.append([1, int(rng.integers(5))])
                else:
                    k = rng.choice(len(tables), p=np.array([x[0] - d for x in tables]) / (n - d * len(tables)))
                    tables[k][0] += 1
            for dish in range(5):
                own = [x[0] for x in tables if x[1] == dish]
                if sum(own) > 1:
                    counts[sum(own) * (pitman_yor.EXACT + 1) + len(own)] += 1
            t.append(len(tables))
            c.append(60)
        weights = pitman_yor.seating_weights(np.array(t), np.array(c)) + (np.where(counts > 0, stirling.reshape(len(pitman_yor.DISCOUNTS), -1), 0) @ counts)[:, None]
        drawn = pitman_yor._draw(weights, rng)
        assert abs(drawn[0] - d) < 0.1 and 0.4 < drawn[1] / strength < 2.5


def test_a_word_split_over_shards_gives_the_same_counts(spark):
    rng = np.random.default_rng(8)
    texts = [(i, "hot " + " hot ".join(f"w{rng.integers(40)}" for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame([*texts, (900, "w1 " * 30_000), (None, None)], "doc_id long, text string")
    one, many = (pitman_yor.score_texts(df, shard_bytes=n).toPandas().sort_values("doc_id", ignore_index=True) for n in (10**9, 500))
    same = ["n_tokens", "n_known", "train_tokens"]
    assert one[same].equals(many[same]) and np.allclose(one["base_score"], many["base_score"])
    assert np.allclose(one["score"], many["score"], rtol=0.1)


def test_words_of_texts():
    odd = [None, "", " a  B\n", "x\x0by\x0cz\r\n", "\x85 \xa0É \x1c A", "  ", "İ ẞ q", "same same"]
    for ends in (False, True):
        ids, distinct, hashes, sizes = blocks.text_words(odd, ends)
        got = [[distinct[i] for i in part] for part in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [[w.encode() for w in re.findall(SPACE, fold(t))] + [b""] * ends for t in odd]
        assert (np.diff(hashes.astype(object)) > 0).all()
    assert blocks.text_words([])[3].tolist() == [] and blocks.text_words([], True)[0].tolist() == []


@pytest.mark.parametrize("kind", ["u1", "<u4", "<i8", "<u8", "<f8"])
def test_cells_round_trip(kind):
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        a = rng.integers(0, 200, n).astype(kind)
        assert np.array_equal(blocks.take(blocks.put(a, kind), kind), a)
        up = np.sort(rng.integers(0, 2**63, n).astype("<u8") * np.uint64(2))
        assert np.array_equal(blocks.take_sorted(blocks.put_sorted(up)), up)


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = queries()["op6_mil_quality"](spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").toPandas()
    held = out[out["held_out"]].merge(labels, on="doc_id")
    assert auc(held["quality"].to_numpy(), held["score"].to_numpy()) > 0.9
    assert (out["predicted"] == (out["score"] >= 0.5)).all() and out["score"].between(0, 1).all()


def test_classifier_on_words_alone(spark):
    """Both labels have words of the same characters, lengths and repetition; a few passages of a text tell them apart."""
    rng = np.random.default_rng(6)
    words = np.array(["".join(rng.choice(list("abcdefghijkl"), 6)) for _ in range(400)])
    rows, labels = [], []
    for i in range(700):
        y = int(rng.random() < 0.5)
        passages = [rng.choice(words[:200], 96) for _ in range(int(rng.integers(2, 5)))]
        marked = words[200:300] if y else words[300:]
        passages[int(rng.integers(len(passages)))] = np.where(rng.random(96) < 0.5, rng.choice(marked, 96), passages[0])
        rows.append((i, " ".join(np.concatenate(passages))))
        labels.append((i, y))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    held = mil_quality.quality_scores(docs, marks).where("held_out").join(marks, "doc_id").toPandas()
    assert len(held) > 150 and auc(held["quality"].to_numpy(), held["score"].to_numpy()) > 0.95
    model = mil_quality.fit(*mil_quality.training_bags(docs, marks))
    x, sizes = mil_quality.encode_texts([t for _, t in rows])
    attention = model.forward(x, np.repeat(np.arange(len(sizes)), sizes), len(sizes))["a"]
    assert np.isclose(np.add.reduceat(attention, np.cumsum(sizes) - sizes), 1).all() and np.maximum.reduceat(attention, np.cumsum(sizes) - sizes).mean() > 1.2 * (1 / sizes).mean()


def test_scores_replace_a_clashing_column_and_keep_others(spark):
    model = mil_quality.fit([], np.zeros(0))
    df = spark.createDataFrame([("a", "old", 1), (None, "old", 2), ("w " * 300_000, "old", 3)], "text string, score string, _y int")
    got = mil_quality.score_documents(df, model).collect()
    assert [(r["score"], r["_y"]) for r in got] == [(0.5, 1), (0.5, 2), (0.5, 3)]


def test_attention_gradients_match_differences():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, mil_quality.WIDTH)) for n in (1, 3, 2, 4)]
    y = np.array([0, 1, 1, 0.0])
    m = mil_quality.fit(bags, y, hidden=5, attention=3, epochs=1)
    x, bag = np.concatenate(bags), np.repeat(np.arange(4), [1, 3, 2, 4])
    loss = lambda: float(-(y * np.log(p := m.score(x, bag, 4)) + (1 - y) * np.log(1 - p)).sum())
    f = m.forward(x, bag, 4)
    g = mil_quality._gradients(m, f, bag, f["p"] - y)
    for k in ("V", "U", "w", "c", "E"):
        at = np.unravel_index(1, m.weights[k].shape)
        kept = m.weights[k][at]
        m.weights[k][at] = kept + 1e-6
        up = loss()
        m.weights[k][at] = kept - 1e-6
        down = loss()
        m.weights[k][at] = kept
        assert np.isclose((up - down) / 2e-6, g[k][at], atol=1e-4)


def test_classifier_without_labels_and_odd_texts(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    scores = [r["score"] for r in mil_quality.quality_scores(docs, none).collect()]
    assert len(scores) == docs.count() and all(s == 0.5 for s in scores)


def test_packing_is_gapless_and_tight(docs, texts):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(TOKENS)
    got = packing.packed_rows(docs, TOKENS).toPandas()
    want = []
    for i, t in texts:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for p, at in enumerate(range(0, len(ids), 2048))]
    have = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.03 * -(-got["length"].sum() // 2048) + 1


def test_word_ids_equal_an_untouched_tokenizer():
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(TOKENS)
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endof text|>", "x\n<|endoftext|>\té", "<|endoftext", ""]
    texts += ["It's WE'LL don'T 'sort 's", "İstanbul ΟΔΟΣ Σ ŉ ǆ Ǆ ẞ", "e\u0301 \u1fef \u0345", "a\xa0b\u2003c\u3000d \x85e\x1cf", "½ ² ١٢ 12a3 €5 “q” … a—b", "日本語 テキスト 😀👍🏽 \u200d", "!!! ###$$$ a_b-c", "x" * 5000, "ab" * 3000 + " é" * 50, " \t\n"]
    assert [x.tolist() for x in packing.WordIds(TOKENS).texts(texts)] == [coder.encode(t, add_special_tokens=False).ids for t in texts]
    assert packing.WordIds(TOKENS).texts(texts[:1])[0].tolist() == [3306, 49407, 1002]


def test_words_equal_an_untouched_tokenizer_on_random_characters():
    from tokenizers import Tokenizer

    coder, ids, rng = Tokenizer.from_file(TOKENS), packing.WordIds(TOKENS), np.random.default_rng(1)
    low, high = [chr(c) for c in range(9, 0x300)], [chr(c) for c in (*range(0x300, 0x600), *range(0x2000, 0x2200), 0xFB01, 0x1F600)]
    texts = ["".join(rng.choice(low, 40)) for _ in range(300)] + ["".join(rng.choice(low + high, 40)) for _ in range(300)]
    texts += ["".join(rng.choice(list("aAsStTlL'’ré  "), 30)) for _ in range(300)]
    assert [x.tolist() for x in ids.texts(texts)] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def fewest_bins(sizes, capacity):
    """By trying every placement."""
    best = len(sizes)

    def place(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(sizes):
            best = len(fill)
            return
        for b in range(len(fill)):
            if fill[b] + sizes[i] <= capacity:
                place(i + 1, (*fill[:b], fill[b] + sizes[i], *fill[b + 1 :]))
        place(i + 1, (*fill, sizes[i]))

    place(0, ())
    return best


def test_search_against_every_placement():
    rng = np.random.default_rng(8)
    over = []
    for _ in range(60):
        sizes = sorted(rng.integers(1, 20, 9).tolist(), reverse=True)
        b = packing.Bins(sizes, 24)
        b.best_fit()
        b.search()
        over.append(len(b.bins) - fewest_bins(sizes, 24))
    assert min(over) >= 0 and sum(over) <= 2


def test_no_exchange_is_left_after_the_search():
    rng = np.random.default_rng(9)
    for high in (3, 30):
        sizes = rng.integers(1, high, 300).tolist()
        b = packing.Bins(sizes, 101)
        b.bins = [[int(i) for i in x] for x in np.array_split(rng.permutation(300), 1 + sum(sizes) // 60)]
        b.bins = [x for x in b.bins if sum(sizes[i] for i in x) <= 101]
        b.fill = [sum(sizes[i] for i in x) for x in b.bins]
        b.search()
        for x, f in zip(b.bins, b.fill, strict=True):
            for y, g in zip(b.bins, b.fill, strict=True):
                if x is y or f > g or g == 101:
                    continue
                one = lambda z: [(sizes[i],) for i in z]
                two = lambda z: [(sizes[i], sizes[j]) for k, i in enumerate(z) for j in z[:k]]
                moves = [sum(o) - sum(i) for o in one(x) for i in [(), *one(y), *two(y)]] + [sum(o) - sum(i) for o in two(x) for i in one(y)]
                assert not any(0 < m <= 101 - g for m in moves)


def test_underfull_sequences_of_groups_meet_again(spark):
    sizes = np.random.default_rng(4).integers(1, 60, 3000).tolist()
    pieces = spark.createDataFrame([(i, s, "own") for i, s in enumerate(sizes)], "doc_id long, length long, offset string")
    got = packing.pack(pieces, capacity=100, group=64).toPandas()
    assert sorted(got["doc_id"]) == list(range(3000)) and got["sequence_id"].nunique() <= -(-sum(sizes) // 100) + 1
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 100
    wide = spark.createDataFrame([(i, 70) for i in range(300)], "doc_id long, length long")
    assert packing.pack(wide, capacity=100, group=64).select("sequence_id").distinct().count() == 300
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(1, None)], "doc_id long, length long")).collect()


def test_swap_search_never_adds_bins_and_raises_squared_fill():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 60, 40).tolist()
        b = packing.Bins(sizes, 100)
        b.best_fit()
        bins, squares = len(b.bins), sum(f * f for f in b.fill)
        b.search()
        assert len(b.bins) <= bins and sum(f * f for f in b.fill) >= squares
        assert sorted(i for x in b.bins for i in x) == list(range(40)) and max(b.fill) <= 100
        assert [sum(sizes[i] for i in x) for x in b.bins] == b.fill


def test_two_for_one_exchange_empties_a_bin():
    b = packing.Bins([50, 30, 20, 60, 40], 100)
    b.bins, b.fill = [[0, 1], [3, 4], [2]], [80, 100, 20]
    b.search()
    assert len(b.bins) == 2


@pytest.mark.parametrize("name", ["op1_pitman_yor", "op6_mil_quality", "op7_prefix_join", "op8_packing", "pipeline"])
def test_empty_tables(spark, sf, tmp_path, name):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries()[name](spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = cp.stored(stage(spark, before, sf), "test-" + name.replace(" ", "-"))
        assert after.columns == columns
        assert after.join(before, "doc_id", "left_anti").count() == 0 and 0 < after.count() <= before.count()
        if "Jaccard" in name:
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            want = set(components([i for i, _ in rows], [shingles(t) for _, t in rows]))
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == want
        before = after
    packed = cp.STAGES[-1][1](spark, before, sf)
    assert packed.select("doc_id").distinct().count() == before.count()


def test_pipeline_stages_with_odd_rows(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 2000").orderBy("doc_id").first()
    rows = [(None, good["text"], 1, "a"), (None, good["text"], 2, "b"), (5, good["text"], 3, "c"), (5, good["text"], 3, "c"), (6, None, 4, "d"), (7, "", 5, "e"), (8, " \n", 6, "f"), (9, good["text"] * 60, 7, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row long, quality string")
    for name, stage in cp.STAGES[:-1]:
        df = cp.stored(stage(spark, df, sf), "odd-" + name.replace(" ", "-"))
        assert df.columns == ["doc_id", "text", "_row", "quality"], name
    left = df.collect()
    assert {r["doc_id"] for r in left} <= {5, 9} and sum(r["doc_id"] == 5 for r in left) == 1
    packed = cp.STAGES[-1][1](spark, df, sf)
    assert packed.where("length between 1 and 2048").count() == packed.count() > 0


def test_pipeline_classifier_rejects_what_only_it_can_see(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = [f"the of and {' '.join(f'{a}{b}{c}OUND!!' for c in 'RST')}" for a in "BDFGHKLM" for b in "AEIOU"]
    planted = spark.createDataFrame([(-1, "\n".join(lines), "en", "x", 0)], docs.schema)
    ruled = cp.stored(cp.quality_rules(spark, docs.unionByName(planted), sf), "test-ruled")
    assert ruled.where("doc_id = -1").count() == 1
    left = cp.quality_classifier(spark, ruled, sf)
    assert left.where("doc_id = -1").count() == 0 and left.where("doc_id >= 0").count() > 0
