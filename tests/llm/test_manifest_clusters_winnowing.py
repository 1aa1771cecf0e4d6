"""Merkle manifest, centroid clustering and winnowing, against brute force and SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftwave.llm import centroids, merkle, winnowing
from siftwave.llm.queries import oracle_sql, queries

BIG = 2**53 + 1


def table(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroids"])
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got, want = queries()[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got[sorted(got.columns)].itertuples(index=False)) == table(want[sorted(got.columns)].itertuples(index=False))


# Merkle manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, n: H("".join(map(said, (r.doc_id, r.source, r.lang, n, r.text))))
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.n_chars), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: up([y[2] for y in sorted(trees[x], key=lambda y: y[:3])]) for x in names}
    top = up([own[x][-1][0] for x in names])
    for k, x in enumerate(names):
        for i, (_, _, digest, r) in enumerate(sorted(trees[x], key=lambda y: y[:3])):
            changed = r.doc_id is not None and r.n_chars is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            now, path = leaf(r, r.n_chars + 1) if changed else digest, []
            for levels, p in ((own[x], i), (top, k)):
                for nodes in levels[:-1]:
                    other = nodes[p ^ 1 : (p ^ 1) + 1]
                    path += other
                    now = H("".join([now, *other] if p % 2 == 0 else [*other, now]))
                    p //= 2
            out.append((r.doc_id, digest, own[x][-1][0], top[-1][0], H("".join(path)), now, now == top[-1][0]))
    return out


ODD = [(None, None, None, None, None), (None, None, None, None, None), (None, "a", None, 3, "x"), (BIG, "é", "fr", 2, "éé"), (BIG, "é", "fr", 2, "éé"), (BIG + 2, None, "fr", None, "y" * 300_000), (-5, "s", "zz", 2**62, ""), (7, "s", "", 1, "t")]


@pytest.fixture(scope="module")
def documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    return d.unionByName(spark.createDataFrame(ODD, d.schema)).withColumn("tree", F.lit(3)).withColumn("pos", F.lit("x")).withColumn("lead", F.lit(1))


@pytest.mark.parametrize("steps", [1, 3, 10])
def test_manifest_equals_brute_force(documents, monkeypatch, steps):
    monkeypatch.setattr(merkle.merkle_rows, "__defaults__", (False, 2, steps))
    got = [tuple(r) for r in merkle.manifest_rows(documents).collect()]
    assert table(got) == table(manifest(documents.collect()))


def test_manifest_of_no_and_of_one_row(spark, documents):
    assert merkle.manifest_rows(documents.limit(0)).collect() == []
    one = spark.createDataFrame([(1, None, "de", 1, "t")], documents.select("doc_id", "source", "lang", "n_chars", "text").schema)
    r = merkle.manifest_rows(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == H("")


def test_proofs_fold_in_runs_of_three(spark):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(23)]
    rows = spark.createDataFrame([("a" if i < 16 else "b", i, x, x) for i, x in enumerate(leaves)], "tree string, doc_id long, leaf binary, claim binary")
    got = merkle.merkle_rows(rows, proofs=True, fanout=3, steps=2).collect()
    assert len(got) == 23 and all(r.verified for r in got)
    level = [x.hex() for x in leaves[:16]]
    while len(level) > 1:
        level = [H("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    assert {r.subroot for r in got if r.tree == "a"} == set(level)
    assert all(len(r.proof) == len(set(r.proof)) and r.proof_sha256 == H("".join(r.proof)) for r in got)


# Centroids


def clustered(rows, k=40, rounds=5, dims=64):
    kept = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(range(len(kept)), key=lambda j: (H(f"2:{'' if kept[j][0] is None else kept[j][0]}"), kept[j][1]))[:k]
    x = np.array([v for _, v in kept])
    c = x[first].copy()
    measure = lambda: ((x[:, None] - c[None]) ** 2).sum(-1)
    for _ in range(rounds):
        a = measure().argmin(1)
        for j in set(a.tolist()):
            c[j] = x[a == j].sum(0) // (a == j).sum()
    d = measure()
    a, low = d.argmin(1), d.min(1)
    return [(kept[i][0], int(a[i]), int(low[i]), int(low[a == a[i]].sum()), int(low.sum()), H(",".join(map(str, c[a[i]].tolist())))) for i in range(len(kept))]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))


def test_clusters_equal_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    odd = [(1, None), (2, [0.5] * 63), (3, [0.5] * 65), (4, [None] + [0.1] * 63), (5, [float("nan")] + [0.1] * 63), (6, [float("-inf")] * 64), (7, []), (None, [0.25] * 64), (BIG, [-0.001] * 64), (BIG + 2, [1000.0] * 64), *[(9, [0.5] * 64)] * 100]
    got = [tuple(r) for r in centroids.cluster_rows(vectors(spark, rows + odd)).collect()]
    assert table(got) == table(clustered(rows + odd))
    assert {BIG, BIG + 2, None} <= {r[0] for r in got}


def test_few_equal_and_no_vectors(spark):
    for rows in ([(i, [float(i % 2)] * 64) for i in range(9)], [(3, [0.5] * 64)] * 50):
        assert table(map(tuple, centroids.cluster_rows(vectors(spark, rows)).collect())) == table(clustered(rows))
    assert centroids.cluster_rows(vectors(spark, [(1, None)])).collect() == []
    with pytest.raises(PySparkException, match="too large"):
        centroids.cluster_rows(vectors(spark, [(1, [1e30] * 64)])).collect()


def test_partial_search_finds_what_a_full_one_does_and_measures_less():
    rng = np.random.default_rng(3)
    c = rng.integers(-400, 400, (30, 64))
    x = c[rng.integers(0, 30, 3000)] + rng.integers(-3, 4, (3000, 64))
    x[:50] = 0
    c[7] = c[3]
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    cluster, distance, terms = centroids.assign(x, c, np.argsort(-x.var(0)))
    assert (cluster == d.argmin(1)).all() and (distance == d.min(1)).all() and not (cluster == 7).any()
    assert terms < 0.25 * d.size * 64


# Winnowing


def kept(text, k, window):
    """Positions by the definition, over the hashes of each run taken alone."""
    k = min(k, len(text))
    h = [int(winnowing.run_hashes(winnowing.code_points(text[i : i + k]), k)[0]) for i in range(len(text) - k + 1)] if k else []
    window, out = min(window, len(h)), []
    for i in range(len(h) - window + 1 if h else 0):
        out.append(max(j for j in range(i, i + window) if h[j] == min(h[i : i + window])))
    return sorted(set(out)), h


@pytest.mark.parametrize("piece", [16, 2**18])
def test_winnowing_equals_its_definition(monkeypatch, piece):
    monkeypatch.setattr(winnowing, "PIECE", piece)
    rng = np.random.default_rng(piece)
    for trial in range(120):
        text = "".join(rng.choice(list("abé𝄞"), int(rng.choice([0, 1, 2, 5, 24, 30, 100, 300]))))
        text = text[:7] * 20 if trial % 3 == 0 else text
        other = "".join(rng.choice(list("abé𝄞"), int(rng.choice([0, 1, 10, 60, 200]))))
        k, window = [(3, 4), (24, 41), (5, 1), (4, 7)][trial % 4]
        at, hashes = winnowing.fingerprint(text, k, window)
        want, h = kept(text, k, window)
        assert at.tolist() == want and hashes.tolist() == [h[p] for p in want]
        assert len(set(h)) == len({text[i : i + min(k, len(text))] for i in range(len(h))})
        a, b = (winnowing.code_points(t) for t in (text, other))
        seam = winnowing._edited_hashes(a, winnowing.run_hashes(a, k), b, winnowing.run_hashes(b, k), k)
        assert seam.tolist() == kept(winnowing.edited(text, other), k, window)[1]


def test_a_shared_passage_of_guaranteed_length_is_found():
    rng = np.random.default_rng(5)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    for _ in range(50):
        shared = letters(winnowing.K + winnowing.WINDOW - 1)
        a, b = (winnowing.fingerprint(letters(int(rng.integers(0, 200))) + shared + letters(int(rng.integers(0, 200))))[1] for _ in "ab")
        assert np.intersect1d(a, b).size


def follows(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, -(rows[i][0] or 0), i))
    out = []
    for place, i in enumerate(order):
        doc_id, text, following = rows[i][0], rows[i][1] or "", rows[order[(place + 1) % len(rows)]][1] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        prints = [winnowing.fingerprint(t) for t in (text, changed, following)]
        near = [1.0 if not (a := set(prints[0][1].tolist())) | (b := set(p[1].tolist())) else len(a & b) / len(a | b) for p in prints[1:]]
        out.append((doc_id, len(text), H(changed), *[winnowing.written(*p) for p in prints[:2]], *near))
    return out


@pytest.mark.parametrize("size", [16_000_000, 20_000])
def test_fingerprints_equal_brute_force(spark, documents, monkeypatch, size):
    monkeypatch.setattr(winnowing.with_following, "__defaults__", (size,))
    # A third of the rows share an id, so several partitions begin with it.
    docs = documents.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 1, 77).otherwise(F.col("doc_id"))).coalesce(1)
    got = [tuple(r) for r in winnowing.fingerprint_rows(docs).collect()]
    assert table(got) == table(follows([(r.doc_id, r.text) for r in docs.collect()]))
    assert {BIG, BIG + 2, None} <= {r[0] for r in got}


def test_fingerprints_of_no_and_of_one_row(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert winnowing.fingerprint_rows(docs()).collect() == []
    for text in ("abc " * 40, "", None):
        r = winnowing.fingerprint_rows(docs((1, text))).first()
        assert (r.near_next, r.n_chars) == (1.0, len(text or ""))
