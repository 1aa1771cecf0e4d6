"""Merkle manifest of a table by supersteps up and down its trees.

A vertex stands for `span` consecutive nodes of a tree, that is for `steps` levels of runs. In each
superstep up, children message their digests to the vertex that covers their place; a vertex has
then all of them, completes its levels and forwards one digest. The digests of the trees form a tree
of their own. Supersteps down carry sibling paths: a vertex adds to the path it got the siblings that
each child has inside it. Each superstep ends in a stored table, so a lost executor repeats one
superstep at most, and no task holds more than a vertex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.storage import discard, release, stored

FANOUT = 2  # nodes of a run
STEPS = 10  # levels that a vertex completes


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of fields in order: `-` for null, else the UTF-8 byte count, `:` and the value as text."""

    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields]).cast("binary"), 256))


def _hash(nodes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


def _split(cell: bytes) -> list[bytes]:
    """The digests of a cell, as hex text."""
    text = bytes(cell).hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def run_levels(nodes: list[bytes], levels: int, fanout: int = FANOUT) -> list[list[bytes]]:
    """nodes and the levels above them; a last run may be shorter, even a single node, and is hashed all the same."""
    out = [nodes]
    for _ in range(levels):
        out.append([_hash(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def siblings(levels: list[list[bytes]], place: int, fanout: int = FANOUT) -> list[bytes]:
    """The other nodes of each run on the way up from a place, from left to right; levels as run_levels gives them."""
    out = []
    for nodes in levels[:-1]:
        start = place - place % fanout
        out += nodes[start:place] + nodes[place + 1 : start + fanout]
        place //= fanout
    return out


def fold(digest: bytes, place: int, size: int, path: list[bytes], levels: int | None = None, fanout: int = FANOUT) -> tuple[bytes, int]:
    """The digest `levels` levels above a node (at the top if None), from its place among `size` nodes and its path; and how much of path that took."""
    used = 0
    for _ in range(depth(size, fanout) if levels is None else levels):
        before = place % fanout
        others = min(fanout, size - (place - before)) - 1
        digest = _hash([*path[used : used + before], digest, *path[used + before : used + others]])
        used, place, size = used + others, place // fanout, -(-size // fanout)
    return digest, used


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with a column tree) with pos, their place in their tree by `order`, and n, the rows of the tree.

    A range sort and a table of partitions and trees: no tree has to fit in a task.
    """
    sorted_rows = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tree", *order).sortWithinPartitions("tree", *order)
    # The id counts the rows of a partition in order; its upper bits are the partition.
    numbered = stored(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    ends = numbered.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    every = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_rows").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = stored(ends.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(every).alias("n")), "shifts")
    return numbered.join(shifts, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


VERTEX = "tree string, pos long, n long, digest binary, children binary"


def _up(nodes: DataFrame, superstep: int, fanout: int, steps: int, extra: dict[str, str]) -> DataFrame:
    """One superstep: (tree, pos, n, digest) message the vertices that cover them; extra binary columns are gathered as they stand."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        n, children = int(g["n"].iloc[0]), b"".join(map(bytes, g["digest"]))
        levels = min(steps, max(0, depth(n, fanout) - superstep * steps))
        top = run_levels(_split(children), levels, fanout)[-1]
        return pd.DataFrame([(g["tree"].iloc[0], int(g["pos"].iloc[0]) // fanout**steps, n, bytes.fromhex(top[0].decode()), children, *[b"".join(map(bytes, g[c])) for c in extra])])

    vertex = F.expr(f"pos div {fanout**steps}")
    schema = VERTEX + "".join(f", {c} binary" for c in extra)
    return stored(nodes.select("tree", "pos", "n", "digest", *extra).groupBy("tree", vertex).applyInPandas(run, schema), f"vertices-{superstep}")


def _grow(nodes: DataFrame, fanout: int, steps: int, extra: tuple[str, ...] = ()) -> list[DataFrame]:
    """The vertices of every superstep up; those of the last are one for each tree."""
    tallest = nodes.agg(F.max("n")).first()[0]
    supersteps = max(1, -(-depth(tallest, fanout) // steps))
    out = [_up(nodes, 0, fanout, steps, {c: "binary" for c in extra})]
    for s in range(1, supersteps):
        out.append(_up(out[-1], s, fanout, steps, {}))
    return out


def _descend(levels: list[DataFrame], start: DataFrame, fanout: int, steps: int) -> DataFrame:
    """The vertices of the lowest superstep with the path above each; start: tree, path and further columns of whole trees."""
    about = [c for c in start.columns if c not in ("tree", "path")]
    paths = start.withColumn("pos", F.lit(0).cast("long"))
    for s in range(len(levels) - 1, 0, -1):
        vertices = levels[s].select("tree", "pos", "n", "children").join(paths, ["tree", "pos"])

        def run(batches: Iterator[pd.DataFrame], s: int = s) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.to_dict("records"):
                    nodes = run_levels(_split(r["children"]), min(steps, max(0, depth(r["n"], fanout) - s * steps)), fanout)
                    own = [bytes.fromhex(b"".join(siblings(nodes, i, fanout)).decode()) + r["path"] for i in range(len(nodes[0]))]
                    out = pd.DataFrame({"path": own, "pos": r["pos"] * fanout**steps + np.arange(len(own))})
                    yield out.assign(tree=r["tree"], **{c: r[c] for c in about})[["tree", *about, "path", "pos"]]

        kinds = {f.name: f.dataType.simpleString() for f in paths.schema.fields}
        schema = ", ".join(f"{c} {kinds[c]}" for c in ["tree", *about, "path", "pos"])
        paths = stored(vertices.mapInPandas(run, schema), f"paths-{s}")
    return levels[0].join(paths, ["tree", "pos"])


ROWS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, tree string, pos long"


def merkle_rows(rows: DataFrame, proofs: bool = False, fanout: int = FANOUT, steps: int = STEPS) -> DataFrame:
    """A row for each of rows: its leaf, the digest of its tree and of all trees, its proof's digest, and what its claim folds to.

    rows: tree (a name, not null; trees are ordered by it), doc_id, leaf (digest) and claim (the
    digest of what is to be verified). Leaves ascend by doc_id, null first, and then by leaf, so
    equal rows may stand in either order. A tree of one leaf has that leaf as its digest, and one
    tree's digest is the root. proofs adds `proof`, the siblings from the leaf's run up to the root.
    A very long text is one leaf like any other, since only digests travel. An empty table gives no
    rows.
    """
    spark, schema = rows.sparkSession, ROWS + ", proof array<string>" * proofs
    digests = rows.select("tree", F.col("doc_id").cast("long").alias("doc_id"), F.col("leaf").alias("digest"), "claim")
    # Ids travel in binary cells: a column of whole numbers with nulls would reach Python as doubles.
    packed = F.concat(F.when(F.col("doc_id").isNull(), F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("01"))), F.unhex(F.lpad(F.hex(F.coalesce("doc_id", F.lit(0))), 16, "0")))
    base = stored(digests, "leaves")
    nodes = placed(base, "doc_id", "digest").withColumn("ids", packed)
    if base.isEmpty():
        return spark.createDataFrame([], schema)
    levels = _grow(nodes, fanout, steps, ("claim", "ids"))
    discard(base)
    release(spark)
    subroots = placed(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    top = _grow(subroots.withColumn("name", F.col("name").cast("binary")).withColumn("size", F.unhex(F.lpad(F.hex(F.octet_length("name")), 8, "0"))), fanout, steps, ("size", "name"))
    at_top = _descend(top, top[-1].select("tree", F.unhex(F.lit("")).alias("path"), F.col("digest").alias("root")), fanout, steps)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                children = _split(r["children"])
                nodes = run_levels(children, min(steps, depth(r["n"], fanout)), fanout)
                ends = np.cumsum(np.frombuffer(r["size"], ">u4"))
                names = [r["name"][a:z].decode() for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                yield pd.DataFrame(
                    [
                        (name, bytes.fromhex(b"".join(siblings(nodes, i, fanout)).decode()) + r["path"], bytes.fromhex(children[i].decode()), r["pos"] * fanout**steps + i, r["n"], r["root"])
                        for i, name in enumerate(names)
                    ],
                    columns=["tree", "path", "subroot", "rank", "trees", "root"],
                )

    starts = at_top.mapInPandas(named, "tree string, path binary, subroot binary, rank long, trees long, root binary")
    vertices = _descend(levels, stored(starts, "subroots"), fanout, steps)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                yield _verified(r, proofs, fanout, steps)

    return vertices.mapInPandas(verify, schema)


def _verified(r: dict, proofs: bool, fanout: int, steps: int) -> pd.DataFrame:
    """The rows of one vertex of leaves."""
    leaves, claims, above = _split(r["children"]), _split(r["claim"]), _split(r["path"])
    n, levels = r["n"], min(steps, depth(r["n"], fanout))
    nodes, root, subroot = run_levels(leaves, levels, fanout), bytes(r["root"]).hex(), bytes(r["subroot"]).hex()
    joined, tops, out = b"".join(above), {}, []
    ids = np.frombuffer(r["ids"], np.dtype([("known", "u1"), ("id", ">i8")]))
    for i, claim in enumerate(claims):
        path = siblings(nodes, i, fanout)
        # Within the vertex every leaf folds its own siblings; what lies above is the same for all that reach one digest.
        digest, used = fold(claim, i, len(leaves), path, levels, fanout)
        if digest not in tops:
            size, place = n, r["pos"]
            for _ in range(levels):
                size = -(-size // fanout)
            whole, taken = fold(digest, place, size, above, None, fanout)
            tops[digest] = fold(whole, r["rank"], r["trees"], above[taken:], None, fanout)[0].decode()
        proof = hashlib.sha256(b"".join(path) + joined).hexdigest()
        row = (leaves[i].decode(), subroot, root, proof, tops[digest], tops[digest] == root, r["tree"], r["pos"] * fanout**steps + i)
        out.append((*row, [x.decode() for x in path + above]) if proofs else row)
    frame = pd.DataFrame(out, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "tree", "pos"] + ["proof"] * proofs)
    doc_id = pd.array(ids["id"].astype("<i8"), "Int64")
    doc_id[ids["known"] == 0] = pd.NA
    frame.insert(0, "doc_id", doc_id)
    return frame


def manifest_rows(docs: DataFrame) -> DataFrame:
    """The digest columns of op11: trees by lang, null first; where crc32(doc_id) divides by 7 the claim has one more in n_chars.

    A null doc_id has no decimal text and isn't tampered with, and neither is a null n_chars. Other
    columns of docs are not read.
    """
    one_more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    claimed = [one_more if c == "n_chars" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang"))
    rows = docs.select(tree.alias("tree"), "doc_id", leaf_digest(*fields).alias("leaf"), leaf_digest(*claimed).alias("claim"))
    return merkle_rows(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
