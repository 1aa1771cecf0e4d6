"""N-gram Jaccard join by grouped prefixes.

Shingles are ordered by document frequency, rarest first. Two sets that are similar enough share a
shingle within their prefixes, and a shingle of one document only cannot be shared, so most
documents end with a prefix of such shingles alone. Of the others, equal sets become one class, and
classes with identical prefixes and sizes one group. Groups first offer their classes to hubs, which
joins families of copies with one comparison each; then every pair of groups that still lies in two
components is filtered by size and shared prefix, expanded into its classes, and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwave.llm.blocks import distinct, mix, put, put_sorted, runs, take, take_sorted, text_blocks, text_words, trim
from siftwave.llm.storage import discard, release, shards, stored

OFFERS = 4  # hubs that a group is compared with in each round before all remaining pairs are
BLOCK = 4_000_000  # bytes of text in a block, unless one text is longer
SHARD = 12_000_000  # bytes of text for each range of shingles
SPLIT = 256  # groups that share a shingle from which its pairs are dealt over several tasks
OFTEN = 16  # documents of a block from which a shingle's list stays with the block


def shingle_hashes(texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (64-bit hash, text) pairs in order of hash, and each text's number of shingles."""
    ids, _, hashes, sizes = text_words(texts)
    h = mix(hashes)[ids] if len(ids) else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    out, of = [], []
    with np.errstate(over="ignore"):
        if len(h) >= width:
            rolled = np.zeros(len(h) - width + 1, np.uint64)
            for k in range(width):
                rolled = mix(rolled + h[k : len(h) - width + 1 + k])
            whole = text[: len(rolled)] == text[width - 1 :]
            out.append(rolled[whole])
            of.append(text[: len(rolled)][whole])
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero((sizes > 0) & (sizes < width)):
            x = np.array([sizes[i]], np.uint64)
            for k in range(sizes[i]):
                x = mix(x + h[starts[i] + k])
            out.append(x)
            of.append(np.array([i]))
    h, text = (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(h, kind="stable")
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], text[new], np.bincount(text[new], minlength=len(sizes))


LISTS = "shard int, block long, token binary, count binary, doc binary, ids binary, no_id binary, sizes binary, often binary, often_count binary, often_doc binary"


def _lists(docs: DataFrame, width: int, total: int) -> DataFrame:
    """Each block's inverted lists, by range of shingles; a block's frequent lists travel in one extra cell of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId() << 16
        for number, b in enumerate(text_blocks(batches, "text", BLOCK)):
            token, doc, sizes = shingle_hashes(b["text"], width)
            at = runs(token)
            count = np.diff(np.append(at, len(token)))
            often = count >= OFTEN
            listed = np.repeat(~often, count)
            shard = ((token[at] >> np.uint64(32)) * np.uint64(total) >> np.uint64(32)).astype(np.int64)
            cuts = np.append(runs(shard), len(shard))
            before = np.append(0, np.cumsum(np.where(often, 0, count)))
            light = doc[listed]
            block = task + number
            home = block % total
            about = (put(b["doc_id"], "<i8"), put(b["no_id"], "u1"), put(sizes, "<u4"), put(token[at][often], "<u8"), put(count[often], "<u4"), put(doc[~listed], "<u4"))
            rows = [(home, block, None, None, None, *about)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((int(shard[a]), block, put_sorted(token[at][a:z]), put(count[a:z], "<u4"), put(light[before[a] : before[z]], "<u4"), *[None] * 6))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in LISTS.split(", ")])
        trim()

    return docs.mapInPandas(run, LISTS)


SHARED = "block long, token binary, count binary, df binary, doc binary, lonely binary, ids binary, no_id binary, sizes binary, often binary, often_count binary, often_doc binary"


def _shared(lists: DataFrame) -> DataFrame:
    """Of every block and shard: the shingles that other documents have too, and how many of each document's nobody shares."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        cells = g[g["token"].notna()]
        tokens, counts = [take_sorted(x) for x in cells["token"]], [take(x, "<u4").astype(np.int64) for x in cells["count"]]
        trim()  # what the group before has left
        rows = [(r.block, *[None] * 5, r.ids, r.no_id, r.sizes, r.often, r.often_count, r.often_doc) for r in g[g["ids"].notna()].itertuples()]
        if tokens:
            known = distinct(np.concatenate(tokens))
            df = np.zeros(len(known), np.int64)
            for token, count in zip(tokens, counts, strict=True):
                df[np.searchsorted(known, token)] += count  # a cell names each shingle once
            for r, token, count in zip(cells.itertuples(), tokens, counts, strict=True):
                mine, doc = df[np.searchsorted(known, token)], take(r.doc, "<u4")
                held = np.where(count >= OFTEN, 0, count)
                many = mine > 1
                keep = np.repeat(many, held)
                lonely = np.bincount(doc[~keep]) if (~keep).any() else np.zeros(0)
                rows.append((r.block, put_sorted(token[many]), put(count[many], "<u4"), put(mine[many], "<u4"), put(doc[keep], "<u4"), put(lonely, "<u4"), *[None] * 6))
        return pd.DataFrame(rows, columns=[f.split()[0] for f in SHARED.split(", ")])

    return lists.groupBy("shard").applyInPandas(run, SHARED)


DOCS = "doc_id long, rid long, n long, span long, prefix array<long>, tokens binary, class string"


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _documents(shared: DataFrame, percent: int) -> DataFrame:
    """A row per document; prefix, tokens and class only where a partner is possible.

    prefix: its shared shingles within the first prefix_length; span: that length; tokens: all its
    shared shingles; class: equal for equal sets.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        trim()
        about = g[g["ids"].notna()].iloc[0]
        ids, n = take(about["ids"], "<i8"), take(about["sizes"], "<u4").astype(np.int64)
        lonely = np.zeros(len(ids), np.int64)
        tokens, dfs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        often, often_count, often_doc = take(about["often"], "<u8"), take(about["often_count"], "<u4"), take(about["often_doc"], "<u4")
        starts = np.append(0, np.cumsum(often_count)).astype(np.int64)
        for r in g[g["token"].notna()].itertuples():
            token, count, df, doc = take_sorted(r.token), take(r.count, "<u4").astype(np.int64), take(r.df, "<u4").astype(np.int64), take(r.doc, "<u4")
            some = take(r.lonely, "<u4")
            lonely[: len(some)] += some
            own = count >= OFTEN
            if own.any():
                at = np.searchsorted(often, token[own])
                sizes = often_count[at].astype(np.int64)
                index = np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                tokens.append(np.repeat(token[own], sizes))
                dfs.append(np.repeat(df[own], sizes))
                docs.append(often_doc[index].astype(np.int64))
            tokens.append(np.repeat(token[~own], count[~own]))
            dfs.append(np.repeat(df[~own], count[~own]))
            docs.append(doc.astype(np.int64))
        token, df, doc = np.concatenate(tokens), np.concatenate(dfs), np.concatenate(docs)
        span = prefix_length(n, percent)
        alive = (n > 0) & (lonely < span)
        keep = alive[doc]
        token, df, doc = token[keep], df[keep], doc[keep]
        order = np.lexsort((token, df, doc))
        token, doc = token[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        rid = (np.int64(about["block"]) << 20) + np.arange(len(ids))
        prefix, cells, classes = [None] * len(ids), [None] * len(ids), [None] * len(ids)
        for i in np.flatnonzero(alive):
            mine = token[cuts[i] : cuts[i + 1]]
            prefix[i] = mine[: span[i] - lonely[i]].astype(np.int64)
            cells[i] = put_sorted(np.sort(mine))
            classes[i] = f"{n[i]} {mix(mine).sum(dtype=np.uint64)} {np.bitwise_xor.reduce(mix(mine + np.uint64(1)))}" if not lonely[i] else f"{rid[i]}"
        doc_id = pd.array(ids, "Int64")
        doc_id[take(about["no_id"], "u1").astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "rid": rid, "n": n, "span": span, "prefix": prefix, "tokens": cells, "class": classes})

    return shared.groupBy("block").applyInPandas(run, DOCS)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rids whose sets are similar enough.

    `sets` is a stored table read as it is, so that a join by a hub of many pairs can be split at run time.
    """
    left = pairs.join(sets.select(F.col("rid").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a")), "a")
    both = left.join(sets.select(F.col("rid").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            common = np.fromiter((len(np.intersect1d(take_sorted(x), take_sorted(y), assume_unique=True)) for x, y in zip(g["t_a"], g["t_b"], strict=True)), np.int64, len(g))
            yield g.loc[100 * common >= percent * (g["n_a"] + g["n_b"] - common), ["a", "b"]]
        trim()

    return both.select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInPandas(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows hooks twice, and keeps the edges
    between what remains; star-shaped families are gone after one round.
    """
    spark = edges.sparkSession
    left = stored(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while left.take(1):
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(ends.groupBy("a").agg(F.min("b").alias("h")).select(F.col("a").alias("node"), F.least("a", "h").alias("up")), "hooks")
        for _ in range(2):
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            before, hooks = hooks, stored(hooks.join(above, "up").select("node", F.col("higher").alias("up")), "hooks")
            discard(before)
        if labels is None:
            labels = stored(hooks.select("node", F.col("up").alias("component")), "labels")
        else:
            up = hooks.select(F.col("node").alias("component"), F.col("up"))
            before, labels = labels, stored(labels.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
            discard(before)
        a, b = (hooks.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in "ab")
        before, left = left, stored(left.join(a, "a").join(b, "b").where("up_a != up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
        discard(before, hooks)
    discard(left)
    return spark.createDataFrame([], "node long, component long") if labels is None else labels


def _close(left: str, right: str, percent: int):
    """Whether two sizes allow the wanted similarity."""
    return F.expr(f"100 * least({left}, {right}) >= {percent} * greatest({left}, {right})")


def join_similar(docs: DataFrame, width: int = 5, percent: int = 75, hubs: int = 2) -> DataFrame:
    """One row per document: doc_id, rid (unique), n_shingles, class (its set, where a partner is possible) and component.

    docs: doc_id and text. A document's set is its distinct `width`-word shingles, or its whole word
    sequence as one shingle if it is shorter; null texts and those without words have empty sets and
    no links. Documents link when 100 * intersection >= percent * union; equal sets always do.
    Shingles are compared by 64-bit hashes, and whole sets are equal if their sizes and two 64-bit
    digests over all shingles are. `component` is the smallest doc_id reachable by links. A null
    doc_id takes part but is no component's name unless all its members are null. Very long texts are
    taken whole, ties and repeated rows need no special case, other columns of docs are not read, and
    an empty table gives no rows.
    """
    key = F.col("doc_id").cast("long")
    # In pandas a column of ids with a null would be one of doubles.
    docs = docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("no_id"), F.col("text").cast("string").alias("text"))
    total = shards(docs, size=SHARD)
    table = stored(_documents(_shared(_lists(docs, width, total)), percent), "shingle-sets")
    release(docs.sparkSession)
    alive = table.where(F.col("class").isNotNull())
    classes = alive.groupBy("class").agg(F.min("rid").alias("rep"))
    sets = alive.join(classes.select(F.col("rep").alias("rid")), "rid").select(F.col("rid").alias("rep"), "n", "span", "prefix", F.md5(F.concat_ws(" ", "n", "prefix")).alias("key"))
    grouped = sets.groupBy("key").agg(F.min("rep").alias("g")).join(sets.select("key", "rep", "n", "span", "prefix"), "key")
    members = stored(grouped.select("g", "rep", "n", "span", F.when(F.col("g") == F.col("rep"), F.col("prefix")).alias("prefix")), "groups")
    postings = members.where("g = rep").select(F.explode("prefix").alias("token"), "g", "n", "span", (F.col("span") - F.size("prefix")).alias("lonely"))
    # What many rows of one token, component or class are joined with is stored first: Spark splits a join between plain tables.
    repeated = stored(postings.groupBy("token").count().where("count > 1").select("token"), "repeated")
    postings = stored(postings.join(repeated, "token", "left_semi"), "postings")
    discard(repeated)

    links, labels = stored(_verify(members.where("g != rep").select(F.col("rep").alias("a"), F.col("g").alias("b")), alive, percent), "links"), None
    release(docs.sparkSession)
    for r in range(hubs):
        labels = connected(links) if r else None
        placed = _placed(postings.select("token", F.col("g").alias("node"), "n", "lonely"), labels)
        # First the groups with the least of their own, as an original has; later members of large components.
        rank = F.struct(F.col("lonely") / F.col("n"), F.xxhash64("node"))
        if r:
            sizes = stored(labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
            placed = placed.join(sizes, "component", "left")
            rank = F.struct(-F.coalesce("size", F.lit(1)), F.xxhash64("node", "token", F.lit(r)))
        hub = placed.groupBy("token").agg(F.min_by(F.struct("node", "n", "component"), rank).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        hub = stored(hub.where("low != high").select("token", "hub"), "hubs")
        offers = placed.join(hub, "token").where("component != hub.component").where(_close("n", "hub.n", percent))
        rivals = Window.partitionBy("node").orderBy(F.desc("count"), F.xxhash64("b"))
        best = offers.groupBy("node", F.col("hub.node").alias("b")).count().withColumn("r", F.row_number().over(rivals)).where(F.col("r") <= OFFERS)
        before, links = links, stored(links.unionByName(_verify(best.select(F.col("node").alias("a"), "b"), alive, percent)), "links")
        discard(before, hub)
        release(docs.sparkSession)

    labels = connected(links)
    inside = stored(_placed(members.select("g", F.col("rep").alias("node")), labels), "inside")
    # A group's classes may lie in several components; each of these is compared.
    placed = postings.select("token", F.col("g").alias("node"), "n", "span").join(inside.select(F.col("g").alias("node"), "component").distinct(), "node")
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"))
    mixed = stored(mixed.where("low != high").select("token", "parts"), "mixed")
    placed = placed.join(mixed, "token")
    placed = placed.join(members.where("g = rep").select(F.col("g").alias("node"), "prefix"), "node")
    # A shingle of many groups is dealt over tasks: one side of its pairs by group, the other in full to each part.
    deal = {"a": F.pmod(F.xxhash64("node"), "parts").cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}
    one, two = (placed.select("token", deal[x].alias("part"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "span", "component", "prefix")]) for x in "ab")
    shared = F.array_intersect("prefix_a", "prefix_b")
    # A pair comes up once, at its smallest common shingle. What can be common beyond the prefixes,
    # against what must be, leaves few pairs; both are conditions of the join itself.
    able = F.expr(f"(greatest(n_a - span_a, n_b - span_b) + size(array_intersect(prefix_a, prefix_b))) * {100 + percent} >= {percent} * (n_a + n_b)")
    near = one.join(two, ["token", "part"]).where("node_a < node_b and component_a != component_b").where(_close("n_a", "n_b", percent)).where(F.array_min(shared) == F.col("token")).where(able)
    within = members.groupBy("g").count().where("count > 1").select(F.col("g").alias("node_a"), F.col("g").alias("node_b"))
    a, b = (inside.select(F.col("g").alias(f"node_{x}"), F.col("node").alias(x), F.col("component").alias(f"at_{x}")) for x in "ab")
    pairs = near.select("node_a", "node_b").distinct().unionByName(within).join(a, "node_a").join(b, "node_b").where("at_a != at_b and (node_a < node_b or a < b)").select("a", "b")
    links = stored(links.unionByName(_verify(pairs, alive, percent)), "links")
    release(docs.sparkSession)

    final = connected(links)
    named = stored(_placed(alive.groupBy("class").agg(F.min("doc_id").alias("low"), F.min("rid").alias("node")), final), "named")
    lowest = stored(named.groupBy("component").agg(F.min("low").alias("name")), "lowest")
    by_class = stored(named.select("class", "component").join(lowest, "component").select("class", "name"), "names")
    discard(named, lowest)
    rows = ("doc_id", "rid", F.col("n").alias("n_shingles"), "class")
    alone = table.where("class is null").select(*rows, F.col("doc_id").alias("component"))
    return alone.unionByName(alive.join(by_class, "class").select(*rows, F.col("name").alias("component")))


def _placed(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """nodes with the component that each lies in, itself where no link is known."""
    if labels is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The digest columns of op7."""
    return join_similar(docs).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
