"""Operator 7: near-duplicates by min-max hashing.

A document's set has its distinct shingles of five words (fewer words: all of them as one).  Each of
PERMUTATIONS hash functions is evaluated once per shingle and gives two signature values, the set's
minimum and maximum; ROWS minima, or ROWS maxima, of different functions make a band.  With 64
functions that is 32 bands of 4: a pair of similarity 0.75 shares none with probability 5e-6.

Documents with equal sets, known by 128 bits of hashes, are one node from the start.  In each bucket of a band, every node is
compared, on whole sets, with the bucket's smallest and largest node, then for some rounds with the node
of the bucket that has the most links so far.  Buckets whose nodes are then in one component are done.
What is left is an exact prefix-filtered join: nodes of open buckets in different components are compared
if a shingle that is rare among these nodes stands early enough in both sets; all others can't be linked.
How early depends on both sizes, so shingles that many nodes have are joined by class of size as well, each
only as far as that class allows: a family of texts that resemble each other a little too little makes no pairs.
So every pair that shares a band is linked, ruled out or already connected, and a large group of near
copies costs a few comparisons for each copy, not all pairs.  Links are exact: 100 * common >= 75 * union.

Cases: null texts and texts without words have an empty set and stay alone; equal ids, null ids and
repeated rows are rows of their own (rows are numbered once if ids aren't unique); component_id is the
smallest id, null if all are; of rows that tie for it one is the keeper; other columns play no part and
may have any name; a very long text is one block and must fit a worker some forty times over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.llm import store
from tamarack.llm import textkit as tk
from tamarack.llm.components import components

WORDS, PERMUTATIONS, ROWS, PERCENT = 5, 64, 4, 75
HUB_ROUNDS = 2
#: Shingles that more open nodes have are joined by classes of size, each this much wider than the one before.
FEW_HOLDERS, CLASS = 64, 1.02
_A = (tk.randoms(PERMUTATIONS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (tk.randoms(PERMUTATIONS, 22) >> np.uint64(32)).astype(np.uint32)
_BAND = tk.randoms(2 * PERMUTATIONS // ROWS, 23)
_FOLDS = tk.randoms(2, 24) | np.uint64(1)
_FOLD = _FOLDS[0]


def sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all documents of a block, and where each document's begin."""
    _, _, _, h, at = tk.words(data, offs, tk.NONSPACE)
    n = np.diff(at)
    own = tk.owner(at, len(h))
    inside = np.arange(len(h)) + WORDS <= at[1:][own]
    full = tk.shingles(h, WORDS)
    for k in range(1, WORDS):
        first = at[:-1][n == k]
        full[first] = tk.shingles(h, k)[first] if len(first) else 0
        inside[first] = True
    x, own = full[inside], own[inside]
    begin = np.searchsorted(own, np.arange(len(offs)))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (own[1:] != own[:-1])
    return x[new], np.searchsorted(own[new], np.arange(len(offs)))


def names(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each non-empty set, from sums of different functions of its shingles."""
    n = np.diff(np.append(begin, len(x))).astype(np.uint64)
    return tuple(tk.mix(np.add.reduceat(tk.mix(x ^ fold), begin) * fold + n) for fold in _FOLDS)


def bands(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Band keys of each non-empty set; x: shingles of all, begin: where each set begins."""
    short = (x >> np.uint64(32)).astype(np.uint32)
    out = np.repeat(_BAND[:, None], len(begin), 1)
    half = PERMUTATIONS // ROWS
    for k in range(PERMUTATIONS):
        v = short * _A[k] + _B[k]
        out[k // ROWS] = tk.mix(out[k // ROWS] * _FOLD + np.minimum.reduceat(v, begin))
        out[half + k // ROWS] = tk.mix(out[half + k // ROWS] * _FOLD + np.maximum.reduceat(v, begin))
    return out.T


def _signed(docs: DataFrame) -> DataFrame:
    """(_rid, doc_id, n, node, bands), written; node and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(2)):
                x, at = sets(data, offs)
                n = np.diff(at)
                some = np.flatnonzero(n)
                node, other, keys = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64), np.zeros((hi - lo, len(_BAND)), np.uint64)
                if len(some):
                    (node[some], other[some]), keys[some] = names(x, at[some]), bands(x, at[some])
                empty = n == 0
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(empty, 0, len(_BAND)))]), pa.int32()), pa.array(keys[~empty].ravel().view(np.int64)))
                columns = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), *(pa.array(k.view(np.int64), mask=empty) for k in (node, other)), listed]
                yield pa.RecordBatch.from_arrays(columns, names=["_rid", "doc_id", "n", "node", "other", "bands"])

    rows = docs.select("_rid", "doc_id", F.col("text").cast("string").alias("text"))
    signed = store.write_table(rows.mapInArrow(tk.tidy(run), "_rid long, doc_id long, n long, node long, other long, bands array<long>"), "signatures")
    return _apart(signed)


def _apart(signed: DataFrame) -> DataFrame:
    """``signed`` without the second name, and different sets that share the first one under different names."""
    shared = signed.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).filter("node is not null and lo != hi").select("node", "lo")
    if not shared.take(1):
        return signed.drop("other")
    shared = store.write_table(shared, "shared")  # different sets under one name: all but one get a new one
    renamed = signed.join(store.broadcast_if_small(shared, shared.count(), 24), "node", "left")
    node = F.when(F.col("other") != F.col("lo"), F.xxhash64("node", "other")).otherwise(F.col("node"))
    return store.write_table(renamed.select("_rid", "doc_id", "n", node.alias("node"), "bands"), "signatures")


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that ``wanted`` (_rid, node) names, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(1)):
                x, at = sets(data, offs)
                listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), listed], names=["node", "shingles"])

    few = store.broadcast_if_small(wanted, wanted.count(), 32)
    rows = docs.join(few, "_rid").select("node", F.col("text").cast("string").alias("text"))
    return store.write_table(rows.mapInArrow(tk.tidy(run), "node long, shingles array<long>"), "sets")


def _compare(pairs: DataFrame, whole: DataFrame, name: str) -> DataFrame:
    """(a, b, distance, linked) of pairs of nodes, on their whole sets, written."""
    one, two = (whole.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    common, size = F.size(F.array_intersect("sa", "sb")).cast("long"), (F.size("sa") + F.size("sb")).cast("long")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("common"), size.alias("size"))
    union = F.col("size") - F.col("common")
    return store.write_table(both.select("a", "b", (1 - F.col("common") / union).alias("distance"), (100 * F.col("common") >= PERCENT * union).alias("linked")), name)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_key(rows: DataFrame, keyed: DataFrame, name: str) -> DataFrame:
    """``rows`` joined on key with one row a key, which is written first: a small table is broadcast, and beside a
    large one a key that many rows have can be split, as neither side is then made in the stage that joins."""
    table = store.write_table(keyed, name)
    return rows.join(store.broadcast_if_small(table, table.count(), 40), "key")


def _open(places: DataFrame, root: DataFrame) -> DataFrame:
    """(key, node, n, label) of the buckets whose nodes are in more than one component, written."""
    labelled = places.select("key", "node", "n").join(root, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("label"))
    table = store.write_table(labelled, "labels")
    keys = table.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("key")
    return store.write_table(_by_key(table, keys, "keys"), "open")


def _hubs(places: DataFrame, links: DataFrame) -> DataFrame:
    """(key, hub, hub_label): each bucket's node with the most links so far."""
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    best = places.join(degree, "node", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("d", F.lit(0)).alias("d"), "node", "label")).alias("m"))
    return best.select("key", F.col("m.node").alias("hub"), F.col("m.label").alias("hub_label"))


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(CLASS))).cast("int")


def _rest(places: DataFrame, whole: DataFrame, checked: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of open buckets in different components that may be linked, by prefixes of their sets.

    Shingles are put in the order of how many open nodes have them, rarest first.  Two sets with enough in common
    for a link must meet in a shingle that stands early in both: at most (size - needed common part + 1)-th."""
    open_ = places.groupBy("node").agg(F.first("n").alias("n"), F.first("label").alias("label"))
    own = whole.join(open_, "node").select("node", "n", "label", F.explode("shingles").alias("s"))
    often = store.write_table(own.groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1"), "often")
    ranked = own.join(often, "s").groupBy("node", "n", "label").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("order"))
    # shingles that no other node has come first of all; they take up places but meet nothing
    alone = F.col("n") - F.size("order")
    first = F.slice("order", 1, F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - alone).cast("int"))
    early = ranked.select("node", "n", "label", alone.alias("alone"), F.posexplode(first).alias("k", "x"))
    early = store.write_table(early.select("node", "n", "label", (F.col("alone") + F.col("k") + 1).alias("at"), "x.s", "x.f"), "early")

    n, m = F.col("n"), F.col("x_n")
    needed = lambda size: F.ceil((n + size) * PERCENT / (100 + PERCENT))
    may = (F.col("x_node") < F.col("node")) & (F.col("x_label") != F.col("label")) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))
    may = may & (F.col("at") <= n - needed(m) + 1) & (F.col("x_at") <= m - needed(m) + 1)
    columns = ("node", "n", "label", "at")
    other = lambda df, *keys: df.select(*[F.col(c).alias(f"x_{c}") for c in columns], *keys)
    rare = early.filter(F.col("f") <= FEW_HOLDERS)
    pairs = rare.join(other(rare, "s"), "s").filter(may).select("x_node", "node")

    mine = early.filter(F.col("f") > FEW_HOLDERS).withColumn("own", _class(n))
    classes = F.sequence(_class(F.ceil(n * PERCENT / 100)) - 1, _class(n * 100 / PERCENT) + 1)
    least = F.greatest(F.lit(1), F.floor(F.pow(F.lit(CLASS), F.col("its"))) - 1)  # no size of the class is smaller
    mine = mine.withColumn("its", F.explode(classes)).filter(F.col("at") <= n - needed(least) + 1)
    mine = store.write_table(mine.select(*columns, "s", "own", "its"), "classes")
    met = mine.join(other(mine, "s", F.col("own").alias("its"), F.col("its").alias("own")), ["s", "own", "its"]).filter(may)
    pairs = pairs.union(met.select("x_node", "node")).toDF("a", "b")
    return _ordered(pairs).join(checked.select("a", "b"), ["a", "b"], "left_anti")


def clusters(docs: DataFrame) -> DataFrame:
    """(_rid, doc_id, n_shingles, component_id, keeper) of every row; ``docs`` has _rid, doc_id and text."""
    store.ship_package(docs.sparkSession)
    signed = _signed(docs)
    first = F.min(F.struct("_rid", "n", "bands")).alias("m")
    each = store.write_table(signed.filter("node is not null").groupBy("node").agg(first).select("node", "m.*"), "nodes")
    keyed = each.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo != hi")
    members = store.write_table(_by_key(keyed, shared, "buckets"), "members")
    whole = _sets_of(docs, store.write_table(each.select("_rid", "node").join(members.select("node").distinct(), "node", "left_semi"), "wanted"))
    ends = members.select(F.col("node").alias("a"), F.col("lo").alias("b")).union(members.select("node", "hi")).filter("a != b")
    checked = _compare(_ordered(ends), whole, "ends")
    links = checked.filter("linked").select("a", "b")
    root = components(links)
    places = _open(members, root)
    for _ in range(HUB_ROUNDS):
        more = _by_key(places, _hubs(places, links), "hubs").filter("label != hub_label").select(F.col("node").alias("a"), F.col("hub").alias("b"))
        more = _ordered(more).join(checked.select("a", "b"), ["a", "b"], "left_anti")
        met = _compare(more, whole, "hubs")
        checked = checked.union(met)
        if not met.filter("linked").take(1):
            break
        links = checked.filter("linked").select("a", "b")
        root = components(links)
        places = _open(places, root)
    rest = _compare(_rest(places, whole, checked), whole, "rest").filter("linked").select("a", "b")
    if rest.take(1):
        root = components(links.union(rest))

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_rid")
    own = signed.filter("node is not null").groupBy("node").agg(F.min(order).alias("best"))
    own = own.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of_root = store.write_table(own.groupBy("root").agg(F.min("best").alias("best")), "roots")  # so that a large component can be split
    final = store.write_table(own.select("node", "root").join(of_root, "root").select("node", F.col("best.doc_id").alias("c"), F.col("best._rid").alias("keep")), "final")
    alone = F.col("node").isNull()
    out = signed.select("_rid", "doc_id", "n", "node").join(final, "node", "left")
    return out.select("_rid", "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("c")).alias("component_id"), (alone | (F.col("keep") == F.col("_rid"))).alias("keeper"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    rows = store.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    return clusters(rows).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, all columns as they are."""
    own = [c if c in ("doc_id", "text") else f"_c{k}" for k, c in enumerate(docs.columns)]
    rows = store.with_row_key(docs.toDF(*own), "doc_id")
    going = store.write_table(clusters(rows).filter(~F.col("keeper")).select("_rid"), "going")
    few = store.broadcast_if_small(going, going.count(), 24)
    return rows.join(few, "_rid", "left_anti").select(*own).toDF(*docs.columns)
