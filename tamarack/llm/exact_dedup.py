"""Operator 4: exact duplicates by distributed MSD radix partitioning; texts are compared, never their digests.

1. In every Arrow batch, documents are split by successive byte strings of growing width until a
   group is a singleton or its texts have ended; equal texts of a batch become one *head* row.
   A text that a third of all rows share thus leaves each batch once.
2. Heads are dealt out by radix: a driver loop asks which prefixes more than a share of the heads have
   (a bucket has SHARES of them), lengthens only those, and stops when none is left or all of them have
   ended.  What it collects is a long for a heavy prefix, fewer than there are shares, whatever the prefix's
   length (two prefixes that have the same long only meet in a bucket).  Every head goes to the bucket of its first prefix that
   isn't heavy.
3. A whole text with more than a share of heads is reduced first: its heads are dealt out to as many tasks
   as it has shares, each of which leaves one, and so on until a share is enough.
4. Each bucket comes in the order of its prefixes and is split prefix by prefix, to the end of the texts.

Cases: null texts are empty and equal to empty texts; a null id is below every other, and the kept
row of a group of null ids has keep_id null; of rows that repeat the largest id of a group, exactly
one is kept; a very long text is never split and must fit a worker some ten times over; other columns
play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import store
from tamarack.llm import textkit as tk

FIRST_WIDTH, WIDEST = 8, 1 << 16
BUCKET_BYTES, HELD_BYTES, LEAST_SHARE, SHARES = 32 << 20, 4 << 20, 64, 8


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Places of equal texts, split by successive bytes; each group in the order of the input."""
    done: list[list[int]] = []
    todo = [(list(range(len(texts))), 0, FIRST_WIDTH)] if texts else []
    while todo:
        group, at, width = todo.pop()
        buckets: dict[bytes, list[int]] = {}
        for i in group:
            buckets.setdefault(texts[i][at : at + width], []).append(i)
        for digit, members in buckets.items():
            if len(members) == 1 or len(digit) < width:
                done.append(members)
            else:
                todo.append((members, at + width, min(2 * width, WIDEST)))
    return done


def _top(ids: list, members: list[int]) -> int:
    """The member with the largest id, the first of them; null is the least."""
    return max(members, key=lambda i: (ids[i] is not None, ids[i] or 0, -i))


class Route(NamedTuple):
    """Where rows go: ``key`` is a long of a row's first light prefix; ``hot`` are keys of whole texts with more
    than ``share`` rows, at most ``most``."""

    key: Column
    buckets: int
    share: int
    hot: list[int]
    most: int


def route(df: DataFrame, text: str) -> Route:
    """How to deal ``df`` out so that equal texts meet; see step 2 above."""
    spark = df.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    raw, size = whole.cast("binary"), F.octet_length(whole)
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["b"] or 0) // BUCKET_BYTES))
    share = max(LEAST_SHARE, total["n"] // (SHARES * buckets))
    full = lambda level: FIRST_WIDTH * (2 ** (level + 1) - 1)
    prefix = lambda level: F.xxhash64(F.substring(raw, 1, full(level)))
    chain: list[list[int]] = []
    hot: list[int] = []
    most = 0
    while True:
        seen = df if not chain else df.filter(prefix(len(chain) - 1).isin(chain[-1]))
        counted = seen.groupBy(prefix(len(chain)).alias("p"), (size < full(len(chain))).alias("ended")).agg(F.count(F.lit(1)).alias("n"))
        heavy = counted.filter(F.col("n") > share).collect()
        hot += [r["p"] for r in heavy if r["ended"]]
        most = max([most, *(r["n"] for r in heavy if r["ended"])])
        chain.append([r["p"] for r in heavy if not r["ended"]])
        if not chain[-1]:
            break
    key = prefix(len(chain) - 1)
    for level in reversed(range(len(chain) - 1)):
        key = F.when(~prefix(level).isin(chain[level]), prefix(level)).otherwise(key)
    return Route(key, buckets, share, hot, most)


def _reduced(rows: DataFrame, r: Route, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], stays: Column) -> Iterator[DataFrame]:
    """Step 3 for the ``rows`` of hot texts, one written table a round: what ``run`` makes of each task's rows, of
    which those that stay go on to the next."""
    most = r.most
    while most > r.share:
        salts = -(-most // r.share)
        salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).repartition(r.buckets, r.key, "_salt").drop("_salt")
        made = store.write_table(salted.mapInArrow(tk.tidy(run), rows.schema), "reduced")
        yield made
        rows, most = made.filter(stays), salts


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _together(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows that come in the order of ``key``, some at a time: all rows of a key are in one table."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.flatnonzero(k == k[-1])[0])
        if held and size >= HELD_BYTES and (cut or k[0] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if k[0] == last else held).combine_chunks()
            held, size = ([] if k[0] == last else [batch.slice(0, cut)]), 0
            batch = batch.slice(cut)
        held.append(batch)
        size, last = size + batch.nbytes, k[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    if got := [b for b in batches if b.num_rows]:
        yield pa.Table.from_batches(got).combine_chunks()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    store.ship_package(docs.sparkSession)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
            out: dict[str, list] = {k: [] for k in ("doc_id", "gid", "head", "n", "_text")}
            for members in radix_groups(texts):
                gid, top = next(number), _top(ids, members)
                for i in members:
                    row = (ids[i], gid, i == top, len(members) if i == top else None, texts[i] if i == top else None)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["gid"], pa.int64()), pa.array(out["head"], pa.bool_()), pa.array(out["n"], pa.int64()), pa.array(out["_text"], pa.binary()).cast(pa.string())],
                names=list(out),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = store.write_table(rows.mapInArrow(tk.tidy(local), "doc_id long, gid long, head boolean, n long, _text string"), "heads")

    def top_of(ids: list, gids: list, members: list[int]) -> int:
        return max(members, key=lambda i: (ids[i] is not None, ids[i] or 0, -gids[i]))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Heads as they are but for n and up: the head that stands for each; a text only where a head stays."""
        for t in _gathered(batches):
            ids, gids, n, texts = (t[c].to_pylist() for c in ("doc_id", "gid", "n", "_text"))
            up, kept = list(gids), list(texts)
            for members in radix_groups(_texts(t["_text"])):
                top = top_of(ids, gids, members)
                n[top] = sum(n[i] for i in members)
                for i in members:
                    up[i], kept[i] = gids[top], texts[i] if i == top else None
            yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), t["gid"].combine_chunks(), pa.array(n, pa.int64()), pa.array(up, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "gid", "n", "up", "_text"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _together(batches, "_key"):
            ids, gids, n, texts = (t["doc_id"].to_pylist(), t["gid"].to_pylist(), t["n"].to_pylist(), _texts(t["_text"]))
            out: dict[str, list] = {k: [] for k in ("gid", "keep_id", "keep_gid", "group_size", "text_sha256")}
            for members in radix_groups(texts):
                top = top_of(ids, gids, members)
                row = (ids[top], gids[top], sum(n[i] for i in members), hashlib.sha256(texts[top]).hexdigest())
                for i in members:
                    out["gid"].append(gids[i])
                    for k, v in zip(("keep_id", "keep_gid", "group_size", "text_sha256"), row, strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if k == "text_sha256" else pa.int64()) for k, v in out.items()], names=list(out))

    heads = table.filter("head").select("doc_id", "gid", "n", F.col("gid").alias("up"), "_text")
    r = route(heads, "_text")
    rounds = []
    if r.hot:
        rounds = list(_reduced(heads.filter(r.key.isin(r.hot)), r, reduce, F.col("_text").isNotNull()))
        heads = heads.filter(~r.key.isin(r.hot)).union(rounds[-1].filter("_text is not null"))
    dealt = heads.select("doc_id", "gid", "n", "_text", r.key.alias("_key")).repartition(r.buckets, "_key").sortWithinPartitions("_key")
    groups = dealt.mapInArrow(tk.tidy(whole), "gid long, keep_id long, keep_gid long, group_size long, text_sha256 string")
    if rounds:
        groups = store.write_table(groups, "groups")
        for made in reversed(rounds):
            joined = made.filter("_text is null").select(F.col("gid").alias("was"), F.col("up").alias("gid")).join(groups, "gid")
            groups = groups.union(joined.select(F.col("was").alias("gid"), "keep_id", "keep_gid", "group_size", "text_sha256"))
    kept = F.col("head") & (F.col("gid") == F.col("keep_gid"))
    return table.select("doc_id", "gid", "head").join(groups, "gid").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    store.ship_package(docs.sparkSession)
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    own = [f"_c{k}" for k in range(len(docs.columns))]

    def stay(t: pa.RecordBatch | pa.Table) -> pa.RecordBatch | pa.Table:
        ids = t.column(at_id).to_pylist()
        return t.take(pa.array(sorted(_top(ids, g) for g in radix_groups(_texts(t.column(at_text)))), pa.int64()))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(stay, batches)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _gathered(batches):
            yield from stay(t).to_batches()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _together(batches, "_key"):
            yield from stay(t).select(own).to_batches()

    rows = docs.toDF(*own)
    heads = store.write_table(rows.mapInArrow(tk.tidy(local), rows.schema), "heads")
    r = route(heads, own[at_text])
    if r.hot:
        hot = heads.filter(r.key.isin(r.hot))
        for made in _reduced(hot, r, reduce, F.lit(True)):
            hot = made
        heads = heads.filter(~r.key.isin(r.hot)).union(hot)
    dealt = heads.withColumn("_key", r.key).repartition(r.buckets, "_key").sortWithinPartitions("_key")
    return dealt.mapInArrow(tk.tidy(whole), T.StructType([heads.schema[c] for c in own])).toDF(*docs.columns)
