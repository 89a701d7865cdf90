"""Operator 2 for benchmarks too large to be an index in every worker: the same prefix-filtered join, shuffled.

Windows are rows, keyed by their words, which are compared as they are.  Two passes over the documents
send only tokens that a bit table of bounded size lets through: the first counts them, which gives each
window its rarest token, the second looks these up and sends the words around every place with them.
A window of which some token
doesn't occur is given up before the second pass; the others are looked up only where their rarest token stands.

Cases are those of ``decontam``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import store
from tamarack.llm import textkit as tk

#: The bit table takes 2**FILTER_BITS / 8 bytes; with more tokens than bits more rows are shuffled, and the join turns them away.
FILTER_BITS = 27


class Joined:
    """The words of a block with one space after each."""

    def __init__(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        self.at = np.concatenate([[0], np.cumsum(e - s + 1)])
        self.text = np.full(self.at[-1], 32, np.uint8)
        inside = np.ones(len(self.text), bool)
        inside[self.at[1:] - 1] = False
        self.text[inside] = low[tk.ALNUM[low]]

    def cut(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        """Words lo to hi - 1, joined by spaces."""
        size = self.at[hi] - 1 - self.at[lo]
        offs = np.concatenate([[0], np.cumsum(size)])
        data = self.text[np.repeat(self.at[lo] - offs[:-1], size) + np.arange(offs[-1])]
        return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def windows(benchmark: DataFrame, window: int, token_words: int) -> DataFrame:
    """item_id, words, n (words in the window), k (words in a token), tokens; a row for each distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(1)):
                low, s, e, h, at = tk.words(data, offs, tk.ALNUM)
                n = np.diff(at)
                many = np.where(n > 0, np.maximum(1, n - window + 1), 0)
                item = np.repeat(np.arange(hi - lo), many)
                first, length = at[item] + _within(many), np.minimum(window, n[item])
                k = np.minimum(length, token_words)
                each = length - k + 1
                place = np.repeat(first, each) + _within(each)
                of, token = np.repeat(k, each), np.zeros(len(place), np.uint64)
                for size in np.unique(k):
                    token[of == size] = tk.shingles(h, int(size))[place[of == size]]
                tokens = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(each)]).astype(np.int32), pa.array(token.view(np.int64)))
                columns = [batch.column(0).slice(lo, hi - lo).take(pa.array(item)), Joined(low, s, e).cut(first, first + length), pa.array(length, pa.int32()), pa.array(k, pa.int32()), tokens]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "words", "n", "k", "tokens"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(tk.tidy(run), "item_id string, words string, n int, k int, tokens array<long>").dropDuplicates(["item_id", "words"])


def _bits(tokens: DataFrame) -> Broadcast:
    """A bit for the first FILTER_BITS bits of every token: at most 2**FILTER_BITS / 64 rows come to the driver."""
    slot = f"shiftrightunsigned(token, {64 - FILTER_BITS})"
    rows = tokens.groupBy(F.expr(f"shiftright({slot}, 6)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return tokens.sparkSession.sparkContext.broadcast(table)


def _places(table: np.ndarray, h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens of k words that the table lets through stand within a document, and these tokens."""
    token = tk.shingles(h, k)
    slot = token >> np.uint64(65 - (len(table) * 64).bit_length())
    place = np.flatnonzero(table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
    place = place[place + k <= np.repeat(at[1:], np.diff(at))[place]]
    return place, token[place]


def _counted(texts: DataFrame, bits: Broadcast, sizes: list[int]) -> DataFrame:
    """token, often: how often each token that the table lets through stands in the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in tk.blocks(batch.column(0)):
                _, _, _, h, at = tk.words(data, offs, tk.ALNUM)
                token, n = np.unique(np.concatenate([_places(bits.value, h, at, k)[1] for k in sizes]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n, pa.int64())], names=["token", "n"])

    return texts.mapInArrow(tk.tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("often"))


def _near(texts: DataFrame, bits: Broadcast, sizes: list[int], window: int, token_words: int) -> DataFrame:
    """_rid, token, place (its first word in the document), lead (words before it in near), near (words that a window there may cover)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(1)):
                low, s, e, h, at = tk.words(data, offs, tk.ALNUM)
                doc, joined = tk.owner(at, len(h)), Joined(low, s, e)
                rid = batch.column(0).slice(lo, hi - lo)
                for k in sizes:
                    place, token = _places(bits.value, h, at, k)
                    d, reach = doc[place], window - k if k == token_words else 0
                    first, last = np.maximum(at[d], place - reach), np.minimum(at[d + 1], place + k + reach)
                    columns = [rid.take(pa.array(d)), pa.array(token.view(np.int64)), pa.array(place - at[d], pa.int64()), pa.array(place - first, pa.int32()), joined.cut(first, last)]
                    yield pa.RecordBatch.from_arrays(columns, names=["_rid", "token", "place", "lead", "near"])

    return texts.mapInArrow(tk.tidy(run), "_rid long, token long, place long, lead int, near string")


def _n_words(docs: DataFrame) -> DataFrame:
    """``docs`` (the text last) with n_words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(batch.num_columns - 1)):
                n = np.diff(tk.word_spans(tk.LOWER[data], offs, tk.ALNUM)[2])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n_words"])

    return docs.mapInArrow(tk.tidy(run), T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType())]))


def occurrences(texts: DataFrame, members: DataFrame, window: int, token_words: int) -> DataFrame:
    """_rid, start, end (after the last word), words: every place of ``texts`` (_rid, _text) where a window stands."""
    distinct = members.groupBy("words").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    tokens = distinct.select("words", "n", F.posexplode("tokens").alias("off", "token"))
    sizes = sorted(r["k"] for r in members.select("k").distinct().collect())
    if not sizes:
        return texts.sparkSession.createDataFrame([], "_rid long, start long, end long, words string")
    bits = _bits(members.select(F.explode("tokens").alias("token")))
    often = store.write_table(_counted(texts.select("_text"), bits, sizes), "often")
    bits.destroy()
    rarest = tokens.join(often, "token", "left").groupBy("words", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token", "off")).alias("r"))
    prefix = store.write_table(rarest.filter("r.often > 0").select("words", "n", "r.token", "r.off"), "prefix")
    bits = _bits(prefix)
    near = store.write_table(_near(texts, bits, sizes, window, token_words), "near")
    bits.destroy()
    found = near.join(prefix, "token").filter("lead >= off and array_join(slice(split(near, ' '), lead - off + 1, n), ' ') = words")
    return found.select("_rid", F.expr("place - off").alias("start"), F.expr("place - off + n").alias("end"), "words")


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str, keep_text: bool, window: int, token_words: int) -> DataFrame:
    """``decontam.annotate`` without an index: nothing that grows with either table is broadcast or collected."""
    store.ship_package(docs.sparkSession)
    added = ["n_words", "n_hit", "n_items", "items"]
    rest = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    kept = {c: f"_c{k}" for k, c in enumerate(rest)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()], F.monotonically_increasing_id().alias("_rid"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    keyed = store.write_table(_n_words(rows), "keyed")
    members = store.write_table(windows(benchmark, window, token_words), "windows")
    hits = store.write_table(occurrences(keyed.select("_rid", "_text"), members, window, token_words), "hits")
    before = F.expr('max(end) over (partition by _rid order by start, end rows between unbounded preceding and 1 preceding)')
    n_hit = hits.withColumn("before", before).groupBy("_rid").agg(F.sum(F.expr("greatest(0, end - greatest(start, coalesce(before, 0)))")).alias("n_hit"))
    named = hits.select("_rid", "words").distinct().join(members.select("words", "item_id"), "words")
    items = named.groupBy("_rid").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = keyed.join(n_hit.join(items, "_rid"), "_rid", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(*[F.col(n).alias(c) for c, n in kept.items()], "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
