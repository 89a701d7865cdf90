"""Operator 2: benchmark decontamination as a prefix-filtered set join.

A window is ten consecutive words of an item (a shorter item is one window).  Its tokens are
shingles of up to five words.  Shingles are ordered by rarity, counted over all documents.  A
document holds a whole window only if it holds every token, so the prefix that the join needs is
the window's rarest token; a match at some place bounds where the window starts and ends, and both
must lie in the document.  What is left is verified word by word.

The benchmark goes to the tasks as an index of bounded blocks: the driver reads it once, builds each from item
texts of BLOCK_ITEM_BYTES, about, and keeps of all others only a count for each token; workers load one at a time.
Tokens of all blocks are counted in one pass over the documents, and a second pass looks the windows up.
Items of more than INDEX_BYTES together aren't made an index: ``decontam_join`` shuffles windows and documents, with the same results.

Cases: null texts have no words; a very long text is one block and must fit a worker some forty times over; items without words have no windows; an item with a null id is
called "null"; repeated items or item ids count once; other columns pass through or are left out,
and those named like output columns are replaced; either table may be empty.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import decontam_join, store
from tamarack.llm import textkit as tk

WINDOW, TOKEN_WORDS = 10, 5
BLOCK_ITEM_BYTES = 8 << 20
INDEX_BYTES = 32 << 20
_FILTER_BITS = 20


class Tokens:
    """Sorted distinct hashes, with a bit table that turns most others away first."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.sorted = np.unique(hashes)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[(self.sorted >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are in the set, and which member each is."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.sorted):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
        hit = self.sorted[k] == h[at]
        return at[hit], k[hit]


class Windows:
    """The distinct windows of some items, and how they are found."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, token_words: int = TOKEN_WORDS) -> None:
        self.starts, self.ends = [], []
        parts, at = [], 0
        first, length, self.names, of = [], [], [], []
        for name, text in items:
            low, s, e, _, _ = tk.words(*_one(text), tk.ALNUM)
            if not len(s):
                continue
            n = len(s)
            for k in range(max(1, n - window + 1)):
                first.append(len(self.starts) + k)
                length.append(min(window, n))
                of.append(len(self.names))
            self.names.append(name)
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                self.starts.append(at)
                parts.append(low[a:b].tobytes())
                at += b - a
                self.ends.append(at)
                at += 1
        self.text = np.frombuffer(b" ".join(parts), np.uint8)
        self.starts, self.ends = np.array(self.starts, np.int64), np.array(self.ends, np.int64)
        h = tk.hash_words(parts)
        first, length, of = np.array(first, np.int64), np.array(length, np.int64), np.array(of, np.int64)
        full = np.zeros(len(first), np.uint64)
        for n in np.unique(length):
            full[length == n] = tk.shingles(h, int(n))[first[length == n]]
        self.hash, rep, inverse = np.unique(full, return_index=True, return_inverse=True)
        self.first, self.length = first[rep], length[rep]
        order = np.argsort(inverse, kind="stable")
        self.item_at = np.searchsorted(inverse[order], np.arange(len(self.hash) + 1))
        self.items = of[order]
        self.size = np.minimum(self.length, token_words)  # words in each window's tokens
        self.token_hash = {int(k): tk.shingles(h, int(k)) for k in np.unique(self.size)}
        self.tokens = {k: Tokens(self._of(k)[2]) for k in self.token_hash}
        self.prefix: dict[int, tuple] = {}

    def _of(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, offset, hash) of all tokens of k words."""
        win = np.flatnonzero(self.size == k)
        n = self.length[win] - k + 1
        rep = np.repeat(win, n)
        off = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        return rep, off, self.token_hash[k][self.first[rep] + off]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keeps each window's rarest token; counts: of each token in all documents."""
        for k in self.token_hash:
            win, off, h = self._of(k)
            often = counts[k][np.searchsorted(self.tokens[k].sorted, h)]
            order = np.lexsort((off, h, often, win))
            order = order[np.unique(win[order], return_index=True)[1]]
            win, off, h = win[order], off[order], h[order]
            order = np.argsort(h, kind="stable")
            keys = Tokens(h)
            self.prefix[k] = (keys, np.searchsorted(h[order], keys.sorted), np.searchsorted(h[order], keys.sorted, side="right"), win[order], off[order])

    def hits(self, low: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence."""
        doc = tk.owner(at, len(h))
        found = []
        for k, (keys, lo, hi, win, off) in self.prefix.items():
            place, key = keys.find(tk.shingles(h, k))
            n = hi[key] - lo[key]
            place = np.repeat(place, n)
            entry = np.repeat(lo[key], n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
            w, d = win[entry], doc[place]
            start = place - off[entry]
            fits = (start >= at[d]) & (start + self.length[w] <= at[d + 1])
            w, d, start = w[fits], d[fits], start[fits]
            for length in np.unique(self.length[w]):
                at_length = np.flatnonzero(self.length[w] == length)
                total = np.zeros(len(at_length), np.uint64)
                for j in range(int(length)):
                    total += h[start[at_length] + j] * tk._STEP[j]
                at_length = at_length[tk.mix(total + np.uint64(length)) == self.hash[w[at_length]]]
                at_length = at_length[self._same(low, s, e, start[at_length], w[at_length], int(length))]
                found.append((d[at_length], start[at_length], w[at_length]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _same(self, low: np.ndarray, s: np.ndarray, e: np.ndarray, start: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from each start on are, byte for byte, those of a window."""
        words = np.arange(n)
        mine, its = (start[:, None] + words).ravel(), (self.first[w][:, None] + words).ravel()
        size = e[mine] - s[mine]
        alike = size == self.ends[its] - self.starts[its]
        size = np.where(alike, size, 0)
        until = np.cumsum(size)
        step = np.arange(until[-1] if len(until) else 0) - np.repeat(until - size, size)
        differ = low[np.repeat(s[mine], size) + step] != self.text[np.repeat(self.starts[its], size) + step]
        alike &= np.bincount(np.repeat(np.arange(len(size)), size)[differ], minlength=len(size)) == 0
        return alike.reshape(-1, n).all(1)


def _one(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)], np.int64)


def _item_bytes(benchmark: DataFrame) -> int:
    return benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    block, size = [], 0
    for r in items.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        if (size := size + len(r["text"])) >= BLOCK_ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _counted(texts: DataFrame, tokens: list[Broadcast]) -> dict[int, dict[int, np.ndarray]]:
    """By block and by words in a token: how often each of the block's tokens stands in all ``texts``."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, _, data, offs in tk.blocks(batch.column(0)):
                _, _, _, h, at = tk.words(data, offs, tk.ALNUM)
                last = np.repeat(at[1:], np.diff(at))
                for block, b in enumerate(tokens):
                    for k, t in b.value.items():
                        place, member = t.find(tk.shingles(h, k))
                        n = np.bincount(member[place + k <= last[place]], minlength=len(t.sorted))
                        counts[block, k] = counts[block, k] + n if (block, k) in counts else n
                    if len(tokens) > 1:
                        b.__dict__.pop("_value", None)  # read again from the worker's disk when it's next needed
        for (block, k), c in counts.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(some), block), pa.int32()), "size": pa.array(np.full(len(some), k), pa.int32()), "token": pa.array(some, pa.int64()), "n": pa.array(c[some], pa.int64())})

    out = {}
    for block, b in enumerate(tokens):
        out[block] = {k: np.zeros(len(t.sorted), np.int64) for k, t in b.value.items()}
        b.__dict__.pop("_value", None)
    if tokens:
        for r in texts.mapInArrow(tk.tidy(tally), "block int, size int, token long, n long").groupBy("block", "size", "token").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["block"]][r["size"]][r["token"]] = r["n"]
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long) and items (array of the item ids, sorted as strings)."""
    if _item_bytes(benchmark) > INDEX_BYTES:
        return decontam_join.annotate(docs, benchmark, text_col, keep_text, WINDOW, TOKEN_WORDS)
    spark = docs.sparkSession
    store.ship_package(spark)
    sc = spark.sparkContext
    text_only = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    shared, tokens = [], []
    for items in _item_blocks(benchmark):
        index = Windows(items)
        tokens.append(sc.broadcast(index.tokens))
        shared.append(sc.broadcast(index))
        del index
    counts = _counted(text_only, tokens)
    for t in tokens:
        t.destroy()
    chosen = []
    for k, b in enumerate(shared):
        index = b.value
        index.choose(counts.pop(k))
        index.tokens, index.token_hash = {}, {}
        chosen.append(sc.broadcast(index))
        b.destroy()
        del index
    shared = chosen

    added = ["n_words", "n_hit", "n_items", "items"]
    rest = [c for c in docs.columns if c not in added and (keep_text or c != text_col)]
    fields = [T.StructField(c, T.LongType()) for c in added[:3]] + [T.StructField("items", T.ArrayType(T.StringType()))]
    where = rest.index(text_col) if text_col in rest else len(rest)
    one_block = len(shared) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(where)):
                low, s, e, h, at = tk.words(data, offs, tk.ALNUM)
                cover = np.zeros(len(h) + 1, np.int64)
                names: dict[int, set[str]] = defaultdict(set)
                for b in shared:
                    index = b.value
                    d, start, w = index.hits(low, s, e, h, at)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + index.length[w], -1)
                    for i, win in {*zip(d.tolist(), w.tolist(), strict=True)}:
                        names[i].update(index.names[x] for x in index.items[index.item_at[win] : index.item_at[win + 1]].tolist())
                    if not one_block:
                        b.__dict__.pop("_value", None)  # read again from the worker's disk when it's next needed
                hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
                items = [sorted(names.get(i, ())) for i in range(hi - lo)]
                more = [pa.array(np.diff(at)), pa.array(hit[at[1:]] - hit[at[:-1]]), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(rest)], *more], names=[*rest, *added])

    schema = T.StructType([docs.schema[c] for c in rest] + fields)
    sent = [F.col(f"`{c}`") for c in rest] + ([] if text_col in rest else [F.col(f"`{text_col}`").cast("string").alias("_text")])
    return docs.select(*sent).mapInArrow(tk.tidy(run), schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    found = annotate(docs.select("doc_id", "text"), benchmark, keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, all columns as they are."""
    names = [f"_c{k}" for k in range(len(docs.columns))]
    found = annotate(docs.toDF(*names), benchmark, text_col=names[docs.columns.index("text")])
    return found.filter("n_hit = 0").select(*names).toDF(*docs.columns)
