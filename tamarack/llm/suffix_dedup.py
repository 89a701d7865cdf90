"""Operator 6: removal of repeated substrings with per-shard suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else.

1. Every window of LENGTH bytes has an anchor, the leftmost of its grams of GRAM bytes with the least
   hash, so equal windows have equal anchors.  The windows of one anchor are a run; the bytes under a
   run are a span.  Runs whose anchor occurs once hold no repeat and end here, most of the corpus.
2. Equal spans, known by 128 bits of hashes, are counted together, inside a task before they are shuffled,
   so a text that a third of all rows share costs a row a task.
3. An anchor with more than GROUP_BYTES of distinct spans, as a line that many texts have between varied
   neighbours, is split: its windows are dealt by how far on in them the anchor stands, in ever narrower
   classes, and by the bytes that all windows of a class must share.  Equal windows stay together, and at
   the last class, one distance wide, these are whole windows; so any anchor ends in small groups.
4. One instance of every span goes to a shard with its count.  A shard gets a suffix array by
   Larsson-Sadakane refinement: sorted by eight bytes, then only unsorted groups are split by the rank that
   stands as far on as is sorted.  Kasai's common prefixes, all spans in lockstep, say which neighbours
   agree in LENGTH bytes.  A shard ends at SHARD_BYTES, also inside an anchor's spans; such an anchor's
   windows are merged across its shards by binary search in the order of the suffix arrays.
5. What is repeated goes back from the distinct spans to every place that has them, and each document's
   bytes are cut once.

Windows are judged on the input as it is, in whole documents; they never cross documents.

Cases: null texts are empty; texts under LENGTH bytes hold no window; a text may repeat itself, and
overlapping occurrences count; repeated rows and ids are documents of their own (rows are numbered once
if ids aren't unique); a very long text is one block and must fit a worker some sixty times over; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import store
from tamarack.llm import textkit as tk

LENGTH, GRAM = 200, 24
RUN_BYTES, SHARD_BYTES, PARTITION_BYTES, GROUP_BYTES = 1 << 20, 1 << 20, 8 << 20, 1 << 18
#: Widths of the classes of distances by which the windows of a large anchor are split, one after the other.
WIDTHS = (88, 44, 22, 11, 5, 2, 1)
_SPAN = np.uint64(0xA0761D6478BD642F)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` entries in a row, from two running minima over chunks."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    chunks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(chunks, 1).ravel()
    back = np.minimum.accumulate(chunks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc, first (in the document), n (windows), at (the anchor from first on),
    anchor and span hashes."""
    size = np.diff(offs)
    starts = np.maximum(size - length + 1, 0)
    none = {k: np.zeros(0, np.int64) for k in ("doc", "first", "n", "at")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "span")}
    if not starts.any():
        return none
    sums = tk.prefix_hash(data)
    place = np.arange(len(data) - gram + 1)
    h = tk.span_hash(sums, place, place + gram)
    coded = (h >> np.uint64(32)) << np.uint64(32) | place.astype(np.uint64)
    at = (_least(coded, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), starts)
    s = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + offs[doc]
    anchor = at[s]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0)]))
    n = np.diff(np.append(new, len(s)))
    first, doc, anchor = s[new], doc[new], anchor[new]
    key = h[anchor]
    span = tk.mix(tk.span_hash(sums, first, first + n + length - 1) * _SPAN + key)
    return {"doc": doc, "first": first - offs[doc], "n": n, "at": anchor - first, "anchor": key, "span": span}


# ---------------------------------------------------------------------------- suffix arrays


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by ``depth`` bytes at least (fewer at the end), and each position's rank."""
    key = _words(text, 0)
    return _refine(np.argsort(key), key, depth)


def _words(text: np.ndarray, more: int) -> np.ndarray:
    """Eight bytes from each position on as one number, zeros after the end; ``more`` positions beyond it."""
    n = len(text) + more
    padded = np.concatenate([text, np.zeros(more + 8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : n + k]
    return key


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """Of sorted keys, where each one's group of equal keys begins."""
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))


def _refine(sa: np.ndarray, key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    n, done = len(sa), 8
    rank = np.empty(n, np.int64)
    group = _ranks(key[sa])
    rank[sa] = group
    while done < depth:
        last = np.append(group[1:] != group[:-1], True)
        alone = last & (group == np.arange(n))
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        own = sa[slots]
        on = own + done
        further = np.where(on < n, rank[np.minimum(on, n - 1)] + 1, 0)  # the end sorts first
        both = group[slots] * (n + 1) + further
        order = np.argsort(both)
        sa[slots] = own[order]
        both = both[order]
        begin = np.concatenate([[True], both[1:] != both[:-1]])
        group[slots] = np.maximum.accumulate(np.where(begin, slots, 0))
        rank[sa[slots]] = group[slots]
        done *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each slot, how many bytes its suffix shares with the slot before, up to ``cap``.

    Kasai's rule, that going one byte on loses at most one, runs down every span at the same time."""
    n = len(text)
    rank = np.empty(n, np.int64)
    rank[sa] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = _words(text, cap + 8)
    out = np.zeros(n, np.int64)
    lanes = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[lanes], sizes[lanes]
    have = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max(initial=0))):
        alive = int(np.searchsorted(-sizes, -t, side="left"))
        i = starts[:alive] + t
        j = before[i]
        have = np.maximum(have[:alive] - 1, 0)
        have[j < 0] = 0
        room = np.minimum(cap, n - np.maximum(i, j))
        go = np.flatnonzero((j >= 0) & (have < room))
        while len(go):
            differ = words[i[go] + have[go]] ^ words[j[go] + have[go]]
            differ &= ~(differ >> np.uint64(1))  # keeps the highest bit, and what stays can't round up to the next
            same = (64 - np.frexp(differ.astype(float))[1]) >> 3  # equal bytes from the left
            have[go] += same
            go = go[(same == 8) & (have[go] < room[go])]
        have = np.minimum(have, room)
        out[rank[i]] = have
    return out


class Shard:
    """Some spans, sorted: which group of equal windows each window is in, and the groups' occurrences."""

    def __init__(self, spans: list[bytes], times: np.ndarray, length: int) -> None:
        self.text = np.frombuffer(b"".join(spans), np.uint8)
        self.sizes = np.array([len(s) for s in spans], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.n = self.sizes - length + 1
        self.length = length
        sa, _ = suffix_array(self.text, len(self.text))  # to the end: Kasai's rule needs the whole order
        shared = common_prefixes(self.text, sa, length, self.starts, self.sizes)
        owner = np.repeat(np.arange(len(spans)), self.sizes)
        window = np.arange(len(self.text)) - self.starts[owner] < self.n[owner]  # suffixes with a whole window in their span
        group = np.cumsum(shared < length) - 1
        valid = window[sa]
        self.count = np.bincount(group[valid], times[owner[sa[valid]]], int(group[-1]) + 1 if len(group) else 0)
        self.group = np.full(len(self.text), -1, np.int64)
        self.group[sa[valid]] = group[valid]
        self.sa, self.owner = sa[valid], owner[sa[valid]]

    def repeated(self, span: int) -> np.ndarray:
        a = self.starts[span]
        return self.count[self.group[a : a + self.n[span]]] >= 2

    def sorted_windows(self, members: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Groups of some spans' windows in the order of the suffix array, and where one of each begins."""
        at = self.sa[np.isin(self.owner, members)]
        group, first = np.unique(self.group[at], return_index=True)
        return group, at[first]


def _bisect(words: np.ndarray, at: np.ndarray, asked_words: np.ndarray, asked: np.ndarray, length: int) -> np.ndarray:
    """Which of the sorted windows that begin at ``at`` equals each asked one, or -1: binary search, all at once.

    ``words`` and ``asked_words`` have the eight bytes from each position of the two texts on."""
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]

    def compare(k: np.ndarray, q: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(k), np.int8), np.arange(len(k))
        for t in steps:
            x, y = words[at[k[open_]] + t], asked_words[asked[q[open_]] + t]
            out[open_] = np.where(x < y, -1, x > y)
            open_ = open_[x == y]
            if not len(open_):
                break
        return out

    lo, hi = np.zeros(len(asked), np.int64), np.full(len(asked), len(at), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        less = compare(mid, open_) < 0
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
    out = np.full(len(asked), -1, np.int64)
    inside = np.flatnonzero(lo < len(at))
    equal = inside[compare(lo[inside], inside) == 0]
    out[equal] = lo[equal]
    return out


def merge(holders: list[tuple[Shard, list[int]]]) -> None:
    """Adds up the occurrences of equal windows of one anchor, whose spans lie in several shards."""
    listed = [shard.sorted_windows(members) for shard, members in holders]
    words = [_words(shard.text, shard.length) for shard, _ in holders]
    before = [shard.count[group].copy() for (shard, _), (group, _) in zip(holders, listed, strict=True)]
    for i, (group, asked) in enumerate(listed):
        for j, (_, at) in enumerate(listed):
            if i != j:
                k = _bisect(words[j], at, words[i], asked, holders[i][0].length)
                holders[i][0].count[group[k >= 0]] += before[j][k[k >= 0]]


def _covers(mask: np.ndarray, length: int) -> list[int]:
    """from, to, from, to ... of the bytes under the marked windows."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    out: list[int] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if out and a <= out[-1]:
            out[-1] = b - 1 + length
        else:
            out += [a, b - 1 + length]
    return out


# ---------------------------------------------------------------------------- Spark side


def _runs_of(docs: DataFrame) -> DataFrame:
    """(anchor, span, _rid, first, n, at) of all runs, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for lo, _, data, offs in tk.blocks(batch.column(1), RUN_BYTES):
                r = runs(data, offs)
                columns = [r["anchor"].view(np.int64), r["span"].view(np.int64), rid[lo + r["doc"]], *(r[c].astype(np.int32) for c in ("first", "n", "at"))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "span", "_rid", "first", "n", "at"])

    return store.write_table(docs.select("_rid", "text").mapInArrow(tk.tidy(run), "anchor long, span long, _rid long, first int, n int, at int"), "runs")


_SENT = ("anchor", "span", "times", "at")


def _bytes_of(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(anchor, span, times, at, bytes): the text under each span, taken from one document that has it."""
    places = spans.groupBy("_rid").agg(F.collect_list(F.struct(*_SENT, "first", "n")).alias("spans"))
    few = store.broadcast_if_small(places, spans.count(), 64, 16 << 20)
    rows = docs.select("_rid", "text").join(few, "_rid").select("text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, spans in zip(batch.column(0), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                s = {k: spans.values.field(k) for k in (*_SENT, "first", "n")}
                cut = [raw[a : a + n + LENGTH - 1] for a, n in zip(s["first"].to_pylist(), s["n"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(s[k] for k in _SENT), pa.array(cut, pa.binary())], names=[*_SENT, "bytes"])

    return rows.mapInArrow(tk.tidy(run), "anchor long, span long, times long, at int, bytes binary")


def _narrowed(rows: DataFrame, width: int) -> DataFrame:
    """Parts of spans by classes of ``width`` distances, written: (up_anchor, up_span, shift) of the span that a
    part is from, and the part's own (anchor, span, times, at, bytes).  An anchor then stands for the class and
    the bytes that all windows of the class have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("bytes").cast(pa.large_binary())
            _, ends, data = raw.buffers()
            offs = np.frombuffer(ends, np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data, begin = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs[:-1] - offs[0]
            n, at = np.diff(offs) - LENGTH + 1, batch.column("at").to_numpy().astype(np.int64)
            up = batch.column("anchor").to_numpy().view(np.uint64)
            sums = tk.prefix_hash(data)
            for c in range((LENGTH - GRAM) // width + 1):
                lo, hi = np.maximum(0, at - (c + 1) * width + 1), np.minimum(n - 1, at - c * width)
                own = np.flatnonzero(lo <= hi)
                if not len(own):
                    continue
                lo, size, core = lo[own], (hi - lo)[own] + LENGTH, (begin + at)[own] - c * width
                key = tk.mix(tk.mix(up[own] + np.uint64(c * len(WIDTHS) + WIDTHS.index(width) + 1) * _SPAN) + tk.span_hash(sums, core, core - width + 1 + LENGTH))
                s = begin[own] + lo
                span = tk.mix(tk.span_hash(sums, s, s + size) * _SPAN + key)
                until = np.concatenate([[0], np.cumsum(size)])
                cut = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(until), pa.py_buffer(data[np.arange(until[-1]) + np.repeat(s - until[:-1], size)])])
                of = lambda name: batch.column(name).take(pa.array(own))  # noqa: E731, B023
                columns = [of("anchor"), of("span"), pa.array(lo.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(span.view(np.int64)), of("times"), pa.array((at[own] - lo).astype(np.int32)), cut.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["up_anchor", "up_span", "shift", *_SENT, "bytes"])

    return store.write_table(rows.mapInArrow(tk.tidy(run), "up_anchor long, up_span long, shift int, anchor long, span long, times long, at int, bytes binary"), "narrowed")


def _large(spans: DataFrame, size: str) -> DataFrame | None:
    """(anchor) of those with more than GROUP_BYTES of spans, or None."""
    large = store.write_table(spans.groupBy("anchor").agg(F.sum(size).alias("b")).filter(F.col("b") > GROUP_BYTES).select("anchor"), "large")
    n = large.count()
    return store.broadcast_if_small(large, n, 16) if n else None


def _split(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Small groups (anchor, span, times, at, bytes) out of large ones, and the links up, level by level."""
    small, links = None, []
    for width in WIDTHS:
        made = _narrowed(rows, width)
        links.append(made.select("up_anchor", "up_span", "shift", "anchor", "span"))
        kinds = made.groupBy("anchor", "span", "at", "bytes").agg(F.sum("times").alias("times")).select(*_SENT, "bytes")
        large = _large(kinds.withColumn("b", F.length("bytes")), "b") if width > 1 else None
        part = kinds if large is None else kinds.join(large, "anchor", "left_anti")
        small = part if small is None else small.union(part)
        if large is None:
            break
        rows = kinds.join(large, "anchor", "left_semi")
    return small, links


def _sorted_out(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """(anchor, span, covers) of a partition whose rows come in the order of their anchors.

    Held are the open shard and, of an anchor that began in an earlier one, the shards that have its spans."""
    closed: list[tuple[Shard, list[int], list[int]]] = []
    spans, times, keys, own = [], [], [], []
    size = 0

    def close() -> None:
        nonlocal spans, times, keys, own, size
        closed.append((Shard(spans, np.array(times, float), LENGTH), keys, own))
        spans, times, keys, own, size = [], [], [], [], 0

    def flush(open_anchor: int | None) -> Iterator[pa.RecordBatch]:
        """Ends the anchors that can't go on, and lets go what only they needed."""
        first = 0
        while first < len(closed):
            last = closed[first][2][-1]  # only a shard's last anchor goes on in the next
            run = first + 1
            while run < len(closed) and closed[run][2][0] == last:
                run += 1
                if closed[run - 1][2][-1] != last:
                    break
            if last == open_anchor and closed[run - 1][2][-1] == last:
                break
            if run - first > 1:
                merge([(s, [k for k, a in enumerate(o) if a == last]) for s, _, o in closed[first:run]])
            ended = run - first if run - first == 1 else run - first - 1
            for shard, ids, anchors in closed[first : first + ended]:
                covers = [_covers(shard.repeated(k), LENGTH) for k in range(len(ids))]
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(ids, pa.int64()), pa.array(covers, pa.list_(pa.int32()))], names=["anchor", "span", "covers"])
            first += ended
        del closed[:first]

    for batch in batches:
        for anchor, span, n, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "span", "times", "bytes")), strict=True):
            if size >= shard_bytes:
                close()
                yield from flush(anchor)
            spans.append(raw)
            times.append(n)
            keys.append(span)
            own.append(anchor)
            size += len(raw)
    if spans:
        close()
    yield from flush(None)


def repeats(docs: DataFrame) -> DataFrame:
    """(_rid, covers) of documents that have repeated bytes: from, to pairs, not in order; ``docs`` has _rid and text."""
    spark = docs.sparkSession
    store.ship_package(spark)
    found = _runs_of(docs)
    again = store.write_table(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("total")).filter("total > 1").select("anchor"), "anchors")
    places = store.write_table(found.join(again, "anchor"), "places")
    one = F.min(F.struct("_rid", "first", "n", "at")).alias("one")
    spans = store.write_table(places.groupBy("anchor", "span").agg(one, F.count(F.lit(1)).alias("times")).select("anchor", "span", "times", "one.*"), "spans")
    large = _large(spans.withColumn("b", F.col("n") + (LENGTH - 1)), "b")
    links: list[DataFrame] = []
    if large is None:
        sent = _bytes_of(docs, spans)
    else:
        parts, links = _split(_bytes_of(docs, spans.join(large, "anchor", "left_semi")))
        sent = _bytes_of(docs, spans.join(large, "anchor", "left_anti")).union(parts)
    size = spans.agg(F.sum(F.col("n") + LENGTH).alias("b")).first()["b"] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    sharded = sent.repartition(tasks, "anchor").sortWithinPartitions("anchor")
    shard_bytes = SHARD_BYTES
    back = sharded.mapInArrow(tk.tidy(lambda batches: _sorted_out(batches, shard_bytes)), "anchor long, span long, covers array<int>").filter(F.size("covers") > 0)
    back = store.write_table(back, "covers")
    for link in reversed(links):
        up = link.join(back, ["anchor", "span"]).select(F.col("up_anchor").alias("anchor"), F.col("up_span").alias("span"), F.transform("covers", lambda x: x + F.col("shift")).alias("covers"))
        back = store.write_table(back.union(up), "covers")
    few = store.broadcast_if_small(back, back.agg(F.sum(F.size("covers") * 4 + 48).alias("b")).first()["b"] or 0, 1, 32 << 20)
    placed = places.select("anchor", "span", "_rid", "first").join(few, ["anchor", "span"])
    covers = F.transform("covers", lambda x: x + F.col("first"))
    return store.write_table(placed.groupBy("_rid").agg(F.flatten(F.collect_list(covers)).alias("covers")), "repeats")


def _merged(covers: list[int] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(covers[::2], covers[1::2], strict=True)) if covers else []:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the bytes that stay) of every row of ``docs``."""
    rows = store.with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "doc_id")
    found = repeats(rows)
    size = found.agg(F.sum(F.size("covers") * 4 + 40).alias("b")).first()["b"] or 0
    few = store.broadcast_if_small(found, size, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for raw, covers in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = _merged(covers)
                gone = sum(b - a for a, b in spans)
                kept = b"".join(raw[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(raw)], strict=True)) if spans else raw
                out.append((len(raw), gone, len(spans), kept))
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(few, "_rid", "left").select("doc_id", "text", "covers")
    return joined.mapInArrow(tk.tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
