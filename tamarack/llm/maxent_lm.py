"""Operator 5: language-model scores from a hashed maximum-entropy model with a class-factored softmax.

P(token | two tokens before) = P(class | both) * P(slot | class, the token before) * P(token | slot).  The TOP
most frequent tokens make classes of SLOTS by rank, each a slot of its own; every other token's class is a
hash of its last three bytes and its slot a hash of the whole token, and in its slot it has its add-one share
of the slot's counts, with room for one unseen token.  So the probabilities of all tokens sum to one, unseen
ones included.

Features of a class are the token before (n-gram), the one before that (skip) and both together; features of a
slot are its class with the token before.  Each feature is hashed from the tokens' own 64-bit hashes, of the
whole vocabulary, into a row of a table; the tables' number of rows follows the number of distinct training
tokens, from LEAST_ROWS to MOST_ROWS.  Training goes once over all training texts, in ROUNDS parts: the
weights go out, tasks sum up observed and expected counts of every row over their texts, the sums are added up
table block by table block in tasks again, and the weights move by the scaled log ratio of the two.

Token counts of the base score cover all training texts.  Up to BROADCAST_WORDS distinct tokens they
go to the tasks as a sorted table; beyond, documents' distinct tokens meet them in a shuffled join.

Cases: null and empty texts have the end token only; without training texts all counts are zero and
the base score is 0; repeated rows score alike; null ids are in the fold of the empty text; very long texts are
worked on in pieces of CHUNK tokens, but a text must fit a worker some forty times over; columns other than
doc_id and text are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.llm import labelled, store
from tamarack.llm import textkit as tk
from tamarack.llm.tables import Table

FOLDS, HELD_OUT = 7, 2
TOP, SLOTS, TAILS = 512, 32, 16
CLASSES = TOP // SLOTS + TAILS
#: Rows of each table: one for WORDS_A_ROW distinct training tokens, between the two bounds.
LEAST_ROWS, MOST_ROWS, WORDS_A_ROW = 1 << 14, 1 << 18, 100
ROUNDS, PRIOR, CHUNK = 4, 4.0, 1 << 14
#: Parts of a log ratio that a round moves a feature by: three features make a class, one makes a slot.
STEP = {"one": 0.5, "two": 0.5, "both": 0.5, "slot": 1.0}
SUM_ROWS = 1 << 11
BROADCAST_WORDS = 8 << 20
MERGE_AT = 1 << 20
END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
_TAIL = np.uint64(64 - int(np.log2(TAILS)))
_ROW = tk.randoms(5, 31) | np.uint64(1)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all documents' tokens with their ends, tails' classes, and each document's first token."""
    low = tk.LOWER[data]
    s, e, at = tk.word_spans(low, offs, tk.NONSPACE)
    sums = tk.prefix_hash(low)
    n_docs = len(offs) - 1
    place = np.arange(len(s)) + tk.owner(at, len(s))
    h = np.full(len(s) + n_docs, END, np.uint64)
    tail = np.zeros(len(h), np.int32)
    h[place] = tk.span_hash(sums, s, e)
    tail[place] = (tk.span_hash(sums, np.maximum(s, e - 3), e) >> _TAIL).astype(np.int32)
    return h, tail, at + np.arange(n_docs + 1)


def before(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens one and two before each token of its document."""
    one, two = np.full(len(h), START, np.uint64), np.full(len(h), START, np.uint64)
    one[1:] = h[:-1]
    one[at[:-1]] = START
    two[1:] = one[:-1]
    two[at[:-1]] = START
    return one, two


class Words:
    """Classes and slots of tokens: the top ones by rank, the others by hashes."""

    def __init__(self, top: np.ndarray) -> None:
        order = np.argsort(top)
        self.top, self.rank = Table(top[order], np.zeros(len(top))), order

    def places(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, slot, and whether a token is outside the top, so only has a share of its slot."""
        k = self.top.find(h)
        rank = self.rank[np.maximum(k, 0)] if len(self.rank) else np.zeros(len(h), np.int64)
        outside = k < 0
        kind = np.where(outside, TOP // SLOTS + tail, rank // SLOTS)
        slot = np.where(outside, (tk.mix(h ^ START) % np.uint64(SLOTS)).astype(np.int64), rank % SLOTS)
        return kind, slot, outside


class Weights:
    """Log-linear weights: a class table for each kind of context, a slot table, and the biases."""

    def __init__(self, size: int) -> None:
        z = lambda *shape: np.zeros(shape, np.float32)
        self.size = size
        self.tables = {"one": z(size, CLASSES), "two": z(size, CLASSES), "both": z(size, CLASSES), "slot": z(size, SLOTS)}
        self.bias, self.slot_bias = z(CLASSES), z(CLASSES, SLOTS)

    def rows(self, one: np.ndarray, two: np.ndarray, kind: np.ndarray) -> dict[str, np.ndarray]:
        """The row of each feature of tokens with these hashes before them."""
        code = {"one": one * _ROW[0], "two": two * _ROW[1], "both": one * _ROW[2] + two * _ROW[3], "slot": one + (kind.astype(np.uint64) + np.uint64(1)) * _ROW[4]}
        return {k: ((tk.mix(x) >> np.uint64(32)) * np.uint64(self.size) >> np.uint64(32)).astype(np.int64) for k, x in code.items()}

    def classes(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        """Log-probabilities of all classes."""
        x = self.tables["one"][rows["one"]]
        x += self.tables["two"][rows["two"]]
        x += self.tables["both"][rows["both"]]
        x += self.bias
        return _log_softmax(x)

    def slots(self, rows: dict[str, np.ndarray], kind: np.ndarray) -> np.ndarray:
        """Log-probabilities of the slots of one class for each token."""
        x = self.tables["slot"][rows["slot"]]
        x += self.slot_bias[kind]
        return _log_softmax(x)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


class Scorer:
    """What a task needs: classes and slots, counts (if they are broadcast), slots' totals and weights."""

    def __init__(self, words: Words, rest: np.ndarray, weights: Weights, counts: Table | None, n: int, v: int) -> None:
        self.words, self.log_rest, self.weights, self.counts, self.n, self.v = words, np.log10(rest), weights, counts, n, v

    def model(self, h: np.ndarray, tail: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, but for the counts of tokens outside the top; and which these are."""
        one, two = before(h, at)
        kind, slot, outside = self.words.places(h, tail)
        logp = np.empty(len(h))
        for lo in range(0, len(h), CHUNK):
            own = slice(lo, lo + CHUNK)
            rows = self.weights.rows(one[own], two[own], kind[own])
            i = np.arange(len(rows["one"]))
            logp[own] = self.weights.classes(rows)[i, kind[own]] + self.weights.slots(rows, kind[own])[i, slot[own]]
        logp /= np.log(10)
        logp[outside] -= self.log_rest[kind[outside] - TOP // SLOTS, slot[outside]]
        return logp, outside


def _add(out: np.ndarray, rows: np.ndarray, x: np.ndarray) -> None:
    """out[rows] += x, rows that come twice too.  Numpy's fast way needs one flat index and its own float32, which
    an array from a pickle doesn't have before it is viewed as such."""
    at = rows[:, None] * x.shape[1] + np.arange(x.shape[1])
    np.add.at(out.reshape(-1), at.reshape(-1), x.reshape(-1).view(np.float32))


class Sums:
    """Observed and expected counts of all rows of all tables over some texts."""

    def __init__(self, weights: Weights) -> None:
        self.weights = weights
        self.seen, self.expected = ({k: np.zeros(x.shape, np.float32) for k, x in weights.tables.items()} for _ in range(2))

    def add(self, words: Words, h: np.ndarray, tail: np.ndarray, at: np.ndarray) -> None:
        one, two = before(h, at)
        kind, slot, _ = words.places(h, tail)
        for lo in range(0, len(h), CHUNK):
            own = slice(lo, lo + CHUNK)
            rows = self.weights.rows(one[own], two[own], kind[own])
            p, q = np.exp(self.weights.classes(rows)), np.exp(self.weights.slots(rows, kind[own]))
            for name, row in rows.items():
                width, target, x = (SLOTS, slot[own], q) if name == "slot" else (CLASSES, kind[own], p)
                _add(self.expected[name], row, x)
                cell, n = np.unique(row * width + target, return_counts=True)
                self.seen[name].reshape(-1)[cell] += n


def _packed(x: np.ndarray) -> bytes:
    """The upper halves of float32 numbers: counts to three digits."""
    return ((x.view(np.uint32) + np.uint32(1 << 15)) >> np.uint32(16)).astype(np.uint16).tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return (np.frombuffer(x, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def _moved(weights: Weights, name: str, lo: int, seen: np.ndarray, expected: np.ndarray) -> None:
    weights.tables[name][lo : lo + len(seen)] += (STEP[name] * np.log((seen + PRIOR) / (expected + PRIOR))).astype(np.float32)


def train(rows: DataFrame, words: Words, weights: Weights, rounds: int = ROUNDS) -> None:
    """Moves the weights in ``rounds`` rounds, each over a part of ``rows`` (doc_id, text), dealt out by the texts."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    part = F.pmod(F.xxhash64("text"), F.lit(rounds))
    for k in range(rounds):
        sent = sc.broadcast((words, weights))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, weights = sent.value
            sums, some = Sums(weights), False
            for batch in batches:
                for _, _, data, offs in tk.blocks(batch.column(0)):
                    sums.add(words, *tokens(data, offs))
                    some = True
            for name in sums.seen if some else ():
                for lo in range(0, weights.size, SUM_ROWS):
                    seen, expected = (_packed(x[name][lo : lo + SUM_ROWS]) for x in (sums.seen, sums.expected))
                    yield pa.RecordBatch.from_pydict({"name": [name], "lo": pa.array([lo], pa.int64()), "seen": [seen], "expected": [expected]})

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, int], list[np.ndarray]] = {}
            for batch in batches:
                for name, lo, *both in zip(*(batch.column(c).to_pylist() for c in ("name", "lo", "seen", "expected")), strict=True):
                    x = [_unpacked(b) for b in both]
                    held[name, lo] = [a + b for a, b in zip(held[name, lo], x, strict=True)] if (name, lo) in held else x
            for (name, lo), (seen, expected) in held.items():
                yield pa.RecordBatch.from_pydict({"name": [name], "lo": pa.array([lo], pa.int64()), "seen": [_packed(seen)], "expected": [_packed(expected)]})

        shape = "name string, lo long, seen binary, expected binary"
        own = rows.filter(part == k).select("text").coalesce(max(1, sc.defaultParallelism))  # a task sends whole tables
        summed = own.mapInArrow(tk.tidy(count), shape).repartition("name", "lo").mapInArrow(tk.tidy(total), shape)
        for r in summed.toLocalIterator():
            width = weights.tables[r["name"]].shape[1]
            _moved(weights, r["name"], r["lo"], *(_unpacked(r[c]).reshape(-1, width) for c in ("seen", "expected")))
        sent.destroy()


def _with_tails(rows: DataFrame) -> DataFrame:
    """(key, tail, n) of all tokens of ``rows``; the tail's class follows from the token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def merged() -> tuple[np.ndarray, ...]:
            key, tail, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key)
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            return key[order][first], tail[order][first], np.add.reduceat(n[order], first)

        for batch in batches:
            for _, _, data, offs in tk.blocks(batch.column(0)):
                h, tail, _ = tokens(data, offs)
                key, first, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((key, tail[first], n))
                if (size := size + len(key)) > MERGE_AT:
                    parts = [merged()]
                    if (size := len(parts[0][0])) > MERGE_AT // 2:
                        yield _token_rows(*parts[0])
                        parts, size = [], 0
        if size:
            yield _token_rows(*merged())

    seen = rows.mapInArrow(tk.tidy(run), "key long, tail byte, n long")
    return seen.groupBy("key").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _token_rows(key: np.ndarray, tail: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tail, pa.int8()), pa.array(n, pa.int64())], names=["key", "tail", "n"])


def _counts_table(counts: DataFrame, v: int) -> Table:
    """All counts, sorted by token, gathered as packed arrays."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.minimum(batch.column(1).to_numpy(), (1 << 32) - 1).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"key": [batch.column(0).to_numpy().tobytes()], "n": [n.tobytes()]})

    wide = counts.filter(F.col("n") >= 1 << 32).select("key", "n").collect()  # a token's count rarely needs more than 32 bits
    key, n, at = np.empty(v, np.uint64), np.empty(v, np.uint32), 0
    for r in counts.select("key", "n").mapInArrow(tk.tidy(pack), "key binary, n binary").collect():
        k = np.frombuffer(r["key"], np.uint64)
        key[at : at + len(k)], n[at : at + len(k)] = k, np.frombuffer(r["n"], np.uint32)
        at += len(k)
    order = np.argsort(key)
    n = n[order]
    key.sort()
    if wide:
        n = n.astype(np.int64)
        for r in wide:
            n[np.searchsorted(key, np.array([r["key"]], np.int64).view(np.uint64))] = r["n"]
    return Table(key, n)


def fit(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS, held_out: int = HELD_OUT) -> tuple[Scorer, DataFrame]:
    """The scorer, and the (key, tail, n) table of all training tokens' counts."""
    spark = docs.sparkSession
    store.ship_package(spark)
    rows = docs.filter(labelled.fold("doc_id", FOLDS) != held_out).select(F.col("text").cast("string").alias("text"))
    counts = store.write_table(_with_tails(rows), "tokens")
    whole = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    top = np.array([r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(TOP).collect()], np.int64).view(np.uint64)
    if len(top) == TOP and END not in top:
        top[-1] = END
    words = Words(top)
    sent = spark.sparkContext.broadcast(words)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, slot, outside = sent.value.places(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int64()), pa.array(slot, pa.int64()), pa.array(outside), batch.column(2)], names=["kind", "slot", "outside", "n"])

    placed = counts.select("key", "tail", "n").mapInArrow(tk.tidy(places), "kind long, slot long, outside boolean, n long")
    seen, rest = np.zeros((CLASSES, SLOTS)), np.ones((TAILS, SLOTS))
    for r in placed.groupBy("kind", "slot", "outside").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        seen[r["kind"], r["slot"]] += r["n"]
        if r["outside"]:
            rest[r["kind"] - TOP // SLOTS, r["slot"]] += r["n"] + r["v"]
    weights = Weights(int(np.clip(whole["v"] // WORDS_A_ROW, LEAST_ROWS, MOST_ROWS)))
    weights.bias[:] = np.log((seen.sum(1) + 1) / (seen.sum() + CLASSES))
    weights.slot_bias[:] = np.log((seen + 1) / (seen.sum(1, keepdims=True) + SLOTS))
    if whole["n"]:
        train(rows, words, weights)
    table = _counts_table(counts, whole["v"]) if whole["v"] <= broadcast_words else None
    return Scorer(words, rest, weights, table, whole["n"], whole["v"]), counts


_OUT = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    scorer, counts = fit(docs, broadcast_words)
    shared = spark.sparkContext.broadcast(scorer)
    held_out = (labelled.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    columns = ["doc_id", held_out, "n_tokens", "n_known", F.lit(scorer.n).cast("long").alias("train_tokens"), "base_score", "score"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return c[at[1:]] - c[at[:-1]]

    if scorer.counts is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                for lo, hi, data, offs in tk.blocks(batch.column(1)):
                    h, tail, at = tokens(data, offs)
                    found, c = m.counts.get(h)
                    logp, outside = m.model(h, tail, at)
                    more = np.log10(c + 1)
                    out = [np.diff(at), sums(found, at).astype(np.int64), sums(more - np.log10(m.n + m.v + 1), at), sums(logp + np.where(outside, more, 0), at)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, out)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

        return texts.mapInArrow(tk.tidy(run), "doc_id long, " + _OUT).select(*columns)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(1)):
                h, tail, at = tokens(data, offs)
                doc = tk.owner(at, len(h))
                logp, outside = m.model(h, tail, at)
                logp = sums(logp, at)
                order = np.lexsort((h, doc))
                first = np.flatnonzero(np.concatenate([[True], (np.diff(h[order]) != 0) | (np.diff(doc[order]) != 0)]))
                times, one = np.diff(np.append(first, len(h))), order[first]
                own = np.concatenate([[True], np.diff(doc[one]) != 0])  # one of a document's rows carries what is the document's
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + doc[one])), pa.array(h[one].view(np.int64)), pa.array(times, pa.int64()), pa.array(outside[one]), pa.array(np.where(own, logp[doc[one]], 0.0))],
                    names=["_rid", "key", "times", "outside", "logp"],
                )

    rows = store.with_row_key(texts, "doc_id")
    split = rows.select("_rid", "text").mapInArrow(tk.tidy(parts), "_rid long, key long, times long, outside boolean, logp double")
    c = F.coalesce("n", F.lit(0))
    more = F.col("times") * F.log10(c + 1)
    met = split.join(counts.select("key", "n"), "key", "left").groupBy("_rid").agg(
        F.sum("times").alias("n_tokens"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(more - F.col("times") * float(np.log10(scorer.n + scorer.v + 1))).alias("base_score"), (F.sum("logp") + F.sum(F.when(F.col("outside"), more).otherwise(0.0))).alias("score"),
    )
    return rows.select("_rid", "doc_id").join(met, "_rid").select(*columns)
