"""Operator 10: toxicity by class-conditional Kneser-Ney models.

Two sequence models, one of toxic and one of ordinary documents, give each word a probability after the
word before it:

* p(w | v) discounts the counts of the pair v w and spreads what that frees over
* p(w), the spelling of w: each of its first DEPTH bytes, then the rest and the end as one symbol, given the
  whole beginning before it.  Each class's counts are discounted, and what that frees goes to
* the last order, which both classes share: the continuation counts of both together, and under them a
  uniform one.  So an expression that is too rare to stand out from a class's discount says nothing.

All counts are Kneser-Ney's continuation counts, of the different words that come before a pair or a word,
so what a text's copies repeat counts once.

The first byte's model is shared, as the mix of languages is no evidence.  A toxic document is mostly made
of ordinary text: a word's evidence is the log of (1 - SHARE + SHARE * toxic / ordinary probability), and a
text's is their sum over a power of its number of words.  The discount, whether the word before counts,
the share and the power, and the logistic curve that turns evidence into a score, are chosen on a fold of
training rows that the counts don't use.  The discount is 1 at least, so what occurs once needs no place in the tables; nothing else is left out.

The models are fitted on a bounded sample of labelled rows (MAX_LABELLED), which bounds the tables that
are sent to the workers.  Every row is scored, whole, in blocks; the longest text must fit a worker.

Cases: null and empty texts have no evidence, which gives the curve's value at zero; without labels
of both classes every score is the share of toxic labels (0 without labels); null ids are held in
the fold of the empty text; repeated rows score alike; a word of any length counts as one; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import labelled, store
from tamarack.llm import textkit as tk
from tamarack.llm.tables import Table

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
#: Labelled rows that the models and the curve are fitted on at most, in expectation.
MAX_LABELLED = 10_000
DEPTH = 12
DISCOUNTS = (1.0, 2.0)
SHARES = (0.1, 0.01, 0.001)
HISTORIES = (False, True)
POWERS = (0.5, 0.75, 1.0)
_WHOLE = tk.randoms(1, 5)[0]
_PAIR = tk.randoms(1, 6)[0]
_UNIFORM = 1 / 257


class Words(NamedTuple):
    """The words of a block: hashes, 32 bits of the one before (0: none), and each document's first word."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    key: np.ndarray
    before: np.ndarray
    at: np.ndarray


def words_of(data: np.ndarray, offs: np.ndarray) -> Words:
    low = tk.LOWER[data]
    s, e, at = tk.word_spans(low, offs, tk.ALNUM)
    sums = tk.prefix_hash(low)
    key = tk.span_hash(sums, s, e)
    before = np.zeros(len(key), np.int64)
    before[1:] = (key[:-1] >> np.uint64(32)).view(np.int64)
    before[at[:-1][np.diff(at) > 0]] = 0
    return Words(low, s, e, sums, key, before, at)


def _pair_key(key: np.ndarray, before: np.ndarray) -> np.ndarray:
    return tk.mix(key + (before.astype(np.uint64) + np.uint64(1)) * _PAIR)


def _binary(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at])])


def _pairs(rows: DataFrame) -> DataFrame:
    """(w, v, head, ordinary, toxic): how many different words come before the pair v w in each class, written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for lo, hi, data, offs in tk.blocks(batch.column(0)):
                x = words_of(data, offs)
                doc = tk.owner(x.at, len(x.key))
                further = np.zeros_like(x.before)
                further[1:] = np.where(doc[1:] == doc[:-1], x.before[:-1], 0)
                before = x.before << 32 | further
                _, one, own = np.unique(_pair_key(x.key, before), return_index=True, return_inverse=True)
                toxic = np.bincount(own, label[lo:hi][doc], len(one))
                head = _binary(x.low, x.start[one], np.minimum(x.end - x.start, DEPTH)[one])
                columns = [pa.array(x.key[one].view(np.int64)), pa.array(before[one]), head, pa.array(np.bincount(own, minlength=len(one)) > toxic), pa.array(toxic > 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["w", "uv", "head", "ordinary", "toxic"])

    met = rows.select("text", "label").mapInArrow(tk.tidy(count), "w long, uv long, head binary, ordinary boolean, toxic boolean")
    met = met.groupBy("w", "uv").agg(F.first("head").alias("head"), *[F.max(c).alias(c) for c in ("ordinary", "toxic")])
    v = F.shiftright("uv", 32).cast("int").alias("v")
    return store.write_table(met.groupBy("w", v).agg(F.first("head").alias("head"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("ordinary", "toxic")]), "pairs")


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, parent, level, ordinary, toxic, needed) of all beginnings of a batch's words, and of the whole words."""
    for batch in batches:
        head = batch.column(1).cast(pa.large_binary())
        _, ends, raw = head.buffers()
        offs = np.frombuffer(ends, np.int64)[head.offset : head.offset + len(head) + 1]
        data, s = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]], offs[:-1] - offs[0]
        size = np.diff(offs)
        sums = tk.prefix_hash(data)
        o, t, needed = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
        level = [(n, np.flatnonzero(size >= n)) for n in range(1, DEPTH + 1)] + [(DEPTH + 1, np.arange(len(size)))]
        for n, of in level:
            if n > DEPTH:
                key, parent = batch.column(0).to_numpy().view(np.uint64) ^ _WHOLE, tk.span_hash(sums, s, s + size)
            else:
                key, parent = tk.span_hash(sums, s[of], s[of] + n), tk.span_hash(sums, s[of], s[of] + n - 1)
            one_key, one, own = np.unique(key, return_index=True, return_inverse=True)
            add = lambda x: np.bincount(own, x[of], len(one)).astype(np.int64)  # noqa: E731, B023
            columns = [one_key.view(np.int64), parent[one].view(np.int64), np.full(len(one), n), add(o), add(t), add(needed)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COLUMNS)


_COLUMNS = ["key", "parent", "level", "ordinary", "toxic", "needed"]


class Counts(NamedTuple):
    """What the models are made of, from the rows of the counted folds; columns of numpy arrays.

    beginnings: key, parent, level and continuation counts; pairs: w, v and counts; before: v and its totals."""

    beginnings: dict[str, np.ndarray]
    total: np.ndarray
    pairs: dict[str, np.ndarray]
    before: dict[str, np.ndarray]


def count(rows: DataFrame) -> Counts:
    """Counts over ``rows`` (text, label).  What occurs once in a class and never twice in one is all discounted."""
    pairs = _pairs(rows)
    most = F.greatest("ordinary", "toxic")
    of_class = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in ("ordinary", "toxic")]
    words = pairs.groupBy("w").agg(F.first("head").alias("head"), *of_class, F.max((most > 1).cast("long")).alias("needed"))
    nodes = words.mapInArrow(tk.tidy(_beginnings), ", ".join(f"{c} long" for c in _COLUMNS))
    nodes = nodes.groupBy("key").agg(F.first("parent").alias("parent"), F.first("level").alias("level"), *[F.sum(c).alias(c) for c in _COLUMNS[3:]])
    nodes = nodes.filter((most > 1) | (F.col("needed") > 0) | (F.col("level") == 1)).drop("needed")
    often = pairs.filter(most > 1).select("w", "v", "ordinary", "toxic")
    before = pairs.groupBy("v").agg(*[F.sum(c).alias(c) for c in ("ordinary", "toxic")], F.max(most).alias("most")).filter("most > 1").drop("most")
    got = [{c: t[c].to_numpy() for c in t.column_names} for t in (nodes.toArrow(), often.toArrow(), before.toArrow())]
    first = got[0]["level"] == 1
    return Counts(got[0], np.array([got[0][c][first].sum() for c in ("ordinary", "toxic")], float), got[1], got[2])


class Estimates:
    """Discounted estimates of both classes for one discount, as log ratios of toxic to ordinary."""

    def __init__(self, counts: Counts, discount: float) -> None:
        b = counts.beginnings
        order = np.argsort(b["key"].view(np.uint64))
        key, parent, level = b["key"][order].view(np.uint64), b["parent"][order].view(np.uint64), b["level"][order]
        n = np.stack([b["ordinary"], b["toxic"]])[:, order].astype(float)
        place = Table(key, np.zeros(len(key)))
        up = place.find(parent)
        up[level == 1] = -1
        over = np.maximum(n - discount, 0)
        taken = np.stack([np.bincount(up[up >= 0], over[c][up >= 0], len(key)) for c in (0, 1)]) if len(key) else n
        freed = n - taken
        both = n.sum(0)
        shared = (both + _UNIFORM) / (np.where(up >= 0, both[up], counts.total.sum()) + 1) if len(key) else both
        log = np.zeros_like(n)
        for k in range(1, DEPTH + 2):
            own = np.flatnonzero(level == k)
            p = shared[own]
            if k > 1:
                m = n[:, up[own]]
                p = np.where(m > 0, (over[:, own] + freed[:, up[own]] * p) / np.maximum(m, 1), p)
            log[:, own] = np.log(p) + (log[:, up[own]] if k > 1 else 0)
        rest = np.where(level <= DEPTH, np.log(np.where(n[1] > 0, freed[1] / np.maximum(n[1], 1), 1)) - np.log(np.where(n[0] > 0, freed[0] / np.maximum(n[0], 1), 1)), 0.0)
        #: The log ratio of a word whose longest kept beginning this is.
        self.spelling = Table(key, (log[1] - log[0] + rest).astype(np.float32))

        q, v = counts.pairs, counts.before
        by_v = np.argsort(v["v"])
        names = v["v"][by_v]
        total = np.stack([v["ordinary"], v["toxic"]])[:, by_v].astype(float)
        of = np.searchsorted(names, q["v"])
        m = np.stack([q["ordinary"], q["toxic"]]).astype(float)
        over = np.maximum(m - discount, 0)
        left = total - np.stack([np.bincount(of, over[c], len(names)) for c in (0, 1)]) if len(names) else total
        share = np.where(total > 0, left / np.maximum(total, 1), 1)
        before = (names.astype(np.uint32).astype(np.int64)).view(np.uint64)
        key = tk.mix(before)
        by_key = np.argsort(key)
        self.before = Table(key[by_key], (np.log(share[1]) - np.log(share[0]))[by_key].astype(np.float32))
        word = np.exp(log[:, place.find(q["w"].view(np.uint64) ^ _WHOLE)]) if len(of) else m
        p = np.where(total[:, of] > 0, (over + left[:, of] * word) / np.maximum(total[:, of], 1), word)
        key = _pair_key(q["w"].view(np.uint64), q["v"].astype(np.uint32).astype(np.int64))
        by_key = np.argsort(key)
        self.pairs = Table(key[by_key], (np.log(p[1]) - np.log(p[0]))[by_key].astype(np.float32))

    def ratios(self, x: Words, history: bool = True) -> np.ndarray:
        """Log of toxic over ordinary probability of every word, after the word before it or by itself."""
        distinct, one, own = np.unique(x.key, return_index=True, return_inverse=True)
        start, size = x.start[one], x.end[one] - x.start[one]
        value = np.zeros(len(one))
        alive = np.arange(len(one))
        for n in range(1, DEPTH + 2):
            ends = alive[(size[alive] < n) | (n > DEPTH)]  # their next symbol is the end
            found, got = self.spelling.get(distinct[ends] ^ _WHOLE)
            value[ends[found]] = got[found]
            alive = alive[size[alive] >= n] if n <= DEPTH else alive[:0]
            found, got = self.spelling.get(tk.span_hash(x.sums, start[alive], start[alive] + n)) if len(alive) else (np.zeros(0, bool), np.zeros(0))
            alive = alive[found]
            value[alive] = got[found]
        if not history:
            return value[own]
        out = value[own] + self.before.get(tk.mix(x.before.astype(np.uint64)))[1]
        found, got = self.pairs.get(_pair_key(x.key, x.before))
        return np.where(found, got, out)


class Model:
    """Estimates with what turns a text's words into a score."""

    def __init__(self, estimates: Estimates | None, history: bool, share: float, power: float, slope: float, level: float) -> None:
        self.estimates, self.history, self.share, self.power, self.slope, self.level = estimates, history, share, power, slope, level

    def score(self, x: Words) -> np.ndarray:
        n = np.diff(x.at)
        sums = evidence(self.estimates.ratios(x, self.history), x.at, self.share) if self.estimates else np.zeros(len(n))
        return 1 / (1 + np.exp(-np.clip(self.level + self.slope * sums / np.maximum(n, 1) ** self.power, -40, 40)))


def evidence(ratios: np.ndarray, at: np.ndarray, share: float) -> np.ndarray:
    """Of each document: the log ratio of a text that is toxic in a share of its words to an ordinary one."""
    total = np.concatenate([[0.0], np.cumsum(np.log1p(share * np.expm1(np.clip(ratios, -30, 30))))])
    return total[at[1:]] - total[at[:-1]]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope, level and loss of y on x, by Newton steps with a little shrinkage."""
    scale = max(float(np.std(x)), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        g = z.T @ (p - y) + 1e-3 * w
        w -= np.clip(np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), g), -3, 3)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return w[0] / scale, w[1], -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    rows = store.write_table(labelled.training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, bound), "toxic")
    n = {(r["fold"], r["label"] > 0): r["n"] for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = lambda label: sum(v for (f, x), v in n.items() if x == label and f != CALIBRATION)
    if not all(n.get((CALIBRATION, x)) and of(x) for x in (False, True)):
        share = sum(v for (_, x), v in n.items() if x) / max(1, sum(n.values()))
        return Model(None, False, 1.0, 1.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else -40.0 if not share else 40.0)
    counts = count(rows.filter(F.col("fold") != CALIBRATION))
    models = [Estimates(counts, discount) for discount in DISCOUNTS]
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(0)):
                x = words_of(data, offs)
                got = [evidence(ratios, x.at, share) for m in shared.value for history in HISTORIES for ratios in [m.ratios(x, history)] for share in SHARES]
                columns = [batch.column(1).slice(lo, hi - lo), pa.array(np.diff(x.at), pa.int64()), pa.array(np.stack(got, 1).tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "n", "sums"])

    t = rows.filter(F.col("fold") == CALIBRATION).select("text", "label").mapInArrow(tk.tidy(measure), "label int, n long, sums array<double>").toArrow()
    shared.destroy()
    y, length, sums = (t["label"].to_numpy() > 0).astype(float), t["n"].to_numpy(), np.array(t["sums"].to_pylist())
    tried = [(*_logistic(sums[:, k] / np.maximum(length, 1) ** power, y), k, power) for k in range(sums.shape[1]) for power in POWERS]
    slope, level, _, k, power = min(tried, key=lambda x: x[2])
    k, share = divmod(k, len(SHARES))
    return Model(models[k // len(HISTORIES)], HISTORIES[k % len(HISTORIES)], SHARES[share], power, slope, level)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``toxicity``, a double; ``docs`` has a string column text."""
    spark = docs.sparkSession
    store.ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    sent = keep if "text" in keep else [*keep, "text"]
    where = sent.index("text")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("toxicity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(where)):
                own = pa.array(shared.value.score(words_of(data, offs)))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[: len(keep)], own], names=[*keep, "toxicity"])

    return docs.select(*sent).mapInArrow(tk.tidy(run), schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    store.ship_package(docs.sparkSession)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", (labelled.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't judged toxic, all columns as they are."""
    store.ship_package(docs.sparkSession)
    names = ["text" if c == "text" else f"_c{k}" for k, c in enumerate(docs.columns)]
    return score(docs.toDF(*names), fit(docs, labels), names).filter("toxicity < 0.5").select(*names).toDF(*docs.columns)
