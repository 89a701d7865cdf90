"""Operator 3: quality by a generalised additive model with pairwise interactions.

A document becomes some twenty numbers about its bytes, words and lines, each cut into bins at the
quantiles of the training rows.  Boosting goes round the features: at each turn one shallow tree on
one feature's histogram of gradients is added to that feature's lookup table.  Then the pairs of
features that explain most of what is left get two-dimensional tables the same way, from trees with
one cut in either feature.  A score is the sum of table entries at a document's bins, taken for a
whole block at once, through the logistic curve.

The model is fitted on a bounded sample of labelled rows (``labelled.MAX_LABELLED``) from which the
tasks compute the numbers; the driver gets only those.  Every row is scored, whole.

Cases: null and empty texts get the bins of zero counts; without labels of both kinds every score is
the share of good labels (1 without labels); null ids are in the fold of the empty text; repeated
rows score alike; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.llm import labelled, store
from tamarack.llm import textkit as tk

FOLDS, HELD_OUT, CUT = 4, 2, 0.7
BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 8, 60, 8, 40, 0.15

_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, 65:91] = True  # upper case
_CLASSES[1, 48:58] = True  # digits
_CLASSES[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True  # punctuation
_CLASSES[3, [33, 44, 46, 58, 59, 63]] = True  # of sentences
_CLASSES[4, 128:] = True
_CLASSES[5, 10] = True
_CLASSES[6, 32] = True
_CLASSES[7, [124, 60, 62, 123, 125, 91, 93, 92]] = True  # of markup and tables
NAMES = (
    "bytes", "words", "upper", "digits", "punctuation", "sentence marks", "other bytes", "newlines", "spaces", "markup", "word length", "word length spread",
    "long words", "short words", "distinct words", "distinct triples", "distinct lines", "words with end marks", "largest word share", "words a line", "symbols of words' ends",
)


def _per_document(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def _kinds(h: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, and how often its most frequent one occurs."""
    key = np.sort(own.astype(np.uint64) << np.uint64(42) | h >> np.uint64(22))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    doc = (key[new] >> np.uint64(42)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, doc, np.diff(np.append(new, len(key))))
    return np.bincount(doc, minlength=n).astype(float), most.astype(float)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of NAMES for each document of a block."""
    n = len(offs) - 1
    low = tk.LOWER[data]
    s, e, at = tk.word_spans(low, offs, tk.NONSPACE)
    sums = tk.prefix_hash(low)
    h, own, length = tk.span_hash(sums, s, e), tk.owner(at, len(s)), e - s
    size, words = np.maximum(np.diff(offs), 1).astype(float), np.diff(at).astype(float)
    some = np.maximum(words, 1)
    marks = [_per_document(c[data], offs) for c in _CLASSES]
    mean = np.bincount(own, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(own, length.astype(float) ** 2, n) / some - mean**2, 0))
    kinds, most = _kinds(h, own, n)
    inside = np.arange(len(h)) + 3 <= np.repeat(at[1:], np.diff(at))
    triples, _ = _kinds(tk.shingles(h, 3)[inside], own[inside], n)
    lines_in = np.ones(256, bool)
    lines_in[10] = False
    ls, le, lat = tk.word_spans(low, offs, lines_in)
    lines, _ = _kinds(tk.span_hash(sums, ls, le), tk.owner(lat, len(ls)), n)
    n_lines = np.maximum(np.diff(lat), 1)
    last = low[e - 1] if len(e) else np.zeros(0, np.uint8)
    odd = _CLASSES[2][last] & ~_CLASSES[3][last]
    columns = [
        np.log1p(np.diff(offs)), np.log1p(words), *(marks[k] / size for k in range(8)), mean, spread,
        np.bincount(own, length > 12, n) / some, np.bincount(own, length < 4, n) / some, kinds / some, triples / np.maximum(words - 2, 1), lines / n_lines,
        np.bincount(own, _CLASSES[3][last], n) / some, most / some, words / n_lines, np.bincount(own, odd, n) / some,
    ]
    return np.stack(columns, 1).astype(np.float32)


class Model:
    """Cuts between bins, and lookup tables of features and of pairs of features."""

    def __init__(self, cuts: list[np.ndarray], base: float) -> None:
        self.cuts, self.base = cuts, base
        self.single = np.zeros((len(cuts), BINS))
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], 1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def logit(self, b: np.ndarray) -> np.ndarray:
        total = np.full(len(b), self.base)
        for k in range(b.shape[1]):
            total += self.single[k, b[:, k]]
        for i, j, t in self.pairs:
            total += t[b[:, i] * COARSE // BINS, b[:, j] * COARSE // BINS]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)), -40, 40)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values by bin of the tree that cuts a histogram where it gains most, again and again."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    parts = [(0, len(g))]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-6, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gain = worth(a, c) + worth(c, b) - worth(a, b)
                if (top := int(gain.argmax())) >= 0 and gain[top] > best[0]:
                    best = (float(gain[top]), (k, a, a + 1 + top, b))
        if best[1] is None:
            break
        k, a, c, b = best[1]
        parts[k : k + 1] = [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(cg[b] - cg[a], ch[b] - ch[a])
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree with one cut in either feature, of two-dimensional histograms."""
    def quarters(x: np.ndarray) -> np.ndarray:
        c = np.zeros((COARSE + 1, COARSE + 1))
        c[1:, 1:] = x.cumsum(0).cumsum(1)
        a = c[1:-1, 1:-1]
        return np.stack([a, c[1:-1, -1:] - a, c[-1:, 1:-1] - a, c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + a])

    qg, qh = quarters(g), quarters(h)
    gain = (qg**2 / (qh + 1.0)).sum(0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = _leaf(qg[:, i, j], qh[:, i, j])
    t = np.empty((COARSE, COARSE))
    t[: i + 1, : j + 1], t[: i + 1, j + 1 :], t[i + 1 :, : j + 1], t[i + 1 :, j + 1 :] = v
    return float(gain[i, j] - g.sum() ** 2 / (h.sum() + 1.0)), t


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1e-9) / max(len(y), 1e-9)
    if not len(y) or share in (0.0, 1.0) or not 0 < y.sum() < len(y):
        return Model([], 40.0 if not len(y) or y.sum() else -40.0)
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(x.shape[1])]
    m = Model(cuts, float(np.log(share / (1 - share))))
    b = m.bins(x)
    total = m.logit(b)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(b.shape[1]):
            g, h = gradient()
            t = RATE * _tree(np.bincount(b[:, k], g, BINS), np.bincount(b[:, k], h, BINS))
            m.single[k] += t
            total += t[b[:, k]]
    coarse = b * COARSE // BINS
    cell = lambda i, j: coarse[:, i] * COARSE + coarse[:, j]
    square = lambda i, j, v: np.bincount(cell(i, j), v, COARSE**2).reshape(COARSE, COARSE)
    g, h = gradient()
    ranked = sorted(((_cross(square(i, j, g), square(i, j, h))[0], i, j) for i in range(b.shape[1]) for j in range(i)), reverse=True)[:PAIRS]
    tables = {(i, j): np.zeros((COARSE, COARSE)) for _, i, j in ranked}
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in tables.items():
            g, h = gradient()
            step = RATE * _cross(square(i, j, g), square(i, j, h))[1]
            t += step
            total += step.ravel()[cell(i, j)]
    m.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return m


def fit(docs: DataFrame, labels: DataFrame, bound: int = labelled.MAX_LABELLED) -> Model:
    rows = labelled.training_rows(docs, labels, "quality", FOLDS, HELD_OUT, bound).select("text", "label")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(0)):
                x = features(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])

    t = rows.mapInArrow(tk.tidy(measure), "label int, x binary").toArrow()
    x = np.frombuffer(b"".join(t["x"].to_pylist()), np.float32).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)  # the model doesn't depend on the order in which rows arrive
    return boost(x[order].astype(float), (t["label"].to_numpy() > 0).astype(float)[order])


def judged(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    store.ship_package(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in tk.blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(features(data, offs)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tk.tidy(run), schema)
    return scored.select("doc_id", (labelled.fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
