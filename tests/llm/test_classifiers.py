import zlib

import numpy as np
import pytest

from tamarack.llm import labelled, quality, toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(n=400):
    """Every fourth text is junk, every fifth toxic; words are drawn by rule."""
    docs, labels = [], []
    for k in range(n):
        words = [f"w{(k * 37 + j * j * 11) % 90}" for j in range(20 + k % 30)]
        if k % 5 == 0:
            words[3 : k % 7 + 5 : 2] = ["vilest"] * len(words[3 : k % 7 + 5 : 2])
        text = " ".join(words) + "."
        docs.append((k, text.replace(" ", "%%% ") if k % 4 == 0 else text))
        labels.append((k, int(k % 4 != 0), int(k % 5 == 0)))
    return docs, labels


@pytest.mark.parametrize(("op", "label", "folds", "out"), [(quality, 1, 4, 2), (toxicity, 2, 5, 0)])
def test_held_out_accuracy(spark, op, label, folds, out):
    docs, labels = corpus()
    got = {r.doc_id: r for r in op.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % folds == out) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == labels[i][label] for i in held]) > 0.95


@pytest.mark.parametrize("op", [quality, toxicity])
def test_held_out_labels_play_no_part(spark, op):
    docs, labels = corpus(200)
    folds, out = op.FOLDS, op.HELD_OUT
    other = [(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % folds == out else (i, q, t) for i, q, t in labels]
    a, b = (sorted(op.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("op", [quality, toxicity])
def test_odd_rows(spark, op):
    docs, labels = corpus(120)
    docs += [(None, "x"), (500, None), (501, ""), (7, docs[7][1]), (502, "é " * 30_000), (503, "\x00")]
    labels += [(None, 1, 1), (3, None, None), (3, 1, 0), (999, 0, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS + ", lang string, score int")
    got = op.judged(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1
    assert op.judged(df.limit(0), spark.createDataFrame([], LABELS)).collect() == []
    assert len(op.judged(df, spark.createDataFrame([], LABELS)).collect()) == len(docs)
    assert len(op.judged(df, spark.createDataFrame([(1, 1, 1)], LABELS)).collect()) == len(docs)


def test_sample_is_bounded(spark):
    docs, labels = corpus(400)
    rows = labelled.training_rows(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), "toxic", 5, 0, bound=100)
    assert 50 < rows.count() < 150


def test_ordinary_keeps_columns(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], DOCS + ", toxicity int")
    kept = toxicity.ordinary(df, spark.createDataFrame(labels, LABELS)).collect()
    assert {r.toxicity for r in kept} == {9} and 200 < len(kept) < 260
