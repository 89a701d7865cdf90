import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tamarack.llm import bpe, toxicity
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_minmax import shingle_set


def near(rows):
    own, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min(i for (i, _), r in zip(rows, root, strict=True) if r == c) for c in sorted(set(root))]


def test_whole_pipeline(spark, sf):
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    bad = {r.doc_id for r in toxicity.judged(docs, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in bad]
    last = {}
    for i, t in sorted(rows):
        last[t] = i
    rows = [(i, t) for i, t in rows if last[t] == i]
    stay = set(near(rows))
    rows = [(i, t) for i, t in rows if i in stay]
    found = {int(r[1:].split(",")[0]) for r in leaks(rows, [tuple(r) for r in items.select("item_id", "text").collect()]) if r.endswith("True)")}
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for i, t in rows:
        if i not in found:
            ids = tok.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(want)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (None, "x y", "en", "s", 3), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, sf, k):
    stage = corpus_pipeline.STAGES[k][1]
    for some in (ODD, []):
        made = stage(spark, spark.createDataFrame(some, COLUMNS), sf)
        assert made.columns == (corpus_pipeline.COLUMNS if k < 4 else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        assert made.count() == (0 if not some else 2 if k == 1 else 4)


@pytest.mark.parametrize("k", range(5))
def test_stages_pass_clashing_columns_and_long_texts(spark, sf, k):
    """Columns named like those that operators make, and a long text, come through as they are."""
    long = " ".join(f"word{j * j % 7919}" for j in range(60_000)) + " " + "x" * 200_000
    rows = [(*r, 7, 8, 9, 1.5) for r in (*ODD[:3], (3, long, "en", "s", len(long)), (4, "plain text of a few words only", "en", "s", 30))]
    df = spark.createDataFrame(rows, COLUMNS + ", _rid int, n_tokens int, node int, toxicity double")
    made = corpus_pipeline.STAGES[k][1](spark, df, sf)
    got = made.collect()
    if k < 4:
        assert made.columns == df.columns and {tuple(r)[5:] for r in got} == {(7, 8, 9, 1.5)}
        assert {r.text for r in got} >= {long, "plain text of a few words only"} and len(got) == (4 if k == 1 else 5)
    else:
        tok = Tokenizer.from_file(bpe.default_vocabulary())
        assert {r.doc_id: r.n_tokens for r in got}[3] == len(tok.encode(long, add_special_tokens=False).ids)
