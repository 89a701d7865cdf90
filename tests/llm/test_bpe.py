import functools
import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tamarack.llm import bpe

DOCS = "doc_id long, text string"


def expected(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    back = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_whole_table_and_odd_texts(spark, sf):
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    odd = [(9001, None), (9002, ""), (9003, "a<|endoftext|>b  <|endoftext|>"), (9004, "\u0085 x\x1c\x00 \n\n it's we'LL 12٣ 😀 "), (9005, "zq " * 40_000), (None, "x"), (9002, "")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, DOCS))
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs).collect())
    assert got == sorted((r.doc_id or -1, *expected(tok, r.text)) for r in docs.collect())


def test_rare_words_are_merged_exactly(spark):
    docs = spark.createDataFrame([(1, "the the the unheardof wörd"), (2, "the end")], DOCS)
    one = bpe.encode(docs, lexicon_words=1).collect()
    none = bpe.encode(docs, lexicon_words=0).collect()
    assert {r.doc_id: bytes(r.ids) for r in one} == {r.doc_id: bytes(r.ids) for r in none}


def test_empty_table_and_clashing_columns(spark):
    assert bpe.digests(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame([(1, "a b", 7, "z")], "doc_id long, text string, n_tokens int, lang string")
    row = bpe.encode(docs).first()
    assert (row.n_tokens, row.lang) == (2, "z")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6), min_size=1, max_size=40, unique=True), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer_numbers_its_words(words, others):
    words = sorted(words)
    lexicon = bpe.Lexicon(bpe.build_transducer(words))
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find(others).tolist() == [words.index(w) if w in words else -1 for w in others]


def test_suffixes_are_shared():
    plain = bpe.build_transducer(sorted(a + b for a in (b"a", b"b", b"c") for b in (b"tion", b"ting")))
    assert len(plain["final"]) == 7  # the root, one each after the letter, t, i, tio and tin, and the end


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_split_like_the_library(text):
    pieces = TOK.pre_tokenizer.pre_tokenize_str(text)
    plain, careful = bpe._finders()
    want = [text[a:b] for _, (a, b) in pieces]
    assert careful(text) == want
    if max(text.encode(), default=0) < bpe._NEWER_LEAD:
        assert plain(text) == want


TOK = Tokenizer.from_file(bpe.default_vocabulary())


@pytest.mark.parametrize("word", [b"", b"\xff\xfe", b"aaaaaaaaaaaaaaaa", " naïve".encode()])
def test_merge_is_total(word):
    vocab = bpe.Vocabulary(bpe.default_vocabulary())
    assert b"".join(vocab.bytes_of[i] for i in vocab.merge(word)) == word


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="atehion é", max_size=50), max_size=30))
def test_lockstep_merges_like_one_by_one(words):
    raw = [w.encode() for w in words]
    assert VOCAB.merge_many(raw) == [np.array(VOCAB.merge(w), "<u4").tobytes() for w in raw]


VOCAB = bpe.Vocabulary(bpe.default_vocabulary())


def test_a_word_of_a_million_letters(spark):
    """Unbroken text: ids are the library's, in seconds."""
    tok = Tokenizer.from_file(bpe.default_vocabulary())
    draw = random.Random(5)
    word = "".join(draw.choice("etaoinshrdlu") for _ in range(1 << 20))
    began = time.perf_counter()
    assert vocabulary().merge(word.encode()) == tok.encode(word, add_special_tokens=False).ids
    assert vocabulary().merge(b"a" * 300_000) == tok.encode("a" * 300_000, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60
    rows = [(1, word[:400_000]), (2, word[:400_000]), (3, "é" * 50_000), (4, "中文" * 20_000)]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: expected(tok, t) for i, t in rows}


@functools.cache
def vocabulary():
    return bpe.Vocabulary(bpe.default_vocabulary())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abthein ", min_size=1, max_size=200))
def test_heap_and_lockstep_merge_alike(text):
    words = [w.encode() for w in text.split()]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary().merge_many(words)] == [vocabulary().merge(w) for w in words]
