import hashlib
from itertools import groupby

from hypothesis import given
from hypothesis import strategies as st

from tamarack.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    key = lambda r: tuple((x is not None, x or 0) for x in r[:2]) + (r[2] or "", r[3] or "")
    out = []
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in own]
        replies = "".join(t for r, t in turns if r == "assistant")
        all_of = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(all_of.encode()).hexdigest(), len(replies), hashlib.sha256(replies.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)[:5]) for r in chat.read_back(chat.expand(df)).collect())


ODD = [
    (1, 0, "user", chat.EXTRA_TEXT), (1, 1, "assistant", chat.EXTRA_TEXT), (1, 2, "user", "tail"), (2, 1, "assistant", None), (2, 0, None, "\\<|\\|n\n<<||"), (3, 0, "user", ""), (None, 0, "user", "x"),
    (None, 1, "assistant", "y"), (4, 0, "ro\nle\\", "q"), (4, None, "assistant", "null turn"), (4, 0, "ro\nle\\", "q"), (5, 1, "assistant", "😀é" * 3), (5, 1, "assistant", "a"), (6, 0, "assistant", "z " * 50_000),
]


def test_odd_rows(spark):
    assert got(spark.createDataFrame(ODD, TURNS)) == brute(ODD)


def test_long_stretches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 1)
    rows = [(7, k, "user" if k % 3 else "assistant", f"t{k}") for k in range(40)]
    assert got(spark.createDataFrame(rows, TURNS)) == brute(rows)


def test_empty_and_extra_columns(spark):
    assert got(spark.createDataFrame([], TURNS)) == []
    df = spark.createDataFrame([(1, 0, "assistant", "a", 3)], TURNS + ", segment int")
    assert got(df) == brute([(1, 0, "assistant", "a")])


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()])


def test_examples_have_their_context(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")]
    made = sorted(chat.whole_examples(chat.expand(spark.createDataFrame(rows, TURNS))).collect(), key=lambda r: r.example)
    assert [r.text[r.target_start : r.target_end] for r in made] == ["b", "d"]
    assert made[1].text == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in rows[:4]) and made[1].text.startswith(made[0].text)


@given(st.text(alphabet="<|\\n\n>a"))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
