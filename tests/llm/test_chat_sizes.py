import hashlib

import pytest
from pyspark.sql import functions as F

from tamarack.llm import chat

ROWS = [(1, 0, "user", "a<|"), (1, 1, "assistant", "b"), (1, 2, "us\ner", "c\\"), (1, 3, "assistant", "dd"), (1, 4, "user", "e"), (2, 0, "user", "x")]


def turn(role, text):
    role, text = (x.replace("\\", "\\\\").replace("<|", "<\\|") for x in (role, text))
    role = role.replace("\n", "\\n")
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_a_lost_row_is_noticed(spark):
    examples = chat.expand(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match="context"):
        chat.read_back(examples.filter("example <> 0 OR conv_id <> 1")).collect()


def test_formatted_chars_and_lengths_of_whole_examples(spark):
    examples = chat.expand(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    text = ["".join(turn(*r[2:]) for r in ROWS[:n]) for n in (2, 4)]
    rest = [len(turn(*r[2:])) for r in ROWS[4:]]
    read = {r.conv_id: (r.formatted_chars, r.n_examples, r.examples_sha256) for r in chat.read_back(examples).collect()}
    assert read == {1: (len(text[0]) + len(text[1]) + rest[0], 2, digest("".join(map(digest, text)))), 2: (rest[1], 0, digest(""))}
    shared = {(r.conv_id, r.example): r.prefix_chars + len(r.segment) for r in examples.collect() if r.target_start is not None}
    whole = {(r.conv_id, r.example): len(r.text) for r in chat.whole_examples(examples).collect()}
    assert shared == whole == {(1, 0): sum(len(turn(*r[2:])) for r in ROWS[:2]), (1, 1): sum(len(turn(*r[2:])) for r in ROWS[:4])}


@pytest.mark.parametrize(
    ("column", "value", "message"),
    [("target_start", "target_start - 1", "mask"), ("target_end", "target_end - 1", "mask"), ("segment", "replace(segment, '|>assistant', '|>assistent')", "mask"), ("segment", "replace(segment, '<|im_start|>assistant', '<?im_start|>assistant')", "turns")],
)
def test_whole_examples_are_checked(spark, column, value, message):
    examples = chat.expand(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string"))
    with pytest.raises(Exception, match=message):
        chat.read_back(examples.withColumn(column, F.expr(value))).collect()


def whole(rows):
    return chat._batch(rows, [*chat.WHOLE], [*chat.WHOLE.values()])


def test_reading_takes_each_example_with_its_context():
    a, b, c, d, e = (turn(*r[2:]) for r in ROWS[:5])
    first, second, rest = (1, 0, a + b, len(a + b) - 12, len(a + b) - 11), (1, 1, a + b + c + d, len(a + b + c + d) - 13, len(a + b + c + d) - 11), (1, 2, e, None, None)
    (made,) = [r for batch in chat.read(iter([whole([first]), whole([second, rest])])) for r in batch.to_pylist()]
    turns = "".join(f"{r[2]}\n{r[3]}\n" for r in ROWS[:5])
    assert made == {
        "conv_id": 1, "n_turns": 5, "turns_sha256": digest(turns), "loss_chars": 3, "loss_sha256": digest("bdd"),
        "formatted_chars": len(first[2] + second[2] + rest[2]), "n_examples": 2, "examples_sha256": digest(digest(first[2]) + digest(second[2])),
    }
    for text in (second[2].replace("user\na", "user\nz"), c + d, a + c + b + d):
        with pytest.raises(ValueError, match="context"):
            list(chat.read(iter([whole([first, (1, 1, text, len(text) - 13, len(text) - 11)])])))


def test_long_conversation_is_spelled_out_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(chat, "BATCH_CHARS", 50_000)
    rows = [(1, k, "assistant" if k % 2 else "user", f"<|{k}\\") for k in range(1001)]
    spark_rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = [turn(*r[2:]) for r in rows]
    texts = ["".join(formatted[: k + 1]) for k in range(1, 1000, 2)]
    shared = chat.expand(spark_rows).orderBy("prefix_chars").toArrow().to_batches()
    batches = list(chat.spell_out(iter(shared)))
    assert [t for batch in batches for t in batch.column("text").to_pylist()] == [*texts, formatted[-1]]
    assert len(batches) > 100 and max(sum(map(len, batch.column("text").to_pylist())) for batch in batches) <= 50_000
    (read,) = chat.read_back(chat.expand(spark_rows)).collect()
    assert (read.n_turns, read.n_examples, read.formatted_chars) == (1001, 500, sum(map(len, texts)) + len(formatted[-1]))
    assert read.examples_sha256 == digest("".join(map(digest, texts)))
