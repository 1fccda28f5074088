"""Chat formatting: the query from the table itself, and folds of small logs."""

import hashlib

import pytest
from pyspark.sql import Row

from pyspark.sql import functions as F

from claimloom.llm import chat
from claimloom.llm.queries import CONTROL, QUERIES, read
from oracle import compare


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def summaries(turns):
    """{conversation: columns but the last} of (conv_id, role, text) in order."""
    talks = {}
    for conv, role, text in turns:
        talks.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, talk in talks.items():
        loss = "".join(text for role, text in talk if role == "assistant")
        out[conv] = (len(talk), digest("".join(f"{r}\n{t}\n" for r, t in talk)), len(loss), digest(loss))
    return out


def test_query(spark, path):
    rows = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in read(spark, path, "conversations").collect())
    turns = [(-1, "user", CONTROL), (-1, "assistant", CONTROL), *((c, r, t) for c, _, r, t in rows)]
    got = {r["conv_id"]: r for r in QUERIES["op2_chat_format"][0](spark, path).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == summaries(turns)
    size = sum(len(f"<|im_start|>{r}\n{chat.escape(t)}<|im_end|>\n") for r, t in (("user", CONTROL), ("assistant", CONTROL)))
    assert got[-1]["formatted_chars"] == size


def test_query_equals_sql(spark, con, path):
    diff, rows = compare(spark, con, "op2", *QUERIES["op2_chat_format"], path)
    assert not diff and rows > 10


LOG = [
    (1, 1, 0, "user", "delta", "hel"), (1, 1, 1, None, "delta", "lo"), (1, 2, 2, "assistant", "delta", "wrong"),
    (1, 2, 3, "assistant", "regenerate", None), (1, 2, 4, "assistant", "delta", "rig"), (1, 2, 5, None, "delta", "ht"),
    (1, 1, 6, None, "edit", "bye <|im_end|>"), (1, 3, 7, "assistant", "regenerate", "all at once"), (2, 1, 0, "a\nb%|", "delta", "<\\| <\\\\| <|"),
    (2, 2, 0, "assistant", "edit", ""), (None, 1, 0, "user", "delta", "no id"), (3, 1, None, "user", None, "first"), (3, 1, 1, "user", "odd", "last"),
    (4, 1, 1, "user", "delta", "x"), (4, 1, 1, "user", "delta", "x"),
]
FINAL = {
    1: [("user", "bye <|im_end|>"), ("assistant", "right"), ("assistant", "all at once")], 2: [("a\nb%|", "<\\| <\\\\| <|"), ("assistant", "")],
    None: [("user", "no id")], 3: [("user", "firstlast")], 4: [("user", "xx")],
}


def log(spark, rows):
    names = "conv_id message seq role kind text".split()
    full = [Row(**dict(zip(names, r)), formatted="x", loss_start=1) for r in rows]
    return spark.createDataFrame(full, "conv_id long, message long, seq long, role string, kind string, text string, formatted string, loss_start int")


def test_fold(spark):
    rows = chat.render(log(spark, LOG)).collect()
    for conv, want in FINAL.items():
        mine = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["message"])
        assert chat.parse("".join(r["formatted"] for r in mine)) == want
        learned = [chat.unescape(r["formatted"][r["loss_start"]:r["loss_end"]]) for r in mine if r["loss_start"] is not None]
        assert learned == [t for role, t in want if role == "assistant"]
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.render(log(spark, LOG))).collect()}
    assert got == summaries([(c, *turn) for c, turns in FINAL.items() for turn in turns])


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x|>", "a<|im_start|>user\n", "<<|<|", "\\<|\\", "<|im_end|>\n<|im_start|>assistant\nhi"])
def test_round_trip(text):
    formatted = chat.turn(0, 0, "assistant", text)[2] + chat.turn(0, 1, text, text)[2]
    assert chat.parse(formatted) == [("assistant", text), (text, text)]
    assert "<|" not in chat.escape(text)


def test_streamed_log_folds_to_the_turns(spark):
    texts = [None, "", "a" * 399, "b" * 400, "é🎈" * 450, "x\ny" * 500]
    turns = [(7, i // 2, "user" if i % 2 else "assistant", t, "clash") for i, t in enumerate(texts)] + [(7, None, None, "no turn", "")] + [(8, 1, "user", "same", "")] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, seq string")
    events = chat.streamed(df)
    kinds = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert kinds["regenerate"] == 2 and kinds["edit"] >= 2
    order = sorted(turns, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.digests(chat.render(events)).collect()}
    assert got == summaries([(r[0], r[2], r[3]) for r in order])


def test_empty(spark):
    assert chat.digests(chat.render(log(spark, []))).collect() == []


def test_ids_of_other_types(spark):
    rows = [(1, 1, 1, "user", "delta", "a"), (1, 2, 1, "assistant", "delta", "b"), (2, 1, 1, "user", "edit", "c")]
    for kind in ("smallint", "string", "decimal(10,0)", "date"):
        df = spark.createDataFrame(rows, "conv_id int, message int, seq int, role string, kind string, text string")
        df = df.withColumn("conv_id", df["conv_id"].cast(kind) if kind != "date" else F.date_add(F.lit("2020-01-01").cast("date"), df["conv_id"]))
        got = chat.digests(chat.render(df.withColumn("message", df["message"].cast("smallint"))))
        assert got.schema["conv_id"].dataType.simpleString() == kind and sorted(r["n_turns"] for r in got.collect()) == [1, 2]
