"""Byte-level BPE against the public library, and an exact round trip."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import Row

from claimloom.llm import bpe, worker
from claimloom.llm.queries import QUERIES, RANKS, read

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def theirs(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(theirs, text):
    ids = theirs.encode_ordinary(text or "")
    digest = lambda x: hashlib.sha256(x).hexdigest()
    return len(ids), digest(",".join(map(str, ids)).encode()), digest((text or "").encode())


def test_query(spark, path, theirs):
    got = sorted(map(tuple, QUERIES["op7_bpe"][0](spark, path).collect()))
    assert got == sorted((r["doc_id"], *expected(theirs, r["text"])) for r in read(spark, path, "documents").collect())


CASES = [
    None, "", " ", "\n\n  \t x", "<|endoftext|> is text", "it's WE'LL", "a" * 3000, "ab" * 2500 + "é", "漢字かな交じり文" * 200, "🎈🧵👩‍👩‍👧‍👦",
    "x\x1cy\x85z\xa0\u2003end ", "1234567890" * 50, "!?" * 700, "é" * 999, "\u0300\u0301", " \u200d\ufeff", "ß" * 5, "\x00\x01",
]


def test_cases(spark, ranks, theirs):
    rng = random.Random(3)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [Row(doc_id=i, text=t, ids="x", decoded=1, version="v") for i, t in enumerate(CASES + noise)]
    rows += [rows[5], Row(doc_id=None, text="null id", ids="", decoded=0, version="")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int, version string")
    out = bpe.decode(bpe.encode(df, ranks, public_tokenizers.PATTERN), ranks).collect()
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"])) for r in out), key=repr)
    assert got == sorted(((r["doc_id"], theirs.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in rows), key=repr)


def test_merges_follow_rank_then_place():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aaa": 258, b"aab": 259}
    assert bpe.merge(b"aaab", ranks) == [256, 257]
    assert bpe.merge(b"aaaa", ranks) == [256, 256]
    assert bpe.merge(b"", ranks) == [] and bpe.merge(b"z", ranks) == [122]


def test_remembered_pieces_are_bounded(ranks, theirs, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    own = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 17}" for i in range(300))
    assert own.encode(text) == theirs.encode_ordinary(text)
    assert len(own.new) <= 3 and len(own.old) <= 3


def test_empty_table(spark, ranks):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), ranks, public_tokenizers.PATTERN).collect() == []


def test_portions_hold_every_row_once():
    rows = ["a" * n for n in (0, 3, 10, 1, 1, 25, 0, 2)] + [None]
    batch = pa.RecordBatch.from_pydict({"text": rows, "id": list(range(9))})
    got = list(worker.portions([batch, batch.slice(0, 0)], "text", 10))
    assert [r for part in got for r in part.column("id").to_pylist()] == list(range(9))
    assert len(got) == 3 and all(part.num_rows for part in got)
