"""Token files against the tokenizers library, the coder against exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from claimloom.llm import rangecoder, tokenfile
from claimloom.llm.queries import END, TOKENIZER, op11_token_files, read
from claimloom.session import new_path

PATH = public_tokenizers.path(TOKENIZER)


def library(rows):
    """(doc_id, start, n, crc32) of (doc_id, text) in the order of the files, each text encoded whole."""
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def found(df):
    return [tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]


@pytest.mark.parametrize("n", [1, 2, 100, 4096, 4097, 9000])
@pytest.mark.parametrize("most", [1, 3, 300, 50257])
def test_coder_round_trip(n, most):
    ids = np.random.default_rng(n + most).integers(0, most, n).astype(np.int32)
    blocks = rangecoder.pack(ids, 50257)
    assert np.array_equal(np.concatenate(rangecoder.unpack(blocks)), ids)
    assert np.array_equal(np.concatenate(rangecoder.unpack(blocks[::-1])[::-1]), ids), "blocks know nothing of each other"


def test_coder_predicts():
    """Repeats cost little: order 1 knows a cycle, and order 0 a skewed choice."""
    cycle = np.tile(np.arange(500, 600, dtype=np.int32), 41)[:4096]
    assert len(rangecoder.pack(cycle, 50257)[0]) < 4096 / 8 + 400
    skewed = np.random.default_rng(1).choice(16, 4096, p=[0.5] + [0.5 / 15] * 15).astype(np.int32)
    assert len(rangecoder.pack(skewed, 50257)[0]) < 4096 * 4.6 / 8


def test_orders_are_mixed():
    """Ids that only the two before them tell are cheaper than the one before could make them."""
    rng, ids = np.random.default_rng(2), [1, 2]
    for _ in range(4094):
        ids.append((7 * ids[-1] + 3 * ids[-2]) % 23 if rng.random() < 0.97 else int(rng.integers(23)))
    assert len(rangecoder.pack(np.array(ids, np.int32), 50257)[0]) < 4096 * 3 / 8  # log2(23) is 4.5 bits


def test_damage_is_an_error():
    ids = np.arange(5000, dtype=np.int32)
    block = rangecoder.pack(ids, 50257)[0]
    for broken in (block[:-2], b"", block[:40] + bytes([block[40] ^ 1]) + block[41:], block[:8] + b"\0\0\0\0" + block[12:]):
        with pytest.raises(ValueError):
            rangecoder.unpack([broken])


def test_bounds_of_ids():
    with pytest.raises(ValueError):
        rangecoder.pack(np.array([5], np.int32), 5)
    with pytest.raises(ValueError):
        rangecoder.pack(np.array([5], np.int32), (1 << 20) + 1)
    assert rangecoder.pack(np.empty(0, np.int32), 9) == [] and rangecoder.unpack([]) == []
    top = np.array([(1 << 20) - 1, 0, 7], np.int32)
    assert np.array_equal(rangecoder.unpack(rangecoder.pack(top, 1 << 20))[0], top)


def test_crc32_joined():
    a, b = b"some bytes", bytes(range(256)) * 77
    for cut in (0, 1, 5, len(b)):
        assert rangecoder.crc32_joined(zlib.crc32(a), zlib.crc32(b[:cut]), cut) == zlib.crc32(a + b[:cut])


TEXTS = [
    "", None, " ", "a", " a", "a ", "  a  b ", "one two  three\n four\t five", "don't can't  we'll ' s", "é à ü  x 　 y  z", "x\u0085 y z",
    "<|endoftext|> a <|endoftext|>", "12 34 5 6 #2 ##", "word " * 3000, "漢字 かな 한글 \U0001f600 \U0001f600", "a\x00b \x1c c \x1c d", "  q  r",
]


def test_pieces_equal_whole_texts():
    own, tokenizer = tokenfile.Pieces(PATH), Tokenizer.from_file(PATH)
    ids, sizes = own.ids([(x or "").encode() for x in TEXTS])
    want = [tokenizer.encode(x or "", add_special_tokens=False).ids for x in TEXTS]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    ids, sizes = own.ids([b"ab \xff\xfe cd", b"ok"])
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in ("ab �� cd", "ok")]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_pieces_are_encoded_once_while_they_are_kept(monkeypatch):
    """Over several portions, behind marks too; forgetting costs time and nothing else."""
    tokenizer = Tokenizer.from_file(PATH)
    marks = [f"one{chr(k)}two one{chr(k)} two{chr(k)}{chr(k)}x it's{chr(k)}'s {chr(k)}one a{chr(k)}\n\n  b" for k in range(128)]
    marks += ["Fin.\nNow, go.\n\n- so (it) is;the <|endoftext|> x<|endoftext|>.y one<|endoftext|>", "été.Là one…two １.a ab.\u2003c", "we'll.I've,they're\n'd a'.b ' a.'"]
    portions = [marks, TEXTS, marks[::-1], TEXTS + marks]
    for bound in (tokenfile.KNOWN, 0):
        monkeypatch.setattr(tokenfile, "KNOWN", bound)
        own, learned, real = tokenfile.Pieces(PATH), [], tokenfile.Pieces.learn
        monkeypatch.setattr(own, "learn", lambda pieces: learned.extend(pieces.to_pylist()) or real(own, pieces))
        for portion in portions:
            ids, sizes = own.ids([(x or "").encode() for x in portion])
            want = [tokenizer.encode(x or "", add_special_tokens=False).ids for x in portion]
            assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
        assert learned and (len(learned) == len(set(learned))) == (bound > 0)


def test_added_tokens_are_not_cut(tmp_path):
    added = Tokenizer.from_file(PATH)
    added.add_special_tokens(["[MASK]", "no.end"])
    path = str(tmp_path / "added.json")
    added.save(path)
    texts = ["one [MASK] two[MASK], no.end one.two no.end.", "a [MASK]b c.no.end d"]
    ids, _ = tokenfile.Pieces(path).ids([x.encode() for x in texts])
    assert ids.tolist() == [i for x in texts for i in added.encode(x, add_special_tokens=False).ids]


def test_whole_table(spark, path):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, path, "documents").orderBy("doc_id").collect()]
    assert found(op11_token_files(spark, path)) == library(rows)


def test_files_give_back_the_ids(spark):
    rows = [Row(doc_id=i, text=x, shard="x", data=1.5) for i, x in enumerate(TEXTS)]
    path = new_path(spark, "token-files")
    tokenfile.write(spark.createDataFrame(rows, "doc_id long, text string, shard string, data double"), path, PATH, shards=3)
    got = {}
    for r in tokenfile.parts(tokenfile.read(spark, path), ids=True).orderBy("shard", "at").collect():
        got.setdefault((r["shard"], r["doc"]), [None, []])
        got[r["shard"], r["doc"]][1] += r["ids"]
        if r["ended"]:
            got[r["shard"], r["doc"]][0] = r["doc_id"]
    tokenizer = Tokenizer.from_file(PATH)
    assert {d: ids for d, ids in got.values()} == {
        i: [*tokenizer.encode(x or "", add_special_tokens=False).ids, END] for i, x in enumerate(TEXTS)}
    assert found(tokenfile.documents(tokenfile.read(spark, path))) == library(list(enumerate(TEXTS)))


def test_ids_nulls_repeats_and_long_texts(spark):
    """Null ids first, text keys, repeated rows, and a text over many blocks."""
    long = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
    rows = [("b", long), ("a", "x"), ("a", "x"), (None, "n"), ("c", None), ("d", long[:50_000])]
    path = new_path(spark, "token-files")
    tokenfile.write(spark.createDataFrame(rows, "doc_id string, text string"), path, PATH, shards=2)
    assert found(tokenfile.documents(tokenfile.read(spark, path))) == library([(None, "n"), ("a", "x"), ("a", "x"), ("b", long), ("c", None), ("d", long[:50_000])])


def test_empty_table(spark):
    path = new_path(spark, "token-files")
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert found(tokenfile.documents(tokenfile.read(spark, path))) == []


def test_batches_of_blocks(spark, monkeypatch):
    """Shards of several batches, whose ends fall on and off the ends of documents."""
    monkeypatch.setattr(rangecoder, "LANES", 2)
    schema, _ = tokenfile._arrow(spark, tokenfile._blocks_of("long"))
    import pyarrow as pa

    sizes = [4095, 4096, 1, 8190, 20_000, 3, 4095]
    texts = ["a" + " a" * (n - 1) for n in sizes]
    monkeypatch.setattr(tokenfile.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 4})())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(sizes))), "text": texts})
    blocks = [r for b in tokenfile._coded([batch], PATH, END, schema) for r in b.to_pylist()]
    decoded = rangecoder.unpack([b["data"] for b in blocks])
    assert sum(map(len, decoded)) == sum(sizes) + len(sizes)
    parts = [p for b, ids in zip(blocks, decoded) for p in tokenfile._parts(b, ids, False)]
    for doc, size in enumerate(sizes):
        mine = [p for p in parts if p["doc"] == doc]
        assert sum(p["n"] for p in mine) == size + 1 and [p["ended"] for p in mine] == [False] * (len(mine) - 1) + [True]
        assert mine[-1]["doc_id"] == doc and (len(mine) == 1) == mine[0]["whole"], (doc, mine)
