"""CSV files cut at any byte against the same files read whole."""

import random

import pyarrow as pa
import pytest

from claimloom import schemas
from claimloom.sources import csvsplit, scans

COLUMNS = ["a", "b", "c"]


def cut(spark, size):
    """Splits of `size` bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")


@pytest.fixture
def small(spark):
    yield lambda size: cut(spark, size)
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXT = (
    'a,b,c\n1,"two\nlines",x\n2,plain,"say ""hi"", he\n\nsaid",\n"3,4",\n'
    '"\n\n",é,"""q"""\n\nshort\n5,6,7,8\n" kept ",,"a,b"\n9,"""\n""\n""",z\nlast,no,break'
)


def test_every_cut(spark, tmp_path, small):
    (tmp_path / "x.csv").write_text(TEXT)
    want = rows(scans.read_claims(spark, str(tmp_path / "x.csv"), COLUMNS, split=False))
    assert len(want) == 9 and any("\n" in (v or "") for r in want for v in r[:3])
    for size in (1, 2, 3, 4, 5, 7, 11, 16, 23, 31, 47, 60, len(TEXT.encode()), 1000):
        small(size)
        assert rows(scans.read_claims(spark, str(tmp_path / "x.csv"), COLUMNS)) == want, size


def test_one_file_is_many_tasks(spark, tmp_path, small):
    """Also without a header, with plain lines and with a value that is larger than a split."""
    long = '"' + "line of a value\n" * 300 + '"'
    body = "".join(f"{i},plain,\n" for i in range(400)) + f"x,{long},y\n" + "".join(f"{i},more,\n" for i in range(400))
    (tmp_path / "x.csv").write_text(body)
    want = rows(scans.read_claims(spark, str(tmp_path), COLUMNS, header=False, split=False))
    small(700)
    assert csvsplit.lines(spark, str(tmp_path)).rdd.getNumPartitions() > 10
    assert rows(scans.read_claims(spark, str(tmp_path), COLUMNS, header=False)) == want and len(want) == 801


def test_plain_files_are_not_shuffled(spark, tmp_path, small):
    (tmp_path / "x.csv").write_text("a,b,c\n" + '1,"quoted, but whole",3\n' * 200)
    small(500)
    df = scans.read_claims(spark, str(tmp_path), COLUMNS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan and df.count() == 200


def test_random_files(spark, tmp_path, small):
    rng = random.Random(8)
    cell = lambda: "".join(rng.choice(["a", "é", " ", ",", "\n", '"', "9"]) for _ in range(rng.randrange(7)))
    put = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',\n"') or v.strip() != v else v
    for k in range(4):
        lines = [",".join(put(cell()) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(60)]
        (tmp_path / f"{k}.csv").write_text("a,b,c\n" + "\n".join(lines) + rng.choice(["", "\n"]))
    (tmp_path / "empty.csv").write_text("a,b,c\n")
    want = rows(scans.read_claims_ragged(spark, str(tmp_path), COLUMNS, split=False))
    for size in (5, 23, 64, 1000):
        small(size)
        assert rows(scans.read_claims_ragged(spark, str(tmp_path), COLUMNS)) == want, size


def test_windows_line_ends(spark, tmp_path, small):
    (tmp_path / "x.csv").write_bytes(b'a,b,c\r\n1,"x\r\ny",z\r\n2,,q\r\n')
    small(6)
    got = rows(scans.read_claims(spark, str(tmp_path / "x.csv"), COLUMNS))
    assert got == [("1", "x\ny", "z", None), ("2", None, "q", None)]


def test_unclosed_quotes_and_other_headers_are_errors(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n5" tall,b,c\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        scans.read_claims(spark, str(tmp_path / "x.csv"), COLUMNS)
    assert scans.read_claims(spark, str(tmp_path / "x.csv"), COLUMNS, split=False).count() == 1
    (tmp_path / "x.csv").write_text("a,b,c\n1,2,3\n")
    (tmp_path / "y.csv").write_text("b,a,c\n1,2,3\n")
    with pytest.raises(ValueError, match="different headers"):
        scans.read_claims(spark, str(tmp_path), COLUMNS)


def test_empty(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert csvsplit.records(spark, str(tmp_path)).collect() == []
    (tmp_path / "x.csv").write_text(",".join(schemas.RAW_COLUMNS) + "\n")
    assert scans.read_claims(spark, str(tmp_path)).collect() == []


def test_broken_lines_are_not_shuffled(spark, tmp_path, small, monkeypatch):
    """Of a file whose records all span lines, only the ends of splits leave their task; also if the states of splits are not broadcast."""
    body = "a,b,c\n" + "".join(f'{i},"one\ntwo, ""said""\n\n{i}",z\n' for i in range(500))
    (tmp_path / "x.csv").write_text(body)
    want = rows(scans.read_claims(spark, str(tmp_path), COLUMNS, split=False))
    small(2000)
    kept, real = {}, csvsplit.stored
    monkeypatch.setattr(csvsplit, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    df = scans.read_claims(spark, str(tmp_path), COLUMNS)
    assert rows(df) == want and len(want) == 500
    splits = csvsplit.lines(spark, str(tmp_path)).rdd.getNumPartitions()
    assert splits > 5 and 0 < kept["csv-parts"].count() <= 2 * splits
    assert "Exchange hashpartitioning(file" in (plan := df._jdf.queryExecution().executedPlan().toString())
    assert "FileScan text" not in plan.split("Exchange hashpartitioning(file")[-1]
    monkeypatch.setattr(csvsplit, "is_small", lambda df: False)
    kept.clear()
    assert rows(scans.read_claims(spark, str(tmp_path), COLUMNS)) == want


def test_records_over_splits_and_batches():
    """Whole records and ends of splits make up the file, wherever splits and batches begin."""
    rng = random.Random(5)
    for _ in range(300):
        records = [rng.choice(["plain", "", 'a,"b"', '"x\ny"', '"\n\n"', '"l\n""q""\n\nz",1']) for _ in range(rng.randrange(1, 25))]
        data, inside, at, k = [], False, 0, 0
        for line in "\n".join(records).split("\n"):
            if not data or rng.random() < 0.2:
                at, within = at + 10, inside
            data.append({"file": "f", "split": at, "value": line, "within": within, "header": k == 0})
            inside, k = inside ^ (line.count('"') % 2 == 1), k + 1
        table, size = pa.Table.from_pylist(data), rng.randrange(1, 12)

        def run(ends):
            return [r for b in csvsplit._records(ends)(iter(table.to_batches(size))) for r in b.to_pylist()]

        joined, header = [], None
        for part in sorted(run(True), key=lambda r: (r["split"], r["place"])):
            if part["place"] == csvsplit.LAST:
                joined.append(part["value"])
                header = (len(joined) - 1) if part["header"] else header
            else:
                joined[-1] += "\n" + part["value"]
        if header is not None:
            del joined[header]
        assert sorted([r["value"] for r in run(False)] + joined) == sorted(records[1:])
