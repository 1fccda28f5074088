"""Scans, repair and quality operators on small files."""

import pytest
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.operators import clean, reports
from claimloom.plans.merge import merge_claims
from claimloom.session import new_path
from claimloom.sources import scans, sinks

HEADER = ",".join(schemas.WIDE_COLUMNS)
FULL = 'q1,hi,"a, ""quoted""\nclaim",c,d,pn,ps,rt,https://u/1,rd,False,gu'
OLD = 'q2,"old\nclaim",c,d,pn,ps,rt,https://u/2,rd,True,mr'
EMPTY_LANGUAGE = "q3,en,claim,c,d,pn,ps,rt,https://u/3,rd,False,"


@pytest.fixture(scope="module")
def ragged(spark, tmp_path_factory):
    file = tmp_path_factory.mktemp("csv") / "claims.csv"
    file.write_text("\n".join([HEADER, FULL, OLD, EMPTY_LANGUAGE]) + "\n", encoding="utf-8")
    return scans.read_claims_ragged(spark, str(file))


def test_repair(ragged):
    rows = {r["query"]: r.asDict() for r in clean.repair_shift(ragged).collect()}
    assert list(rows["q1"].values()) == [
        "q1", "hi", 'a, "quoted"\nclaim', "c", "d", "pn", "ps", "rt", "https://u/1", "rd", "False", "gu"]
    assert list(rows["q2"].values()) == [
        "q2", None, "old\nclaim", "c", "d", "pn", "ps", "rt", "https://u/2", "rd", "True", "mr"]
    assert rows["q3"]["language"] is None and rows["q3"]["query_lang"] == "en"


def test_report_and_predicate(ragged):
    assert tuple(reports.corruption_report(ragged).first()) == (3, 1, 0, 33.3)
    marked = {r["query"]: r["is_shifted"] for r in clean.is_shifted(ragged).collect()}
    assert marked == {"q1": False, "q2": True, "q3": False}


def test_merge_refuses_shifted_rows(ragged):
    source = ragged.withColumn("data_source", F.lit(schemas.API))
    with pytest.raises(Exception, match="shifted rows"):
        merge_claims([source]).collect()
    repaired = clean.repair_shift(ragged).withColumn("data_source", F.lit(schemas.API))
    assert {r["review_url"] for r in merge_claims([repaired]).collect()} == {"https://u/1", "https://u/2"}


def test_published_shape_of_the_corruption_share(spark):
    df = spark.range(166_696).select(
        F.when(F.col("id") < 124_413, ",".join("abcdefghijk")).alias(schemas.CORRUPT),
        F.when(F.col("id") >= 124_413, "hi").alias("language"),
    )
    assert tuple(reports.corruption_report(df).first()) == (166_696, 124_413, 0, 74.6)


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_rows_that_no_repair_puts_right(spark, tmp_path):
    short, long = "q,only,ten,d,pn,ps,rt,u,rd,True", 'q,hi,"a,b",c,d,pn,ps,rt,u,rd,False,gu,more'
    ragged = scans.read_claims_ragged(spark, write(tmp_path / "x.csv", HEADER, FULL, OLD, short, long))
    assert tuple(reports.corruption_report(ragged).first()) == (4, 1, 2, 25.0)
    assert sorted(r["reason"] for r in clean.malformed(ragged).collect()) == ["long", "short"]
    assert {r["query"] for r in clean.repair_shift(ragged).collect()} == {"q1", "q2"}


def test_claims_are_read_by_name(spark, tmp_path):
    names = [*reversed(schemas.RAW_COLUMNS), "extra"]
    path = write(tmp_path / "x.csv", ",".join(names), ",".join(f"v_{n}" for n in names), "too,few")
    good, bad = sorted(scans.read_claims(spark, path).collect(), key=lambda r: r[schemas.CORRUPT] is not None)
    assert good.asDict() == {n: f"v_{n}" for n in schemas.RAW_COLUMNS} | {schemas.CORRUPT: None}
    assert bad[schemas.CORRUPT] == "too,few"


def test_a_header_without_a_column_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="matched_query"):
        scans.read_claims(spark, write(tmp_path / "x.csv", HEADER, FULL))
    with pytest.raises(ValueError, match="header"):
        scans.read_claims_ragged(spark, write(tmp_path / "y.csv", ",".join(schemas.RAW_COLUMNS), "a"))


def test_files_with_different_headers_fail(spark, tmp_path):
    write(tmp_path / "a.csv", ",".join(schemas.RAW_COLUMNS), ",".join("abcdefghijk"))
    write(tmp_path / "b.csv", ",".join(reversed(schemas.RAW_COLUMNS)), ",".join("abcdefghijk"))
    with pytest.raises(Exception, match="(?i)header"):
        scans.read_claims(spark, str(tmp_path)).collect()


def test_phrase_columns_are_checked(spark, tmp_path):
    write(tmp_path / "hi_frequent_ngrams.csv", "n,phrase,freq,score,rank", "2,a b,7,,1")
    with pytest.raises(Exception, match="(?i)header"):
        scans.read_phrases(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_formats_read_back_alike(spark, tmp_path, format):
    rows = [('a "quoted"\nline, with comma', " u ", "hi"), (None, "é", "gu")]
    df = spark.createDataFrame(rows, "claim_text string, review_url string, language string")
    sinks.write_by_language(df, str(tmp_path / "t"), format)
    back = sinks.read_written(spark, str(tmp_path / "t"), df.schema, format)
    assert sorted(map(tuple, back.select(df.columns).collect()), key=repr) == sorted(rows, key=repr)


def test_every_response_is_read_or_rejected(spark):
    body = '{"claims":[{"text":"t"}]}'
    rows = [("q", body), ("q", "{}"), ("q", "broken"), ("q", body[:-1]), ("q", '{"error":{"code":429}}'), ("q", None), ("q", "[1]"), ("q", '{"claims":7}'), ("q", '{"claims":null}')]
    landed = spark.createDataFrame(rows, "matched_query string, response string")
    reasons = sorted((r["reason"], r["response"] or "") for r in scans.response_rejects(landed).collect())
    assert reasons == sorted([("unreadable", "broken"), ("unreadable", body[:-1]), ("error", '{"error":{"code":429}}'),
                              ("unreadable", ""), ("unreadable", "[1]"), ("unreadable", '{"claims":7}')])
    assert scans.flatten_responses(landed).count() == 1


def test_drop_missing_markers(spark):
    rows = [("a", "x"), ("NA", "x"), ("None", "x"), (None, "x"), ("", "x"), ("nan", "x"), ("n", None), ("na", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert {r["a"] for r in clean.drop_missing(df).collect()} == {"a", "na"}


def test_clean_and_flagged_are_the_input(spark):
    rows = [("real claim", "u1"), ("Site.in is an independent fact-checking initiative of X", "u2"), (None, "u3")]
    flagged = clean.flag_boilerplate(spark.createDataFrame(rows, "claim_text string, review_url string"))
    path = new_path(spark, "qc-test")
    sinks.write_qc(flagged, path)
    part = {p: {r["review_url"] for r in sinks.read_qc(spark, path, p, flagged.schema).collect()} for p in ("clean", "flagged")}
    assert part == {"clean": {"u1", "u3"}, "flagged": {"u2"}}
    assert {r["review_url"] for r in clean.drop_boilerplate(flagged).collect()} == {"u1", "u3"}


def test_flat_phrase_files(spark, tmp_path):
    (tmp_path / "hi_frequent_ngrams.csv").write_text("phrase,n,freq,score,rank\nएक दो,2,7,,1\n", encoding="utf-8")
    (tmp_path / "gu_yake_phrases.csv").write_text('phrase,n,freq,score,rank\n"ક, ખ",,,0.25,1\n', encoding="utf-8")
    rows = {(r["lang"], r["method"]): r for r in scans.read_phrases(spark, str(tmp_path)).collect()}
    assert rows["hi", "frequent_ngrams"]["freq"] == 7
    assert rows["gu", "yake_phrases"]["phrase"] == "ક, ખ" and rows["gu", "yake_phrases"]["score"] == 0.25


def test_external_map_rejects_unknown_targets(spark):
    with pytest.raises(ValueError):
        scans.map_source(spark.range(1), {"nope": "id"}, "x")
