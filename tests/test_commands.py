"""The commands one after the other, as in a full collection."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.__main__ import main
from test_extract import BOX, LABELS


@pytest.fixture()
def run(spark):
    return lambda *argv: main([str(a) for a in argv], spark)


def test_corpus_to_queries(spark, run, tmp_path):
    text = tmp_path / "hi.txt"
    text.write_text("\n".join(f"झूठा दावा {i} है" for i in range(30)), encoding="utf-8")
    (tmp_path / "stop.csv").write_text("lang,token\nhi,है\n", encoding="utf-8")
    (tmp_path / "seeds.csv").write_text("query,query_lang\nscheme,en\n", encoding="utf-8")
    run("sample", "--input", f"hi:{text}", "--max-lines", 20, "--outdir", tmp_path / "raw")
    assert spark.read.text(str(tmp_path / "raw")).count() == 20
    run("phrases", "--input", f"hi:{tmp_path}/raw/lang=hi", "--stopwords", tmp_path / "stop.csv",
        "--top", 5, "--batch-size", 7, "--outdir", tmp_path / "lists")
    run("seeds", "--phrases", tmp_path / "lists", "--seeds", tmp_path / "seeds.csv", "--top-per-file", 3,
        "--output", tmp_path / "queries")
    queries = {r["query"] for r in spark.read.csv(str(tmp_path / "queries"), header=True).collect()}
    assert {"scheme", "झूठा दावा"} <= queries and "है" not in queries and len(queries) <= 7


def test_collect_split_merge(spark, run, tmp_path):
    def review(url, lang):
        return {"publisher": {"name": "P", "site": "p.org"}, "url": url, "reviewDate": "2023-01-01",
                "textualRating": "False.", "languageCode": lang}

    body = {"claims": [{"text": "दावा", "claimReview": [review("u1", "hi"), review("u2", "mr"), review("u3", "en")]}]}
    landed = spark.createDataFrame([("q", json.dumps(body)), ("q", "{}"), ("q", "broken")], "matched_query string, response string")
    for _ in range(2):  # the second landing brings the same claims again
        landed.write.mode("append").parquet(str(tmp_path / "landing"))
        run("collect", "--landing", tmp_path / "landing", "--table", tmp_path / "api", "--checkpoint", tmp_path / "ckpt")
    assert spark.read.parquet(str(tmp_path / "api")).count() == 3
    rejected = spark.read.parquet(str(tmp_path / "api-rejects")).collect()
    assert [(r["response"], r["reason"]) for r in rejected] == [("broken", "unreadable")]
    run("split", "--input", tmp_path / "api", "--outdir", tmp_path / "split")
    split = spark.read.parquet(str(tmp_path / "split"))
    assert {(r["language"], r["query"]) for r in split.collect()} == {("hi", "q"), ("mr", "q")}

    with open(tmp_path / "old.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, schemas.RAW_COLUMNS)
        out.writeheader()
        out.writerow({"claim_text": "पुराना,\n\"दावा\"", "review_url": "u1", "language": "hi"})
    run("merge", "--source", f"xfact_2021={tmp_path}/old.csv", "--source", f"google_factcheck_api={tmp_path}/api",
        "--outdir", tmp_path / "merged")
    merged = spark.read.parquet(str(tmp_path / "merged"))
    assert sorted(merged.columns) == sorted(schemas.MERGED_COLUMNS)
    assert {(r["review_url"], r["data_source"], r["rating_clean"]) for r in merged.collect()} == {
        ("u1", "xfact_2021", None), ("u2", "google_factcheck_api", "false")}
    assert merged.filter(F.col("review_url") == "u1").first()["claim_text"] == "पुराना,\n\"दावा\""


def test_archive(spark, run, tmp_path):
    pages = [(1, "https://a.org/p/1", BOX), (2, "https://a.org/p/2", LABELS), (3, "https://a.org/list", "<a href='/p/3'>x</a><a href='/p/1'>y</a><a href='/p/x/4'>z</a>"),
             (4, "https://a.org/p/9", LABELS.replace("दावा", "A.in is an independent fact-checking initiative"))]
    spark.createDataFrame(pages, schemas.PAGE).write.parquet(str(tmp_path / "pages"))
    (tmp_path / "rules.csv").write_text("host,prefix,allow\na.org,/p/x/,false\n", encoding="utf-8")
    run("extract", "--landing", tmp_path / "pages", "--table", tmp_path / "t", "--checkpoint", tmp_path / "c", "--lang", "gu")
    run("qc", "--input", tmp_path / "t", "--outdir", tmp_path / "qc")
    kept = spark.read.parquet(str(tmp_path / "qc" / "part=clean"))
    assert {r["review_url"] for r in kept.collect()} == {"https://a.org/p/1", "https://a.org/p/2"}
    run("frontier", "--pages", tmp_path / "pages", "--rules", tmp_path / "rules.csv", "--pattern", "/p/", "--output", tmp_path / "next")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "next")).collect()] == ["https://a.org/p/3"]


def test_repair(spark, run, tmp_path):
    (tmp_path / "claims.csv").write_text(
        ",".join(schemas.WIDE_COLUMNS) + "\nq,text,c,d,pn,ps,rt,u,rd,False,gu\n", encoding="utf-8")
    run("repair", "--input", tmp_path / "claims.csv", "--outdir", tmp_path / "fixed")
    assert spark.read.parquet(str(tmp_path / "fixed")).first()["language"] == "gu"


def test_mixed_layouts_are_never_merged_as_they_are(spark, run, tmp_path):
    header, full, old = ",".join(schemas.WIDE_COLUMNS), "q,hi,t1,c,d,pn,ps,rt,u1,rd,False,gu", "q,t2,c,d,pn,ps,rt,u2,rd,False,mr"
    path = tmp_path / "claims.csv"
    path.write_text("\n".join([header, full, old]) + "\n", encoding="utf-8")
    merge = ["merge", "--source", f"google_factcheck_api={path}", "--outdir", tmp_path / "merged"]
    with pytest.raises(SystemExit, match="twelve-column"):
        run(*merge)
    run(*merge, "--repair", "--format", "csv")
    merged = spark.read.csv(str(tmp_path / "merged"), header=True)
    assert {(r["review_url"], r["claim_text"], r["language"]) for r in merged.collect()} == {("u1", "t1", "gu"), ("u2", "t2", "mr")}
    run("split", "--input", path, "--repair", "--outdir", tmp_path / "split")
    assert {(r["language"], r["query"]) for r in spark.read.parquet(str(tmp_path / "split")).collect()} == {("gu", "q"), ("mr", "q")}
    path.write_text("\n".join([header, full, full + ",more"]) + "\n", encoding="utf-8")
    with pytest.raises(SystemExit, match="no repair"):
        run(*merge, "--repair")
    run("repair", "--input", path, "--outdir", tmp_path / "fixed")
    assert [r["reason"] for r in spark.read.parquet(str(tmp_path / "fixed-malformed")).collect()] == ["long"]
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("claim_text,url\na,b\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no column"):
        run("qc", "--input", wrong, "--outdir", tmp_path / "qc")
