"""The jobs as commands: `spark-submit` or `python -m claimloom <command> ...`.

Paths may be anything Spark reads. Claims are CSV when the path ends in `.csv`,
else Parquet. A CSV file is read by its header; the twelve-column layout, whose older rows lack a
field, is refused unless `--repair` is given, and a row that no repair puts right fails the job.
"""

import argparse

from pyspark.sql import functions as F

from claimloom import schemas
from claimloom.operators import clean, phrases, reports
from claimloom.plans import archive, merge, seeds
from claimloom.session import get_spark
from claimloom.sources import scans, sinks
from claimloom.streaming import ingest


def _pairs(values, sep):
    return dict(v.split(sep, 1) for v in values)


def _claims(spark, path, mend=False):
    """Claims of a path, with every row in its right columns or none at all."""
    if not path.endswith(".csv"):
        return spark.read.parquet(path)
    names = scans.csv_header(spark, path)
    if sorted(names) != sorted(schemas.WIDE_COLUMNS):
        return merge.refuse_shifted(scans.read_claims(spark, path))
    if not mend:
        raise SystemExit(f"{path} has the twelve-column layout, whose older rows lack a field: run repair, or pass --repair")
    ragged = scans.read_claims_ragged(spark, path)
    report = reports.corruption_report(ragged).first()
    print(f"{path}: {report['total_rows']} rows, {report['shifted_rows']} put right, {report['malformed_rows']} malformed")
    if report["malformed_rows"]:
        raise SystemExit(f"{path} has rows that no repair puts right: run repair, which lists them")
    return clean.repair_shift(ragged).withColumnRenamed("query", "matched_query")


def sample(spark, a):
    """Capped text lines per language, to `lang=..` folders."""
    corpus = scans.read_corpus(spark, _pairs(a.input, ":"))
    lines = phrases.sample_lines(corpus, a.max_lines, languages=tuple(_pairs(a.input, ":")))
    lines.select("lang", "text").write.mode("overwrite").partitionBy("lang").text(a.outdir)


def rank(spark, a):
    """Both ranked phrase lists of every language."""
    languages = tuple(_pairs(a.input, ":"))
    corpus = scans.read_corpus(spark, _pairs(a.input, ":"))
    if a.sample:
        corpus = phrases.sample_lines(corpus, a.sample, languages=languages)
    stop = spark.read.schema("lang string, token string").csv(a.stopwords, header=True)
    out = seeds.ranked_phrases(corpus, stop, a.top, a.batch_size, "line_id", languages)
    sinks.write_phrases(out, a.outdir)


def query_seeds(spark, a):
    """Query list from given seeds and phrase lists."""
    given = spark.read.schema("query string, query_lang string").csv(a.seeds, header=True)
    out = phrases.build_seeds(given, scans.read_phrases(spark, a.phrases), a.top_per_file)
    out.write.mode("overwrite").csv(a.output, header=True, escape='"')


def collect(spark, a):
    """Landed search responses into the claims table, once each; unreadable ones beside it, with the reason."""
    rejects = a.table.rstrip("/") + "-rejects"
    ingest.response_stream(spark, a.landing, a.table, a.checkpoint, rejects).awaitTermination()
    spark.read.parquet(rejects).groupBy("reason").count().show()


def split(spark, a):
    """Claims by language, others dropped."""
    sinks.write_by_language(clean.rename_query(clean.keep_languages(_claims(spark, a.input, a.repair)).drop("query_lang")), a.outdir, a.format)


def repair(spark, a):
    """Shifted rows put back into place, malformed ones beside them; prints how many there were."""
    ragged = scans.read_claims_ragged(spark, a.input, a.header.split(","))
    clean.repair_shift(ragged).write.mode("overwrite").parquet(a.outdir)
    clean.malformed(ragged).write.mode("overwrite").parquet(a.outdir.rstrip("/") + "-malformed")
    reports.corruption_report(ragged).show()


def frontier(spark, a):
    """Article addresses that are neither landed nor disallowed."""
    rules = spark.read.schema("host string, prefix string, allow boolean").csv(a.rules, header=True)
    pages = scans.read_pages(spark, a.pages)
    archive.next_pages(pages, rules, a.pattern).write.mode("overwrite").text(a.output)


def extract(spark, a):
    """Claims of landed pages into a table, once each."""
    ingest.extract_stream(spark, a.landing, a.table, a.checkpoint, a.lang).awaitTermination()
    reports.extraction_mix(spark.read.schema(schemas.SCRAPED).parquet(a.table)).show()


def qc(spark, a):
    """Clean copy and flagged rows; prints the report."""
    flagged = clean.flag_boilerplate(_claims(spark, a.input, a.repair), a.pattern or clean.BOILERPLATE)
    sinks.write_qc(flagged, a.outdir, format=a.format)
    reports.qc_report(flagged).show(truncate=False)


def merge_all(spark, a):
    """Sources (`label=path`) into the 22-column table per language, with accounting."""
    frames = [
        _claims(spark, path, a.repair).withColumn("data_source", F.lit(label))
        for label, path in _pairs(a.source, "=").items()
    ]
    sinks.write_merged(merge.merge_claims(frames), a.outdir, a.format)
    reports.merge_summary(merge.union_sources(frames)).show()


def parser():
    top = argparse.ArgumentParser(prog="claimloom")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, *flags):
        sub = commands.add_parser(name, help=run.__doc__.strip().splitlines()[0])
        sub.set_defaults(run=run)
        for flag, options in flags:
            sub.add_argument(flag, **options)

    claims = [("--repair", {"action": "store_true"}), ("--format", {"choices": ["parquet", "csv"], "default": "parquet"})]
    need, many = {"required": True}, {"required": True, "action": "append"}
    command("sample", sample, ("--input", many), ("--max-lines", {"type": int, "default": 300_000}), ("--outdir", need))
    command(
        "phrases", rank, ("--input", many), ("--stopwords", need), ("--top", {"type": int, "default": 200}),
        ("--sample", {"type": int, "default": 0}), ("--batch-size", {"type": int, "default": 1000}), ("--outdir", need),
    )
    command(
        "seeds", query_seeds, ("--phrases", need), ("--seeds", need),
        ("--top-per-file", {"type": int, "default": 100}), ("--output", need),
    )
    command("collect", collect, ("--landing", need), ("--table", need), ("--checkpoint", need))
    command("split", split, ("--input", need), ("--outdir", need), *claims)
    command("repair", repair, ("--input", need), ("--header", {"default": ",".join(schemas.WIDE_COLUMNS)}), ("--outdir", need))
    command("frontier", frontier, ("--pages", need), ("--rules", need), ("--pattern", need), ("--output", need))
    command(
        "extract", extract, ("--landing", need), ("--table", need), ("--checkpoint", need), ("--lang", {"default": None}),
    )
    command("qc", qc, ("--input", need), ("--pattern", {"action": "append"}), ("--outdir", need), *claims)
    command("merge", merge_all, ("--source", many), ("--outdir", need), *claims)
    return top


def main(argv=None, spark=None):
    args = parser().parse_args(argv)
    args.run(spark or get_spark(f"claimloom-{args.command}"), args)


if __name__ == "__main__":
    main()
