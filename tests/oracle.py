"""Runs a registered query and its SQL side by side.

    python tests/oracle.py [sf] [name ...]
"""

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("CLAIMLOOM_TESTDATA", "/root/testdata")


def sf_dir(sf):
    return os.path.join(TESTDATA, f"sf{sf}")


def duck(path):
    con = duckdb.connect()
    for file in sorted(os.listdir(path)):
        name = file.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}/{file}')")
    return con


KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE",
}


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark, con, name, run, sql, path):
    """List of differences; empty when schema and rows (as a multiset) agree."""
    df = run(spark, path)
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return [f"columns {columns} != {sorted(rel.columns)}"], 0
    theirs = dict(zip(rel.columns, map(str, rel.types)))
    diff = [
        f"type of {c}: {types[c]} != {theirs[c]}" for c in columns
        if KINDS.get(types[c]) != theirs[c] and theirs[c] != '"NULL"'
    ]
    ours = Counter(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    at = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in rel.fetchall())
    if ours != want:
        diff.append(f"rows {sum(ours.values())} != {sum(want.values())}; columns {columns}")
        diff += [f"  only ours {str(r)[:400]}" for r in list((ours - want))[:3]]
        diff += [f"  only sql  {str(r)[:400]}" for r in list((want - ours))[:3]]
    return diff, sum(ours.values())


if __name__ == "__main__":
    from claimloom.plans.registry import all_queries
    from claimloom.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark, con = get_spark("oracle", 8), duck(sf_dir(sf))
    bad = 0
    for name, (run, sql) in all_queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            diff, rows = compare(spark, con, name, run, sql, sf_dir(sf)) if sql else ([], run(spark, sf_dir(sf)).count())
        except Exception as e:  # report and go on to the next query
            diff, rows = [f"{type(e).__name__}: {str(e)[:1500]}"], 0
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name:32} {rows:8} rows {time.time() - start:6.1f}s", flush=True)
        for d in diff:
            print("    ", d, flush=True)
    print("failed:", bad)
    sys.exit(bool(bad))
