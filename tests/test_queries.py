"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry_file
from claimloom.plans.registry import all_queries
from oracle import compare

ALL = all_queries()


@pytest.mark.parametrize("name", list(ALL))
def test_query_equals_sql(spark, con, path, name):
    run, sql = ALL[name]
    assert sql, "every query has a SQL twin so far"
    diff, rows = compare(spark, con, name, run, sql, path)
    assert not diff, "\n".join(diff)
    assert rows > 0


def test_entry_file(spark):
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())
    rows = {r["language"]: r for r in entry_file.entry(spark).collect()}
    assert set(rows) == {"hi", "gu", "mr"}
    for r in rows.values():
        added = r["api_rows_added"] + r["archive_rows_added"] + r["unlabelled_rows"]
        assert r["final_rows"] == r["existing_rows"] + added - r["duplicates_removed"]
