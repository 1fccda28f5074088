"""Collects the registered queries of all modules."""

from claimloom.plans import (
    queries_claims, queries_pages, queries_reports, queries_storage, queries_text,
)

MODULES = (queries_claims, queries_pages, queries_text, queries_reports, queries_storage)


def all_queries():
    out = {}
    for module in MODULES:
        for name, (run, sql) in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = (run, sql)
    return out
