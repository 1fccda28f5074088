"""Landed archive pages → claims → quality check."""

from claimloom.operators.clean import flag_boilerplate
from claimloom.operators.extract import extract_claims
from claimloom.operators.frontier import allowed_urls, article_frontier


def archive_claims(pages, language=None):
    """Extracted claims with the boilerplate flag."""
    return flag_boilerplate(extract_claims(pages, language))


def next_pages(pages, rules, pattern):
    """Article addresses to fetch next, as the crawl rules allow."""
    return allowed_urls(article_frontier(pages, pattern), rules)
