"""Landmark extraction from article HTML with built-in string expressions."""

from pyspark.sql import functions as F

from claimloom.functions.text import _col, clean_text, non_blank, once

# What is not closed hides the rest of the page.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|<head\b.*?</head\s*>"
# The rest of a tag; a quoted value may hold `>`, and no search goes beyond the next `<`.
REST = r"(?:(?:[^\"'<>]++|\"[^\"<]*+\"|'[^'<]*+')*+>|[^<>]*+>)"
TAG = r"</?[a-zA-Z]" + REST + r"|<[!?][^<>]*+>"
# Elements that hold others and are always closed; paragraphs and list items often are not.
BOX = r"div|section|article|main|header|footer|nav|aside|table|blockquote|figure|ul|ol"
BLOCK_TAG = (
    r"(?i)</?(?:p|" + BOX + r"|h[1-6]|li|tbody|thead|tr|td|th|figcaption|br|hr|html|body)\b" + REST
)
# Marks that stand for tags in `page_boxes`.
OPEN, CLOSE, BOLD, LIGHT, PARAGRAPH = (chr(c) for c in range(1, 6))
DASH_ENTITY = r"(?i)&(?:#8211|#8212|#x2013|#x2014|ndash|mdash);"
NAMED_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}


def _code_point(n):
    valid = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def _after_marker(part):
    """Text behind `&#`, its leading code point decoded if there is one."""
    digits = F.regexp_extract(part, r"^([0-9]{1,7});", 1)
    hexed = F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
    number = F.when(digits != "", digits.try_cast("bigint")).when(
        hexed != "", F.conv(hexed, 16, 10).try_cast("bigint")
    )
    rest = F.regexp_replace(part, r"^[xX]?[0-9A-Fa-f]+;", "")
    return F.coalesce(F.concat(_code_point(number), rest), F.concat(F.lit("&#"), part))


def _numeric_entities(text):
    """Replace `&#2709;` and `&#xA95;`; anything else after `&#` is kept."""

    def decoded(parts):
        tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
        return F.concat(F.get(parts, 0), F.array_join(F.transform(tail, _after_marker), ""))

    return F.when(F.contains(text, F.lit("&#")), once(F.split(text, "&#"), decoded)).otherwise(text)


def _entities(text):
    out = _numeric_entities(text)
    for entity, char in NAMED_ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def unescape(col):
    """Replace character entities; text without any is passed on."""
    return once(col, lambda t: F.when(F.contains(t, F.lit("&")), _entities(t)).otherwise(t))


def fragment_text(col):
    """Visible text of an HTML fragment on one line; blank becomes null."""
    spaced = F.regexp_replace(_col(col), BLOCK_TAG, " ")
    return clean_text(unescape(F.regexp_replace(spaced, TAG, "")))


def page_boxes(html):
    """Page text with one line per block element, entities still escaped.

    A line of its own marks where a box opens and closes and where a paragraph begins or ends; marks within lines tell
    what is bold. Tags are read with their quoted values, once each.
    """
    bare = F.translate(_col(html), OPEN + CLOSE + BOLD + LIGHT + PARAGRAPH, "")
    out = F.regexp_replace(F.regexp_replace(bare, HIDDEN, " "), r"[ \t\n\r\f]+", " ")
    for pattern, mark in (
        (r"(?i)<(?:" + BOX + r")\b" + REST, f"\n{OPEN}\n"), (r"(?i)</(?:" + BOX + r")\b" + REST, f"\n{CLOSE}\n"),
        (r"(?i)</?p\b" + REST, f"\n{PARAGRAPH}\n"), (r"(?i)<(?:strong|b)\b" + REST, BOLD), (r"(?i)</(?:strong|b)\b" + REST, LIGHT),
        (BLOCK_TAG, "\n"), (TAG, ""),
    ):
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_replace(out, r" *\n[ \n]*", "\n")


def lines_of(boxes):
    """`page_boxes` without its marks."""
    return F.regexp_replace(F.regexp_replace(_col(boxes), r"[\x01-\x05]", ""), r" *\n[ \n]*", "\n")


def visible_lines(html):
    """Page text with one line per block element, entities still escaped."""
    return lines_of(page_boxes(html))


def _found(col, pattern):
    return non_blank(F.regexp_extract(col, pattern, 1))


CLAIM_LINE = r"(?i)^claim ?[:–—-]?$"
FACT_LINE = r"(?i)^fact ?[:–—-]?$"
# Up to the next label, or to the end of the paragraph or of its box.
CLAIM_LABEL = (
    r"(?i)\x03+\s*claim\s*[:–—-]\s*\x04+([^\x01\x02\x05]*?)(?:\x03+\s*fact\s*[:–—-]\s*\x04|[\x01\x02\x05]|\z)"
)
# A label of its own line or fused with its value by a colon or dash.
RESULT = r"(?:^|\n)(?:RESULT|Result)(?: ?[:–—-] ?\n?|\n)([^\n]+)"


def result_of(boxes):
    """Value behind the result label, from `page_boxes`."""
    return clean_text(unescape(_found(lines_of(boxes), RESULT)))


# What the fold over the lines of a page has seen: nothing, a claim label, claim text behind it, the end of its box, a fact label.
NOTHING, LABEL, TEXT, ENDED, FOUND = range(5)


def _next_line(s, line):
    claim, fact = line.rlike(CLAIM_LINE), line.rlike(FACT_LINE)
    closes = line == CLOSE
    text = ~line.isin("", OPEN, CLOSE, PARAGRAPH)
    phase, place = s["phase"], s["place"] + 1
    depth = s["depth"] + F.when(line == OPEN, 1).when(closes, -1).otherwise(0)
    done = phase == FOUND
    complete = fact & phase.isin(TEXT, ENDED)
    after = (
        F.when(done | complete, FOUND).when(claim, LABEL).when(fact | (text & (phase == ENDED)), NOTHING)
        .when(text & (phase == LABEL), TEXT).when(closes & (phase == TEXT) & (depth < s["box"]), ENDED).otherwise(phase)
    )
    # Boxes that close before any text held the label only.
    box = F.when(claim, depth).when(closes & (phase == LABEL), F.least(s["box"], depth)).otherwise(s["box"])
    return F.struct(
        place.alias("place"), depth.alias("depth"), after.alias("phase"), box.alias("box"),
        F.when(claim & ~done, place).otherwise(s["first"]).alias("first"), F.when(complete, place).otherwise(s["last"]).alias("last"),
    )


def template_a_claim(boxes):
    """Claim of a "Claim / Fact" box, from `page_boxes`; else null.

    It lies between the two labels and within the box that holds the first, or in that box and the second label right behind it.
    """
    start = F.struct(*(F.lit(0).alias(n) for n in ("place", "depth", "phase", "box", "first", "last")))

    def between(lines):
        def cut(s):
            part = F.slice(lines, s["first"] + 1, F.greatest(s["last"] - s["first"] - 1, F.lit(0)))
            kept = F.filter(part, lambda x: ~x.isin(OPEN, CLOSE, PARAGRAPH))
            return F.when(s["phase"] == FOUND, F.array_join(kept, " "))
        return F.aggregate(lines, start, _next_line, cut)

    plain = F.regexp_replace(_col(boxes), r"[\x03\x04]", "")
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(x))
    # Most pages have no such label and are not folded.
    return once(lines, lambda x: F.when(F.exists(x, lambda y: y.rlike(FACT_LINE)), clean_text(unescape(between(x)))))


def template_b_claim(boxes):
    """Claim behind a bold label within one paragraph, from `page_boxes`; else null."""
    found = _found(F.regexp_replace(_col(boxes), DASH_ENTITY, "–"), CLAIM_LABEL)
    return clean_text(unescape(F.regexp_replace(found, r"[\x03\x04]", "")))


def page_title(html):
    heading = _found(_col(html), r"(?is)<h1\b[^>]*>(.*?)</h1\s*>")
    title = _found(_col(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>")
    return fragment_text(F.coalesce(heading, title))


def page_language(html):
    """Primary language subtag of `<html lang=..>`."""
    return F.lower(_found(_col(html), r"(?is)<html\b[^>]*?\blang=[\"']?([a-z]{2,3})\b"))
