"""Personal data by anchor expansion.

An Aho-Corasick automaton goes over a text once and finds anchors: at-signs, schemes,
plus signs, digits and cues of identifiers. From each anchor a small deterministic
parser expands to the borders of what may be there and checks it.
"""

import re
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

from claimloom.llm.spans import keyed
from claimloom.llm.worker import kept, portions
from claimloom.sizing import spread

#: In the order of spans in the digest.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "handle", "account"]
#: Cues of an account or document number, in any case.
CUES = ["iban", "account", "acct", "passport", "ssn", "customer id", "user id", "login", "username"]

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
SCHEMES = ("https", "http", "ftp")
HANDLE = re.compile(r"@[A-Za-z_][A-Za-z0-9_]{1,30}(?![A-Za-z0-9_.@-])")
ACCOUNT = re.compile(r"(?i:\s?(?:no|nr|number|id))?[.:#=\s]{0,3}([A-Za-z0-9][A-Za-z0-9._-]{3,33}[A-Za-z0-9])")
LOCAL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-")


ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def automaton():
    found = ahocorasick.Automaton()
    for sign, sort in [("@", "at"), ("://", "scheme"), ("+", "plus"), *((d, "digit") for d in "0123456789")]:
        found.add_word(sign, (sort, len(sign)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def luhn(digits):
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def email(text, at, free):
    """The address around the at-sign, its local part from `free` on."""
    start = at
    while start > free and text[start - 1] in LOCAL_CHARS:
        start -= 1
    domain = DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def addresses(text, start):
    """Ends of the run of dotted numbers from `start`, and the runs of four that are IP addresses."""
    run = NUMBERS.match(text, start)
    parts, at, found = run[0].split("."), start, []
    for k in range(0, len(parts) - 3, 4):
        end = at + sum(map(len, parts[k:k + 4])) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k:k + 4]):
            found.append((at, end))
        at = end + 1
    return run.end(), found


def card(text, start):
    run = CARD.match(text, start)
    if not run:
        return start + 1, None
    digits = run[0].replace(" ", "").replace("-", "")
    return run.end(), run.span() if 13 <= len(digits) <= 19 and luhn(digits) else None


def phone(text, start):
    run = PHONE.match(text, start)
    if not run:
        return start + 1, None
    return run.end(), run.span() if 9 <= sum(map(str.isdigit, run[0])) <= 15 else None


def url(text, at, free):
    """The address around `://` at `at`, without closing punctuation."""
    scheme = next((s for s in SCHEMES if text[at - len(s):at].lower() == s), "")
    start, rest = at - len(scheme), URL_REST.match(text, at + 3)
    if not scheme or start < free or (start and text[start - 1].isalpha()) or not rest:
        return None
    end = rest.end() - (len(rest[0]) - len(rest[0].rstrip(".,;:!?)]")))
    return (start, end) if end > at + 3 else None


def account(text, cue, after):
    """A name or number behind a cue that stands alone; it must hold a digit."""
    if cue and (text[cue - 1].isalnum() or text[cue - 1] == "_"):
        return None
    found = ACCOUNT.match(text, after)
    if not found or not any(map(str.isdigit, found[1])) or found.start(1) == after:
        return None
    return found.span(1)


def lower_in_place(text):
    """Lower case of the same length; the few letters that grow leave only A-Z lower-cased."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(ASCII_LOWER)


def find(text, anchors):
    """Spans (kind, start, end) of a text in code points, end exclusive, kind by kind and then by start."""
    free = dict.fromkeys(KINDS, 0)
    out = {kind: [] for kind in KINDS}

    def keep(kind, span):
        out[kind].append(span)
        free[kind] = span[1]

    for last, (sort, size) in anchors.iter(lower_in_place(text)):
        at = last - size + 1
        if sort == "digit":
            if at >= free["ip"]:
                free["ip"], spans = addresses(text, at)
                out["ip"] += spans
            if at >= free["card"]:
                free["card"], span = card(text, at)
                out["card"] += [span] if span else []
        elif sort == "at":
            if at >= free["email"] and (span := email(text, at, free["email"])):
                keep("email", span)
            elif (at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "._%+-@")) and (handle := HANDLE.match(text, at)):
                keep("handle", handle.span())
        elif sort == "plus":
            if at >= free["phone"]:
                free["phone"], span = phone(text, at)
                out["phone"] += [span] if span else []
        elif sort == "scheme":
            if at >= free["url"] and (span := url(text, at, free["url"])):
                keep("url", span)
        elif at >= free["account"] and (span := account(text, at, last + 1)):
            keep("account", span)
    return [(kind, *span) for kind in KINDS for span in out[kind]]


def scan(docs, doc_id="doc_id", text="text"):
    """Personal data of each document, one row per row of `docs`.

    Columns: doc_id, version (digest of the text), spans: array of (kind, start, end)
    by kind as in KINDS, then start; code points, end exclusive.

    A null or empty text has none. A null doc_id keeps its row, repeated rows give equal
    rows, rows with one id and other texts are scanned apart. Whole texts are scanned in
    time that grows with their length. Only the named columns are read. An empty table
    gives an empty result.
    """
    texts = keyed(spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    kind = texts.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        anchors = kept("anchors", automaton)
        for batch in portions(batches, "text"):
            spans = ([dict(zip(("kind", "start", "end"), x)) for x in find(t.as_py(), anchors)] for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("version"), pa.array(spans, pa.list_(span))], ["doc_id", "version", "spans"]
            )

    return texts.mapInArrow(run, f"doc_id {kind}, version long, spans array<struct<kind:string,start:long,end:long>>")
