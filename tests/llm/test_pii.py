"""Personal data against plain patterns over the whole text."""

import hashlib
import random
import re

from pyspark.sql import Row

from claimloom.llm import pii
from claimloom.llm.queries import QUERIES, pii_columns, read


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans):
    return ",".join(":".join(map(str, x)) for x in spans)


def summary(text):
    found = plain(text or "")
    n = [sum(k == kind for k, _, _ in found) for kind in pii.BASE]
    return *n, hashlib.sha256(joined(found).encode()).hexdigest()


CASES = [
    None, "", "a@b.c@d.e", "a@b@c.d", "x@y..z a.b%c+d@e-f.g.", "@a.b", "é@x.y ü.z@q.w", "a@b.c.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.2.3.4",
    "01.002.0003.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "0" * 13, "0" * 20, "+1 (555) 010-9999", "+12", "+1 2", "+1-",
    "++49 30 1234567 +49 30 1234567", "+1.2.3.4.5.6.7.8.9.0", "call +44 20 7946 0958.", "1" * 5000, "9" * 4400 + ".1.1.1", "a" * 3000 + "@", "@" * 2000,
    "see https://www.example.org/a?b=c. or ftp://x.y", "http:// x://y", "@someone said; a@b.cd", "IBAN DE89370400440532013000, account no: 12-345-678",
    "İ@x.yz 1.1.1.1", "user id: alice_99 usernames login x1y2z", "4111 1111 1111 1111 1111 1111", "12 34 56 78 90 12 34 5",
]


def test_cases(spark):
    rng = random.Random(2)
    noise = ["".join(rng.choice("0123456789.+@ -()aé:/") for _ in range(rng.randrange(80))) for _ in range(2000)]
    rows = [Row(doc_id=i, text=t, spans="x", version=1) for i, t in enumerate(CASES + noise)]
    rows += [rows[3], Row(doc_id=None, text=CASES[11], spans="", version=0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, version int")
    out = pii_columns(pii.scan(df)).collect()
    assert sorted((tuple(r)[:6] for r in out), key=repr) == sorted(((r["doc_id"], *summary(r["text"])) for r in rows), key=repr)
    assert all(r["spans"].startswith(joined(plain(rows[r["doc_id"]]["text"] or ""))) for r in out if r["doc_id"] is not None)


def test_added_kinds():
    anchors = pii.automaton()
    kinds = lambda text: [(k, text[s:e]) for k, s, e in pii.find(text, anchors) if k not in pii.BASE]
    assert kinds("see https://www.example.org/a?b=c. or ftp://x.y") == [("url", "https://www.example.org/a?b=c"), ("url", "ftp://x.y")]
    assert kinds("thanks @some_one, mail a@b.cd") == [("handle", "@some_one")]
    assert kinds("IBAN DE89370400440532013000, account no: 12-345-678") == [("account", "DE89370400440532013000"), ("account", "12-345-678")]
    assert kinds("xhttp://a.bc xxhttps://d.ef HTTPS://g.hi") == [("url", "HTTPS://g.hi")]
    assert kinds("accounts differ, on account of rain, http:// nothing") == []


def test_query(spark, path):
    got = sorted(tuple(r)[:6] for r in QUERIES["op10_pii"][0](spark, path).collect())
    assert got == sorted((r["doc_id"], *summary(r["text"])) for r in read(spark, path, "documents").collect())


def test_empty_table(spark):
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
