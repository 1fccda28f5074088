"""Secret scan: three fixed shapes, and sliding-window entropy over other candidate strings.

A candidate is a run of token letters with a digit, or what other spans and allowed
pieces leave of one. A window slides over it; the counts of its letters change by one letter in and one letter out, and so
does the sum of n * log2(n) from which the Shannon entropy follows. The letters in a
window are counted per character class of the candidate (hex, letters and digits, or
base64), which sets the entropy that random text of the class reaches. Built-in
expressions only.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.llm.spans import few, keyed, matches, same_doc
from claimloom.session import stored
from claimloom.sizing import spread

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs shorter than the bound would be dropped, so they need not match: within one run no later start does better.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_CHARS = 12
#: In the order of spans that start together.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "entropy"]
#: A run that holds a digit; it is looked at from its first letter only, so long runs stay linear.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{%d,}"
#: Character class (the first whose pattern holds) → least entropy in bits of a window of 20.
CLASSES = [("hex", r"^(?:[0-9a-f-]+|[0-9A-F-]+)$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.6), ("base64", r"", 3.7)]
#: Candidates that are known to be no secrets.
ALLOWED = [
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|lorem",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",  # date
    r"^[A-Z0-9_]*_[A-Z0-9_]*$|^[a-z]+(?:[-_/][a-z0-9]+)+$",  # constant, slug or path
    r"^[^A-Za-z]*$|^[^0-9]*$",  # one sort of letter only
]

#: Of these the ones that may lie inside a longer run: there they cut it, and what is left is looked at by itself.
PIECES = "|".join(f"(?:{x})" for x in [ALLOWED[0], ALLOWED[1].replace("^", "").replace("$", ""), ALLOWED[2]])


def parts(found, base):
    """(doc_id, version, start, match): what spans of `base` and PIECES leave of each candidate."""
    run = ["doc_id", "version", "first", "last", "match"]
    found = found.select("doc_id", "version", F.col("start").alias("first"), F.col("end").alias("last"), "match")
    a, b = found.alias("a"), base.alias("b")
    cuts = a.join(b, same_doc() & (F.col("first") < F.col("b.end")) & (F.col("b.start") < F.col("last")))
    cuts = cuts.select(*(f"a.{c}" for c in run), "b.start", "b.end").union(found.select(*run, "last", "last"))
    order = Window.partitionBy("doc_id", "version", "first").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    left = cuts.withColumn("at", F.coalesce(F.max("end").over(order), "first")).filter("at < start")
    piece = F.expr("substr(match, int(at - first + 1), int(start - at))")
    left = left.select("doc_id", "version", "at", piece.alias("part"))
    gone = F.transform(F.regexp_extract_all("part", F.lit(PIECES), 0), lambda x: F.char_length(x))
    both = F.arrays_zip(F.split("part", PIECES, -1).alias("match"), gone.alias("gone"))
    left = left.select("doc_id", "version", "at", F.posexplode_outer(both).alias("i", "x"))
    before = Window.partitionBy("doc_id", "version", "at").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("at") + F.coalesce(F.sum(F.char_length("x.match") + F.coalesce("x.gone", F.lit(0))).over(before), F.lit(0))
    return left.select("doc_id", "version", start.alias("start"), "x.match")


def windows(candidates, window):
    """(doc_id, version, first, i, sum): sum of n * log2(n) over the `window` letters that end at i."""
    run = ["doc_id", "version", "first"]
    letters = candidates.select(*run, F.posexplode(F.split("match", "")).alias("i", "letter")).filter("letter != ''")
    alike = Window.partitionBy(*run, "letter").orderBy("i")
    before = F.count("*").over(alike.rangeBetween(-(window - 1), -1))
    after = F.count("*").over(alike.rangeBetween(0, window - 1))
    term = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    steps = letters.select(*run, "i", (term(before + 1) - term(before)).alias("come"), (term(after - 1) - term(after)).alias("go"))
    order = Window.partitionBy(*run).orderBy("i")
    steps = steps.withColumn("step", F.col("come") + F.lag("go", window, 0.0).over(order))
    return steps.select(*run, "i", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))


def entropy_spans(found, window, classes, allowed):
    """(doc_id, version, kind, start, end): from the first to the last window of a candidate that is random enough."""
    key = ["doc_id", "version"]
    free = found.filter(~F.greatest(F.lit(False), F.lit(False), *(F.col("match").rlike(x) for x in allowed)))
    least = F.lit(classes[-1][2])
    for _, pattern, bits in reversed(classes[:-1]):
        least = F.when(F.col("match").rlike(pattern), F.lit(bits)).otherwise(least)
    free = free.select(*key, F.col("start").alias("first"), least.alias("least"), "match")
    entropy = F.log2(F.lit(float(window))) - F.col("sum") / window
    a, b = windows(free, window).alias("a"), free.alias("b")
    random = a.join(b, same_doc() & (F.col("a.first") == F.col("b.first"))).filter((F.col("i") >= window - 1) & (F.round(entropy, 9) >= F.col("least")))
    ends = random.groupBy("a.doc_id", "a.version", "a.first").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    return ends.select(
        *key, F.lit("entropy").alias("kind"), (F.col("first") + F.col("lo") - (window - 1)).alias("start"),
        (F.col("first") + F.col("hi") + 1).alias("end"),
    )


def scan(docs, window=20, classes=CLASSES, allowed=ALLOWED, doc_id="doc_id", text="text"):
    """The secrets of each document, one row per row of `docs`.

    Columns: doc_id, version (digest of the text), secrets: array of (kind, start,
    end) by start and then kind as in KINDS; code points, end exclusive. Kind
    `entropy` never overlaps a span of another kind. A candidate is cut at other spans
    and at PIECES, and each part of `window` letters or more is looked at by itself;
    parts that `allowed` names are no secrets.

    A null or empty text has no secret. A null doc_id keeps its row. Repeated rows
    give equal rows; rows with one id and other texts are scanned apart. Whole texts
    are scanned, of any length. Only the named columns are read. An empty table gives
    an empty result.
    """
    texts = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    texts = keyed(texts)
    key, span = ["doc_id", "version"], ["kind", "start", "end"]
    hits = stored(matches(texts, [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("candidate", CANDIDATE % window)]), "secret-hits")
    value = F.regexp_extract("match", ASSIGN, 2)
    base = hits.filter((F.col("kind") != "candidate") & ((F.col("kind") != "assign") | (F.char_length(value) >= ASSIGN_CHARS)))
    candidates = parts(hits.filter("kind = 'candidate'"), base).filter(F.char_length("match") >= window)
    more = entropy_spans(stored(candidates, "secret-parts"), window, classes, allowed)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = base.select(*key, *span).union(more.select(*key, *span)).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("found")
    )
    a, b = texts.select(key).alias("a"), spans.alias("b")
    secrets = F.transform(F.coalesce("b.found", F.array().cast("array<struct<start:long,rank:long,end:long,kind:string>>")),
                          lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return a.join(b, same_doc(), "left").select("a.doc_id", "a.version", secrets.alias("secrets"))


def redacted(docs, **params):
    """Rows of `docs` with every secret in `text` replaced by its kind in brackets; n_chars, where there is one, follows.

    Secrets that overlap become one, named after the first; of spans that start together the first in KINDS counts. Texts without a
    secret, null ones too, stay as they are, as do all other columns, whatever their names. Repeated rows stay repeated.
    """
    found = scan(docs, **params).filter(F.size("secrets") > 0).dropDuplicates(["doc_id", "version"])
    found = few(stored(found, "secrets")).alias("b")
    text, spans = F.col("a.text"), F.col("b.secrets")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("b.version"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def replace(done, x):
        gap = F.substr(text, (done["at"] + 1).cast("int"), (x["start"] - done["at"]).cast("int"))
        out = F.when(x["start"] >= done["at"], F.concat(done["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], x["end"]).alias("at"))

    rest = lambda done: F.concat(done["out"], F.substr(text, (done["at"] + 1).cast("int")))
    hit = F.col("b.version").isNotNull()
    new = {"text": F.when(hit, F.aggregate(spans, start, replace, rest)).otherwise(text)}
    if "n_chars" in docs.columns:
        count = F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(hit, count).otherwise(F.col("a.n_chars"))
    same_name = {c: F.col(f"a.`{c}`") for c in docs.columns}
    return docs.alias("a").join(found, same, "left").select(*({**same_name, **new}[c].alias(c) for c in docs.columns))
