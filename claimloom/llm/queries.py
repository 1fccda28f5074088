"""The registered query of each operator, over its whole table, and its SQL where there is one."""

import public_tokenizers
from pyspark.sql import functions as F

from claimloom.llm import bpe, chat, collocations, embeddings, langid, metrictree, pii, secrets, simhash, tokenfile, toxicity, urlfilter
from claimloom.llm import decontaminate as decontamination
from claimloom.session import new_path


def read(spark, sf, table):
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_language_id(spark, sf):
    docs = read(spark, sf, "documents")
    found = langid.predict(docs, langid.train(docs))
    held_out = F.coalesce(langid.held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "ambiguous")


#: Added to the conversations: turns that look like the end of a turn.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark, sf):
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    return chat.digests(chat.render(chat.streamed(turns.unionByName(added))))


OP2_SQL = rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, x, case x when 0 then 'user' else 'assistant' end, '{CONTROL}' from range(2) r(x)),
f as (select *, concat(role, chr(10), text, chr(10)) as line, length(concat('<|im_start|>',
  replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C'), chr(10),
  regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'), '<|im_end|>', chr(10))) as n from t)
select conv_id, count(*) as n_turns, sha256(string_agg(line, '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(n) as bigint) as formatted_chars
from f group by conv_id
"""


def op3_simhash(spark, sf):
    found = simhash.near_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark, sf):
    found = decontamination.decontaminate(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


WORDS_SQL = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP4_SQL = f"""
with d as (select row_number() over () as r, doc_id, {WORDS_SQL} as ws from documents),
b as (select item_id, {WORDS_SQL} as ws from benchmark),
b1 as (select item_id, ws, least(len(ws), 10) as l from b where len(ws) > 0),
b2 as (select item_id, ws, l, unnest(range(1, len(ws) - l + 2)) as s from b1),
win as (select distinct item_id, l, array_to_string(ws[s:s + l - 1], ' ') as g from b2),
d1 as (select r, ws, l, unnest(range(1, len(ws) - l + 2)) as s from d, (select distinct l from win) where len(ws) >= l),
d2 as (select r, s, l, array_to_string(ws[s:s + l - 1], ' ') as g from d1),
hit as (select r, s, l, item_id from d2 join win using (l, g)),
pos as (select r, count(distinct p) as n_hit from (select r, unnest(range(s, s + l)) as p from hit) group by r),
ids as (select r, count(*) as n_items, string_agg(i, ',' order by i) as items
  from (select distinct r, cast(item_id as varchar) as i from hit) group by r)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (r) left join ids using (r)
"""


#: From this score on a document counts as toxic.
TOXIC = 0.3


def op6_toxicity(spark, sf):
    docs = read(spark, sf, "documents")
    found = toxicity.score(docs, toxicity.train(docs, read(spark, sf, "labels")))
    held_out = F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


#: The vocabulary that texts are encoded with.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op7_bpe(spark, sf, path=None):
    ranks = bpe.load_ranks(path or public_tokenizers.path(RANKS))
    encoded = bpe.encode(read(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_secrets(spark, sf):
    return secret_columns(secrets.scan(read(spark, sf, "documents")))


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def number_of(spans, kind):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def secret_columns(found):
    counted = [number_of("secrets", kind) for kind in secrets.BASE]
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", *counted, F.sha2(joined(base), 256).alias("base_sha256"), joined("secrets").alias("spans"))


URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
#: Hosts with one of these labels have all their pages' URLs listed.
LISTED_HOSTS = r"(?:^|\.)(?:spam-farm|cheap-pills)\."


def op5_url_filter(spark, sf):
    pages = read(spark, sf, "pages")
    listed = pages.filter(urlfilter.host(F.col("url")).rlike(LISTED_HOSTS)).select(urlfilter.canonical(F.col("url")))
    return urlfilter.judge(pages, URL_RULES, listed)


OP5_SQL = """
with p as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from p),
r as (select *, case
  when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
  when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
  when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
  when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
  when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from q)
select page_id, host, path, rule, case rule when 'example.org/en/1' then 'block' when 'example.org/es/' then 'block'
  when 'com/de/' then 'block' when 'com/fr/' then 'allow' when 'org/' then 'allow'
  else case when regexp_matches(host, '(^|[.])(spam-farm|cheap-pills)[.]') then 'block' else 'allow' end end as verdict
from r
"""


def either_case(word):
    """Pattern of a word in ASCII letters of either case; the flag of the other engine also folds beyond ASCII."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN_SQL = (
    "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
# Written out here and not taken from the operator, so that a mistake there shows.
PIECES_SQL = (
    "(?i)(?:example|sample|dummy|placeholder|changeme|redacted|lorem)"
    "|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}"
)
CLASS_SQL = (
    "when regexp_matches(m, '^([0-9a-f-]+|[0-9A-F-]+)$') then 3.0 when regexp_matches(m, '^[A-Za-z0-9]+$') then 3.6 else 3.7"
)
SPARED_SQL = (
    "(contains(m, '_') and regexp_matches(m, '^[A-Z0-9_]+$')) or regexp_matches(m, '^[a-z]+([-_/][a-z0-9]+)+$') "
    "or not regexp_matches(m, '[A-Za-z]') or not regexp_matches(m, '[0-9]')"
)
OP8_SQL = f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
found as (
  select r, 'assign' as kind, 1 as k, regexp_extract_all(text, '{ASSIGN_SQL}') as ms, string_split_regex(text, '{ASSIGN_SQL}') as gs from t
  union all select r, 'access', 2, regexp_extract_all(text, 'AKIA[A-Z0-9]{{14,}}'), string_split_regex(text, 'AKIA[A-Z0-9]{{14,}}') from t
  union all select r, 'hex', 3, regexp_extract_all(text, '[0-9a-f]{{16,}}'), string_split_regex(text, '[0-9a-f]{{16,}}') from t
  union all select r, 'entropy', 4, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{20,}}'), string_split_regex(text, '[A-Za-z0-9+/_=-]{{20,}}') from t),
each as (select *, unnest(range(1, len(ms) + 1)) as i from found where len(ms) > 0),
placed as (select r, kind, k, ms[i] as m, cast(list_sum(list_transform(gs[1:i], lambda x: length(x)))
  + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as a from each),
base as (select r, kind, k, a, a + length(m) as z from placed
  where k < 4 and (k > 1 or length(regexp_extract(m, '{ASSIGN_SQL}', 2)) >= 12)),
cand as (select r, a, m, unnest(range(0, length(m))) as p from placed where k = 4 and regexp_matches(m, '[0-9]')),
free as (select *, p - row_number() over (partition by r, a order by p) as g from cand c
  where not exists (select 1 from base b where b.r = c.r and b.a <= c.a + c.p and c.a + c.p < b.z)),
isle as (select r, a + min(p) as a, string_agg(substr(m, p + 1, 1), '' order by p) as m from free group by r, a, g),
cuts as (select r, a, string_split_regex(m, '{PIECES_SQL}') as gs, regexp_extract_all(m, '{PIECES_SQL}') as ms from isle),
part as (select r, gs[i] as m, cast(a + coalesce(list_sum(list_transform(gs[1:i - 1], lambda x: length(x))), 0)
  + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) as bigint) as a
  from (select *, unnest(range(1, len(gs) + 1)) as i from cuts)),
left_over as (select r, a, m, case {CLASS_SQL} end as least from part where length(m) >= 20 and not ({SPARED_SQL})),
win as (select r, a, least, w, unnest(string_split(substr(m, w + 1, 20), '')) as c
  from (select *, unnest(range(0, length(m) - 19)) as w from left_over)),
ent as (select r, a, least, w, -sum(n / 20 * log2(n / 20)) as h from (select r, a, least, w, c, count(*) as n from win group by all) group by all),
spans as (select r, kind, k, a, z from base union all
  select r, 'entropy', 4, a + min(w), a + max(w) + 20 from ent where round(h, 9) >= least group by r, a),
told as (select *, concat(kind, ':', cast(a as varchar), ':', cast(z as varchar)) as s from spans)
select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
  count(*) filter (kind = 'hex') as n_hex, sha256(coalesce(string_agg(s, ',' order by a, k) filter (k < 4), '')) as base_sha256,
  coalesce(string_agg(s, ',' order by a, k), '') as spans
from t left join told using (r) group by r, doc_id
"""


def op9_embedding_dedup(spark, sf):
    return embeddings.near_duplicates(read(spark, sf, "embeddings"))


OP9_SQL = """
with recursive v as (select vec_id, label, [cast(x as double) for x in embedding] as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a join v b
  on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from reach r join link l on r.b = l.a)
select e.vec_id, coalesce(n, 0) as n_links, component_id, e.vec_id = component_id as kept
from embeddings e left join (select a, count(*) as n from link group by a) n on e.vec_id = n.a
join (select a, min(b) as component_id from reach group by a) c on e.vec_id = c.a
"""


def op10_pii(spark, sf):
    return pii_columns(pii.scan(read(spark, sf, "documents")))


def pii_columns(found):
    counted = [number_of("spans", kind) for kind in pii.BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(pii.BASE))
    return found.select("doc_id", *counted, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


#: The vocabulary whose ids are written to files, and the id behind each document.
TOKENIZER, END = "byte_bpe_50k.json", 2


def op11_token_files(spark, sf, tokenizer=None):
    path = new_path(spark, "token-files")
    tokenfile.write(read(spark, sf, "documents"), path, tokenizer or public_tokenizers.path(TOKENIZER), END)
    return tokenfile.documents(tokenfile.read(spark, path))


def op12_collocations(spark, sf):
    return collocations.collocations(read(spark, sf, "documents"))


OP12_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select row_number() over () as id, lang, regexp_extract_all(piece, '[^ \t]+') as ws from p),
o as (select id, lang, unnest(ws) as w, unnest(range(len(ws))) as i from w),
o5 as (select lang, w as w1, lead(w, 1) over x as w2, lead(w, 2) over x as w3, lead(w, 3) over x as w4, lead(w, 4) over x as w5
  from o window x as (partition by id order by i)),
f as materialized (select lang, phrase, len, count(*) as a from (select lang, len, concat_ws(' ', w1, case when len > 1 then w2 end,
  case when len > 2 then w3 end, case when len > 3 then w4 end, case when len > 4 then w5 end) as phrase from o5, range(1, 6) t(len)
  where len = 1 or (len = 2 and w2 is not null) or (len = 3 and w3 is not null) or (len = 4 and w4 is not null) or (len = 5 and w5 is not null))
  group by all),
t as (select lang, sum(a) as n from f where len = 1 group by lang),
c as materialized (select lang, phrase, len, a, string_split(phrase, ' ') as ws from f where len > 1 and a >= 100),
cuts as (select c.*, k, x.a as l, y.a as r, cast(floor(1000 * cast(c.a as hugeint) * n // (cast(x.a as hugeint) * y.a)) as bigint) as score
  from (select *, unnest(range(1, len)) as k from c) c join f x on x.lang = c.lang and x.phrase = array_to_string(ws[1:k], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(ws[k + 1:c.len], ' ') join t on t.lang = c.lang),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_runs as (select lang, a, len, array_to_string(ws[s:s + m - 1], ' ') as phrase from (
  select *, unnest(range(1, len - m + 2)) as s from (select *, unnest(range(2, len)) as m from c))),
kept as (select * from worst c where not exists (select 1 from inner_runs i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.a >= 100 * c.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select c.lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked c join t on t.lang = c.lang where rank <= 2000
"""


def op13_vector_codes(spark, sf):
    rows, _ = metrictree.compress(read(spark, sf, "embeddings"))
    return rows.drop("label")


def _rounds_sql():
    """Assignments a0 .. a4 to the codebooks b0 .. b4, each from the one before."""
    out = []
    for k in range(5):
        out.append(f"""a{k} as materialized (select id, part, arg_min(entry, (far, entry)) as entry, min(far) as far from (
  select id, p.part, entry, cast(list_inner_product(p.x, p.x) + list_inner_product(e, e) - 2 * list_inner_product(p.x, e) as bigint) as far
  from p join b{k} on p.part = b{k}.part) group by id, part)""")
        if k < 4:
            out.append(f"""b{k + 1} as materialized (select b.part, b.entry, coalesce(m.e, b.e) as e from b{k} b left join (
  select part, entry, list(v order by i) as e from (select part, entry, i, floor(sum(v) / count(*)) as v from (
    select a.part, a.entry, unnest(x) as v, unnest(range(len(x))) as i from a{k} a join p on p.id = a.id and p.part = a.part)
  group by part, entry, i) group by part, entry) m on m.part = b.part and m.entry = b.entry)""")
    return ",\n".join(out)


#: Whole numbers of this size and their products are exact in doubles.
OP13_SQL = f"""
with v as (select row_number() over (order by vec_id) as id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select id, part, e[1 + part * (len(e) // 4):(part + 1) * (len(e) // 4)] as x from v, range(4) t(part)),
b0 as (select part, id - 1 as entry, x as e from p where id <= 256),
{_rounds_sql()},
t as (select id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(far) as bigint) as error from a4 group by id),
h as (select sha256(string_agg(cast(cast(c as bigint) as varchar), ',' order by part, entry, i)) as codebooks_sha256
  from (select part, entry, unnest(e) as c, unnest(range(len(e))) as i from b4)),
s as (select label, cast(sum(error) as bigint) as label_error from v join t using (id) group by label)
select vec_id, code, error, label_error, codebooks_sha256 from v join t using (id) join s on s.label is not distinct from v.label, h
"""


#: Name → (query, SQL or None).
QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_chat_format": (op2_chat_format, OP2_SQL),
    "op3_simhash": (op3_simhash, None),
    "op4_decontamination": (op4_decontamination, OP4_SQL),
    "op5_url_filter": (op5_url_filter, OP5_SQL),
    "op6_toxicity": (op6_toxicity, None),
    "op7_bpe": (op7_bpe, None),
    "op8_secrets": (op8_secrets, OP8_SQL),
    "op9_embedding_dedup": (op9_embedding_dedup, OP9_SQL),
    "op10_pii": (op10_pii, None),
    "op11_token_files": (op11_token_files, None),
    "op12_collocations": (op12_collocations, OP12_SQL),
    "op13_vector_codes": (op13_vector_codes, OP13_SQL),
}
