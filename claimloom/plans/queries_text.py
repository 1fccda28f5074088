"""Queries over corpus text: tokens, grams, keyword scores, query seeds."""

from pyspark.sql import functions as F

from claimloom.functions.text import tokenize
from claimloom.operators import inflections, linesketch, sitetext
from claimloom.operators import phrases as ph
from claimloom.operators import yake
from claimloom.plans import seeds as seed_plan
from claimloom.plans import views
from claimloom.plans.views import with_views
from claimloom.session import new_path, stored
from claimloom.sources import scans

LANGS = ("hi", "gu", "mr", "es")
STOPWORDS = 25
TOP = 200
SAMPLE = 60
BATCH = 100

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\x{200C}\x{200D}]+')"

TOKEN_ROWS_SQL = (
    f"select lang, doc_id, unnest(range(len(t))) as pos, unnest(t) as token "
    f"from (select lang, doc_id, {TOKENS} as t from corpus_v)"
)
STOP_SQL = (
    "select lang, token from (select lang, token, row_number() over (partition by lang "
    "order by count(*) desc, token) as r from token_rows group by lang, token) "
    f"where r <= {STOPWORDS}"
)


def _grams_sql(rows, keys, part):
    """Grams of one to three tokens from token rows, by the following tokens."""
    order = f"over (partition by {part} order by pos)"
    return (
        f"select {keys}, n, t1, case when n >= 2 then t2 end as t2, case when n >= 3 then t3 end as t3 "
        f"from (select {keys}, token as t1, lead(token, 1) {order} as t2, lead(token, 2) {order} as t3 "
        f"from {rows}) cross join (values (1), (2), (3)) as ns(n) "
        "where n = 1 or (n = 2 and t2 is not null) or (n = 3 and t3 is not null)"
    )


NO_STOP = " and ".join(
    f"not exists (select 1 from stop_v x where x.lang = g.lang and x.token = g.{c})"
    for c in ("t1", "t2", "t3")
)
GRAM_COUNTS_SQL = (
    "select lang, cast(n as integer) as n, concat_ws(' ', t1, t2, t3) as phrase, count(*) as freq "
    "from gram_rows g {where} group by all"
)
T = ("token_rows", TOKEN_ROWS_SQL)
S = ("stop_v", STOP_SQL)
G = ("gram_rows", _grams_sql("token_rows", "lang", "lang, doc_id"))
COUNTS = ("counts_v", GRAM_COUNTS_SQL.format(where=f"where {NO_STOP}"))
TOP_SQL = (
    "select lang, n, phrase, freq, cast(row_number() over (partition by lang order by freq desc, "
    f"phrase) as integer) as rank from counts_v qualify rank <= {TOP}"
)

BATCH_SQL = (
    "select c.*, cast('0x' || substr(md5(concat_ws(':', c.lang, cast(doc_id as varchar))), 1, 8) as bigint) % k as batch "
    f"from corpus_v c join (select lang, cast(ceil(count(*) / {BATCH}.0) as bigint) as k from corpus_v "
    "group by lang) using (lang)"
)
B = ("batch_v", BATCH_SQL)
SENT_SQL = (
    "select lang, batch, start + unnest(range(len(l))) as sent, unnest(l) as s from (select lang, batch, l, "
    "coalesce(sum(len(l)) over (partition by lang, batch order by doc_id rows between unbounded "
    "preceding and 1 preceding), 0) as start from (select lang, batch, doc_id, list_filter(list_transform("
    r"regexp_split_to_array(text, '[.!?।॥\n]+'), lambda x: regexp_extract_all(x, "
    r"'[\p{L}\p{M}\p{Nd}\x{200C}\x{200D}]+')), lambda y: len(y) > 0) as l from batch_v))"
)
OCC_SQL = (
    "select *, lag(token) over w as lft, lead(token) over w as rgt from (select lang, batch, sent, "
    "unnest(range(len(s))) as pos, unnest(s) as raw, lower(unnest(s)) as token from sent_v) "
    "window w as (partition by lang, batch, sent order by pos)"
)
STATS_SQL = (
    "select lang, batch, token as term, count(*) as tf, "
    r"count(*) filter (regexp_matches(raw, '^\p{Lu}[\p{Lu}\p{Nd}]+$')) as acr, "
    r"count(*) filter (pos > 0 and regexp_matches(raw, '^\p{Lu}')) as cap, "
    "median(sent) as med, count(distinct sent) as sf, count(lft) as nl, count(distinct lft) as dl, "
    "count(rgt) as nr, count(distinct rgt) as dr from occ_v group by lang, batch, token"
)
FEATURES_SQL = (
    "select lang, batch, term, tf, greatest(acr, cap) / (1 + ln(tf)) as f_case, ln(ln(3 + med)) as f_pos, "
    "tf / (avg(tf) filter (content) over b + stddev_pop(tf) filter (content) over b) as f_norm, "
    "1 + (case when nl > 0 then dl / nl else 0 end + case when nr > 0 then dr / nr else 0 end) * tf / max(tf) over b as f_rel, "
    "sf / n_sents as f_sent from (select *, not exists (select 1 from stop_v x where x.lang = st.lang "
    "and x.token = st.term) as content from stats_v st) join (select lang, batch, count(*) as n_sents from sent_v "
    "group by all) using (lang, batch) window b as (partition by lang, batch)"
)
TERMS_SQL = (
    "select *, (f_rel * f_pos) / (f_case + f_norm / f_rel + f_sent / f_rel) as score from features_v"
)
Y = [
    B, ("sent_v", SENT_SQL), ("occ_v", OCC_SQL), ("stats_v", STATS_SQL),
    ("features_v", FEATURES_SQL), ("terms_v", TERMS_SQL),
]
CAND_SQL = (
    "select lang, batch, t1, t2, t3, count(*) as kf, exists (select 1 from stop_v x where x.lang = g.lang and "
    "x.token = g.t2) and t3 is not null as inner_stop from gram_rows g where not exists (select 1 from stop_v x "
    "where x.lang = g.lang and x.token in (g.t1, coalesce(g.t3, g.t2, g.t1))) group by all"
)
YP = [
    T, S, *Y,
    ("gram_rows", _grams_sql("occ_v", "lang, batch", "lang, batch, sent")),
    ("cand_v", CAND_SQL),
    ("phrase_v", (
        "select c.lang, c.batch, concat_ws(' ', t1, t2, t3) as phrase, kf, "
        "a.score * coalesce(b.score, 1) * coalesce(d.score, 1) / (kf * (1 + a.score + "
        "coalesce(b.score, 0) + coalesce(d.score, 0))) as score from cand_v c "
        "join terms_v a on (a.lang, a.batch, a.term) = (c.lang, c.batch, c.t1) "
        "left join terms_v b on b.lang = c.lang and b.batch = c.batch and b.term = c.t2 and not c.inner_stop "
        "left join terms_v d on d.lang = c.lang and d.batch = c.batch and d.term = c.t3"
    )),
]
MERGED_YAKE = ("yake_v", (
    "select lang, phrase, score, batches, cast(row_number() over (partition by lang order by score, "
    "phrase) as integer) as rank from (select lang, phrase, round(avg(score), 8) as score, count(*) as batches "
    f"from phrase_v group by lang, phrase) qualify rank <= {TOP}"
))
PICKED = ("picked_v", (
    "select lang, 'frequent_ngrams' as method, phrase, rank from top_v union all "
    "select lang, 'yake_phrases', phrase, rank from yake_v"
))
SEEDS_SQL = (
    "select query, query_lang, (select string_agg(distinct a.query_lang, ',' order by a.query_lang) from all_v a "
    "where a.query = b.query) as query_langs from all_v b qualify row_number() over (partition by query "
    "order by r, query_lang) = 1"
)
ALL_QUERIES = ("all_v", (
    "select source as query, 'en' as query_lang, 0 as r from documents union all "
    "select phrase, lang, r from (select lang, phrase, row_number() over (partition by lang, method order by "
    "case when phrase like '% %' then 0 else 1 end, rank, phrase) as r from picked_v) where r <= 100"
))
FREQUENT = [("doc_grams", G[1]), ("counts_v", COUNTS[1].replace("gram_rows", "doc_grams")), ("top_v", TOP_SQL)]


def stopwords(spark, sf):
    """Stopword table: what dominates the corpus itself."""
    counts = ph.ngram_counts(views.corpus(spark, sf), (1,))
    top = ph.top_phrases(counts, STOPWORDS).select("lang", F.col("phrase").alias("token"))
    return stored(top, "stopwords")


def batches(spark, sf):
    return yake.yake_batches(views.corpus_as_read(spark, sf), BATCH, languages=LANGS)


def frequent(spark, sf, stop=None):
    stop = stopwords(spark, sf) if stop is None else stop
    return ph.top_phrases(ph.ngram_counts(views.corpus_as_read(spark, sf), stopwords=stop), TOP)


def phrase_scores(spark, sf, stop=None):
    return yake.yake_phrases(batches(spark, sf), stopwords(spark, sf) if stop is None else stop)


def seed_terms(spark, sf):
    return views.documents(spark, sf).select(
        F.col("source").alias("query"), F.lit("en").alias("query_lang")
    ).distinct()


def seed_list(spark, sf):
    phrases = seed_plan.ranked_phrases(
        views.corpus_as_read(spark, sf), stopwords(spark, sf), TOP, BATCH, languages=LANGS
    )
    return ph.build_seeds(seed_terms(spark, sf), phrases, 100)


def corpus_lines(spark, sf):
    """The corpus as text files, read back as lines."""
    path = new_path(spark, "corpus")
    lines = views.corpus(spark, sf).select("lang", F.explode_outer(F.split("text", "\n")).alias("value"))
    lines.write.partitionBy("lang").text(path)
    return scans.read_corpus(spark, {lang: f"{path}/lang={lang}" for lang in LANGS})


LINES = ("lines_v", "select lang, unnest(string_split(text, chr(10))) as text from corpus_v")


def sketched_lines(spark, sf):
    """The line cap from the sketches of three landings."""
    path, lines = new_path(spark, "line-sketches"), views.corpus(spark, sf)
    for i in range(3):
        linesketch.add_lines(lines.filter(F.col("doc_id") % 3 == i), i, path, SAMPLE, "doc_id", LANGS)
    return linesketch.capped_lines(spark, path, SAMPLE, "doc_id", LANGS)


INFLECTED = {
    "lang": "lang",
    "text": "concat(text, ' ', replace(text, ' ', case lang when 'gu' then 'ોમાં ' else 'ों ' end))",
}
SUFFIXES_SQL = (
    "select lang, token, left(token, length(token) - k) as stem, right(token, k) as suffix from vocab_v, "
    "(values (1), (2), (3)) as ks(k) where length(token) - k >= 2"
)
ENDINGS_SQL = (
    "select c.lang, suffix, count(v.token) as stems from cut_v c left join vocab_v v on v.lang = c.lang and v.token = c.stem "
    "group by all having count(v.token) >= 20 and count(v.token) * 100 >= count(*) * 50"
)
FORMS_SQL = (
    "select c.lang, c.token, c.stem, c.suffix, e.stems from cut_v c join stop_v s on s.lang = c.lang and s.token = c.stem "
    "join ending_v e on e.lang = c.lang and e.suffix = c.suffix where not exists (select 1 from stop_v x where "
    "x.lang = c.lang and x.token = c.token) qualify row_number() over (partition by c.lang, c.token order by length(stem) desc) = 1"
)
INFLECTED_V = ("inflected_v", "select " + ", ".join(f"{e} as {n}" for n, e in INFLECTED.items()) + " from corpus_v")
FORMS = [
    T, S, INFLECTED_V, ("vocab_v", f"select distinct lang, unnest({TOKENS}) as token from inflected_v where lang is not null"),
    ("cut_v", SUFFIXES_SQL), ("ending_v", ENDINGS_SQL),
]


def inflected(spark, sf):
    """The corpus with each line said twice, the second time with endings."""
    return views._select(views.corpus(spark, sf), INFLECTED)


SITE_PAGES = {
    "host": "concat(source, '.example.org')",
    "url": "concat('https://', source, '.example.org/a/', cast(doc_id as STRING))",
    "text": (
        "case when doc_id % 9 = 4 then concat('Read every check that ', source, ' has published here!') when doc_id % 9 < 3 then text "
        "else concat(text, chr(10), 'Read every check that ', source, ' has published here. Write to us about it, please. ', text) end"
    ),
}
KEY_SQL = r"trim(regexp_replace(lower({p}), '[^\p{{L}}\p{{M}}\p{{Nd}}]+', ' ', 'g'))"
PIECES_SQL = (
    "select host, url, i, piece, " + KEY_SQL.format(p="piece") + " as key from (select host, url, unnest(range(len(p))) as i, unnest(p) as piece "
    r"from (select host, url, regexp_extract_all(text, '[^.!?।॥\n]*[.!?।॥\n]+|[^.!?।॥\n]+') as p from site_pages_v))"
)
SENTENCES_SQL = (
    "select p.host, key as sentence, count(distinct url) as pages, host_pages from piece_v p join (select host, count(distinct url) as "
    "host_pages from site_pages_v group by host) h on h.host = p.host where len(string_split(key, ' ')) >= 4 group by p.host, key, host_pages "
    "having count(distinct url) >= 5 and count(distinct url) * 100 >= host_pages * 10"
)
MARKED_SQL = (
    "select url, bool_and(x.sentence is not null) filter (key <> '') as every, bool_or(x.sentence is not null) as cut, "
    "string_agg(piece, '' order by i) filter (key <> '' and x.sentence is null) as own "
    "from piece_v p left join sentence_v x on x.host = p.host and x.sentence = p.key group by url"
)
SITE = [
    ("site_pages_v", views._sql(SITE_PAGES, "documents")), ("piece_v", PIECES_SQL), ("sentence_v", SENTENCES_SQL),
]


def site_pages(spark, sf):
    return views._select(views.documents(spark, sf), SITE_PAGES)


def site_sentences(spark, sf):
    pages = site_pages(spark, sf)
    return sitetext.spelt(pages, stored(sitetext.site_sentences(pages, F.col("host")), "site-sentences"), F.col("host"))


def site_marks(spark, sf):
    pages = site_pages(spark, sf)
    found = stored(sitetext.site_sentences(pages, F.col("host")), "site-sentences")
    return sitetext.mark_site_text(pages, found, F.col("host"), "text").select("url", "is_site_text", "own_text")


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


QUERIES = {
    "indic_tokens": (
        lambda s, d: ph.token_rows(views.corpus(s, d)),
        with_views("select lang, doc_id, cast(pos as integer) as pos, token from token_rows", T),
    ),
    "corpus_line_cap": (
        lambda s, d: ph.sample_lines(views.corpus(s, d), SAMPLE, "doc_id", LANGS),
        with_views(
            "select * exclude (r) from (select *, row_number() over (partition by lang order by "
            f"md5(concat_ws(':', lang, cast(doc_id as varchar)))) as r from corpus_v) where r <= {SAMPLE}"
        ),
    ),
    "corpus_line_cap_text": (
        lambda s, d: ph.sample_lines(corpus_lines(s, d), SAMPLE, languages=LANGS),
        with_views(
            "select lang, text, md5(concat(lang, ':', text)) as line_id from (select lang, text, row_number() over (partition "
            "by lang order by md5(concat(lang, ':', text))) as r from lines_v) where r <= " + str(SAMPLE), LINES,
        ),
    ),
    "corpus_line_cap_sketched": (
        sketched_lines,
        with_views(
            "select * exclude (r) from (select *, row_number() over (partition by lang order by "
            f"md5(concat_ws(':', lang, cast(doc_id as varchar)))) as r from corpus_v) where r <= {SAMPLE}"
        ),
    ),
    "stopword_inflections": (
        lambda s, d: inflections.inflected_stopwords(inflected(s, d), stopwords(s, d)), with_views(FORMS_SQL, *FORMS),
    ),
    "site_sentences": (site_sentences, with_views("select * from sentence_v", *SITE)),
    "site_text_marks": (
        site_marks,
        with_views(
            "select s.url, coalesce(every, false) as is_site_text, case when not cut or cut is null then text "
            r"else nullif(trim(regexp_replace(own, '[ \t\n\r\f\x{00A0}]+', ' ', 'g')), '') end as own_text "
            "from site_pages_v s left join marked_v m on m.url = s.url", *SITE, ("marked_v", MARKED_SQL),
        ),
    ),
    "stopword_removal": (
        lambda s, d: ph.drop_stopwords(ph.token_rows(views.corpus(s, d)), stopwords(s, d)),
        with_views(
            "select lang, doc_id, cast(pos as integer) as pos, token from token_rows g where not "
            "exists (select 1 from stop_v x where x.lang = g.lang and x.token = g.token)", T, S,
        ),
    ),
    "ngram_counts": (
        lambda s, d: ph.ngram_counts(views.corpus_as_read(s, d)),
        with_views(GRAM_COUNTS_SQL.format(where=""), T, G),
    ),
    "top_phrases": (frequent, with_views(TOP_SQL, T, S, G, COUNTS)),
    "top_phrases_by_threshold": (
        lambda s, d: ph.frequent_phrases(views.corpus(s, d), TOP, stopwords=stopwords(s, d)),
        with_views(TOP_SQL, T, S, G, COUNTS),
    ),
    "yake_batches": (
        lambda s, d: batches(s, d).select("doc_id", "lang", "batch"),
        with_views("select doc_id, lang, batch from batch_v", B),
    ),
    "yake_term_scores": (
        lambda s, d: _rounded(
            yake.yake_terms(batches(s, d), stopwords=stopwords(s, d)),
            "f_case", "f_pos", "f_norm", "f_rel", "f_sent", "score",
        ),
        with_views(
            "select lang, batch, term, tf, round(f_case, 6) as f_case, round(f_pos, 6) as f_pos, "
            "round(f_norm, 6) as f_norm, round(f_rel, 6) as f_rel, round(f_sent, 6) as f_sent, "
            "round(score, 6) as score from terms_v", T, S, *Y,
        ),
    ),
    "yake_phrase_scores": (
        lambda s, d: _rounded(phrase_scores(s, d), "score"),
        with_views("select lang, batch, phrase, kf, round(score, 6) as score from phrase_v", *YP),
    ),
    # The same scores in one row a batch: all phrases, but a result that is quickly compared. No score is negative, so halves round up.
    "yake_phrase_score_sums": (
        lambda s, d: phrase_scores(s, d).groupBy("lang", "batch").agg(
            F.count(F.lit(1)).alias("phrases"), F.sum("kf").alias("kf"), F.size(F.collect_set(F.length("phrase"))).cast("long").alias("lengths"),
            F.sum(F.floor(F.col("score") * 1e5) + (F.pmod(F.col("score") * 1e5, F.lit(1.0)) >= 0.5).cast("long")).alias("score_sum"),
            F.round(F.max("score"), 6).alias("score_max"), F.min_by("phrase", F.struct(F.round("score", 6), "phrase")).alias("best"),
        ),
        with_views(
            "select lang, batch, count(*) as phrases, cast(sum(kf) as bigint) as kf, count(distinct length(phrase)) as lengths, "
            "cast(sum(cast(round(score * 1e5) as bigint)) as bigint) as score_sum, max(round(score, 6)) as score_max, "
            "arg_min(phrase, (round(score, 6), phrase)) as best from phrase_v group by lang, batch", *YP,
        ),
    ),
    "yake_ranked_phrases": (
        lambda s, d: yake.merge_yake(phrase_scores(s, d), TOP),
        with_views("select * from yake_v", *YP, MERGED_YAKE),
    ),
    "query_seed_list": (
        seed_list, with_views(SEEDS_SQL, *YP, *FREQUENT, MERGED_YAKE, PICKED, ALL_QUERIES),
    ),
}
