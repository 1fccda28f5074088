"""Language identification by held-out accuracy, and the codes."""

import numpy as np
import pytest
from pyspark.sql import Row

from claimloom.llm import langid
from claimloom.llm.queries import QUERIES, read


def test_held_out_accuracy(spark, path):
    truth = {r["doc_id"]: r["lang"] for r in read(spark, path, "documents").collect()}
    rows = QUERIES["op1_language_id"][0](spark, path).collect()
    assert len(rows) == len(truth) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) >= 0.95


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 7, 8, 40])
def test_codewords_are_far_apart(count):
    code = langid.codewords(count)
    assert len(code) == count
    apart = [int((a != b).sum()) for i, a in enumerate(code) for b in code[i + 1:]]
    assert min(apart, default=1) >= (1 if count < 4 else 2 ** (count - 2) if count <= 7 else code.shape[1] // 4)


def test_one_wrong_bit_is_corrected():
    langs = {k: p for k, p in zip("abcdefgh", np.random.default_rng(1).dirichlet(np.full(langid.BUCKETS * 3, 0.01), 8))}
    model = langid.Model(langs)
    for k in range(8):
        for bit in range(model.code.shape[1]):
            said = model.code[k] * 4.0
            said[bit] *= -0.25
            loss = np.logaddexp(0, -said * model.code) @ model.worth
            assert loss.argmin() == k


TEXTS = {"en": "the quick brown fox jumps over the lazy dog and runs away ", "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg "}


def frame(spark, rows):
    return spark.createDataFrame([Row(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, score string, n_letters int")


def test_edges(spark):
    train = [(i, t * 3, lang) for i in range(40) for lang, t in TEXTS.items()] + [(98, None, "fr"), (99, TEXTS["en"], None)]
    model = langid.train(frame(spark, train))
    assert model.langs == ["de", "en"]
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, TEXTS["en"].upper(), None), (5, TEXTS["de"] * 20000, "x"),
            (6, "漢字", None), (None, TEXTS["de"], None), (4, TEXTS["en"].upper(), None), (7, "a", None), (8, "q" * 700000, None)]
    got = langid.predict(frame(spark, rows), model).collect()
    assert len(got) == len(rows)
    said = {r["doc_id"]: (r["lang_pred"], r["score"], r["ambiguous"]) for r in got}
    assert said[1] == said[2] == said[3] == ("und", 0.0, True)
    assert (said[4][0], said[5][0], said[None][0]) == ("en", "de", "de") and said[6][0] in ("en", "de")
    assert langid.predict(frame(spark, []), model).collect() == []


def test_nothing_or_one_language_to_learn(spark):
    none = langid.train(frame(spark, []))
    assert [tuple(r)[2:4] for r in langid.predict(frame(spark, [(1, "abc", None)]), none).collect()] == [("und", 0.0)]
    one = langid.train(frame(spark, [(i, TEXTS["en"], "en") for i in range(9)]))
    assert [tuple(r)[2:4] for r in langid.predict(frame(spark, [(1, "abc", None)]), one).collect()] == [("en", 1.0)]


def test_long_texts_are_read_whole(spark):
    model = langid.train(frame(spark, [(i, t, lang) for i in range(40) for lang, t in TEXTS.items()]))
    text = TEXTS["de"] * 3 + TEXTS["en"] * 30000
    total, n = model.sums([text, text[:100]])
    assert n.tolist() == [sum(map(str.isalpha, text)), sum(map(str.isalpha, text[:100]))]


def plain_loss(model, text):
    """Loss of each codeword, straight from its definition: n-grams, margins and bits one by one."""
    shown = [c if c.isalpha() else " " for c in text]
    at, margin = [i for i, c in enumerate(shown) if c != " "], np.zeros(model.code.shape[1])
    for i in at:
        digest = 0
        for n in langid.ORDERS:
            letter = shown[i + n - 1] if i + n - 1 < len(shown) else " "
            digest = (digest + ord(letter) * int(langid.FACTORS[n - 1])) % 2**32
            mixed = (digest ^ (digest >> 15)) * 0x2C1B3C6D % 2**32
            margin += model.weights[(mixed >> 20) + (n - 1) * langid.BUCKETS]
    margin *= min(len(at), langid.SURE) ** 0.5 / max(len(at), 1)
    return [sum(w * np.log1p(np.exp(-m * c)) for w, m, c in zip(model.worth, margin, code)) for code in model.code]


def test_decoding_against_its_definition(spark):
    model = langid.train(frame(spark, [(i, t, lang) for i in range(40) for lang, t in TEXTS.items()] + [(i + 50, "ca va bien merci " * 2, "fr") for i in range(9)]))
    texts = ["the dog", "der hund", "merci bien", "x9y", TEXTS["de"] + TEXTS["en"], "q"]
    langs, score, ambiguous, n = model.predict(texts)
    for text, lang, s, unsure in zip(texts, langs, score, ambiguous):
        loss = np.array(plain_loss(model, text))
        ranked = np.sort(loss)
        assert model.langs[loss.argmin()] == lang
        assert s == pytest.approx(1 / np.exp(ranked[0] - loss).sum(), rel=1e-4)
        assert unsure == (ranked[1] - ranked[0] < langid.AMBIGUOUS)


def test_every_language_is_learned(spark):
    names = [f"l{i:03}" for i in range(300)]
    words = {k: " ".join(chr(0x4E00 + (i * 37 + j) % 9000) * 2 for j in range(12)) for i, k in enumerate(names)}
    rows = [(i * 8 + j, words[k], k) for i, k in enumerate(names) for j in range(3)]
    model = langid.train(frame(spark, rows))
    learned = {r["lang"] for r in langid.training_rows(frame(spark, rows)).select("lang").distinct().collect()}
    assert len(learned) > 256 and set(model.langs) == learned
    right = [lang == k for lang, k in zip(model.predict([words[k] for k in model.langs])[0], model.langs)]
    assert sum(right) / len(right) >= 0.98


def test_repeated_ids_do_not_grow_the_sample(spark):
    rows = frame(spark, [(1, f"{TEXTS['en']} {i}", "en") for i in range(300)] + [(i, TEXTS["de"], "de") for i in range(9)])
    assert langid.train(rows).langs == ["de", "en"]
