import itertools
import math
import zlib

import numpy as np

from plumbline.llm import crf, languageid, queries


def test_forward_backward_equals_summing_over_all_paths():
    rng = np.random.default_rng(1)
    lengths, labels = np.array([5, 3, 1]), 3
    emit, transit = rng.normal(size=(3, 5, labels)), rng.normal(size=(labels, labels))
    marginals, expected = crf.forward_backward(emit, lengths, transit)
    pairs = np.zeros((labels, labels))
    for c, n in enumerate(lengths):
        total, at, between = 0.0, np.zeros((n, labels)), np.zeros((labels, labels))
        for path in itertools.product(range(labels), repeat=int(n)):
            score = sum(emit[c, t, y] for t, y in enumerate(path)) + sum(transit[a, b] for a, b in itertools.pairwise(path))
            weight = math.exp(score)
            total += weight
            for t, y in enumerate(path):
                at[t, y] += weight
            for a, b in itertools.pairwise(path):
                between[a, b] += weight
        assert np.allclose(marginals[c, :n], at / total) and (marginals[c, n:] == 0).all()
        pairs += between / total
    assert np.allclose(expected, pairs)


def test_numbers_that_are_no_digits_are_no_letters(docs):
    assert crf.core("² ½ ①") == crf.core("Ⅷ") == "" and crf.core("x²y½") == "xy" and crf.core("9é_ß") == "éß"
    field = crf.train(languageid.training_sample(docs))
    assert field.predict(["² ½ ①"])[0] == (None, 0.0)


def test_features_are_those_of_the_word():
    def of(words):
        return crf.features(words, {"house": 1}, -1)

    alone, beside = of(["house"])[0], of(["a", "house", "internationalization"])[1]
    assert sorted(alone[alone >= 0]) == sorted(beside[beside >= 0])
    affixes, ngrams = 8, len("^house$") - 1 + len("^house$") - 2
    assert (alone >= 0).sum() == affixes + ngrams + 1 and crf.BUCKETS + 1 in alone
    assert len(set(of(["abc"])[0]) & set(of(["cba"])[0])) <= 2  # the mark of no lexicon, and no place


def test_code_switched_text_is_labelled_by_word(docs):
    rows = docs.filter("lang IN ('en', 'de')").select("text", "lang").collect()
    field = crf.train([(r["text"], r["lang"]) for r in rows[:80]])
    by_lang = {k: next(r["text"] for r in rows[80:] if r["lang"] == k and len(r["text"].split()) > 60) for k in ("en", "de")}
    parts = [" ".join(by_lang[k].split()[:40]) for k in ("en", "de")]
    field.predict([*parts, " ".join(parts)])
    codes = np.array([[c for c in map(field.place.get, crf.chunks(" ".join(parts))) if c >= 0]])
    marginals, _ = crf.forward_backward(field.scores[codes], np.array([codes.shape[1]]), field.transit)
    best = marginals[0].argmax(1)
    half = sum(bool(crf.core(w)) for w in parts[0].split())
    assert (best[:half] == field.labels.index("en")).mean() > 0.85
    assert (best[half:] == field.labels.index("de")).mean() > 0.85
    assert field.transit[0, 0] > field.transit[0, 1] and field.transit[1, 1] > field.transit[1, 0]


def test_query_on_documents(spark, docs_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op9_language_id(spark, docs_dir).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert rows.keys() == truth.keys()
    unseen = [d for d in rows if rows[d]["held_out"]]
    assert all((zlib.crc32(str(d).encode()) % 5 == 0) == rows[d]["held_out"] for d in rows)
    assert sum(rows[d]["lang_pred"] == truth[d] for d in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_sample_leaves_the_held_out_fifth_and_order_aside(docs):
    sample = languageid.training_sample(docs, 5)
    assert sample == languageid.training_sample(docs.repartition(9), 5)
    hidden = {r["text"] for r in docs.filter(languageid.held_out()).select("text").collect()}
    seen = {r["text"] for r in docs.filter(~languageid.held_out()).select("text").collect()}
    assert all(t in seen or t not in hidden for t, _ in sample)
    assert max(sum(lang == k for _, lang in sample) for k in {lang for _, lang in sample}) == 5


def test_odd_rows(odd, odd_rows, none):
    found = languageid.identify(odd)
    rows = found.collect()
    assert found.columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"] and len(rows) == len(odd_rows)
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"], r["score"]) == (("en", 1.0) if letters else ("und", 0.0))
    assert languageid.identify(none).count() == 0
    unlabelled = languageid.identify(odd.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    field = crf.train([("a b c", "x"), ("d e f", "x"), ("", "y")])
    assert field.labels == ["x", "y"] and field.predict([""]) == [(None, 0.0)]
