"""Language ID: held-out accuracy, calibration, edge rows."""

import math
import random

import numpy as np

from windlass.llm import langid


def test_counts_over_pieces_equal_whole(monkeypatch):
    text = "Größe und être: " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert (langid.counts(text) == whole).all()
    assert langid.counts(None) is None and langid.counts("12 _ 3!") is None


def test_held_out_accuracy_and_calibration(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = np.array([r.lang == r.lang_pred for r in got])
    score = np.array([r.score for r in got])
    assert len(got) > 150 and right.mean() > 0.95
    assert 0 <= score.min() and score.max() <= 1 and abs(score.mean() - right.mean()) < 0.05


def test_edge_rows(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "der hund und die katze ") * 3, "en" if i % 2 else "de", i)
            for i in range(80)]
    rows += [(None, "der hund", "xx", 0), (901, None, "en", 0), (902, "12345 !", "en", 0),
             (903, "the mat", None, 0), (903, "the mat", None, 0), (904, "the cat " * 200_000, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert got[901].lang_pred == got[902].lang_pred == "und" and got[901].score == 0
    assert got[903].lang_pred == got[904].lang_pred == "en" and got[None].lang_pred == "de"
    assert langid.identify(d).count() == len(rows)
    assert langid.identify(d.limit(0)).count() == 0
    unlabelled = langid.identify(d.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def plain_ftrl(rows, langs, epochs, alpha=1.0, beta=1.0, l1=0.05, l2=0.01):
    """The published update, one weight at a time, on {feature: value} rows."""
    z, n = {}, {}

    def weight(f, k):
        a = z.get((f, k), 0.0)
        if abs(a) <= l1:
            return 0.0
        return -(a - math.copysign(l1, a)) / ((beta + math.sqrt(n.get((f, k), 0.0))) / alpha + l2)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, lang = rows[i]
            s = [sum(v * weight(f, k) for f, v in x.items()) for k in range(len(langs))]
            e = [math.exp(a - max(s)) for a in s]
            for k in range(len(langs)):
                err = e[k] / sum(e) - (langs[k] == lang)
                for f, v in x.items():
                    w, g, old = weight(f, k), err * v, n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
                    n[f, k] = old + g * g
    return weight


def test_weights_are_those_of_plain_ftrl():
    rnd, idf, langs = random.Random(1), np.linspace(1, 2, langid.DIMS), ["a", "b", "c"]
    rows = []
    for k in range(24):
        lang = langs[k % 3]
        text = " ".join(rnd.choice({"a": ["ab", "ba"], "b": ["cd", "dc"], "c": ["ab", "cd"]}[lang]) for _ in range(5))
        rows.append((*langid.features(langid.counts(text), idf), lang, k % 5 == 4))
    model = langid.fit(rows, langs, idf, epochs=2)
    weight = plain_ftrl([({**dict(zip(at.tolist(), v.tolist())), "bias": 1.0}, lang) for at, v, lang, h in rows if not h],
                        langs, 2)
    for at, v, _, _ in rows:
        want = [weight("bias", k) + sum(x * weight(f, k) for f, x in zip(at.tolist(), v.tolist())) for k in range(3)]
        assert np.allclose(model.scores(at, v), want, atol=1e-9)
    again = langid.Model.load(model.dump())
    text = "ab cd ab"
    p = langid.softmax(again.scores(*langid.features(langid.counts(text), again.idf)) / again.temperature)
    assert again.predict(text)[0] == langs[int(p.argmax())] and abs(again.predict(text)[1] - p.max()) < 1e-9
    # The temperature is the best of its grid on the rows kept out of training.
    loss = lambda t: -sum(math.log(langid.softmax(model.scores(at, v) / t)[langs.index(lang)])
                          for at, v, lang, h in rows if h)
    assert all(loss(model.temperature) <= loss(t) + 1e-9 for t in np.exp(np.linspace(np.log(0.02), np.log(20), 400)))


def test_every_language_is_learned(spark):
    """300 languages, the rare ones with 24 rows each."""
    rnd, rows = random.Random(2), []
    for k in range(300):
        vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(6)]
        for _ in range(24 if k % 3 else 36):
            rows.append((len(rows), " ".join(rnd.choice(vocabulary) for _ in range(20)), f"l{k:03d}"))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = {r.lang for r in got if r.lang == r.lang_pred}
    assert len(right) > 290 and sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)


def test_equally_likely_languages():
    """Ties go to the language that comes first by name."""
    none = np.zeros(0)
    m = langid.Model(["aa", "bb"], np.ones(langid.DIMS), np.zeros(langid.DIMS + 1, np.int64), none.astype(np.int64), none,
                     np.zeros(2), 1.0)
    assert m.predict("word") == ("aa", 0.5)
