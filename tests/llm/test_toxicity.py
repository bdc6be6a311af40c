"""Ordinal toxicity: held-out detection on the labelled table, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from windlass.llm import toxicity as t


def test_thresholds_ordered_and_severity_grows():
    rng = np.random.default_rng(1)
    base, bad = [f"w{i}" for i in range(50)], [f"bad{i}" for i in range(6)]
    texts, toxic = [], []
    for i in range(600):
        x = set(rng.choice(base, 12))
        if i % 3 == 0:
            x |= set(rng.choice(bad, 1 + i % 5))
        texts.append(x)
        toxic.append(int(i % 3 == 0))
    z = {**dict.fromkeys(base, 0.1), **dict.fromkeys(bad, 9.0)}
    m = t.fit(texts, np.array(toxic), z)
    assert (np.diff(m.thresholds) >= 0).all() and len(m.thresholds) == 3
    assert {w for w, x in m.vocabulary.items() if x > 1} == set(bad)
    few, many = (t.Model({"a": m.vocabulary["bad0"], "b": m.vocabulary["bad1"]}, m.thresholds, m.cut).predict(x)
                 for x in ("a", "a b"))
    assert m.predict("w")[0] == 0 and many[1] > few[1] > m.predict("w")[1]


def test_finds_toxic_documents(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    big = "/root/testdata/sf0.1"
    m = t.train(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"))
    got = t.score(d, m).join(d.select("doc_id", "text"), "doc_id").collect()
    insults = {"idiot", "stupid", "worthless", "disgusting", "moron", "scum", "loser", "pathetic", "trash", "clown"}
    for r in got:
        assert 0 <= r.severity <= 3 and 0 <= r.grade <= 3
        if len(t.words(r.text) & insults) >= 2:
            assert r.toxic
        if not t.words(r.text) & m.vocabulary.keys():
            assert not r.toxic
    lab = {r.doc_id: r.toxic for r in labels.collect()}
    flagged = [lab[r.doc_id] for r in got if r.toxic and r.doc_id in lab]
    assert np.mean(flagged) > 0.95 and sum(flagged) > 0.85 * sum(lab.values())
    kept = t.drop_toxic(d, m)
    assert kept.columns == d.columns
    assert kept.count() == sum(not r.toxic for r in got)


def test_rare_toxic_labels_are_all_learned(spark):
    base = ["tree", "river", "stone", "cloud", "bread", "chair"]
    rows = [(i, " ".join(base[(i + k) % 6] for k in range(3)) + (" zargwort" if i % 300 == 7 else ""),
             int(i % 300 == 7)) for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = t.train(d, d.select("doc_id", "toxic"), max_sample=60)
    got = {r.doc_id for r in t.score(d, m).where("toxic").collect()}
    assert got == {i for i, _, x in rows if x}


def dense_objective(x, grade, w, theta, l1, l2):
    """Negative log-likelihood of the cumulative-link model, with penalties."""
    edge = np.concatenate(([-np.inf], theta, [np.inf]))
    s = x @ w
    f = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    p = f(edge[grade + 1] - s) - f(edge[grade] - s)
    return -np.log(np.maximum(p, 1e-12)).sum() + l1 * np.abs(w).sum() + l2 / 2 * (w @ w)


def test_fit_reaches_the_optimum_of_a_dense_search():
    """Proximal steps on numeric gradients of the dense model, from the fit and
    from zero, find nothing better."""
    rng = np.random.default_rng(3)
    n, k = 240, 8
    x = (rng.random((n, k)) < 0.3).astype(float)
    toxic = (x[:, 0] + x[:, 1] + 0.7 * rng.random(n) > 1.0).astype(int)
    names = [f"w{i}" for i in range(k)]
    texts = [{names[j] for j in np.flatnonzero(r)} for r in x]
    z = dict(zip(names, [9.0, 8.0, 0.1, 0.2, -0.3, 0.1, -0.2, 0.1]))
    l1, l2 = 1.0, 0.01
    m = t.fit(texts, toxic, z, rounds=3000, l1=l1, l2=l2)
    grade = t.grades((x[:, :2] + (x[:, [2, 3, 5, 7]].sum(1)[:, None] > 9)).sum(1) + x[:, [2, 3, 5, 7]].sum(1), toxic, 3)
    w, theta = np.array([m.vocabulary.get(a, 0.0) for a in names]), m.thresholds
    ours = dense_objective(x, grade, w, theta, l1, l2)

    def search(w, theta, rounds=1500, step=0.01, h=1e-5):
        for _ in range(rounds):
            smooth = lambda a, b: dense_objective(x, grade, a, b, 0.0, l2)
            gw = np.array([(smooth(w + h * e, theta) - smooth(w - h * e, theta)) / (2 * h) for e in np.eye(k)])
            gt = np.array([(smooth(w, theta + h * e) - smooth(w, theta - h * e)) / (2 * h) for e in np.eye(len(theta))])
            w = w - step * gw
            w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
            theta = np.maximum.accumulate(theta - step * gt)
        return dense_objective(x, grade, w, theta, l1, l2)
    start = np.log([(grade <= j).mean() / (grade > j).mean() for j in range(len(theta))])
    assert ours <= min(search(w, theta), search(np.zeros(k), start)) * 1.005


def test_ties():
    """Equally likely grades: the lower one; a probability at the cut is toxic,
    and equal texts are never parted by it."""
    m = t.Model({"bad": 1.0}, np.array([0.0]), 0.5)
    assert m.predict("word")[0] == 0 and m.predict("word")[2]
    p = np.array([0.9, 0.7, 0.7, 0.7, 0.1])
    for toxic in ([1, 1, 0, 1, 0], [1, 0, 0, 1, 0]):
        cut = t.best_cut(p, np.array(toxic) > 0)
        assert not 0.7 - 1e-9 < cut < 0.7 + 1e-9


def test_repeated_and_extra_rows_teach_once(spark):
    rows = [(i, f"tree river {'zargwort' if i % 4 == 0 else 'stone'} {i % 5}", int(i % 4 == 0)) for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, flag int").withColumn("toxic", F.lit("x"))
    lab = spark.createDataFrame([(i, 0, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    once = t.train(d, lab)
    hot = d.unionByName(d.where("doc_id = 4").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("k"))
    many = t.train(hot, lab)
    assert once.vocabulary == many.vocabulary and (once.thresholds == many.thresholds).all()


def test_edge_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "x " * 100_000, 3)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = t.train(d, none)
    assert sorted((str(r.doc_id), r.toxic) for r in t.score(d, m).collect()) == \
        [("1", False), ("1", False), ("2", False), ("None", False)]
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, None, 0), (None, 1, 1), (2, 1, None)],
                                   "doc_id long, quality int, toxic int")
    m = t.train(d, labels)
    assert t.score(d, m).count() == 4 and t.drop_toxic(d, m).columns == d.columns
    assert t.score(d.limit(0), m).count() == 0
