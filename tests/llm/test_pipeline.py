"""The pipeline's stages against brute force on the small table."""

import sys

from llm_helpers import ROOT, SF
from test_decontaminate import plain_words
from test_simhash import brute_roots, plain_fingerprint

sys.path.insert(0, ROOT)
import corpus_pipeline as p  # noqa: E402
from windlass.llm import packing, secret_scan, toxicity  # noqa: E402
from windlass.llm.common import materialise, table  # noqa: E402


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if not model.predict(t)[2]}
    fp = {i: plain_fingerprint(t) for i, t in kept.items()}
    roots, first = brute_roots(set(fp.values()), 4), {}
    for i in sorted(kept):
        first.setdefault(roots[fp[i]], i)
    unique = {i: kept[i] for i in first.values()}
    items = [plain_words(r.text) for r in table(spark, SF, "benchmark").collect()]

    def leaks(text):
        w = plain_words(text)
        grams = {tuple(w[k:k + 8]) for k in range(len(w) - 7)}
        return any(sum(tuple(t[k:k + 8]) in grams for k in range(len(t) - 7)) >= 0.3 * (len(t) - 7) for t in items)
    clean = {i: t for i, t in unique.items() if not leaks(t)}
    want = [kept, unique, clean, {i: secret_scan.redacted(t) for i, t in clean.items()}]
    for (name, stage), w in zip(p.STAGES[:-1], want):
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = docs.collect()
        assert len(got) == len(w) and {r.doc_id: r.text for r in got} == w, name
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = p.STAGES[-1][1](spark, docs, SF).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {r.doc_id: r.doc_tokens for r in packing.pack(docs).collect()}
    assert {r[0] for r in pieces} == set(clean)


def test_run_and_empty_tables(spark):
    assert p.run(spark, SF).count() > 0
    none = table(spark, SF, "documents").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_unusual_rows_through_all_stages(spark, tmp_path):
    """Null ids, texts and columns, repeated rows, a very long text and columns
    whose names the stages use themselves."""
    item = "how many marbles has she if Tom gives her two red and three blue ones and more to a friend"
    plain = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(1, plain(1)), (1, plain(1)), (2, plain(1)), (None, plain(1)), (3, None), (4, ""), (5, " \n"), (None, None),
            (6, plain(6) + " password=hunter2secret"), (7, plain(7) + " " + item), (8, "long " * 200_000 + plain(8)),
            (None, plain(9)), (None, plain(9)), (10, plain(10) + " zargwort")]
    rows += [(100 + i, plain(100 + i) + " zargwort" * (i % 2)) for i in range(60)]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, row string, fp int, c0 string, new int, "
              "key string, toxic string, item_id int")
    docs = spark.createDataFrame([(i, t, None, None, None, "r", 1, None, 2, "k", None, 3) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, None, i % 2) for i in range(60)] + [(None, 1, 1), (100, 1, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    kept, cur = [], table(spark, sf, "documents")
    for name, stage in p.STAGES[:-1]:
        cur = materialise(stage(spark, cur, sf), f"unusual-{name}")
        assert cur.columns == docs.columns
        kept.append(sorted((str(r.doc_id), (r.text or "")[:6], r.key, r.new) for r in cur.collect()))
    toxic = {str(i) for i, t in rows if t and "zargwort" in t}
    assert [k[0] for k in kept[0]] == sorted(str(i) for i, t in rows if str(i) not in toxic)
    ids = [k[0] for k in kept[1]]
    assert ids == sorted([str(i) for i in (1, 3, 6, 7, 8)] + ["None"] + [str(100 + i) for i in range(0, 60, 2)])
    assert [k[0] for k in kept[2]] == [i for i in ids if i != "7"]
    assert [k[0] for k in kept[3]] == [k[0] for k in kept[2]] and all(k[2:] == ("k", 2) for k in kept[3])
    texts = {str(r.doc_id): r.text for r in cur.collect()}
    assert texts["6"].endswith("[assign]") and texts["3"] is None and len(texts["8"]) > 1_000_000
    pieces = p.run(spark, sf)
    assert {str(r.doc_id) for r in pieces.select("doc_id").distinct().collect()} == set(texts)
    assert pieces.where("doc_id = 3").count() == 1 and pieces.where("doc_id = 8").count() > 1
