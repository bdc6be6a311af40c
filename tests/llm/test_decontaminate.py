"""Decontamination against a plain Python version, and planted questions."""

import re
import unicodedata

from windlass.llm import decontaminate as d

ITEM = ("Alice went to the market with Bob and bought 12 apples for 3.50 dollars each, "
        "then Alice gave 5 apples to Bob and walked 2 km home in the rain.")


def frames(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def found(spark, texts, items):
    docs, bench = frames(spark, texts, items)
    return sorted((r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect())


def test_templates_and_slot_consistency(spark):
    other = ITEM.replace("Bob", "Zed").replace("12", "40").replace("5 apples", "7 apples").replace("km", "miles")
    edited = ITEM.replace("gave 5 apples to Bob", "gave 5 apples to Eve")   # most windows are the item's own
    filler = "some plain words about nothing in particular that go on and on "
    texts = [filler + ITEM + " " + filler, filler + "so " + other, filler + edited, filler * 4,
             ITEM.upper(), None, "", "12 13 14 15 16 17 18 19 20 21 22 23"]
    got = found(spark, texts, [ITEM, "1 2 3 4 5 6 7 8 9 10 11 12", None, "ab", ITEM])
    assert (0, 0) in got and (1, 0) in got and (2, 0) in got
    assert {i for _, i in got} == {0} and not {x for x, _ in got} & {3, 5, 6, 7}


def test_one_window_must_be_consistent(spark):
    item = "we saw Bob and later Bob went home"
    texts = [item.replace("Bob", "Kim"), "we saw Kim and later Lee went home", "we saw Bob and later Lee went home",
             "so " + item + " again"]
    assert found(spark, texts, [item]) == [(0, 0), (3, 0)]


def test_short_items_are_matched_as_written(spark):
    items = ["Capital of France?", "Yes", "42", "???", "a\\E b", "Who is Kim"]
    texts = ["He asked: Capital of France? Then left", "the capital of France is", "Capital of Spain?", "Yesterday", "Oh, Yes!",
             "yes", "all 42 of them", "1428", "x a\\E b y", "??? what", "Who is Kim", "Who is Lee", "whowho Who is Kimberley"]
    assert found(spark, texts, items) == [(0, 0), (4, 1), (6, 2), (8, 4), (10, 5)]


def brute(docs, items, size):
    """All windows of all alignments, from the template words."""
    out = set()
    kind = lambda w: w[0] if w[0] in "\x01\x02\x03" else ""
    for i, dt in docs:
        for (j, form), it in items:
            n, best = len(it) - size + 1, 0
            for shift in range(-n, len(dt)):
                found = []
                for q in range(n):
                    a, b = it[q:q + size], dt[max(0, q + shift):q + shift + size] if q + shift >= 0 else []
                    if len(b) < size or [kind(x) or x for x in a] != [kind(x) or x for x in b]:
                        continue
                    if 2 * sum(not kind(x) for x in a) < size and a != b or form == 1 and q == 0 and a[0] != b[0]:
                        continue
                    found.append({(x, y) for x, y in zip(a, b) if kind(x) in ("\x02", "\x03")})
                votes = {}
                for pairs in found:
                    for x, y in pairs:
                        votes.setdefault(x, {}).setdefault(y, 0)
                        votes[x][y] += 1
                chosen = {(x, max(v, key=v.get)) for x, v in votes.items()}
                good = sum(all(x == y for x, y in pairs) or pairs <= chosen for pairs in found)
                best = max(best, good)
            if best >= 0.3 * n:
                out.add((i, j))
    return out


def test_slots_against_brute_force(spark):
    """Items re-parameterised at random: names and units changed throughout,
    now and then, or against each other, numbers at will, words cut off."""
    import random
    rnd = random.Random(7)
    words = "red tall old market river story bread walks sees gives under over with from near about".split()
    names, units = ["Bob", "Kim", "Lee", "Ann", "Zoe"], ["km", "kg", "hours"]

    def item():
        return [rnd.choice([rnd.choice(words)] * 4 + [rnd.choice(names), f"{rnd.randint(2, 99)} {rnd.choice(units)}",
                                                      str(rnd.randint(2, 99))]) for _ in range(rnd.randint(14, 26))]
    items = [["so", *item()] for _ in range(8)]
    texts = []
    for it in items:
        for p in (0.0, 0.05, 0.3, 1.0):
            swap = dict(zip(names, rnd.sample(names, 5)))
            t = [swap[w] if w in swap and rnd.random() < p else rnd.choice(names) if w in swap and rnd.random() < p / 3 else w
                 for w in it]
            t = [str(rnd.randint(2, 99)) if w.isdigit() and rnd.random() < 0.5 else w for w in t]
            cut = rnd.randint(0, len(t) - 8) if rnd.random() < 0.5 else 0
            texts.append(" ".join(["and", *rnd.sample(words, 4), *t[cut:], *rnd.sample(words, 3)]))
    docs, bench = frames(spark, texts, [" ".join(x) for x in items])
    dt = [(r.doc_id, r.t) for r in docs.select("doc_id", d.tokens(docs.text).alias("t")).collect()]
    it = [((r.item_id, 0), r.t) for r in bench.select("item_id", d.tokens(bench.text).alias("t")).collect()]
    want = brute(dt, it, 8)
    assert 8 < len(want) < len(texts) * len(items)
    assert set(found(spark, texts, [" ".join(x) for x in items])) == want


def test_short_item_is_matched_as_a_whole(spark):
    assert found(spark, ["we ask what color is the sky today", "what color is the"],
                 ["What color is the sky?"]) == [(0, 0)]


def plain_words(text):
    """Template words for texts without numbers and names inside sentences."""
    out, word = [], ""
    for ch in text.lower() + " ":
        if unicodedata.category(ch)[0] in "LMN":
            word += ch
        elif word:
            out, word = out + [word], ""
    return out


def test_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in d.contaminated(docs, bench).collect()}
    items = [(r.item_id, plain_words(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = plain_words(r.text)
        grams = {tuple(w[i:i + 8]) for i in range(len(w) - 7)}
        for i, t in items:
            n = len(t) - 7
            if sum(tuple(t[k:k + 8]) in grams for k in range(n)) >= 0.3 * n:
                want.add((r.doc_id, i))
    assert want and got == want
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.collect()} == \
        {i for i, _ in want}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    texts = ["x " + ITEM, ITEM.replace("Bob", "Kim")]
    want = found(spark, texts, [ITEM])
    monkeypatch.setattr(d, "BROADCAST_WINDOWS", 0)
    assert found(spark, texts, [ITEM]) == want


def test_edge_rows(spark):
    rows = [(None, ITEM, 1), (3, None, 2), (4, ITEM, 3), (4, ITEM, 3), (5, "w " * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    bench = spark.createDataFrame([(9, ITEM, 1)], "item_id long, text string, pos int")
    assert sorted(str(r.doc_id) for r in d.contaminated(docs, bench).collect()) == ["4", "None"]
    kept = d.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.row or 0 for r in kept.collect()) == [0, 2]
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).count() == 0
    assert d.drop_contaminated(docs, bench.limit(0)).count() == 5


def test_values_that_meet_or_part_and_first_words(spark):
    items = ["how many marbles has she if Tom gives her 2 red and 3 blue ones and 3 more to a friend",
             "What is the capital of France?"]
    texts = ["x " + items[0].replace("2 red", "4 red").replace("3", "4"),          # 2 and 3 become 4
             "x " + items[0].replace("3 blue", "5 blue").replace("Tom", "Kim"),     # 3 becomes 5 and 3
             "Question: What is the capital of France? And", "so What is the capital of Spain",
             "they say Paris is the capital of France", "yes. What is the capital of France"]
    assert found(spark, texts, items) == [(0, 0), (1, 0), (2, 1), (3, 1), (5, 1)]


def test_prefilter_loses_no_possessive_or_hyphenated_names(spark, monkeypatch):
    items = ["how many cakes does Mary's Bakery sell when Anne-Marie Smith comes",
             "the party on New Year's Eve at James' House was for Mary O'Brien-Lee alone",
             "we saw MARY'S-BAKERY and Mary'-Ba-Ca with Anne-\u00c9va Jos\u00e9-Mar\u00eda Old near Bob3 Zed"]
    texts = [f"some plain words {t} and more of them" for t in items]
    got = found(spark, texts, items)
    assert got == [(0, 0), (1, 1), (2, 2)]
    docs, _ = frames(spark, texts, items)
    words = [w for r in docs.select(d.tokens(docs.text).alias("t")).collect() for w in r.t]
    assert not [w for w in words if w[0] > "\x04" and re.search("[\x01-\x04]", w)]
    assert "\x03anne\x04marie\x04smith" in words and "\x03mary\x04o\x04brien\x04lee" in words
    monkeypatch.setattr(d, "_candidates", lambda docs, items, rare, size: docs)
    assert found(spark, texts, items) == got


def test_no_python_in_the_plan(spark):
    docs, bench = frames(spark, ["a"], [ITEM])
    plan = d.contaminated(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
