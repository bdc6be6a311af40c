"""Quality rules against plain counting; compression bands on made-up texts."""

import base64
import random
import re
from collections import Counter

from hypothesis import given, settings, strategies as st

from llm_helpers import docs  # noqa: F401
from windlass.llm import quality as q


def plain(text):
    words = [w for w in re.split("[ \t\n\v\f\r]", text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^ \t\n\v\f\r]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if grams[tuple(words[i:i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é\x85 ", max_size=80))
def test_base_counts(text):
    assert q.base_counts(text) == plain(text)


def test_many_words_take_the_exact_ranking():
    words = [str(i) for i in range(7000)]
    text = " ".join(words + words[100:110] + words[50:54])
    assert q.base_counts(text) == plain(text) and plain(text)[4] == 20


def test_bands():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    clean = " ".join(word() for _ in range(3000))
    c = q.Compression()
    for n in (0, 20, 100, 700, 3000, 20000):
        assert c.judge(clean[:n])[0]
    assert not c.judge("all work and no play " * 500)[0]
    assert not c.judge(base64.b85encode(rng.randbytes(9000)).decode())[0]
    # Clean text with a long repetitive middle: the chunks tell.
    assert not c.judge(clean[:6000] + "spam " * 20000)[0]


def test_table_and_edge_rows(spark, docs):
    from llm_helpers import SF
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in q.quality(d).collect()}
    for r in d.collect():
        g, p = got[r.doc_id], plain(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == p
        assert g.base_failed == (p[0] < 10 or 100 * p[4] > 20 * p[0])
        assert g.kept == (not g.base_failed and q.Compression().judge(r.text)[0])
    e = q.quality(docs([(None, None), (1, ""), (1, ""), (2, "x " * 300_000)])).collect()
    assert len(e) == 4 and all(r.base_failed and not r.kept for r in e)
    assert q.quality(d.limit(0)).count() == 0
