"""URL filters: the index against every pattern on every URL, in SQL."""

import random
import re

import duckdb

from windlass.llm import url_filter as u

URLS = [None, "", "no scheme", "http://A.Example.NET/en/x", "https://example.net/EN/", "http://net/", "http://x.net",
        "http://notnet/", "http://example.com/de/a?b=/fr/", "http://www.example.org/fr/", "http://example.org/fr",
        "http://a/b://c.net/", "http://my-casino.example.com/", "http://casinos.example.com/", "http://x.com/CASINO",
        "http://free-poker-online.x.com/", "http://poker-strategy.org/poker", "javascript:alert(1)",
        "http://x.com?q=bets#f", "http://a.com/über/bets/", "http://x.com/bets\nhttp://y.net/", "ftp://Ä.NET/É"]


def test_every_pattern_on_every_url(spark):
    rows = [(i, x, 1) for i, x in enumerate(URLS)] + [(None, "http://q.net/", 2), (3, URLS[3], 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, token int")
    got = sorted(map(tuple, u.judge(pages).collect()), key=str)
    pages = pages.toPandas()  # noqa: F841 -- read by name below
    want = duckdb.connect().execute(u.ORACLE.replace("FROM pages", "FROM (SELECT cast(page_id AS BIGINT) AS page_id, url FROM pages)")).fetchall()
    assert got == sorted(want, key=str) and len(got) == len(rows)
    verdict = {r[0]: (r[3], r[4]) for r in got}
    assert verdict[3] == ("example.net/en/", "allow") and verdict[5] == ("net/", "block")
    assert verdict[8] == ("example.com/de/", "block") and verdict[9] == ("org/fr/", "allow")
    assert verdict[12] == (None, "block") and verdict[13] == (None, "allow") and verdict[16] == (None, "allow")
    assert verdict[0] == verdict[1] == verdict[2] == (None, "allow") and verdict[17] == (None, "block")


def test_safe_tokens_are_whole_tokens_of_matches():
    assert u.safe_tokens("^free-*-online^") == ["free", "online"]
    assert u.safe_tokens("banner") == [] and u.safe_tokens("|ads.*") == ["ads"]
    for p in u.PATTERNS:
        for url in filter(None, URLS):
            if re.search(u.to_regex(p.lower()), url.lower()):
                assert set(u.safe_tokens(p)) <= set(re.split("[^a-z0-9]+", url.lower()))


def test_patterns_without_token_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.com/bigbannerad"), (2, "http://x.com/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.judge(pages, patterns=("banner",)).collect()}
    assert got == {1: "block", 2: "allow"}
    assert u.judge(pages, patterns=(), host_rules=()).where("verdict = 'allow' and rule is null").count() == 2
    assert u.judge(pages.limit(0)).count() == 0


def test_thousands_of_patterns_from_a_file(spark, tmp_path):
    """5,000 patterns, some without a token, read from a file, against every
    pattern on every URL."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdeo") for _ in range(rnd.randint(2, 4)))
    forms = ("^{a}^", "||{a}.{b}", "^{a}*{b}^", "/{a}/{b}|", "@@^{a}.{b}^", "{a}{b}{c}", "@@{a}{b}{c}{d}", "|http://{a}.{b}/",
             "^{a}-{b}^{c}^", "{a}{b}*{c}{d}|")
    patterns = [rnd.choice(forms).format(a=word(), b=word(), c=word(), d=word()) for _ in range(5000)]
    path = tmp_path / "rules.txt"
    path.write_text("! comment\n\n" + "\n".join(patterns) + "\n")
    urls = [f"http://{word()}.{word()}/{word()}-{word()}/{word()}{word()}{word()}{rnd.choice(['', '/', '?q=' + word()])}"
            for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.verdict, r.pattern) for r in
           u.judge(pages, host_rules=(), patterns=u.read_patterns(spark, str(path))).collect()}
    known = [(p, re.compile(u.to_regex(p.lower()))) for p in patterns]
    want = {}
    for i, url in enumerate(urls):
        fits = [p for p, r in known if r.search(url.lower())]
        first = next((p for p in fits if p.startswith("@@")), fits[0] if fits else None)
        want[i] = ("block" if first and not first.startswith("@@") else "allow", first)
    assert got == want and len({v for v, _ in want.values()}) == 2
    assert sum(not u.safe_tokens(p) for p in patterns) > 500
