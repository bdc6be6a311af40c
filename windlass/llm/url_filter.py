"""URL filters: host rules, and pattern rules found by their rarest token.

A pattern is literal text in which ``*`` stands for any run, ``^`` for a
character that is neither letter nor digit (or an end of the URL), ``|`` at
an end anchors it there, and a leading ``@@`` makes it an exception.  Every
pattern is filed under the one of its whole literal tokens that is rarest
in the URLs at hand; a URL's tokens fetch candidate patterns, and only those
run as regular expressions.  Patterns may be a list, a text file or a table of
any length; the few that have no whole token are tried together.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, with_workers

#: (verdict, host, path prefix): fits the host and its subdomains.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
              ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PATTERNS = tuple(f"^{w}^" for w in (
    "casino", "bets", "betting", "poker", "jackpot", "slots", "porn", "xxx", "viagra", "cialis", "warez",
    "keygen", "torrents", "phishing", "malware", "adserver", "doubleclick", "clickbait", "payday")) + (
    "^free-*-online^", "|javascript:", "@@^poker-strategy.org^")
#: Pattern rows up to this many are broadcast (about 200 bytes each); patterns
#: without a token are tried so many at once.
BROADCAST_RULES, TOGETHER = 50_000, 100

HOST = "(?s)^.*?://([^/?#]*)"
PATH = "(?s)^.*?://[^/?#]*([^?#]*)"


def to_regex(pattern: str) -> str:
    """The pattern as a regular expression that Java, RE2 and Python read."""
    p = pattern.removeprefix("@@")
    start, end = p.startswith("|"), p.endswith("|")
    out = "^" if start else ""
    for c in p[start:len(p) - end]:
        out += ".*" if c == "*" else "(?:[^a-z0-9]|^|$)" if c == "^" else re.escape(c)
    return "(?s)" + out + ("$" if end else "")


def safe_tokens(pattern: str) -> list[str]:
    """Literal tokens that any matching URL holds as whole tokens: bounded in
    the pattern by an anchor or a character that belongs to no token."""
    p = pattern.removeprefix("@@").lower()
    return sorted({m[0] for m in re.finditer("[a-z0-9]+", p)
                   if m.start() > 0 and p[m.start() - 1] != "*" and m.end() < len(p) and p[m.end()] != "*"})


def host_rule(host, path, rules):
    """(rule text, verdict) columns of the longest host rule that fits."""
    text = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(rule, pattern) of a text file with a pattern per line; empty lines and
    those that begin with ``!`` are left out.  Rules are numbered by line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("rule", "pattern"))
    return lines.select(F.col("rule").cast("long"), F.trim("pattern").alias("pattern")).where("pattern <> '' and not startswith(pattern, '!')")


def _read(batches):
    for b in batches:
        p = b.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([to_regex(x.lower()) for x in p], pa.string()),
             pa.array(["allow" if x.startswith("@@") else "block" for x in p], pa.string()),
             pa.array([safe_tokens(x) for x in p], pa.list_(pa.string()))],
            ["rule", "pattern", "regex", "verdict", "tokens"])


def pattern_table(spark: SparkSession, patterns) -> DataFrame:
    """(rule, pattern, regex, verdict, tokens) of a list of patterns, or of a
    table with columns rule and pattern; null patterns are left out."""
    if not isinstance(patterns, DataFrame):
        patterns = spark.createDataFrame(list(enumerate(patterns)), "rule long, pattern string")
    with_workers(spark)
    return (patterns.where("pattern is not null").select(F.col("rule").cast("long").alias("rule"), "pattern")
            .mapInArrow(_read, "rule long, pattern string, regex string, verdict string, tokens array<string>"))


def _without_token(urls: DataFrame, low, rules: DataFrame) -> DataFrame:
    """Hits of the patterns without a token, which any URL may fit: TOGETHER of
    them are one expression, and only a URL that fits it tries each."""
    loose = [(i // TOGETHER, *r) for i, r in enumerate(
        rules.where("size(tokens) = 0").select("rule", "pattern", "regex", "verdict").orderBy("rule").collect())]
    if not loose:
        return None
    spark = urls.sparkSession
    groups = [F.when(low.rlike("|".join(f"(?:{r[3]})" for r in loose if r[0] == g)), F.lit(g))
              for g in range(loose[-1][0] + 1)]
    table = spark.createDataFrame(loose, "g int, rule long, pattern string, regex string, verdict string")
    return (urls.select("url", F.explode(F.array_compact(F.array(*groups))).alias("g")).join(F.broadcast(table), "g")
            .where(F.expr("rlike(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regex)"))
            .select("url", "rule", "pattern", "verdict"))


def pattern_verdicts(urls: DataFrame, patterns) -> DataFrame:
    """(url, pattern, verdict) of the distinct URLs that a pattern fits: an
    exception wins over a block, then the pattern that stands first."""
    spark = urls.sparkSession
    urls = materialise(urls.where("url is not null").select("url").distinct(), "urls")
    low = ascii_lower(F.col("url"))
    rules = materialise(pattern_table(spark, patterns), "patterns")
    small = F.broadcast if rules.count() <= BROADCAST_RULES else (lambda df: df)
    of_url = urls.select("url", F.explode(F.array_distinct(F.split(low, "[^a-z0-9]+"))).alias("token")).where("token <> ''")
    of_rule = rules.select("rule", F.explode("tokens").alias("token"))
    seen = (of_url.join(small(of_rule.select("token").distinct()), "token").groupBy("token")
            .agg(F.count(F.lit(1)).alias("n")))
    rarest = (of_rule.join(seen, "token", "left").groupBy("rule")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"))
              .select("rule", F.col("m.token").alias("token")))
    index = rules.drop("tokens").join(rarest, "rule")
    hits = (of_url.join(small(index), "token").where(F.expr(
        "rlike(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regex)"))
        .select("url", "rule", "pattern", "verdict"))
    loose = _without_token(urls, low, rules)
    hits = hits if loose is None else hits.unionByName(loose)
    best = F.min(F.struct(F.col("verdict"), "rule", "pattern")).alias("b")     # allow sorts before block
    return hits.groupBy("url").agg(best).select(F.col("url"), F.col("b.pattern").alias("pattern"),
                                                F.col("b.verdict").alias("by_pattern"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          host_rules=HOST_RULES, patterns=PATTERNS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, pattern.

    A null URL, or one without ``://``, has empty host and path; what no rule
    and no pattern fits is allowed.  Repeated rows stay, a null id stays
    null, no rows give none, other columns are ignored.  ``patterns`` is what
    :func:`pattern_table` takes."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    found = pattern_verdicts(p, patterns)
    p = p.join(found, "url", "left")
    url = F.coalesce("url", F.lit(""))
    p = p.withColumns({"host": ascii_lower(F.regexp_extract(url, HOST, 1)), "path": F.regexp_extract(url, PATH, 1)})
    rule, verdict = host_rule(F.col("host"), F.col("path"), host_rules)
    return p.select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, "by_pattern", F.lit("allow")).alias("verdict"), "pattern")


def _oracle() -> str:
    """The same in SQL, every pattern tried on every URL."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    fits = [(f"(host = {q(h)} OR ends_with(host, {q('.' + h)})) AND starts_with(path, {q(p)})", v, h + p)
            for v, h, p in sorted(HOST_RULES, key=lambda r: (-len(r[1] + r[2]), r))]
    hit = "CASE " + " ".join(
        f"WHEN regexp_matches(low, {q(to_regex(p.lower()))}) THEN {q(p)}"
        for p in sorted(PATTERNS, key=lambda p: not p.startswith("@@"))) + " END"
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url,
                  translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
           FROM pages),
h AS (SELECT page_id, low, {hit} AS pattern,
             translate(regexp_extract(url, {q(HOST)}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, {q(PATH)}, 1) AS path FROM u)
SELECT page_id, host, path,
       CASE {' '.join(f"WHEN {c} THEN {q(r)}" for c, _, r in fits)} END AS rule,
       CASE {' '.join(f"WHEN {c} THEN {q(v)}" for c, v, _ in fits)}
            WHEN pattern IS NULL OR starts_with(pattern, '@@') THEN 'allow' ELSE 'block' END AS verdict,
       pattern FROM h"""


ORACLE = _oracle()
