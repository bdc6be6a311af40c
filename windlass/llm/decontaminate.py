"""Benchmark decontamination by template canonicalisation.

Numbers, units and names of a text become typed placeholders, so that a
question keeps its template when its parameters are changed.  Windows of
template words are hash-joined between documents and benchmark items; the hits
that count on one alignment (document position minus item position) must be
consistent: every name and unit of the item stands for one value of the
document, the one that most of the hits say; hits whose values are the item's
own always count.  Different values may become equal, and equal numbers
different, as they may have different roles.  Items of fewer than MIN_WORDS
words have no template worth the name: they are matched as they are written.
Only DataFrame functions, no Python in tasks.

An item's first word may be a name inside a document's sentence, though it
is a plain word at the start of the item.  So an item has a second form, as
if it stood inside a sentence; there the first word must be the same.

Template words and windows are costly to make, so a first pass keeps the
documents that can hold an item at all: every window of an item has an
anchor, its literal word that is in the fewest documents, and a document
without the anchors of enough windows cannot hold enough windows.  Nothing
is lost by it, and since anchors are rare little is shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Words of a window; the share of an item's windows that must be found on
#: one alignment; items of fewer template words are matched literally.
WINDOW, SHARE, MIN_WORDS = 8, 0.3, 4
#: So many benchmark windows (about 100 bytes each), anchors or keys of
#: documents are broadcast; more are shuffled.
BROADCAST_WINDOWS = 200_000

# Placeholders: a control character for the type, then the value.
_NUM, _UNIT, _NAME, _IN = "\x01", "\x02", "\x03", "\x04"
UNITS = ("km m cm mm mi mile miles ft feet foot inch inches yard yards kg g mg lb lbs pound pounds ounce ounces "
         "ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour "
         "hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree "
         "degrees mph kmh kb mb gb tb hz khz mhz ghz v volt volts w watt watts").split()


def tokens(text: Column) -> Column:
    """Template words of a text: lower-cased words, and placeholders that
    start with their type's control character."""
    # Every pattern begins with the rare character it needs; what must stand
    # before it is looked at last.  Texts without digits, most of them, skip
    # what is about numbers.
    digits = text.rlike("[0-9\\x01-\\x04]")
    t = F.regexp_replace(text, "[\\x01-\\x04]", " ")
    t = F.regexp_replace(t, "[,](?=[0-9]{3}(?![0-9]))(?<=[0-9],)", "")
    t = F.regexp_replace(t, "[.](?=[0-9])(?<=[0-9][.])", _IN)
    t = F.when(digits, t).otherwise(text)
    # Names: capitalised words inside a sentence, neighbours as one.
    t = F.regexp_replace(t, "(\\s)(?=\\p{Lu})(?<=[\\p{Ll}\\p{N},;:]\\s)", f"$1{_NAME}")
    # A name goes on from its start only (\G), so that each _IN is inside a
    # word that starts with _NAME; no literal word holds a control character.
    t = F.regexp_replace(
        t, "(?:(\\x03\\p{L}+)(?:['’-]|\\s{1,3}\\x03?)|\\G(?!^)(\\p{L}+)(?:['’-]|\\s{1,3}\\x03))(?=\\p{Lu})",
        f"$1$2{_IN}")
    n = F.regexp_replace(t, f"([0-9][0-9{_IN}]*)", f" {_NUM}$1 ")
    n = F.regexp_replace(n, "[$€£¥]\\s*(?=\\x01)", f" {_UNIT}currency ")
    n = F.lower(F.regexp_replace(n, f"({_NUM}[0-9{_IN}]+)\\s*%", f"$1 {_UNIT}percent "))
    n = F.regexp_replace(n, f"({_NUM}[0-9{_IN}]+)\\s+({'|'.join(UNITS)})(?![\\p{{L}}\\p{{N}}])", f"$1 {_UNIT}$2 ")
    t = F.when(digits, n).otherwise(F.lower(t))
    words = F.split(t, "[^\\p{L}\\p{M}\\p{N}\\x01-\\x04]+")
    return F.filter(words, lambda w: ~w.isin("", _NUM, _UNIT, _NAME, _IN))


def _kind(w: Column) -> Column:
    return F.substring(w, 1, 1)


def windows(df: DataFrame, words: Column, size: int, keep: list[str]) -> DataFrame:
    """(keep..., pos, w, slots, n) for every window of ``size`` template
    ``words``: w hashes the template, slots are hashes of the slot values (0:
    no slot; odd: a number; null: no slot in the text), n counts the windows.

    A window of mostly slots says little, so its values are hashed too, and so
    are those of windows shorter than MIN_WORDS."""
    is_slot = lambda w: _kind(w).isin(_NUM, _UNIT, _NAME)
    # No filter on t: it would go below the projection and make t twice.
    value = lambda w: F.when(_kind(w) == _NUM, F.xxhash64(w).bitwiseOR(F.lit(1))).otherwise(
        F.xxhash64(w).bitwiseAND(F.lit(-2)))
    d = (df.select(*keep, words.alias("t"))
         .select(*keep, F.size("t").alias("m"),
                 F.transform("t", lambda w: F.when(is_slot(w), F.xxhash64(_kind(w)))
                             .otherwise(F.xxhash64(w))).alias("h"),
                 F.when(F.exists("t", is_slot),
                        F.transform("t", lambda w: F.when(is_slot(w), value(w)).otherwise(F.lit(0))))
                 .alias("v")))
    every = lambda i: F.xxhash64(*[F.get("h", i + F.lit(j)) for j in range(size)])
    literal = lambda s: F.size(F.filter(s, lambda x: x == 0))

    def slotted(i):
        s = F.slice("v", i + F.lit(1), F.lit(size))
        return F.struct(F.when((literal(s) * 2 < size) | F.lit(size < MIN_WORDS), F.xxhash64(every(i), s)).otherwise(every(i)).alias("w"),
                        F.when(literal(s) < size, s).alias("s"))
    at = F.when(F.col("m") >= size, F.sequence(F.lit(0), F.col("m") - F.lit(size)))
    plain = F.transform(at, lambda i: F.struct(every(i).alias("w"),
                                               F.lit(None).cast("array<bigint>").alias("s")))
    d = d.select(*keep, (F.col("m") - F.lit(size - 1)).alias("n"),
                 F.posexplode(F.when(F.col("v").isNull(), plain)
                              .otherwise(F.transform(at, slotted))).alias("pos", "x"))
    return d.select(*keep, "n", "pos", F.col("x.w").alias("w"), F.col("x.s").alias("slots"))


# Separators of lower-cased words; ASCII digits stand apart in templates.
_BETWEEN = "[\\x00-\\x60\\x7b-\\x7f[^\\x00-\\x7f\\p{L}\\p{M}\\p{N}]]+"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def rarity(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(word, texts): in how many documents each literal word of the items is;
    counted map-side, for the items' words only."""
    words = (items.select(F.explode("t").alias("word")).where(~_kind(F.col("word")).isin(_NUM, _UNIT, _NAME)).distinct())
    words = materialise(words, "item-words")
    held = docs.select(F.explode(_distinct_words(F.col("text"))).alias("word"))
    return held.join(_small(words, words.count()), "word").groupBy("word").agg(F.count(F.lit(1)).alias("texts"))


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), _BETWEEN))


def anchors(items: DataFrame, rare: DataFrame, size: int) -> DataFrame:
    """(item_id, word, weight, need): the anchor ``word`` of ``weight`` windows
    of the item; a document must hold anchors whose weights add up to need.
    need is not positive for items whose windows lack literal words."""
    t = (items.select("item_id", (F.size("t") - F.lit(size - 1)).alias("n"), F.posexplode("t").alias("p", "word")))
    word = t.where(~_kind(F.col("word")).isin(_NUM, _UNIT, _NAME))
    word = word.join(rare, "word", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    q = F.explode(F.sequence(F.greatest(F.col("p") - F.lit(size - 1), F.lit(0)),
                             F.least("p", F.col("n") - 1))).alias("q")
    rank = F.struct("texts", (-F.length("word")).alias("l"), "word")
    best = (word.select("item_id", "n", "word", "texts", q).groupBy("item_id", "n", "q")
            .agg(F.min(rank)["word"].alias("word")))
    weights = best.groupBy("item_id", "word").agg(F.count(F.lit(1)).alias("weight"))
    held = weights.groupBy("item_id").agg(F.sum("weight").alias("held"))
    have = (t.select("item_id", "n").distinct().join(weights, "item_id", "left").join(held, "item_id", "left"))
    return have.select("item_id", "word", "weight",
                       (F.ceil(F.lit(SHARE) * F.col("n")) - F.col("n") + F.coalesce("held", F.lit(0))).alias("need"))


def _candidates(docs: DataFrame, items: DataFrame, rare: DataFrame, size: int) -> DataFrame:
    """The rows of ``docs`` that hold the anchors of enough windows of an item."""
    a = materialise(anchors(items, rare, size), "anchors")
    if not a.where("need <= 0").isEmpty():
        return docs
    rows = (docs.select("row", F.explode(_distinct_words(F.col("text"))).alias("word")).join(_small(a, a.count()), "word")
            .groupBy("row", "item_id").agg(F.sum("weight").alias("got"), F.max("need").alias("need"))
            .where("got >= need").select("row").distinct())
    # Written first and counted: a small one is sent to the documents (16 bytes
    # a row), a large one is joined by row.
    rows = materialise(rows, "candidates")
    return docs.join(_small(rows, rows.count()), "row", "left_semi")


def _counted(found: Column) -> Column:
    """How many of the windows ``found`` on one alignment, each an array of
    (value of the item, value of the document), agree: those without changes,
    and those in which every value of the item has the one that most of the
    windows give it (of equally many the least)."""
    every = F.flatten(found)
    votes = F.transform(F.array_distinct(every), lambda d: F.struct(
        d["a"].alias("a"), d["b"].alias("b"), F.size(F.filter(every, lambda x: x == d)).alias("n")))

    def elected(v, d):
        return ~F.exists(v, lambda e: (e["a"] == d["a"]) & ((e["n"] > d["n"]) | ((e["n"] == d["n"]) & (e["b"] < d["b"]))))
    chosen = F.transform(F.filter(votes, lambda d: elected(votes, d)), lambda d: F.struct(d["a"].alias("a"), d["b"].alias("b")))
    return F.size(F.filter(found, lambda w: F.forall(w, lambda p: p["a"] == p["b"])
                           | F.forall(w, lambda p: F.array_contains(chosen, p))))


def _hits(docs: DataFrame, items: DataFrame, rare: DataFrame, size: int) -> DataFrame:
    bench = (windows(items, F.col("t"), size, ["item_id"])
             .select(F.col("item_id"), F.col("n").alias("item_windows"), F.col("pos").alias("q"), "w",
                     F.col("slots").alias("item_slots")))
    bench = materialise(bench, "benchmark-windows")
    hit = (windows(_candidates(docs, items, rare, size), tokens(F.col("text")), size, ["row", "doc_id"]).drop("n")
           .join(_small(bench, bench.count()), "w")
           .where((F.col("item_id.form") == 0) | (F.col("q") > 0)
                  | F.coalesce(F.col("item_slots")[0] == F.col("slots")[0], F.lit(True))))
    both = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    pairs = F.when(F.col("item_slots").isNull(), F.array().cast("array<struct<a:bigint,b:bigint>>")).otherwise(
        F.filter(both, lambda p: (p["a"] != 0) & (p["a"].bitwiseAND(F.lit(1)) == 0)))
    # At most as many rows as the item has windows share one alignment.
    g = (hit.groupBy("row", "doc_id", "item_id", "item_windows", (F.col("pos") - F.col("q")).alias("shift"))
         .agg(F.count(F.lit(1)).alias("hits"), F.collect_list(F.array_distinct(pairs)).alias("found")))
    enough = F.lit(SHARE) * F.col("item_windows")
    g = g.where(F.col("hits") >= enough).withColumn("found", _counted(F.col("found")).cast("long"))
    return (g.where(F.col("found") >= enough).groupBy("row", "doc_id", F.col("item_id.id").alias("item_id"))
            .agg(F.max("found").alias("found_windows"), F.max(F.col("item_windows").cast("long")).alias("item_windows")))


def _literal_hits(docs: DataFrame, items: DataFrame, rare: DataFrame, size: int) -> DataFrame:
    """Hits of items of ``size`` < MIN_WORDS words: the same words with the same
    values find the rows that may hold them; these must hold the item's text as
    it is written, not as a part of longer words."""
    bench = materialise(windows(items, F.col("t"), size, ["item_id", "text"]).select("item_id", F.col("text").alias("said"), "w"),
                        "benchmark-windows")
    rows = (windows(_candidates(docs, items, rare, size), tokens(F.col("text")), size, ["row"])
            .join(_small(bench, bench.count()), "w").select("row", F.col("item_id.id").alias("item_id"), "said").distinct())
    edge, quoted = "[\\p{L}\\p{M}\\p{N}]", F.replace(F.trim("said"), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    written = F.concat(F.lit(f"(?<!{edge})\\Q"), quoted, F.lit(f"\\E(?!{edge})"))
    held = docs.join(materialise(rows, "literal-hits"), "row").where(F.regexp_like(F.col("text"), written))
    one = F.lit(1).cast("long")
    return held.select("row", "doc_id", "item_id", one.alias("found_windows"), one.alias("item_windows")).distinct()


def _row_key(id_col: Column, text: Column) -> Column:
    """Names a row by 128 bits of its content: equal rows have equal verdicts."""
    return F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit(1), text, id_col).alias("b"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
            text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(row, doc_id, item_id, found_windows, item_windows) of every document
    that holds a benchmark item, as it is or with other parameters; row is
    the content key of the document's row.

    Items with equal texts count as the one of the smallest id; items shorter
    than a window are matched as a whole, those under MIN_WORDS words as they
    are written; one without words or numbers matches nothing.  Null
    texts match nothing, a null id stays null, repeated rows give one row,
    empty tables give none, other columns are ignored."""
    items = (benchmark.select("item_id", "text").where("text is not null")
             .groupBy("text").agg(F.min("item_id").alias("item_id"))
             .select("item_id", "text", tokens(F.col("text")).alias("t"),
                     tokens(F.concat(F.lit("a "), F.regexp_replace("text", "^\\s+", ""))).alias("inside"))
             .select("item_id", "text", F.posexplode(F.array_distinct(F.array(
                 "t", F.slice("inside", F.lit(2), F.size("inside"))))).alias("form", "t"))
             .select(F.struct(F.col("item_id").alias("id"), "form").alias("item_id"), "text", "t",
                     F.least(F.size("t"), F.lit(window)).alias("size"))
             .where("size > 0"))
    items = materialise(items, "benchmark")
    sizes = [r.size for r in items.select("size").distinct().orderBy("size").collect()]   # at most ``window``
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("row", _row_key(F.col("doc_id"), F.col("text")))
    rare = materialise(rarity(d, items), "rarity")
    out = None
    for size in sizes or [window]:
        part = items.where(F.col("size") == size)
        h = _literal_hits(d, part, rare, size) if size < MIN_WORDS else _hits(d, part.select("item_id", "t"), rare, size)
        out = h if out is None else out.unionByName(h)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per contaminated document id and benchmark item."""
    return (matches(docs, benchmark, id_col, text_col).groupBy("doc_id", "item_id")
            .agg(F.max("found_windows").alias("found_windows"), F.max("item_windows").alias("item_windows")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns unchanged.
    A null text holds none, a null id is an id like others, repeated rows go or
    stay together, empty tables change nothing."""
    # Written first, like the candidates: few rows do not move the documents.
    bad = materialise(matches(docs, benchmark, id_col, text_col).select("row").distinct(), "contaminated")
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key = _row_key(F.col(f"c{names.index(id_col)}"), F.col(f"c{names.index(text_col)}"))
    return safe.withColumn("row", key).join(_small(bad, bad.count()), "row", "left_anti").drop("row").toDF(*names)
