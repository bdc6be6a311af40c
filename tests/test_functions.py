"""Scalar helpers: key, formatting, bands, mapping, extremes."""

from pyspark.sql import functions as F

from windlass.functions.scalar import (fixed, metrics_key, reported_max, reported_min, safe_div,
                                       threshold_status, value_text)


def test_scalar_helpers(spark):
    df = spark.createDataFrame(
        [("A", "B", 258.405, 2.0, 0.0, -1.0), (None, "B", None, 0.0, 1.0, 5e-324)],
        "c string, r string, x double, n double, flag double, m double")
    bands = [(None, "green"), (25.0, "yellow"), (75.0, "red")]
    rows = df.select(
        metrics_key("c", "r").alias("key"),
        fixed("x", 2, missing="N/A").alias("txt"),
        safe_div("x", "n").alias("avg"),
        threshold_status(F.col("flag") * 80.0, bands).alias("band"),
        value_text("flag", {0.0: "INACTIVE", 1.0: "PEAK"}).alias("mapped"),
        reported_max("m").alias("mx"),
        reported_min(F.lit(1.7976931348623157e308)).alias("mn"),
    ).collect()
    assert [r.key for r in rows] == ["A#B", "null#B"]
    assert [r.txt for r in rows] == ["258.41", "N/A"]      # Java HALF_UP on the shortest form
    assert rows[0].avg == 258.405 / 2 and rows[1].avg == 0.0
    assert [r.band for r in rows] == ["green", "red"]
    assert [r.mapped for r in rows] == ["INACTIVE", "PEAK"]
    assert [r.mx for r in rows] == [0.0, 0.0]             # never above Double.MIN_VALUE
    assert [r.mn for r in rows] == [0.0, 0.0]             # untouched Double.MAX_VALUE seed


def test_exact_sum_is_exact_in_any_order(spark):
    """Money sums equal the rounded rational sum, for any partitioning, merged
    or not; other doubles, infinities and nulls are added as usual."""
    import random
    from fractions import Fraction
    from pyspark.sql import functions as F
    from windlass.functions.scalar import exact_sum
    rnd = random.Random(3)
    money = [round(rnd.uniform(-1, 1) * 10 ** rnd.randint(0, 11), rnd.choice([0, 2, 4])) for _ in range(4000)] + [0.1] * 999
    want = float(sum(Fraction(str(x)) for x in money))
    rows = [(i % 7, x) for i, x in enumerate(money)]
    got = set()
    for parts in (1, 3, 11):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, v double").repartition(parts)
        got.add(df.agg(exact_sum("v").alias("s")).first().s)
    assert got == {want}
    small = [(k, round(v % 1000, 2)) for k, v in rows]
    df = spark.createDataFrame(small, "k int, v double")
    twice = df.groupBy("k").agg(exact_sum("v").alias("v")).agg(exact_sum("v").alias("s")).first().s
    assert twice == float(sum(Fraction(str(v)) for _, v in small))
    odd = lambda *vs: spark.createDataFrame([(v,) for v in vs], "v double").agg(exact_sum("v").alias("s")).first().s
    assert odd(None) is None and odd(None, 1.5) == 1.5 and odd(1e300, 2.0, 1e-9) == 1e300 + 2.0
    assert odd(float("inf"), 1.0) == float("inf") and odd(float("nan"), 1.0) != odd(1.0) and odd(-0.25, 1 / 3) == 1 / 3 - 0.25
