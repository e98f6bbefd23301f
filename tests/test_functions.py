"""Column builders on hand-built rows."""

import math

import pytest
from pyspark.sql import functions as F

from freshet.functions import labels
from freshet.functions.conditions import flag, sole_value, unless_missing
from freshet.functions.numbers import magnitude_band, normal_two_sided, settle, t_two_sided
from freshet.functions.seasons import SEASONS, level_order, season_of


def column(spark, values, schema, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {schema}")
    return [r[1] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_seasons_wrap_the_year(spark):
    got = column(spark, range(0, 14), "int", season_of(F.col("v")))
    assert got == [
        None, "Early Winter", "Late Winter", "Late Winter", "Spring", "Spring", "Early Summer",
        "Early Summer", "Late Summer", "Late Summer", "Fall", "Early Winter", "Early Winter", None,
    ]
    assert column(spark, [*SEASONS, "Monsoon", None], "string", level_order(F.col("v"))) == [
        1, 2, 3, 4, 5, 6, None, None,
    ]


def test_station_ids(spark):
    ids = ["H01022001", "X" + "9" * 20]
    got = column(spark, ids, "string", labels.strip_prefix_letter(F.col("v")))
    assert got == ["01022001", "9" * 13]
    padded = column(spark, [1022001, 123456789, None], "bigint", labels.pad_station(F.col("v")))
    assert padded[:2] == ["01022001", "123456789"]


def test_text(spark):
    v = F.col("v")
    assert column(spark, ["aWsbCat", "none"], "string", labels.drop_first(v, "Cat|Ws")) == ["abCat", "none"]
    assert column(spark, ["D1-T-T"], "string", labels.drop_text(v, "-T")) == ["D1"]
    assert column(spark, ["a b\tc"], "string", labels.spaces_to_lines(v)) == ["a\nb\nc"]
    assert column(spark, [33600, 1, None], "int", labels.relabel(v, {33600: "Ditch"})) == ["Ditch", None, None]


def test_p_label_sees_the_rounded_value(spark):
    got = column(spark, [0.0012, 0.0049, 0.006, None], "double", labels.significance_label(F.col("v")))
    assert got == ["<0.001", "<0.001", "0.01", None]


def test_flag_keeps_missing(spark):
    assert column(spark, [1.0, 3.0, None], "double", flag(F.col("v") > 2, "y", "n")) == ["n", "y", None]


def test_unless_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(unless_missing(F.sum, F.col("v")).alias("s")).collect()}
    assert got == {"a": None, "b": 2.0}


def test_sole_value_rejects_two(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "k string, v string")
    pick = sole_value(F.col("v")).alias("v")
    assert {r.k: r.v for r in df.groupBy("k").agg(pick).collect()} == {"a": "x", "b": None}
    mixed = spark.createDataFrame([("a", "x"), ("a", None)], "k string, v string")
    with pytest.raises(Exception, match="constant within its group"):
        mixed.groupBy("k").agg(pick).collect()


def test_settle_ignores_summation_noise(spark):
    noisy = [0.0125, 0.0125 - 1e-17, 0.0125 + 1e-17, 0.3 * 0.125 + 0.000]
    assert column(spark, noisy[:3], "double", settle(F.col("v"), 3)) == [0.013] * 3


def test_band_never_decreases(spark):
    values = sorted(
        [-(10.0**e) for e in range(-300, 300, 7)] + [0.0, 5e-324, 1.7e308]
        + [10.0**e * f for e in range(-300, 300, 7) for f in (1, 1.0000001, 3)]
    )
    for per_octave in (16, 65536):
        bands = column(spark, values, "double", magnitude_band(F.col("v"), per_octave))
        assert bands == sorted(bands)


T_POINTS = [
    (3.56, 38, 0.00101631), (2.5, 8, 0.03694204), (1.0, 1, 0.5), (2.0, 2, 0.18350342),
    (2.27, 7, 0.05747749), (2.0, 600, 0.04595055), (0.0, 5, 1.0), (float("inf"), 4, 0.0),
]


def test_t_tail_points(spark):
    df = spark.createDataFrame([(t, v) for t, v, _ in T_POINTS], "t double, v bigint")
    got = [r[0] for r in df.select(t_two_sided("t", "v")).collect()]
    assert got == pytest.approx([p for *_, p in T_POINTS], abs=1e-8)


def test_t_tail_is_continuous_where_the_method_changes(spark):
    points = [(t, v) for t in (0.01, 0.5, 1.0, 3.0, 8.0, 20.0) for v in (2000, 2001)]
    df = spark.createDataFrame(points, "t double, v bigint")
    got = [r[0] for r in df.select(t_two_sided("t", "v")).collect()]
    for low, high in zip(got[::2], got[1::2]):
        assert low == pytest.approx(high, rel=5e-2) and low >= high
    one = spark.createDataFrame([(2.0, 2001)], "t double, v bigint")
    exact = one.select(t_two_sided("t", "v", beta_up_to=5000)).first()[0]
    near = one.select(t_two_sided("t", "v", beta_up_to=5)).first()[0]
    assert near == pytest.approx(exact, rel=1e-10)


def test_t_tail_without_degrees_of_freedom(spark):
    df = spark.createDataFrame([(1.0, 0), (None, 5)], "t double, v bigint")
    assert [r[0] for r in df.select(t_two_sided("t", "v")).collect()] == [None, None]


def test_normal_tail(spark):
    zs = [0.0, 0.5, 2.9, 3.1, 9.0, 30.0]
    got = column(spark, zs, "double", normal_two_sided("v"))
    assert got == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-10)


# t, n and printed p of published seasonal fits (two-digit rounding).
PRINTED = [(10.66, 128, 0.0), (4.84, 128, 0.0), (3.75, 23, 0.0), (-0.7, 40, 0.49)]


def test_printed_p_values_follow_from_t_and_n(spark):
    df = spark.createDataFrame([(t, n - 2) for t, n, _ in PRINTED], "t double, v bigint")
    got = [r[0] for r in df.select(t_two_sided("t", "v")).collect()]
    assert [round(p, 2) for p in got] == pytest.approx([p for *_, p in PRINTED], abs=0.011)
