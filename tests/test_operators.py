"""Operators on small tables where the answer is worked out by hand or brute force."""

import datetime as dt
import math
import random
import re
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.operators import (
    attributes, cleaning, field, flow, matching, order_stats, regression, seasonal, splitting, summaries,
    transport, weighted,
)
from freshet.operators.order_stats import bands_for, quantiles
from freshet.operators.sizing import Sized, attach, counted, hot_keys, summarised
from freshet.plans import stations
from freshet.sources import readers, schemas, sinks

SAMPLES = "station_number string, station_name string, date date, srp double, flow_cfs double, data_type string"
SLOW = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def samples_of(spark, rows):
    day = dt.date(2014, 8, 1)
    full = [(f"{s:08d}", f"Gage {s}", day, c, q, kind) for s, c, q, kind in rows]
    return spark.createDataFrame(full, SAMPLES)


def brute_fractions(flows):
    known = [f for f in flows if f is not None]
    rank = {f: sum(x < f for x in known) + (known.count(f) + 1) / 2 for f in known}
    return [None if f is None else rank[f] / len(flows) for f in flows]


def test_rank_fraction_of_ties_and_missing(spark):
    flows = [1.0, 2.0, 2.0, 4.0, None]
    df = samples_of(spark, [(1, 0.1, q, "m") for q in flows])
    got = [(r.flow_cfs, r.percent_rank) for r in flow.flow_percent_rank(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1.0, 0.2), (2.0, 0.5), (2.0, 0.5), (4.0, 0.8), (None, None)], key=str
    )


@SLOW
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, -1.5, 0.5, 2.0, 2.0000001, 1e9])), min_size=1, max_size=40))
def test_rank_fraction_and_flag_against_brute_force(spark, flows):
    df = samples_of(spark, [(1, 0.1, q, "m") for q in flows] + [(2, 0.1, 0.0, "m")] * 60)
    ranked = flow.flow_percent_rank(df).where("station_name = 'Gage 1'").collect()
    want = brute_fractions(flows)
    assert sorted((str(r.flow_cfs), r.percent_rank) for r in ranked) == sorted(
        (str(f), w) for f, w in zip(flows, want)
    )
    flagged = flow.flag_low_flow(df).where("station_name = 'Gage 1'").collect()
    names = {True: "yes", False: "no"}
    assert sorted((str(r.flow_cfs), str(r.lowflow)) for r in flagged) == sorted(
        (str(f), str(None if w is None else names[w <= 0.25])) for f, w in zip(flows, want)
    )


def test_bands_follow_the_row_count():
    assert [bands_for(n) for n in (0, 10**6, 3 * 10**7, 10**12)] == [16, 16, 32, 2**20]


def test_fine_bands_give_the_same_ranks(spark, monkeypatch):
    rng = random.Random(5)
    df = samples_of(spark, [(1, 0.1, rng.choice([0.0, rng.lognormvariate(0, 3)]), "m") for _ in range(300)])
    coarse = sorted((r.flow_cfs, r.percent_rank) for r in flow.flow_percent_rank(df).collect())
    monkeypatch.setattr(order_stats, "ROWS_PER_BAND", 0.01)
    fine = sorted((r.flow_cfs, r.percent_rank) for r in flow.flow_percent_rank(df).collect())
    assert coarse == fine


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [
        ("Pct.*Crop", "Crop"), ("abc", "abc"), ("ab?cde", "cde"), ("a|bcd", ""), ("(ab|cd)efg", "efg"), ("[abc]xyz[^]z]q", "xyz"),
        (r"a\.b\d+cc", "cc"), ("[a[b]c]d", ""), ("ab+?cd+", "cd"), ("((((((((a))))))))b", ""), ("ab+cd", "cd"), ("x{2,3}yy", "yy"), ("(?i)abc", ""), ("(a(b)c)d", "d"), (".*", ""), ("", ""),
        ("ab*", "a"), (r"\bword\b", "word"), ("a{0}bc", "bc"), (r"\Qa.b\E", ""),
    ],
)
def test_required_literal(spark, pattern, literal):
    one = spark.createDataFrame([(pattern,)], "p string")
    assert one.select(matching.required_literal(F.col("p"))).first()[0] == literal


def test_regex_patterns_meet_only_names_with_their_literal(spark):
    patterns = ["Crop.*Ws", "^P[a-z]+t$", "Crop", "[0-9]{4}", "Tile|Ditch", "Soil", ".*", "no+pe", ""]
    names = ["PctCrop2010Ws", "CropCat", "Plant", "Tile_1", "Ditch", "Soil", "nooope", "", "x" * 30]
    definitions = spark.createDataFrame([(p, f"d{k}") for k, p in enumerate(patterns)], "pattern string, description string")
    table = spark.createDataFrame([(n, 1.0) for n in names], "predictor string, importance double")
    got = {(r.predictor, r.pattern) for r in matching.matching_definitions(table, summarised(definitions, "p")).collect()}
    assert got == {(n, p) for n in names for p in patterns if re.search(p, n)}


def test_many_names_and_patterns(spark):
    """1e5 names and 1e3 patterns with regular-expression syntax: rows met are those with the literal."""
    names = spark.range(100_000).select(F.concat(F.lit("name"), F.col("id"), F.lit("end")).alias("predictor"), F.lit(1.0).alias("importance"))
    patterns = spark.range(1000).select(F.concat(F.lit("^name"), 90_000 + F.col("id"), F.lit("[a-z]+$")).alias("pattern"), F.lit("d").alias("description"))
    found = matching.matching_definitions(names, summarised(patterns, "p"))
    assert found.count() == 1000 and found.select("predictor").distinct().count() == 1000


@pytest.mark.parametrize("rows_per_band", [1_000_000, 3])
def test_positions_in_narrow_tied_and_mixed_groups(spark, monkeypatch, rows_per_band):
    """Groups inside a millionth of their value, all alike, of both signs, and with missing values."""
    monkeypatch.setattr(order_stats, "ROWS_PER_BAND", rows_per_band)
    monkeypatch.setattr(order_stats, "SUBBANDS", 4)
    draw = random.Random(4)
    values = {
        "narrow": [1e6 + draw.random() * 1e-3 for _ in range(60)], "tied": [2.5] * 30 + [2.6] * 2, "one": [7.0],
        "signs": [draw.uniform(-1, 1) for _ in range(41)] + [0.0, -0.0, 1e-300, -1e300], "gaps": [1.0, None, 3.0, float("nan")], "none": [None],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double").repartition(5)
    got = {r.k: r for r in quantiles(df, ["k"], "v", {"low": 0.0, "q1": 0.25, "p37": 0.37, "high": 1.0}).collect()}
    for k, vs in values.items():
        known = sorted(v for v in vs if v is not None and v == v)
        if not known:
            assert k not in got
            continue
        for name, p in (("low", 0.0), ("q1", 0.25), ("p37", 0.37), ("high", 1.0)):
            at = (len(known) - 1) * p
            low, high = known[math.floor(at)], known[math.ceil(at)]
            assert got[k][name] == pytest.approx(low + (high - low) * (at - math.floor(at)), rel=1e-15)
    alone = quantiles(df.where("k = 'narrow'"), [], "v", {"median": 0.5}).collect()
    assert len(alone) == 1 and alone[0].median == pytest.approx(statistics.median(values["narrow"]), rel=1e-15)


def test_quantiles_against_brute_force(spark):
    rng = random.Random(7)
    groups = {k: [rng.choice([rng.gauss(0, 10), 1.0]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 101))}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75}).collect()
    for row in got:
        values = groups[row.k]
        if len(values) > 1:
            want = statistics.quantiles(values, n=4, method="inclusive")
            assert [row.q1, row.median, row.q3] == pytest.approx(want)
        else:
            assert [row.q1, row.median, row.q3] == values * 3


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_attach_equals_broadcast(spark, how):
    fact = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    table = counted(spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")))
    plain, salted = attach(fact, table, ["k"], how), attach(fact, table, ["k"], how, limit=0)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.collect()), key=str)
    assert plain.columns == salted.columns


def test_hot_keys_are_found_and_only_they_are_dealt(spark):
    fact = spark.range(30000, numPartitions=12).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("same").alias("text"))
    hot = hot_keys(fact, ["k"]).collect()
    assert [(r["_key"], r["_parts"]) for r in hot] == [(fact.where("k = 7").select(F.xxhash64("k")).first()[0], 3)]
    table = Sized(spark.range(30000).select(F.col("id").alias("k"), F.col("id").alias("v")), 30000)
    joined = attach(fact, table, ["k"], limit=0)
    assert joined.agg(F.count("*"), F.sum("v")).first() == fact.join(table.frame, "k").agg(F.count("*"), F.sum("v")).first()
    assert hot_keys(spark.range(5000).select(F.col("id").alias("k")), ["k"]) is None
    assert hot_keys(fact.where("k < 0"), ["k"]) is None


def test_equal_rows_of_a_hot_key_reach_several_tasks(spark):
    """A third of all rows alike in every column: none of the join's tasks has more than its part of them."""
    fact = spark.range(24000, numPartitions=24).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 10).alias("k"))
    table = Sized(spark.range(24010).select(F.col("id").alias("k"), F.lit(1).alias("v")), 24010)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = attach(fact, table, ["k"], limit=0).where("k = 1").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in tasks) == 8000 and len(tasks) >= 2 and max(r["count"] for r in tasks) <= 6000


def test_measured_bytes_of_texts(spark):
    long = spark.range(10).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    assert summarised(long, "long").bytes_in_memory > 1_000_000 > Sized(long, 10).bytes_in_memory


def test_summarised_counts_rows(spark):
    assert summarised(spark.range(123), "numbers").rows == 123


def test_clean_drops_before_typing(spark):
    raw = spark.createDataFrame(
        [
            ("Gage 1", "H00000001", "8/3/2014", "0.05", "10", "m", "x"),
            ("Gage 1", "H00000001", "13/40/2014", "<0.005", "10", "m", "x"),
            ("Gage 1", "H00000001", "8/3/2014", "0.05", "10", "m", None),
        ],
        ["Station", "Station number", "Sample date", "Daily Conc. (mg/L)", "Flow (cfs)", "Data type", "Note"],
    )
    got = sorted(map(tuple, cleaning.clean_samples(raw).collect()), key=str)
    assert got == sorted(
        [
            ("00000001", "Gage 1", dt.date(2014, 8, 3), 0.05, 10.0, "m"),
            ("00000001", "Gage 1", None, None, 10.0, "m"),
        ],
        key=str,
    )


def test_prepared_equals_separate_steps(spark):
    rng = random.Random(3)
    kinds = [cleaning.MEASURED, "modeled"]
    rows = [
        (s, rng.choice([0.0, 0.02, 0.3]), float(rng.randint(0, 30)), rng.choice(kinds))
        for s in (1, 2) for _ in range(150)
    ]
    df = samples_of(spark, rows + [(3, 0.1, 5.0, cleaning.MEASURED)] * 5)
    combined = stations.prepared_samples(df).select("station_name", "srp", "flow_cfs", "lowflow", "n", F.round("normalized_flow", 9))
    steps = flow.normalize_flow(
        flow.min_samples_per_site(cleaning.measured_positive(flow.flag_low_flow(df))), record=df
    ).select("station_name", "srp", "flow_cfs", "lowflow", "n", F.round("normalized_flow", 9))
    assert sorted(map(tuple, combined.collect())) == sorted(map(tuple, steps.collect()))
    assert {r.station_name for r in combined.collect()} == {"Gage 1", "Gage 2"}


LINES = "k string, x double, y double"


def fits(spark, rows, **kw):
    df = spark.createDataFrame(rows, LINES)
    out = regression.fit_lines(df, ["k"], F.col("y"), F.col("x"), **kw)
    return {r.k: r for r in out.collect()}


def test_small_and_degenerate_fits(spark):
    got = fits(
        spark,
        [("one", 1.0, 2.0)]
        + [("two", 1.0, 2.0), ("two", 2.0, 4.0)]
        + [("flat", float(i), 5.0) for i in range(4)]
        + [("wall", 3.0, float(i)) for i in range(4)]
        + [("gap", None, 1.0)]
        + [("exact", float(i), 2.0 * i) for i in range(5)],
    )
    assert got["one"].slope is None and got["one"].n == 1
    assert (got["two"].slope, got["two"].t_stat, got["two"].p) == (2.0, None, None)
    assert got["flat"].r2 is None and got["flat"].slope == 0.0 and got["flat"].t_stat is None
    assert got["wall"].slope is None and got["wall"].p is None
    assert "gap" not in got
    assert got["exact"].t_stat == float("inf") and got["exact"].p == 0.0


def test_known_fit_and_glance(spark):
    x, y = [1.0, 2.0, 3.0, 4.0, 5.0], [2.1, 3.9, 6.2, 7.8, 10.1]
    row = fits(spark, [("k", a, b) for a, b in zip(x, y)], glance=True)["k"]
    slope, intercept = statistics.linear_regression(x, y)
    sse = sum((b - intercept - slope * a) ** 2 for a, b in zip(x, y))
    assert row.slope == pytest.approx(slope) and row.intercept == pytest.approx(intercept)
    assert row.deviance == pytest.approx(sse) and row.df_residual == 3
    assert row.f_stat == pytest.approx(row.t_stat**2)
    assert row.r2 == pytest.approx(row.t_stat**2 / (row.t_stat**2 + 3))
    assert row.bic - row.aic == pytest.approx(3 * (statistics.math.log(5) - 2))


def test_scaling_flow_leaves_the_slope(spark):
    rng = random.Random(1)
    rows = [("k", rng.uniform(1, 9), rng.uniform(1, 9)) for _ in range(50)]
    df = spark.createDataFrame(rows, LINES)
    a, b = (
        regression.fit_lines(df, ["k"], F.log10("y"), F.log10(F.col("x") * c)).first() for c in (1, 250)
    )
    assert (a.slope, a.t_stat, a.p, a.r2) == pytest.approx((b.slope, b.t_stat, b.p, b.r2))


BEHAVIORS = [
    (0.01, 0.2, 0.2, "chemostatic"), (0.01, -0.2, 0.9, "diluting"), (0.01, 0.2, 0.9, "mobilizing"),
    (0.2, 0.1, 0.9, "chemodynamic"), (0.2, 0.1, 0.2, "chemostatic"), (0.05, 0.1, 0.31, "chemodynamic"),
    (None, None, None, None), (None, None, 0.2, "chemostatic"), (None, None, 0.9, None),
    (0.01, 0.2, None, None), (0.01, 0.2, 0.3, "chemostatic"),
]


def test_behavior_rules(spark):
    df = spark.createDataFrame(
        [(i, p, b, c) for i, (p, b, c, _) in enumerate(BEHAVIORS)], "i int, p double, b double, c double"
    )
    rule = transport.behavior(F.col("p"), F.col("b"), F.col("c")).alias("x")
    assert [r.x for r in df.orderBy("i").select(rule).collect()] == [want for *_, want in BEHAVIORS]


def test_cv_ratio_uses_all_flows_and_measured_concentrations(spark):
    m = cleaning.MEASURED
    rows = [(1, 0.0, 1.0, m), (1, 0.4, 3.0, m), (1, 9.0, 8.0, "modeled"), (2, None, 1.0, m), (2, 0.1, 2.0, m), (3, 1.0, 1.0, "modeled")]
    got = {r.station_number: r.cv_ratio for r in transport.cv_ratio(samples_of(spark, rows)).collect()}
    c, q = [0.0, 0.4], [1.0, 3.0, 8.0]
    want = statistics.mean(q) * statistics.stdev(c) / (statistics.mean(c) * statistics.stdev(q))
    assert got == {"00000001": pytest.approx(want), "00000002": None}


def test_impact_and_source_flags(spark):
    df = spark.createDataFrame(
        [(None, 0.2, 0.0), (None, 0.0, 0.001), (0.6, None, 0.005), (0.1, 0.0, 0.006)],
        "pct_crop double, pct_urb_hi double, wwtp_dens double",
    )
    got = attributes.impact_flags(df).collect()
    assert [r.impacted for r in got] == ["Impacted", None, "Impacted", "Less Impacted"]
    assert [r.wwtp_category for r in got] == ["None", "Limited", "Higher", "Higher"]
    assert [r.wwtp_none for r in got] == ["No WWTP"] + ["WWTP present"] * 3


def test_daily_weighting(spark):
    t = dt.datetime(2014, 8, 1, 3)
    rows = [
        ("D1-T", t, 1.0, 0.5, 0.1, None), ("D1-T", t.replace(hour=5), 3.0, 0.9, 0.3, 1.0),
        ("D2-F", t, 0.0, 0.5, 0.1, 1.0), ("D3-T", t, 2.0, 0.2, 0.2, 1.0),
    ]
    df = spark.createDataFrame(rows, "site_id string, datetime timestamp, flow_cfs double, tp_mgl double, dop_mgl double, nh3_mgl double")
    got = weighted.flow_weighted_daily(df, ("tp_mgl", "dop_mgl", "nh3_mgl")).collect()
    assert len(got) == 1  # no flow on D2; no particulate on D3
    row = got[0]
    assert (row.tp_mgl, row.dop_mgl, row.nh3_mgl) == (pytest.approx(0.8), pytest.approx(0.25), None)
    assert (row.type, row.season, row.year) == ("Tile", "Late Summer", "2014")
    assert 0.5 <= row.tp_mgl <= 0.9


def test_pivot_and_unpivot_are_inverse(spark):
    counts = spark.createDataFrame([("a", "Fall", 3), ("a", "Spring", 2), ("b", "Fall", 1)], "station_name string, season string, n bigint")
    wide = seasonal.season_pivot(counts, ["station_name"], "n")
    long = seasonal.season_unpivot(wide, ["station_name"], "n")
    assert long.count() == 12
    assert sorted(map(tuple, long.where("n is not null").collect())) == sorted(map(tuple, counts.collect()))
    total = seasonal.season_site_totals(counts).first()
    assert (total["Fall"], total["Spring"]) == (1, None)


def test_mask_keeps_three(spark):
    df = spark.createDataFrame([(2, 0.1), (3, 0.2)], "n int, mean_srp double")
    assert [r.mean_srp for r in seasonal.mask_small_groups(df).orderBy("n").collect()] == [None, 0.2]


def test_boxplot_outliers_and_limits(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -999.0]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    row = summaries.boxplot_stats(df, ["k"], "v", value_range=(0, 200)).first()
    assert (row.lower_whisker, row.upper_whisker, row.outliers, row.n) == (1.0, 5.0, 1, 6)


def test_bundle_keeps_common_keys(spark):
    a = spark.createDataFrame([(1, 1.0, 9.0), (2, 2.0, 9.0)], "comid int, x double, WsAreaSqKm double")
    b = spark.createDataFrame([(2, 5.0, 9.0)], "comid int, y double, WsAreaSqKm double")
    area = spark.createDataFrame([(1, 7.0), (2, 8.0)], "comid int, WsAreaSqKm double")
    got = attributes.bundle_join([a, b], area=area)
    assert [tuple(r) for r in got.collect()] == [(2, 2.0, 5.0, 8.0)]


def test_zero_columns_and_null_shares(spark):
    df = spark.createDataFrame([("a", 0.0, None, 1), ("b", 0.0, 0.0, 0)], "s string, z double, zn double, i int")
    assert attributes.drop_all_zero_columns(df).columns == ["s", "i"]
    sparse = attributes.null_fraction_by_column(df, above=0.2).collect()
    assert [tuple(r) for r in sparse] == [("zn", 0.5)]


DEFINITIONS = [
    ("PctCrop[Year][AOI]", "crop"), ("Pct[AOI]", "share"), ("Kffact[AOI]", "k"), ("Ag.fact", "dot"),
    ("Clay|Sand[AOI]", "either"), ("Crop2019[AOI]", "late crop"),
]
NAMES = ["PctCrop2019Ws", "PctCrop2019CatRp100", "AgKffactWs", "KffactCat", "ClayWs", "SandCat", "Tile_density", "AgXfact"]


def test_descriptions_equal_a_nested_loop_of_regular_expressions(spark):
    import re

    names = spark.createDataFrame([(n, float(i)) for i, n in enumerate(NAMES)], "predictor string, importance double")
    definitions = spark.createDataFrame(DEFINITIONS, "metric_name string, description string")
    got = {r.predictor: r.description for r in matching.fuzzy_describe(names, definitions).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {}
    for name in NAMES:
        patterns = [(m.replace("[Year]", "", 1).replace("[AOI]", "", 1), d) for m, d in DEFINITIONS]
        found = [(distance(re.sub("Cat|Ws", "", name, count=1), p), p, d) for p, d in patterns if re.search(p, name)]
        if found:
            want[name] = min(found)[2]
    assert got == want


def test_field_join_and_events(spark):
    chem = spark.createDataFrame([("F1", "8/14/2014", 120.0), ("F1", "8/20/2014", None), ("F9", "8/20/2014", 1.0)], "site_id string, date string, srp double")
    areas = spark.createDataFrame([("F1", 3.5)], "site_id string, ws_area double")
    sites = spark.createDataFrame([("F1", 33600, "lake", "LS")], "site_id string, fcode int, outlet_typ string, basin string")
    rows = field.field_samples(chem, areas, sites)
    got = field.event_summary(field.event_rows(rows, ["LS"], [(2014, 8)])).collect()
    assert [tuple(r) for r in got] == [("F1", 0.12, "Ditch", "lake")]


@pytest.mark.parametrize("n", [1, 7, 10, 127, 2000])
def test_split_is_exact_and_repeatable(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    first = {r.row_id: r.split for r in splitting.exact_split(df, "row_id").collect()}
    again = {r.row_id: r.split for r in splitting.exact_split(df.repartition(5), "row_id").collect()}
    assert list(first.values()).count("train") == int(0.7 * n) and first == again


def test_shuffle_permutes_within_strata(spark):
    df = spark.range(600).select("id", (F.col("id") % 3).alias("s"), F.col("id").cast("double").alias("v"))
    moved = {r.id: r.v for r in splitting.shuffled_within(df, "id", "v", ["s"], 1).collect()}
    assert sorted(moved.values()) == [float(i) for i in range(600)]
    assert all(int(v) % 3 == i % 3 for i, v in moved.items())
    assert sum(int(v) == i for i, v in moved.items()) < 30


def test_scaling_and_back(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(20)], "a double, b double")
    scaled = splitting.standardize(df, ["a", "b"], df)
    mean, sd = scaled.agg(F.avg("a"), F.stddev_samp("a")).first()
    assert mean == pytest.approx(0, abs=1e-12) and sd == pytest.approx(1)
    back = splitting.unscale(scaled, ["b"], df, "b").agg(F.max("b_unscaled")).first()[0]
    assert back == pytest.approx(361.0)


def test_csv_keeps_missing_quotes_and_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("a, \"b\"", None), ("", 1.5)], "s string, x double")
    path = str(tmp_path / "t")
    sinks.write_csv(df, path)
    back = readers.read_delimited(spark, path, "s string, x double")
    assert ('a, "b"', None) in [tuple(r) for r in back.collect()] and back.count() == 2
    marked = tmp_path / "bom.csv"
    marked.write_bytes(b"\xef\xbb\xbfid,v\n01,NA\n")
    [row] = readers.read_bundle(spark, [str(marked)], ["id string, v double"])[0].collect()
    assert tuple(row) == ("01", None)


def test_station_and_site_files(spark, tmp_path):
    files = {
        "gages": "Station_number,Site_name,COMID,Area_Km2\n1022001,\"A, B\",77,19.5\n",
        "density": "OID_,HydroID,usgs_id,station_ALL_clean,name_ALL_clean,Area_Km2,QC_Flag,QC_complete,"
        "Area_Km2_retab,ORIG_FID,Shape_Length,Shape_Area,Tile_density\n"
        "1,,05,1022001,\"A, B\",19.5,,,19.5,1,1,2,250.5\n",
        "areas": "OID_,OBJECTID,Site_ID,Shape_Leng,Shape_Area,WS_area\n1,1,12a,2,3,0.5\n",
    }
    read = {}
    for name, schema in (("gages", schemas.GAGES), ("density", schemas.TILE_DENSITY), ("areas", schemas.WATERSHED_AREAS)):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(b"\xef\xbb\xbf" + files[name].encode())
        read[name] = readers.read_delimited(spark, str(path), schema)
    assert [tuple(r) for r in attributes.gage_table(read["gages"]).collect()] == [("01022001", 77, 19.5)]
    assert [tuple(r) for r in attributes.tile_density_table(read["density"]).collect()] == [("01022001", 250.5)]
    assert [tuple(r) for r in field.watershed_areas(read["areas"]).collect()] == [("12a", 0.5)]


def test_thresholds_count_stations_without_transport_or_attributes(spark):
    means = [(k, k, "Late Summer", 0.05, 5) for k in ("a", "b", "c")] + [("d", "d", "Spring", 0.05, 5)]
    summary = spark.createDataFrame(means, "station_number string, station_name string, season string, mean_srp double, n long")
    fits = spark.createDataFrame([("a", 5.0, 1.0, 0.01), ("b", 5.0, 1.0, 0.2)], "station_number string, pct_slope_change double, slope2 double, p2 double")
    described = counted(spark.createDataFrame([("a",), ("c",)], "station_number string"))
    assert tuple(seasonal.threshold_site_count(summary, fits, described).first()) == (3, 1, 1)


def test_columns_go_by_header(spark, tmp_path):
    first, second = tmp_path / "a_C_Q.csv", tmp_path / "b_C_Q.csv"
    first.write_text("Year,v,id,note\n2013,1.5,01,\n2014,,NA,x\n2015,bad,03,NA\n")
    rows = readers.read_delimited(spark, str(first), "id string, v double, note string").collect()
    assert [tuple(r) for r in rows] == [("01", 1.5, ""), (None, None, "x"), ("03", None, None)]
    kept = readers.read_delimited(spark, str(first), "id string", others=True)
    assert kept.columns == ["id", "Year", "v", "note"] and kept.dropna().count() == 1
    with pytest.raises(ValueError, match="no column flow"):
        readers.read_delimited(spark, str(first), "id string, flow double")
    second.write_text("v,Year,id,note\n1.5,2013,01,\n")
    with pytest.raises(Exception, match="CSV header"):
        readers.read_matching(spark, str(tmp_path), "*_C_Q.csv", "id string, v double").collect()


def test_dotted_names_and_missing_ids(spark):
    from freshet.functions.labels import pad_station
    from freshet.operators.attributes import drop_all_zero_columns, null_fraction_by_column
    from freshet.operators.cleaning import round_numeric

    df = spark.createDataFrame([(1.234, 0, None), (None, 0, "7")], "`mean.SRP` double, `NO2.NO3` int, id string")
    assert {r.column_name: r.null_share for r in null_fraction_by_column(df).collect()} == {"mean.SRP": 0.5, "NO2.NO3": 0.0, "id": 0.5}
    assert drop_all_zero_columns(df).columns == ["mean.SRP", "id"]
    assert [r["mean.SRP"] for r in round_numeric(df, 1).collect()] == [1.2, None]
    assert [r[0] for r in df.select(pad_station(df["id"])).collect()] == [None, "00000007"]
