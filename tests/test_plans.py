"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from freshet.bindings import registry
from freshet.bindings.views import view
from freshet.operators import attributes, cleaning, flow, matching, regression
from freshet.operators.order_stats import quantiles
from freshet.operators.sizing import attach, counted, hot_keys
from tests.conftest import SF


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


def test_filters_and_columns_reach_the_scan(spark, capsys, tmp_path):
    path = str(tmp_path / "samples")
    view(spark, SF, "samples").write.parquet(path)
    stored = spark.read.parquet(path)
    plan = plan_of(cleaning.measured_positive(stored).select("station_name", "srp"), capsys)
    pushed = re.search(r"PushedFilters: (.*)", plan).group(1)
    for part in ("EqualTo(data_type,discrete sample point)", "GreaterThan(flow_cfs,0.0)", "GreaterThan(srp,0.0)"):
        assert part in pushed
    narrow = plan_of(flow.geometric_mean_flow(stored), capsys)
    assert "ReadSchema: struct<station_number:string,flow_cfs:double>" in narrow


def test_preparing_samples_does_not_shuffle_them(spark, capsys):
    plan = plan_of(registry.prepared(spark, SF), capsys)
    assert "BroadcastHashJoin" in plan and not re.search(r"(?<!Broadcast)Exchange", plan)
    assert "Window" not in plan


def test_fits_combine_before_the_shuffle(spark, capsys):
    plan = plan_of(regression.regression_compare(registry.prepared(spark, SF)), capsys)
    assert "partial_regr_sxy" in plan
    assert len(re.findall(r"\n\(\d+\) Exchange", plan)) == 1 and "Python" not in plan


def test_above_the_limit_only_hot_keys_are_repeated(spark, capsys):
    """Without hot keys a plain join; with them the table's other rows are still joined once."""
    fact = spark.range(5000).withColumn("k", F.when(F.col("id") < 2500, -1).otherwise(F.col("id")))
    table = counted(spark.range(-1, 5000).select(F.col("id").alias("k"), F.lit(1).alias("w")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        cold = plan_of(attach(fact.where("k > 0"), table, ["k"], limit=0), capsys)
        joined = attach(fact, table, ["k"], limit=0)
        hot = plan_of(joined, capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in cold and "_salt" not in cold and "Broadcast" not in cold
    assert "SortMergeJoin" in hot and "_salt" in hot and joined.count() == 5000
    found = hot_keys(fact, ["k"])
    copies = table.frame.withColumn("_key", F.xxhash64("k")).join(found, "_key", "left").agg(F.sum(F.coalesce("_parts", F.lit(1)))).first()[0]
    assert copies == 5001 + found.first()["_parts"] - 1


def test_values_outside_wanted_bands_do_not_move(spark, capsys, tmp_path):
    """Rows meet their group's wanted bands in the scan's own stage; what an exchange gets was counted before."""
    path = str(tmp_path / "values")
    spark.range(100_000, numPartitions=4).select((F.col("id") % 7).alias("k"), (F.col("id") + 1.5).alias("v")).write.parquet(path)
    plan = plan_of(quantiles(spark.read.parquet(path), ["k"], "v", {"q1": 0.25, "q3": 0.75}), capsys)
    tree = plan[: plan.index("\n\n\n")].splitlines()
    moved = [k for k, line in enumerate(tree) if re.search(r"[- ]Exchange \(", line)]
    assert moved and all("Aggregate" in tree[k + 1] or "Union" in tree[k + 1] for k in moved)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_co_bucketed_tables_join_without_exchange(spark, capsys):
    tables = [spark.range(1000).select((F.col("id") * k % 1000).alias("comid"), F.lit(k).alias(f"v{k}")) for k in (1, 3, 7)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(attributes.bundle_join(attributes.co_bucketed(tables, buckets=4)), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") >= 2 and "Exchange" not in plan


def test_topk_keeps_k_rows_per_task(spark, capsys):
    assert "TakeOrderedAndProject" in plan_of(matching.top_importance(view(spark, SF, "predictors")), capsys)


@pytest.mark.parametrize(
    "name", ["fuzzy_describe", "inverse_scale", "histogram_fixed_width", "partial_dependence", "season_unpivot"]
)
def test_no_nested_loops_or_products(spark, capsys, name):
    plan = plan_of(registry.QUERIES[name].run(spark, SF), capsys)
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
