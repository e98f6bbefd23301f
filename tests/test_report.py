"""The analysis end to end on the smallest tables."""

from freshet.bindings.views import view
from freshet.operators.cleaning import complete_cases
from freshet.plans.report import Inputs, model_rows, publish
from freshet.sources.sinks import read_handoff
from tests.conftest import SF


def test_every_table_is_written(spark, tmp_path):
    inputs = Inputs(
        samples=complete_cases(view(spark, SF, "samples")),
        gages=view(spark, SF, "gages"),
        attributes=view(spark, SF, "attributes"),
        tile_density=view(spark, SF, "tile_density"),
        tile_readings=view(spark, SF, "tile_obs"),
        field_chemistry=view(spark, SF, "field_chem"),
        field_areas=view(spark, SF, "field_areas"),
        field_sites=view(spark, SF, "field_sites"),
    )
    names = publish(inputs, str(tmp_path), crop_min=50, events=((1998, 8),))
    assert len(names) == 9
    for name in names:
        assert spark.read.csv(f"{tmp_path}/{name}", header=True).count() > 0, name
    means = read_handoff(spark, f"{tmp_path}/handoff/seasonal_means")
    rows = model_rows(means)
    assert rows.count() == rows.select("station_number").distinct().count() > 0
    total = spark.read.csv(f"{tmp_path}/lowflow_sample_counts", header=True, nullValue="NA").where(
        "station_name like 'Total%'"
    ).first()
    enough = means.where("season = 'Late Summer' and n >= 3").count()
    assert int(total["Late Summer"]) == enough
