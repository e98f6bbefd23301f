"""Every registered query: a Spark builder beside its expected-result SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.bindings import oracle as duck
from freshet.bindings.views import view
from freshet.functions import labels
from freshet.functions.seasons import SEASONS
from freshet.operators import (
    attributes,
    cleaning,
    field,
    flow,
    forest,
    matching,
    regression,
    seasonal,
    splitting,
    summaries,
    transport,
    weighted,
)
from freshet.operators.sizing import summarised
from freshet.plans import stations, tables
from freshet.sources import readers, schemas, sinks
from freshet.sources.workspace import fresh_path, stored

Build = Callable[[SparkSession, str], DataFrame]

# The cropland column of the bound attributes is on a 0-100 scale.
CROP_MIN = 50.0
SITES = ("Gage 1", "Gage 2", "Gage 3", "Gage 5")
# The event, basin and limits below suit the value ranges of the bound tables.
EVENTS = ((1997, 8), (1998, 8), (1998, 9))
EVENT_BASINS = ("LS", "CO")
LIMITS = {"srp": 0.1, "flow_cfs": 40.0}
TILE_SCALE = 10.0
# Rows added to the description table by hand.
ADDED = (
    ("Phos_Crop_UptakeWs", 0.0037147074, "Phosphorus uptake by crops in the watershed"),
    ("Phos_Crop_UptakeCat", 0.0003853966, "Phosphorus update by crops in the catchment"),
    ("Tile_density", -0.0009894957, "Tile density in the watershed in m2/km2"),
)
PREDICTORS = ("f1", "f2", "f3", "temp1")


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None
    doubles: str = ""
    ints: str = ""
    digits: int = 9

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        changes = {c: F.round(F.col(c), self.digits) + F.lit(0.0) for c in self.doubles.split(",") if c}
        changes |= {c: F.col(c).cast("bigint") for c in self.ints.split(",") if c}
        return df.withColumns(changes) if changes else df

    def expected(self) -> str | None:
        if self.sql is None:
            return None
        return duck.finished(self.sql, self.doubles, self.ints, self.digits)


QUERIES: dict[str, Query] = {}


def register(
    name: str, sql: str | None = None, doubles: str = "", ints: str = "", digits: int = 9
) -> Callable[[Build], Build]:
    def keep(build: Build) -> Build:
        QUERIES[name] = Query(build, sql, doubles, ints, digits)
        return build

    return keep


# --- analysis tables shared by the queries --------------------------------------


def complete(spark, sf):
    return cleaning.complete_cases(view(spark, sf, "samples"))


def prepared(spark, sf):
    return stations.prepared_samples(complete(spark, sf))


def station_attributes(spark, sf):
    return attributes.station_dimension(
        view(spark, sf, "gages"), view(spark, sf, "attributes"), view(spark, sf, "tile_density")
    )


def attributed(spark, sf):
    return stations.attributed_samples(
        prepared(spark, sf),
        view(spark, sf, "gages"),
        view(spark, sf, "attributes"),
        view(spark, sf, "tile_density"),
        crop_min=CROP_MIN,
    )


def site_seasons(spark, sf):
    return tables.site_seasons(prepared(spark, sf), station_attributes(spark, sf), crop_min=CROP_MIN)


def transport_rows(spark, sf):
    samples = complete(spark, sf)
    return tables.transport_of(samples, stations.prepared_samples(samples))


def daily(spark, sf):
    return weighted.flow_weighted_daily(view(spark, sf, "tile_obs"))


def field_samples(spark, sf):
    return field.field_samples(
        view(spark, sf, "field_chem"), view(spark, sf, "field_areas"), view(spark, sf, "field_sites")
    )


def features(spark, sf):
    return view(spark, sf, "features")


SEASON_COLUMNS = ",".join(SEASONS)

# --- cleaning, projection, filters ------------------------------------------------

CLEAN_SQL = f"""
    select {duck.RAW_ID} as station_number, "Station" as station_name,
           cast(try_strptime("Sample date", '%m/%d/%Y') as date) as date,
           try_cast("Daily Conc. (mg/L)" as double) as srp,
           try_cast("Flow (cfs)" as double) as flow_cfs, "Data type" as data_type
    from raw_samples where "Daily Conc. (mg/L)" is not null"""


@register("clean_samples", CLEAN_SQL, "srp,flow_cfs")
def _(spark, sf):
    return cleaning.clean_samples(view(spark, sf, "raw_samples"))


@register("complete_cases", "select * from complete", "srp,flow_cfs")
def _(spark, sf):
    return complete(spark, sf)


@register(
    "normalize_station_id",
    f"""select {duck.RAW_ID} as station_number, substring("Station", 1, 7) as short_name,
               lpad(cast(cast({duck.RAW_ID} as bigint) as varchar), 8, '0') as padded,
               count(*) as n
        from raw_samples group by all""",
    ints="n",
)
def _(spark, sf):
    raw = view(spark, sf, "raw_samples")
    number = labels.strip_prefix_letter(F.col("Station number"))
    return (
        raw.select(
            number.alias("station_number"),
            labels.short_label(F.col("Station")).alias("short_name"),
            labels.pad_station(number).alias("padded"),
        )
        .groupBy("station_number", "short_name", "padded")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "string_label_ops",
    """select site_id, replace(site_id, '-T', '') as site_label,
              regexp_replace('Tile site ' || site_id, '\\s', chr(10), 'g') as two_lines,
              regexp_replace(site_id, '-T|-F', '') as bare, count(*) as n
       from tile_obs group by all""",
    ints="n",
)
def _(spark, sf):
    site = F.col("site_id")
    return (
        view(spark, sf, "tile_obs")
        .groupBy("site_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "site_id",
            labels.drop_text(site, "-T").alias("site_label"),
            labels.spaces_to_lines(F.concat(F.lit("Tile site "), site)).alias("two_lines"),
            labels.drop_first(site, "-T|-F").alias("bare"),
            "n",
        )
    )


@register(
    "assign_season",
    f"""select *, month(date) as month, {duck.season_case("month(date)")} as season,
               {duck.season_order(duck.season_case("month(date)"))} as season_ord
        from samples""",
    "srp,flow_cfs",
    "month,season_ord",
)
def _(spark, sf):
    return seasonal.assign_season(view(spark, sf, "samples"))


@register(
    "measured_positive",
    """select * from samples
       where data_type = 'discrete sample point' and srp > 0 and flow_cfs > 0""",
    "srp,flow_cfs",
)
def _(spark, sf):
    return cleaning.measured_positive(view(spark, sf, "samples"))


PREPARED_COLUMNS = "station_number, station_name, date, srp, flow_cfs, lowflow, season, n"


@register(
    "holdout_lowflow",
    f"""select {PREPARED_COLUMNS} from prepared
        where not (lowflow = 'yes' and season = 'Late Summer')""",
    "srp,flow_cfs",
    "n",
)
def _(spark, sf):
    return cleaning.hold_out(prepared(spark, sf)).select(*PREPARED_COLUMNS.split(", "))


@register(
    "site_subset",
    f"select {PREPARED_COLUMNS} from prepared where station_name in {SITES}",
    "srp,flow_cfs",
    "n",
)
def _(spark, sf):
    return cleaning.at_sites(prepared(spark, sf), SITES).select(*PREPARED_COLUMNS.split(", "))


@register(
    "min_samples_per_site",
    """select * from (select *, count(*) over (partition by station_name) as n from samples
                      where data_type = 'discrete sample point' and srp > 0 and flow_cfs > 0) as x
       where n >= 20""",
    "srp,flow_cfs",
    "n",
)
def _(spark, sf):
    return flow.min_samples_per_site(cleaning.measured_positive(view(spark, sf, "samples")))


# --- flow -----------------------------------------------------------------------


@register("flow_percent_rank", "select * from ranked", "srp,flow_cfs,percent_rank")
def _(spark, sf):
    return flow.flow_percent_rank(complete(spark, sf))


@register("lowflow_flag", "select * exclude (percent_rank) from flagged", "srp,flow_cfs")
def _(spark, sf):
    return flow.flag_low_flow(complete(spark, sf))


@register("geometric_mean_flow", "select * from means", "qgm")
def _(spark, sf):
    return flow.geometric_mean_flow(complete(spark, sf))


@register(
    "normalize_flow",
    "select c.*, qgm, flow_cfs / qgm as normalized_flow from complete c join means using (station_number)",
    "srp,flow_cfs,qgm,normalized_flow",
)
def _(spark, sf):
    return flow.normalize_flow(complete(spark, sf))


# --- seasonal low-flow tables -------------------------------------------------------


@register(
    "seasonal_lowflow_mean",
    "select station_number, season, mean_srp, sd_srp, n from lowmeans",
    "mean_srp,sd_srp",
    "n",
)
def _(spark, sf):
    return seasonal.seasonal_low_flow_mean(prepared(spark, sf))


@register(
    "seasonal_lowflow_masked",
    "select station_number, season, mean_srp, sd_srp, n from masked",
    "mean_srp,sd_srp",
    "n",
)
def _(spark, sf):
    return seasonal.mask_small_groups(seasonal.seasonal_low_flow_mean(prepared(spark, sf)))


@register("season_sample_count", "select * from counts", ints="n")
def _(spark, sf):
    return seasonal.season_sample_count(prepared(spark, sf))


TOTAL_SQL = f"""select '{seasonal.TOTAL_LABEL}' as station_name, season, count(*) as n
                from counts where n >= 3 group by season"""


@register(
    "season_site_totals",
    duck.pivoted("station_name", "n", f"({TOTAL_SQL}) as totals"),
    ints=SEASON_COLUMNS,
)
def _(spark, sf):
    return seasonal.season_site_totals(seasonal.season_sample_count(prepared(spark, sf)))


@register(
    "season_count_with_total",
    duck.pivoted("station_name", "n", f"(select * from counts union all {TOTAL_SQL}) as stacked"),
    ints=SEASON_COLUMNS,
)
def _(spark, sf):
    return tables.appendix_counts(prepared(spark, sf))


APPENDIX_SQL = duck.pivoted(
    "station_name, drainage_area_km2, impacted, source_density",
    "mean_srp",
    f"""(select station_name, season, mean_srp, impacted,
                {duck.settled("ws_area", 2)} as drainage_area_km2,
                {duck.settled("wwtp_dens", 3)} as source_density from site_seasons) as cells""",
)


@register("season_pivot", APPENDIX_SQL, f"drainage_area_km2,source_density,{SEASON_COLUMNS}")
def _(spark, sf):
    return tables.appendix_means(site_seasons(spark, sf))


@register(
    "season_unpivot",
    f"""select s.station_name, v.season, c.n as count
        from (select distinct station_name from counts) as s
        cross join (select unnest({list(SEASONS)}) as season) as v
        left join counts c on c.station_name = s.station_name and c.season = v.season""",
    ints="count",
)
def _(spark, sf):
    wide = seasonal.season_pivot(
        seasonal.season_sample_count(prepared(spark, sf)), ["station_name"], "n"
    )
    return seasonal.season_unpivot(wide, ["station_name"])


@register(
    "attach_season_counts",
    """select p.station_number, p.station_name, p.season, p.date, p.srp, c.n as count
       from prepared p join counts c using (station_name, season)""",
    "srp",
    "count",
)
def _(spark, sf):
    rows = prepared(spark, sf)
    per_season = seasonal.season_sample_count(rows).withColumnRenamed("n", "count")
    joined = seasonal.attach_season_counts(rows, summarised(per_season, "season-counts"))
    return joined.select("station_number", "station_name", "season", "date", "srp", "count")


@register(
    "sites_without_lowflow",
    """select distinct station_number, station_name, season from prepared p
       where not exists (select 1 from low l
                         where l.station_number = p.station_number and l.season = p.season)""",
)
def _(spark, sf):
    return seasonal.sites_without_low_flow(prepared(spark, sf), [*stations.STATION, "season"])


@register(
    "samples_per_site_stats",
    """select avg(n) as mean_n, median(n) as median_n, min(n) as min_n, max(n) as max_n
       from (select station_number, count(*) as n from prepared group by station_number) as sizes""",
    "mean_n,median_n",
    "min_n,max_n",
)
def _(spark, sf):
    return seasonal.samples_per_site_stats(prepared(spark, sf))


@register(
    "column_summary",
    " union all ".join(
        f"""select '{c}' as column_name, min({c}) as minimum, avg({c}) as mean, max({c}) as maximum,
                   count(*) - count({c}) as missing, quantile_cont({c}, 0.25) as q1,
                   quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.75) as q3
            from samples"""
        for c in ("srp", "flow_cfs")
    ),
    "minimum,mean,maximum,q1,median,q3",
    "missing",
)
def _(spark, sf):
    return summaries.column_summary(view(spark, sf, "samples"), ["srp", "flow_cfs"])


@register(
    "out_of_range_counts",
    " union all ".join(
        f"select '{c}' as column_name, count(*) filter (where {c} > {top}) as above, "
        "count(*) as total from low"
        for c, top in LIMITS.items()
    ),
    ints="above,total",
)
def _(spark, sf):
    return summaries.out_of_range_counts(seasonal.low_flow_rows(prepared(spark, sf)), LIMITS)


# --- regressions and transport --------------------------------------------------------

FIT_DOUBLES = "slope,intercept,std_error,t_stat,p,r2"
FIT_COLUMNS = "station_name, slope, intercept, std_error, t_stat, p, r2, n"


@register(
    "cq_regression",
    f"select {FIT_COLUMNS} from ({duck.fit('station_name', duck.LOG_Y, duck.LOG_X, 'prepared')}) as f",
    FIT_DOUBLES,
    "n",
    7,
)
def _(spark, sf):
    return regression.cq_regression(prepared(spark, sf))


HELD = "not (lowflow = 'yes' and season = 'Late Summer')"


@register(
    "cq_regression_holdout",
    f"select {FIT_COLUMNS} from "
    f"({duck.fit('station_name', duck.LOG_Y, duck.LOG_X, 'prepared', HELD)}) as f",
    FIT_DOUBLES,
    "n",
    7,
)
def _(spark, sf):
    return regression.cq_regression_holdout(prepared(spark, sf))


@register(
    "regression_compare",
    "select * from compared",
    "slope1,t_stat1,p1,r2v1,slope2,t_stat2,p2,r2v2,pct_slope_change",
    "n1,n2",
    5,
)
def _(spark, sf):
    return regression.regression_compare(prepared(spark, sf))


@register(
    "regression_glance",
    f"""select {FIT_COLUMNS}, 1 - (1 - r2) * (n - 1) / dof as adj_r2, sqrt(sse / dof) as sigma,
               t_stat * t_stat as f_stat, ll as log_lik, 6 - 2 * ll as aic,
               3 * ln(n) - 2 * ll as bic, sse as deviance, dof as df_residual
        from (select *, -n / 2 * (ln(2 * pi()) + ln(sse / n) + 1) as ll
              from ({duck.fit("station_name", duck.LOG_Y, duck.LOG_X, "prepared")}) as f) as g""",
    FIT_DOUBLES + ",adj_r2,sigma,f_stat,log_lik,aic,bic,deviance",
    "n,df_residual",
    6,
)
def _(spark, sf):
    y, x = regression.log_log()
    return regression.fit_lines(prepared(spark, sf), ["station_name"], y, x, glance=True)


@register(
    "regression_residuals",
    f"""select p.station_name, p.date, p.srp, p.normalized_flow,
               intercept + slope * {duck.LOG_X} as fitted,
               {duck.LOG_Y} - (intercept + slope * {duck.LOG_X}) as residual
        from prepared p
        join ({duck.fit("station_name", duck.LOG_Y, duck.LOG_X, "prepared")}) as f
        using (station_name)""",
    "srp,normalized_flow,fitted,residual",
    digits=8,
)
def _(spark, sf):
    rows = prepared(spark, sf).select("station_name", "date", "srp", "normalized_flow")
    return regression.with_residuals(rows, ["station_name"], *regression.log_log())


@register("cvc_cvq", "select * from ratios", "flow_mean,flow_sd,srp_mean,srp_sd,cv_ratio")
def _(spark, sf):
    return transport.cv_ratio(complete(spark, sf))


@register(
    "transport_behavior",
    "select * from transport",
    "cv_ratio,slope1,p1,r2v1,slope2,p2,r2v2,pct_slope_change",
    "n1,n2",
    2,
)
def _(spark, sf):
    return transport_rows(spark, sf)


@register(
    "transport_headline",
    """select avg(r2v1) filter (where behavior = 'mobilizing') as mean_r2,
              min(r2v1) filter (where behavior = 'mobilizing') as min_r2,
              max(r2v1) filter (where behavior = 'mobilizing') as max_r2,
              avg(pct_slope_change) filter (where slope1 > 0 and slope2 > slope1 and p2 < 0.05)
                as mean_change,
              min(pct_slope_change) filter (where slope1 > 0 and slope2 > slope1 and p2 < 0.05)
                as min_change,
              max(pct_slope_change) filter (where slope1 > 0 and slope2 > slope1 and p2 < 0.05)
                as max_change,
              count(*) filter (where slope1 > 0 and slope2 > slope1 and p2 < 0.05) as strengthened
       from transport""",
    "mean_r2,min_r2,max_r2,mean_change,min_change,max_change",
    "strengthened",
    7,
)
def _(spark, sf):
    return transport.transport_headline(transport_rows(spark, sf))


# --- attributes ---------------------------------------------------------------------

ATTRIBUTED = (
    "station_number, station_name, date, srp, season, comid, area_km2, pct_crop, pct_urb_hi, "
    "wwtp_dens, ws_area, tile_density"
)
FLAGS = "impacted, wwtp_none, wwtp_lim, wwtp_category"


@register(
    "enrich_attributes",
    f"select {ATTRIBUTED} from attributed",
    "srp,area_km2,pct_crop,pct_urb_hi,wwtp_dens,ws_area,tile_density",
    "comid",
)
def _(spark, sf):
    joined = attributes.enrich_attributes(prepared(spark, sf), station_attributes(spark, sf))
    return joined.select(*ATTRIBUTED.split(", "))


@register(
    "impact_flags",
    f"select {FLAGS}, count(*) as n, count(distinct station_number) as sites from attributed group by all",
    ints="n,sites",
)
def _(spark, sf):
    return (
        attributed(spark, sf)
        .groupBy(*FLAGS.split(", "))
        .agg(
            F.count(F.lit(1)).alias("n"), F.count_distinct("station_number").alias("sites")
        )
    )


@register(
    "impact_season_summary",
    f"""select impacted, season, {duck.settled("avg(srp)", 3)} as mean_srp,
               max(srp) as max_srp, min(srp) as min_srp
        from attributed where lowflow = 'yes' group by impacted, season""",
    "mean_srp,max_srp,min_srp",
)
def _(spark, sf):
    return seasonal.impact_season_summary(attributed(spark, sf))


@register(
    "impacted_site_count",
    """select impacted, count(distinct station_name) as sites from attributed
       where station_name <> 'Gage 9' group by impacted""",
    ints="sites",
)
def _(spark, sf):
    return attributes.impacted_site_count(attributed(spark, sf), excluding=["Gage 9"])


@register(
    "high_source_sites",
    "select distinct station_name from site_seasons where wwtp_dens > 0.005",
)
def _(spark, sf):
    return attributes.high_source_sites(site_seasons(spark, sf))


@register(
    "threshold_site_count",
    """select count(*) filter (where mean_srp >= 0.02) as eutrophic_any,
              count(*) filter (where n >= 3 and mean_srp > 0.02 and t.station_number is not null
                                     and s.station_number is not null) as eutrophic_masked,
              count(*) filter (where mean_srp > 0.033 and pct_slope_change > 0 and slope2 > 0
                                     and p2 <= 0.05) as strengthened
       from lowmeans l left join transport t on l.station_number = t.station_number
            left join stations s on l.station_number = s.station_number
       where season = 'Late Summer'""",
    ints="eutrophic_any,eutrophic_masked,strengthened",
)
def _(spark, sf):
    samples = complete(spark, sf)
    rows = stations.prepared_samples(samples)
    means = seasonal.seasonal_low_flow_mean(rows)
    return seasonal.threshold_site_count(
        means, tables.transport_of(samples, rows), station_attributes(spark, sf)
    )


BUNDLE_SQL = """
    select comid, price, priority_length, line_count, quantity_max, discount_max, tax_min,
           a.WsAreaSqKm
    from bundle_order o join bundle_lines l using (comid) join bundle_returns r using (comid)
    join bundle_area a using (comid)"""


@register(
    "attribute_bundle_join",
    BUNDLE_SQL,
    "price,quantity_max,discount_max,tax_min,WsAreaSqKm",
    "priority_length,line_count",
)
def _(spark, sf):
    parts = [view(spark, sf, f"bundle_{name}") for name in ("order", "lines", "returns")]
    return attributes.bundle_join(parts, area=view(spark, sf, "bundle_area"))


BUNDLE_SCHEMAS = {
    "order": "comid bigint, price double, WsAreaSqKm double, priority_length int",
    "lines": "comid bigint, line_count bigint, quantity_max double, WsAreaSqKm double",
    "returns": "comid bigint, discount_max double, tax_min double",
    "area": "comid bigint, WsAreaSqKm double",
}


@register("scan_bundle", BUNDLE_SQL, "price,quantity_max,discount_max,tax_min,WsAreaSqKm", "priority_length,line_count")
def _(spark, sf):
    """From files: written as text, read by their schemas, bucketed together once, joined without exchange."""
    paths = [fresh_path(spark, f"bundle-{name}") for name in BUNDLE_SCHEMAS]
    for name, path in zip(BUNDLE_SCHEMAS, paths, strict=True):
        sinks.write_csv(other_layout(view(spark, sf, f"bundle_{name}")), path)
    *parts, area = attributes.co_bucketed(readers.read_bundle(spark, paths, list(BUNDLE_SCHEMAS.values())))
    return attributes.bundle_join(parts, area=area)


@register(
    "null_over_limit",
    " union all ".join(
        f"select * from (select '{c}' as column_name, avg(case when {c} is null then 1e0 else 0e0 end) as null_share "
        "from features) as share where null_share > 0.1"
        for c in ("row_id", "target", "f1", "f2", "f3", "temp1", "zero1", "sparse1", "planted")
    ),
    "null_share",
)
def _(spark, sf):
    return attributes.null_fraction_by_column(features(spark, sf), above=0.1)


@register(
    "recode_label",
    "select predictor, importance, case predictor when 'Tile_density' then 'Tile density' else predictor end as label from predictors",
    "importance",
)
def _(spark, sf):
    names = view(spark, sf, "predictors").withColumn("label", F.col("predictor"))
    return matching.recode(names, "label", "Tile_density", "Tile density")


@register(
    "null_fraction_by_column",
    " union all ".join(
        f"select '{c}' as column_name, avg(case when {c} is null then 1e0 else 0e0 end) as null_share "
        "from features"
        for c in ("row_id", "target", "f1", "f2", "f3", "temp1", "zero1", "sparse1", "planted")
    ),
    "null_share",
)
def _(spark, sf):
    return attributes.null_fraction_by_column(features(spark, sf))


@register(
    "drop_all_zero_columns",
    "select row_id, target, f1, f2, f3, temp1, sparse1, planted from features",
    "target,f1,f2,f3,temp1,sparse1,planted",
    digits=7,
)
def _(spark, sf):
    return attributes.drop_all_zero_columns(features(spark, sf))


# --- seasonal regressions and summaries -------------------------------------------------

SCENARIOS = (
    ("source density, all watersheds", "wwtp_dens", "true"),
    ("source density, few sources", "wwtp_dens", "wwtp_dens < 0.005"),
    ("cropland, all watersheds", "pct_crop", "true"),
    ("cropland, no sources", "pct_crop", "wwtp_dens = 0"),
)


def scenario_sql() -> str:
    known = "mean_srp > 0"
    stacked = " union all ".join(
        f"select '{name}' as scenario, * from "
        f"({duck.fit('season', 'log10(mean_srp)', x, 'site_seasons', f'{known} and {where}')}) as f"
        for name, x, where in SCENARIOS
    )
    p2 = duck.settled("p", 2)
    return f"""
        select scenario, season, {duck.season_order()} as season_ord,
               {duck.settled("slope", 2)} as slope, {duck.settled("t_stat", 2)} as t_stat, p,
               case when {p2} < 0.001 then '<0.001' when {p2} >= 0.001
                    then cast({p2} as varchar) end as p_label,
               {duck.settled("r2", 2)} as r2, n
        from ({stacked}) as fits"""


@register("regression_scenarios", scenario_sql(), "slope,t_stat,p,r2", "season_ord,n")
def _(spark, sf):
    return tables.appendix_regressions(site_seasons(spark, sf))


@register(
    "facet_r2",
    """select season, regr_intercept(ln(mean_srp), wwtp_dens) as intercept,
              regr_slope(ln(mean_srp), wwtp_dens) as slope,
              power(corr(ln(mean_srp), wwtp_dens), 2) as r2, count(*) as n
       from site_seasons where mean_srp > 0 and wwtp_dens between 0 and 0.012 group by season""",
    "intercept,slope,r2",
    "n",
    7,
)
def _(spark, sf):
    return summaries.facet_lines(
        site_seasons(spark, sf),
        "season",
        F.log("mean_srp"),
        F.col("wwtp_dens"),
        x_range=(0.0, 0.012),
    )


@register(
    "boxplot_stats",
    """select season, q1, median, q3,
              min(srp) filter (where srp between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1))
                as lower_whisker,
              max(srp) filter (where srp between q1 - 1.5e0 * (q3 - q1) and q3 + 1.5e0 * (q3 - q1))
                as upper_whisker,
              count(*) filter (where not srp between q1 - 1.5e0 * (q3 - q1)
                                                 and q3 + 1.5e0 * (q3 - q1)) as outliers,
              count(*) as n
       from low join (select season, quantile_cont(srp, 0.25) as q1, quantile_cont(srp, 0.5) as median,
                             quantile_cont(srp, 0.75) as q3
                      from low where srp between 0 and 0.25 group by season) as hinges using (season)
       where srp between 0 and 0.25 group by season, q1, median, q3""",
    "q1,median,q3,lower_whisker,upper_whisker",
    "outliers,n",
)
def _(spark, sf):
    low = seasonal.low_flow_rows(prepared(spark, sf))
    return summaries.boxplot_stats(low, ["season"], "srp", value_range=(0.0, 0.25))


@register(
    "histogram_fixed_width",
    """select bin, n, bin * 0.001e0 as centre, mean
       from (select cast(ceil(mean_srp / 0.001e0 - 0.5) as bigint) as bin, count(*) as n
             from site_seasons where mean_srp is not null group by 1) as bins
       cross join (select avg(mean_srp) as mean from site_seasons) as overall""",
    "centre,mean",
    "bin,n",
)
def _(spark, sf):
    return summaries.histogram_fixed_width(site_seasons(spark, sf), "mean_srp", 0.001)


ROUNDED = "station_number, season, mean_srp, sd_srp, n, wwtp_dens, ws_area"


@register(
    "round_numeric_columns",
    f"""select station_number, season, n,
               {", ".join(f"{duck.settled(c, 2)} as {c}" for c in
                          ("mean_srp", "sd_srp", "wwtp_dens", "ws_area"))}
        from site_seasons""",
    "mean_srp,sd_srp,wwtp_dens,ws_area",
    "n",
)
def _(spark, sf):
    return cleaning.round_numeric(site_seasons(spark, sf).select(*ROUNDED.split(", ")))


# --- tile outlets ---------------------------------------------------------------------

DAILY_DOUBLES = (
    "flow_l,tss_mgl,tp_mgl,dop_mgl,no2_no3_mgl,nh3_mgl,tkn_mgl,chloride_mgl,pp_mgl"
)
DAILY = f"site_id,date,{DAILY_DOUBLES},month,year,season,type"


@register("flow_weighted_daily", f"select {DAILY} from daily", DAILY_DOUBLES, "month", 7)
def _(spark, sf):
    return daily(spark, sf).select(*DAILY.split(","))


def tile_sql(keys: str) -> str:
    lead = {"season": "null as site_id, season", "site_id": "site_id, null as season"}
    return f"""select '{keys}' as level, {lead[keys]}, {duck.settled("avg(dop_mgl)", 3)} as mean_tile,
                      {duck.settled("stddev_samp(dop_mgl)", 3)} as sd_tile
               from daily where type = 'Tile' group by {keys}"""


@register("tile_means", f"{tile_sql('season')} union all {tile_sql('site_id')}", "mean_tile,sd_tile")
def _(spark, sf):
    rows = stored(daily(spark, sf), "daily")
    columns = ("level", "site_id", "season", "mean_tile", "sd_tile")

    def level(key, other):
        means = weighted.tile_means(rows, [key])
        return means.withColumns({"level": F.lit(key), other: F.lit(None).cast("string")})

    return level("season", "site_id").select(*columns).unionByName(
        level("site_id", "season").select(*columns)
    )


@register(
    "tile_season_pivot",
    duck.pivoted(
        "site_id",
        "m",
        f"""(select site_id, season, {duck.settled("avg(dop_mgl)", 3)} as m from daily
             where type = 'Tile' group by site_id, season) as means""",
    ),
    SEASON_COLUMNS,
)
def _(spark, sf):
    return weighted.tile_season_pivot(daily(spark, sf))


@register(
    "sites_above_threshold",
    f"""select season, count(*) filter (where {duck.settled("mean_srp", 3)} > tile) as total_above,
               count(*) filter (where {duck.settled("mean_srp", 3)} > tile and wwtp_dens > 0.005)
                 as total_above_high_source,
               count(*) as sites
        from site_seasons
        join (select season, {duck.settled("t / 10", 3)} as tile
              from (select season, {duck.settled("avg(dop_mgl)", 3)} as t from daily
                    where type = 'Tile' group by season) as means) as tiles using (season)
        where n >= 3 group by season
        having count(*) filter (where wwtp_dens > 0.005) > 0""",
    ints="total_above,total_above_high_source,sites",
)
def _(spark, sf):
    # Bound tile values are about ten times the bound stream values.
    tile = weighted.tile_means(daily(spark, sf), ["season"]).select(
        "season", (F.col("mean_tile") / TILE_SCALE).alias("mean_tile")
    )
    return seasonal.sites_above_threshold(site_seasons(spark, sf), tile)


# --- field samples -----------------------------------------------------------------------

DURING = " or ".join(f"(year = {y} and month = {m})" for y, m in EVENTS)
EVENT_SQL = f"basin in {EVENT_BASINS} and ({DURING})"


@register(
    "field_event_summary",
    f"""select 'site' as level, site_id, stream_type, outlet_typ, avg(srp / 1000e0) as mean_srp,
               null as n, null as month, null as year
        from field where basin = 'LS' and year = 1998 and month = 8
        group by site_id, stream_type, outlet_typ
        union all
        select 'type', null, stream_type, outlet_typ, avg(srp / 1000e0), count(*), null, null
        from field where {EVENT_SQL} group by stream_type, outlet_typ
        union all
        select 'month', null, null, null, null, count(*), month, year
        from field where {EVENT_SQL} group by month, year
        union all
        select 'sites', null, stream_type, null, null, count(distinct site_id), null, null
        from field where basin = 'LS' and year = 1998 and month = 8 group by stream_type""",
    "mean_srp",
    "n,month,year",
)
def _(spark, sf):
    rows = field_samples(spark, sf)
    events = field.event_rows(rows, EVENT_BASINS, EVENTS)
    per_site = field.event_summary(field.event_rows(rows, ["LS"], [(1998, 8)]))
    parts = {
        "site": per_site,
        "type": field.stream_type_means(events),
        "month": field.samples_by_month(events),
        "sites": field.sites_by_type(per_site).withColumnRenamed("sites", "n"),
    }
    shape = {
        "site_id": "string", "stream_type": "string", "outlet_typ": "string",
        "mean_srp": "double", "n": "bigint", "month": "int", "year": "int",
    }

    def shaped(level, df):
        cells = [
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in shape.items()
        ]
        return df.select(F.lit(level).alias("level"), *cells)

    first, *rest = [shaped(level, df) for level, df in parts.items()]
    for other in rest:
        first = first.unionByName(other)
    return first


@register(
    "code_to_label",
    """select sample_id, fcode, stream_type,
              case stream_type when 'Ditch' then 'Ditch'
                   when 'Intermittent Stream/River' then 'Intermittent Stream'
                   when 'Perennial Stream/River' then 'Perennial Stream' end as short_type
       from field""",
    ints="sample_id,fcode",
)
def _(spark, sf):
    return field_samples(spark, sf).select(
        "sample_id",
        "fcode",
        "stream_type",
        labels.relabel(F.col("stream_type"), field.SHORT_TYPES).alias("short_type"),
    )


# --- predictor descriptions ----------------------------------------------------------------

DESCRIBED_SQL = """
    select predictor, importance, description
    from (select p.predictor, p.importance, d.description,
                 row_number() over (partition by p.predictor
                   order by levenshtein(regexp_replace(p.predictor, 'Cat|Ws', ''), d.pattern),
                            d.pattern, d.description) as place
          from predictors p
          join (select replace(replace(metric_name, '[Year]', ''), '[AOI]', '') as pattern, description
                from metric_defs) as d
          on contains(p.predictor, d.pattern)) as ranked
    where place = 1"""


def described(spark, sf):
    return matching.fuzzy_describe(view(spark, sf, "predictors"), view(spark, sf, "metric_defs"))


@register("fuzzy_describe", DESCRIBED_SQL, "importance")
def _(spark, sf):
    return described(spark, sf)


@register(
    "undescribed_predictors",
    f"select predictor, importance from predictors where predictor not in "
    f"(select predictor from ({DESCRIBED_SQL}) as found)",
    "importance",
)
def _(spark, sf):
    return matching.undescribed(view(spark, sf, "predictors"), described(spark, sf))


@register(
    "append_literal_rows",
    f"select * from ({DESCRIBED_SQL}) as found union all "
    + " union all ".join(f"select '{p}', {i!r}, '{d}'" for p, i, d in ADDED),
    "importance",
)
def _(spark, sf):
    return matching.append_literal_rows(described(spark, sf), ADDED)


@register("rank_importance", "select predictor, importance from predictors", "importance")
def _(spark, sf):
    return matching.rank_importance(view(spark, sf, "predictors"))


@register(
    "topk_importance",
    "select predictor, importance from predictors order by importance desc, predictor limit 15",
    "importance",
)
def _(spark, sf):
    return matching.top_importance(view(spark, sf, "predictors"))


# --- model tables ---------------------------------------------------------------------------

MODEL_IDS = (
    "station_number", "season", "sd_srp", "n", "comid", "area_km2",
    "impacted", "wwtp_none", "wwtp_lim", "wwtp_category",
)


@register(
    "feature_table",
    """select station_name, mean_srp, pct_crop, pct_urb_hi, wwtp_dens, ws_area, tile_density
       from site_seasons where season = 'Late Summer' and n >= 3 and mean_srp < 0.15""",
    "mean_srp,pct_crop,pct_urb_hi,wwtp_dens,ws_area,tile_density",
)
def _(spark, sf):
    rows = site_seasons(spark, sf).where((F.col("season") == "Late Summer") & (F.col("n") >= 3))
    kept = attributes.drop_all_zero_columns(rows.drop(*MODEL_IDS))
    return forest.feature_table(kept, target="mean_srp", target_below=0.15)


@register("exact_split", "select row_id, split from split", ints="row_id")
def _(spark, sf):
    return splitting.exact_split(features(spark, sf), "row_id").select("row_id", "split")


@register(
    "median_impute",
    """select row_id, coalesce(temp1, (select median(temp1) from features)) as temp1,
              coalesce(sparse1, (select median(sparse1) from features)) as sparse1
       from features""",
    "temp1,sparse1",
    "row_id",
)
def _(spark, sf):
    rows = features(spark, sf).select("row_id", "temp1", "sparse1")
    return splitting.median_impute(rows, ["temp1", "sparse1"])


SCALED = ("target", "f1", "f2", "f3")


@register(
    "standardize_train_stats",
    f"""select row_id, split, {", ".join(
        f"({c} - (select avg({c}) from split where split = 'train'))"
        f" / (select stddev_samp({c}) from split where split = 'train') as {c}" for c in SCALED)}
        from split""",
    ",".join(SCALED),
    "row_id",
    7,
)
def _(spark, sf):
    rows = splitting.exact_split(features(spark, sf), "row_id").select("row_id", "split", *SCALED)
    rows = stored(rows, "split")
    return splitting.standardize(rows, SCALED, rows.where(F.col("split") == "train"))


@register(
    "inverse_scale",
    """select row_id, f1 * (select stddev_samp(target) from features)
                      + (select avg(target) from features) as f1_unscaled
       from features""",
    "f1_unscaled",
    "row_id",
    5,
)
def _(spark, sf):
    rows = features(spark, sf)
    return splitting.unscale(rows, ["f1"], rows, "target").select("row_id", "f1_unscaled")


@register(
    "regression_metrics",
    """select sqrt(avg(power(y - p, 2))) as rmse,
              sqrt(avg(power(y - p, 2))) / avg(y) * 100 as rmse_percent, avg(p - y) as bias,
              avg(p - y) filter (where y < 30) as bias_small, regr_slope(y, p) as slope,
              regr_intercept(y, p) as intercept, regr_r2(y, p) as r2, count(*) as n
       from (select planted as y, 1.9e0 * f2 + 25 + f3 as p from features) as pairs""",
    "rmse,rmse_percent,bias,bias_small,slope,intercept,r2",
    "n",
    7,
)
def _(spark, sf):
    rows = features(spark, sf).withColumn("guess", F.lit(1.9) * F.col("f2") + 25 + F.col("f3"))
    return forest.regression_metrics(rows, "planted", "guess", bias_below=30)


@register(
    "target_trim_fit",
    f"select slope, intercept, std_error, t_stat, p, r2, n from "
    f"({duck.fit('', 'planted', 'f2', 'features', 'planted < 100')}) as f",
    FIT_DOUBLES,
    "n",
    6,
)
def _(spark, sf):
    rows = features(spark, sf)
    return regression.fit_lines(
        rows, [], F.col("planted"), F.col("f2"), where=F.col("planted") < 100
    )


# --- forest workflow: what SQL can state of it -----------------------------------------------
# Another library's forest has other numbers, so the queries return what holds of any right one
# beside the rows: known cells unchanged, predictions inside the range of the training values,
# an error below that of the mean, sizes of folds and bags, settings, grids.

MODELS: dict[tuple[str, str], forest.Forest] = {}


def model_rows(spark, sf):
    """Split model rows with temp1 filled by its training median."""
    rows = splitting.exact_split(features(spark, sf), "row_id").select(
        "row_id", "split", "planted", *PREDICTORS
    )
    rows = stored(rows, "model-rows")
    return rows.fillna(splitting.median_fill(train_of(rows), ["temp1"]))


def train_of(rows):
    return rows.where(F.col("split") == "train")


def test_of(rows):
    return rows.where(F.col("split") == "test")


def shared_model(spark, sf):
    """The forest that three queries use, fitted once per application and data."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in MODELS:
        MODELS[at] = forest.fit_forest(train_of(model_rows(spark, sf)), "planted", PREDICTORS)
    return MODELS[at]


def judged(predictions, train):
    """Per row: is its prediction inside the range of the training values; and of all rows: is their
    squared error below half of their variance."""
    low, high = (train.agg(f("planted").alias("v")).scalar() for f in (F.min, F.max))
    predictions = stored(predictions, "predictions")
    error = F.avg(F.pow(F.col("prediction") - F.col("planted"), 2)) < F.var_pop("planted") / 2
    better = predictions.agg(error.alias("better")).scalar()
    return predictions.select("row_id", "planted", F.col("prediction").between(low, high).alias("in_range"), better.alias("better_than_mean"))


JUDGED_SQL = "select row_id, planted, true as in_range, true as better_than_mean from split where split = 'test'"


def imputed_facts(filled, before):
    """Known cells as they came out, and for the gap column whether each filled cell is inside the
    range of the known ones."""
    low, high = (before.agg(f("temp1").alias("v")).scalar() for f in (F.min, F.max))
    gaps = before.select("row_id", F.col("temp1").isNull().alias("gap"))
    fits = F.when(F.col("gap"), F.col("temp1").between(low, high))
    # a broadcast of gaps, which are as many as the rows, would pass the driver
    return filled.join(gaps.hint("merge"), "row_id").select("row_id", "f1", "f2", "f3", F.when(~F.col("gap"), F.col("temp1")).alias("temp1"), fits.alias("gap_in_range"))


def imputed_sql(part):
    return f"""select row_id, f1, f2, f3, temp1, case when temp1 is null then true end as gap_in_range
               from split where split = '{part}'"""


@register("forest_impute", imputed_sql("train"), "f1,f2,f3,temp1", "row_id")
def _(spark, sf):
    rows = splitting.exact_split(features(spark, sf), "row_id")
    train = stored(train_of(rows).select("row_id", *PREDICTORS), "train")
    return imputed_facts(forest.fit_imputer(train, PREDICTORS, "row_id").filled, train)


@register("forest_impute_apply", imputed_sql("test"), "f1,f2,f3,temp1", "row_id")
def _(spark, sf):
    rows = stored(splitting.exact_split(features(spark, sf), "row_id"), "split")
    imputer = forest.fit_imputer(train_of(rows), PREDICTORS, "row_id")
    test = test_of(rows).select("row_id", *PREDICTORS)
    return imputed_facts(imputer.transform(test), rows.select("row_id", "temp1"))


@register("forest_fit_predict", JUDGED_SQL, "planted", "row_id")
def _(spark, sf):
    rows = model_rows(spark, sf)
    return judged(forest.predict(shared_model(spark, sf), test_of(rows)), train_of(rows))


@register("forest_without_replacement", f"select *, floor(0.632e0 * (select count(*) from split where split = 'train')) as bag_rows from ({JUDGED_SQL}) as j", "planted", "row_id,bag_rows")
def _(spark, sf):
    rows = model_rows(spark, sf)
    model = forest.fit_bagged(train_of(rows), "planted", PREDICTORS, "row_id", forest.ForestSpec(bootstrap=False))
    sizes = train_of(rows).agg(*[F.sum(model.bags.count(b)).alias(f"b{b}") for b in range(model.bags.number)])
    least, most = (sizes.select(f(*sizes.columns)).scalar() for f in (F.least, F.greatest))
    found = judged(model.predict(test_of(rows)), train_of(rows))
    # every bag has the same number of rows, or none is given
    return found.withColumn("bag_rows", F.when(least == most, least))


STRATA_SQL = """
    select i as candidate,
           row_number() over (order by md5('split-345-' || i), cast(i as varchar)) - 1 as split_stratum,
           row_number() over (order by md5('node-345-' || i), cast(i as varchar)) - 1 as node_stratum
    from range(1, 21) as r(i)"""
GRID_SQL = """1 + floor((split_stratum + 0.5) * 4 / 20) as features_per_split,
              2 + floor((node_stratum + 0.5) * 39 / 20) as min_node"""


@register(
    "tuning_grid",
    f"""select candidate, split_stratum, node_stratum, {GRID_SQL},
               (select count(*) from split where split = 'train') as rows_compared
        from ({STRATA_SQL}) as strata""",
    ints="candidate,split_stratum,node_stratum,features_per_split,min_node,rows_compared",
)
def _(spark, sf):
    grid = forest.latin_grid(spark, len(PREDICTORS))
    rows = train_of(splitting.exact_split(features(spark, sf), "row_id"))
    return grid.withColumn("rows_compared", rows.agg(F.count(F.lit(1)).alias("n")).scalar())


@register(
    "tuning_folds",
    """select row_id, (row_number() over (order by md5(cast(row_id as varchar) || '-234'), row_id) - 1) % 10 as fold
       from features""",
    ints="row_id,fold",
)
def _(spark, sf):
    return splitting.deal_folds(features(spark, sf).select("row_id"), "row_id", forest.FOLDS)


@register(
    "forest_tune",
    f"select {GRID_SQL}, true as better_than_mean, true as one_best from ({STRATA_SQL}) as strata",
    ints="features_per_split,min_node",
)
def _(spark, sf):
    rows = train_of(model_rows(spark, sf))
    grid = forest.latin_grid(spark, len(PREDICTORS))
    best, compared = forest.tune_forest(rows, "planted", PREDICTORS, "row_id", grid)
    spread = rows.agg(F.stddev_pop("planted")).scalar()
    chosen = compared.where((F.col("features_per_split") == best.features_per_split) & (F.col("min_node") == best.min_node))
    least = compared.agg(F.min("rmse").alias("v")).scalar()
    return compared.select(
        "features_per_split", "min_node", ((F.col("rmse") > 0) & (F.col("rmse") < spread)).alias("better_than_mean"),
        (chosen.agg(F.max("rmse").alias("v")).scalar() == least).alias("one_best"),
    )


@register(
    "permutation_importance",
    """select predictor, predictor = 'f2' as strongest, true as finite
       from (values ('f1'), ('f2'), ('f3'), ('temp1')) as p(predictor)""",
)
def _(spark, sf):
    rows = train_of(model_rows(spark, sf))
    # the forest that is explained draws rows without replacement
    model = forest.fit_bagged(rows, "planted", PREDICTORS, "row_id", forest.ForestSpec(bootstrap=False))
    found = stored(forest.permutation_importance(model, rows, "row_id"), "importance")
    most = found.agg(F.max("importance").alias("v")).scalar()
    return found.select("predictor", (F.col("importance") == most).alias("strongest"), (F.abs("importance") < 1e300).alias("finite"))


DEPENDENCE_SQL = " union all ".join(
    f"""select '{c}' as feature, low + k * (case when n > 1 then (high - low) / (n - 1) else 0 end) as value, true as in_range
        from (select min({c}) as low, max({c}) as high, least(51, count(distinct {c})) as n from filled),
             (select unnest(range(0, 51)) as k) as steps where k < n"""
    for c in PREDICTORS
)


@register(
    "partial_dependence",
    f"select * from ({DEPENDENCE_SQL}) as d",
    "value",
)
def _(spark, sf):
    rows = train_of(model_rows(spark, sf))
    low, high = (rows.agg(f("planted").alias("v")).scalar() for f in (F.min, F.max))
    curves = forest.partial_dependence(shared_model(spark, sf), rows, PREDICTORS, PREDICTORS)
    return curves.select("feature", "value", F.col("mean_prediction").between(low, high).alias("in_range"))


@register("model_roundtrip", "select row_id, true as same from split where split = 'test'", ints="row_id")
def _(spark, sf):
    test = test_of(model_rows(spark, sf))
    model, path = shared_model(spark, sf), fresh_path(spark, "forest")
    forest.save_model(model, path)
    before = forest.predict(model, test).withColumnRenamed("prediction", "before")
    both = forest.predict(forest.load_model(path), before)
    return both.select("row_id", (F.col("prediction") == F.col("before")).alias("same"))


# --- sources and sinks -----------------------------------------------------------------------


def other_layout(rows: DataFrame) -> DataFrame:
    """The same columns in another order among further ones, as files from elsewhere have them."""
    return rows.select(F.lit("x").alias("Remark"), *(F.col(f"`{c}`") for c in reversed(rows.columns)), F.lit(1).alias("Year"))


@register("scan_csv_typed", CLEAN_SQL, "srp,flow_cfs")
def _(spark, sf):
    path = fresh_path(spark, "raw-samples")
    sinks.write_csv(other_layout(view(spark, sf, "raw_samples")), path)
    return cleaning.clean_samples(readers.read_delimited(spark, path, schemas.RAW_SAMPLES, others=True))


@register("scan_tsv", "select site_id, date, srp from field_chem", "srp")
def _(spark, sf):
    path = fresh_path(spark, "field-chemistry")
    chemistry = view(spark, sf, "field_chem")
    text = chemistry.select("site_id", F.date_format("date", "M/d/yyyy").alias("date"), "srp")
    sinks.write_csv(other_layout(text), path, sep="\t")
    back = readers.read_tab(spark, path, schemas.FIELD_CHEMISTRY)
    return back.withColumn("date", F.try_to_date("date", cleaning.DATE_FORMAT))


@register(
    "scan_glob_with_path",
    """select site_id, cast(datetime as date) as date, tp_mgl,
              case when site_id like '%-F' then 'flume' else 'tile' end as source
       from tile_obs""",
    "tp_mgl",
)
def _(spark, sf):
    folder = fresh_path(spark, "tile-files")
    rows = other_layout(view(spark, sf, "tile_obs").select("site_id", "datetime", "flow_cfs", *weighted.ANALYTES))
    is_flume = F.col("site_id").endswith("-F")
    sinks.write_csv(rows.where(is_flume), f"{folder}/flume_C_Q.csv")
    sinks.write_csv(rows.where(~is_flume), f"{folder}/tile_C_Q.csv")
    sinks.write_csv(rows.where(is_flume), f"{folder}/other.csv")
    back = readers.read_matching(spark, folder, "*C_Q*csv", schemas.TILE_READINGS)
    source = F.regexp_extract("path", r"([^/]+)_C_Q", 1)
    return back.select(
        "site_id", F.to_date("datetime").alias("date"), "tp_mgl", source.alias("source")
    )


@register(
    "sink_roundtrip",
    duck.pivoted("station_name", "n", f"(select * from counts union all {TOTAL_SQL}) as stacked"),
    ints=SEASON_COLUMNS,
)
def _(spark, sf):
    table = tables.appendix_counts(prepared(spark, sf))
    handoff, published = fresh_path(spark, "counts"), fresh_path(spark, "counts-csv")
    sinks.write_handoff(table, handoff)
    sinks.write_csv(sinks.read_handoff(spark, handoff), published)
    schema = "station_name string, " + ", ".join(f"`{s}` bigint" for s in SEASONS)
    return readers.read_delimited(spark, published, schema)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasonal low-flow means of every station, side by side."""
    return QUERIES["season_pivot"].run(spark, sf_dir)
