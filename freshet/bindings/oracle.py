"""DuckDB SQL giving the expected result of each registered query.

Written from the definitions with window functions and plain grouping, not from
the Spark plans, so that the two sides can disagree.
"""

from __future__ import annotations

from freshet.bindings.views import VIEWS, duck_view
from freshet.functions.labels import RAW_ID_WIDTH
from freshet.functions.seasons import SEASON_MONTHS, SEASONS

LOG_Y, LOG_X = "log10(srp)", "log10(normalized_flow)"


def settled(expr: str, digits: int) -> str:
    """Round half away from zero on decimal text, as the library does."""
    return f"cast(round(cast({expr} as decimal(30, {digits + 9})), {digits}) as double)"


def season_case(month: str) -> str:
    arms = " ".join(
        f"when {month} in ({', '.join(map(str, months))}) then '{name}'"
        for name, months in SEASON_MONTHS.items()
    )
    return f"case {arms} end"


def season_order(season: str = "season") -> str:
    arms = " ".join(f"when '{s}' then {i}" for i, s in enumerate(SEASONS, 1))
    return f"case {season} {arms} end"


def pivoted(ids: str, value: str, source: str) -> str:
    cells = ", ".join(
        f"max(case when season = '{s}' then {value} end) as \"{s}\"" for s in SEASONS
    )
    return f"select {ids}, {cells} from {source} group by {ids}"


def t_tail(t: str, dof: str) -> str:
    """Two-sided Student-t tail. For |t| >= 2 the positive series of the
    incomplete beta function with gamma-function coefficients (no cancellation,
    so tiny values compare), else one minus the finite trigonometric series."""
    c2 = f"({dof} / ({dof} + {t} * {t}))"
    sine = f"sqrt(1 - {c2})"
    even = (
        f"coalesce(list_sum(list_transform(range(0, cast(floor({dof} / 2) as bigint)), "
        f"lambda m: exp(lgamma(m + 0.5e0) - lgamma(m + 1e0)) / sqrt(pi()) * pow({c2}, m))), 0)"
    )
    odd = (
        f"coalesce(list_sum(list_transform(range(0, cast(floor(({dof} - 1) / 2) as bigint)), "
        f"lambda m: exp(lgamma(m + 1e0) - lgamma(m + 1.5e0)) * sqrt(pi()) / 2 "
        f"* pow({c2}, m + 0.5e0))), 0)"
    )
    far = (
        f"{sine} / sqrt(pi()) * list_sum(list_transform("
        f"range(0, cast(ceil(45 / -ln({c2})) as bigint)), "
        f"lambda m: exp(lgamma({dof} / 2 + 0.5e0 + m) - lgamma({dof} / 2 + 1e0 + m)"
        f" + ({dof} / 2 + m) * ln({c2}))))"
    )
    return (
        f"case when {t} is null or {dof} < 1 then null "
        f"when abs({t}) >= 2 then {far} "
        f"when {dof} % 2 = 0 then 1 - {sine} * {even} "
        f"else 1 - 2 / pi() * (atan(abs({t}) / sqrt({dof})) + {sine} * {odd}) end"
    )


def fit(keys: str, y: str, x: str, source: str, where: str = "true") -> str:
    """One grouped least-squares fit with t, p and r2."""
    by = f"group by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""
      select {lead}slope, intercept, std_error, t_stat, {t_tail("t_stat", "dof")} as p, r2, n,
             syy, sse, dof
      from (select *, slope / std_error as t_stat
            from (select *, case when dof > 0 then sqrt(sse / dof / sxx) end as std_error
                  from (select *, greatest(syy - slope * sxy, 0) as sse,
                               cast(n as double) - 2 as dof,
                               case when sxx > 0 and syy > 0 then sxy * sxy / (sxx * syy) end as r2
                        from (select {lead}case when regr_sxx({y}, {x}) > 0 then regr_slope({y}, {x}) end as slope,
                                     case when regr_sxx({y}, {x}) > 0
                                          then regr_intercept({y}, {x}) end as intercept,
                                     regr_sxx({y}, {x}) as sxx, regr_syy({y}, {x}) as syy,
                                     regr_sxy({y}, {x}) as sxy, cast(regr_count({y}, {x}) as bigint) as n
                              from {source} where {where} {by}) as moments) as parts) as errors
           ) as tests where n > 0"""


CHAIN = {
    "complete": "select * from samples where srp is not null",
    "ranked": """
        select *, (rank() over (partition by station_name order by flow_cfs)
                   + (count(*) over (partition by station_name, flow_cfs) - 1) / 2e0)
                  / count(*) over (partition by station_name) as percent_rank
        from complete""",
    "flagged": """
        select *, case when percent_rank <= 0.25 then 'yes' else 'no' end as lowflow from ranked""",
    "means": """
        select station_number, exp(avg(ln(flow_cfs))) as qgm from complete
        where flow_cfs > 0 group by station_number""",
    "prepared": f"""
        select f.* exclude (percent_rank), month(date) as month,
               {season_case("month(date)")} as season, qgm,
               flow_cfs / qgm as normalized_flow
        from (select *, count(*) over (partition by station_name) as n from flagged
              where data_type = 'discrete sample point' and flow_cfs > 0 and srp > 0) as f
        join means using (station_number) where n >= 20""",
    "stations": """
        select * from gages join attributes using (comid) join tile_density using (station_number)""",
    "attributed": """
        select p.*, s.* exclude (station_number),
               case when pct_crop >= 50 or pct_urb_hi >= 0.1 then 'Impacted'
                    else 'Less Impacted' end as impacted,
               case when wwtp_dens = 0 then 'No WWTP' else 'WWTP present' end as wwtp_none,
               case when wwtp_dens < 0.005 then 'Limited' else 'Higher' end as wwtp_lim,
               case when wwtp_dens = 0 then 'None' when wwtp_dens < 0.005 then 'Limited'
                    else 'Higher' end as wwtp_category
        from prepared p join stations s using (station_number)""",
    "low": "select * from prepared where lowflow = 'yes'",
    "lowmeans": f"""
        select station_number, station_name, season,
               {settled("avg(srp)", 3)} as mean_srp,
               stddev_samp(srp) as sd_srp, count(*) as n
        from low group by station_number, station_name, season""",
    "masked": """
        select * replace (case when n >= 3 then mean_srp end as mean_srp) from lowmeans""",
    "site_seasons": """
        select m.*, s.* exclude (station_number),
               case when pct_crop >= 50 or pct_urb_hi >= 0.1 then 'Impacted'
                    else 'Less Impacted' end as impacted,
               case when wwtp_dens = 0 then 'No WWTP' else 'WWTP present' end as wwtp_none,
               case when wwtp_dens < 0.005 then 'Limited' else 'Higher' end as wwtp_lim,
               case when wwtp_dens = 0 then 'None' when wwtp_dens < 0.005 then 'Limited'
                    else 'Higher' end as wwtp_category
        from masked m join stations s using (station_number)""",
    "counts": """
        select station_name, season, count(*) as n from low group by station_name, season""",
    "fit1": fit("station_number, station_name", LOG_Y, LOG_X, "prepared"),
    "fit2": fit(
        "station_number, station_name", LOG_Y, LOG_X, "prepared",
        "not (lowflow = 'yes' and season = 'Late Summer')",
    ),
    "compared": """
        select a.station_number, a.station_name,
               a.slope as slope1, a.t_stat as t_stat1, a.p as p1, a.r2 as r2v1, a.n as n1,
               b.slope as slope2, b.t_stat as t_stat2, b.p as p2, b.r2 as r2v2, b.n as n2,
               case when b.slope > a.slope then 'Yes' when b.slope <= a.slope then 'No' end
                 as slope_change,
               case when b.p < a.p then 'Yes' when b.p >= a.p then 'No' end as p_change,
               case when b.r2 > a.r2 then 'Yes' when b.r2 <= a.r2 then 'No' end as r2_change,
               case when a.p < 0.05 then 'Yes' when a.p >= 0.05 then 'No' end as sig1,
               case when b.p < 0.05 then 'Yes' when b.p >= 0.05 then 'No' end as sig2,
               (b.slope - a.slope) / a.slope * 100 as pct_slope_change
        from fit1 a join fit2 b using (station_number)""",
    "ratios": """
        select station_number, flow_mean, flow_sd, srp_mean, srp_sd,
               (flow_mean * srp_sd) / (srp_mean * flow_sd) as cv_ratio
        from (select station_number, avg(flow_cfs) as flow_mean, stddev_samp(flow_cfs) as flow_sd
              from complete group by station_number) as q
        join (select station_number, avg(srp) as srp_mean, stddev_samp(srp) as srp_sd
              from complete where data_type = 'discrete sample point' group by station_number) as c
        using (station_number)""",
    "transport": f"""
        select station_name, station_number, behavior,
               {", ".join(f"{settled(c, 2)} as {c}" for c in
                          ("cv_ratio", "slope1", "p1", "r2v1"))}, n1,
               {", ".join(f"{settled(c, 2)} as {c}" for c in
                          ("slope2", "p2", "r2v2"))}, n2,
               {settled("pct_slope_change", 2)} as pct_slope_change
        from (select *,
                case when step3 is null then null
                     when p1 >= 0.05 and cv_ratio > 0.3 then 'chemodynamic'
                     when (p1 is null and cv_ratio > 0.3) then null else step3 end as behavior
              from (select *, case when cv_ratio is null then null
                                   when cv_ratio <= 0.3 then 'chemostatic'
                                   when p1 < 0.05 and slope1 < 0 then 'diluting'
                                   when p1 < 0.05 and slope1 > 0 then 'mobilizing'
                                   else 'open' end as step3
                    from compared join ratios using (station_number)) as steps) as classed""",
    "daily": f"""
        select site_id, date, flow_l,
               {", ".join(f"{a} / flow_l as {a}" for a in
                          ("tss_mgl", "tp_mgl", "dop_mgl", "no2_no3_mgl", "nh3_mgl", "tkn_mgl",
                           "chloride_mgl"))},
               tp_mgl / flow_l - dop_mgl / flow_l as pp_mgl,
               month(date) as month, strftime(date, '%Y') as year,
               {season_case("month(date)")} as season,
               case when site_id like '%-F%' then 'Flume' else 'Tile' end as type
        from (select site_id, cast(datetime as date) as date,
                     case when count(flow_cfs) = count(*) then sum(flow_cfs * 28.32e0) end as flow_l,
                     {", ".join(f"case when count({a} * flow_cfs) = count(*) "
                                f"then sum({a} * flow_cfs * 28.32e0) end as {a}" for a in
                                ("tss_mgl", "tp_mgl", "dop_mgl", "no2_no3_mgl", "nh3_mgl",
                                 "tkn_mgl", "chloride_mgl"))}
              from tile_obs group by 1, 2) as loads
        where flow_l > 0 and tp_mgl / flow_l - dop_mgl / flow_l > 0""",
    "field": f"""
        select c.*, ws_area, fcode, outlet_typ,
               case fcode when 33400 then 'Connector' when 33600 then 'Ditch'
                          when 46006 then 'Perennial Stream/River'
                          when 46003 then 'Intermittent Stream/River' end as stream_type,
               month(date) as month, year(date) as year
        from field_chem c join field_areas using (site_id) join field_sites using (site_id)""",
    "split": """
        select *, case when row_number() over (order by md5(cast(row_id as varchar) || '-100'), row_id)
                            <= floor(0.7e0 * count(*) over ()) then 'train' else 'test' end as split
        from features""",
    "filled": """
        select row_id, planted, f1, f2, f3,
               coalesce(temp1, (select median(temp1) from split where split = 'train')) as temp1
        from split where split = 'train'""",
}


def chained(body: str) -> str:
    """Prefix a query with just the named steps it needs, in order."""
    import re

    steps = {**{name: duck_view(name) for name in VIEWS}, **CHAIN}
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in steps:
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                visit(steps[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    return "with " + ",\n".join(f"{n} as ({steps[n]})" for n in needed) + "\n" + body


def finished(body: str, doubles: str, ints: str, digits: int) -> str:
    """Round doubles (adding zero clears a negative zero) and widen integers, the
    same way on both sides."""
    changes = [f'round("{c}", {digits}) + 0e0 as "{c}"' for c in doubles.split(",") if c]
    changes += [f'cast("{c}" as bigint) as "{c}"' for c in ints.split(",") if c]
    inner = chained(body)
    if not changes:
        return inner
    return f"select * replace ({', '.join(changes)}) from (\n{inner}\n) as result"


RAW_ID = f"substring(\"Station number\", 2, {RAW_ID_WIDTH - 1})"
