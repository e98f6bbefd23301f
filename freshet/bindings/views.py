"""The analysis tables, defined over the given tables.

A definition is one SELECT that both Spark and DuckDB run; ``{lineitem}`` and the
like stand for the given tables, and ``{month_day_year}`` etc. for the few
functions the two dialects spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SPARK_WORDS = {
    "ship_text": "date_format(l_shipdate, 'M/d/yyyy')",
    "k": "cast(get_json_object(props, '$.k') as double)",
    "later_ts": "cast(add_months(cast(ts as date), cast(user_id % 12 as int)) as timestamp_ntz)",
}
DUCK_WORDS = {
    "ship_text": "strftime(l_shipdate, '%-m/%-d/%Y')",
    "k": "cast(json_extract_string(props, '$.k') as double)",
    "later_ts": "cast(cast(cast(ts as date) + to_months(cast(user_id % 12 as int)) as date) as timestamp)",
}

_STATION = "lpad(cast({0} as varchar(20)), 8, '0')"
_SRP = (
    "case when l_linenumber = 7 then null else "
    "(case when l_suppkey % 10 = 2 then 0.1e0 + l_discount / 10 else l_discount end)"
    " * (1 + (l_quantity - 1) * ((l_suppkey % 5) - 2) / 100e0) end"
)
_TYPE = "case when l_returnflag = 'R' then 'discrete sample point' else 'modeled' end"

VIEWS = {
    "samples": f"""
        select {_STATION.format("l_suppkey")} as station_number,
               'Gage ' || cast(l_suppkey as varchar(20)) as station_name,
               cast(l_shipdate as date) as date,
               {_SRP} as srp,
               l_quantity - 1 as flow_cfs,
               {_TYPE} as data_type
        from {{lineitem}}""",
    "raw_samples": f"""
        select 'Gage ' || cast(l_suppkey as varchar(20)) as `Station`,
               'S' || {_STATION.format("l_suppkey")} as `Station number`,
               case when l_linenumber = 6 then 'unknown' else {{ship_text}} end as `Sample date`,
               case when l_linenumber = 5 then '<0.005' else cast({_SRP} as varchar(40)) end
                 as `Daily Conc. (mg/L)`,
               cast(l_quantity - 1 as varchar(40)) as `Flow (cfs)`,
               {_TYPE} as `Data type`
        from {{lineitem}}""",
    "gages": f"""
        select {_STATION.format("s_suppkey")} as station_number,
               100000 + s_suppkey as comid, abs(s_acctbal) as area_km2
        from {{supplier}}""",
    "attributes": """
        select 100000 + s_suppkey as comid,
               cast((s_suppkey * 37) % 101 as double) as pct_crop,
               (s_suppkey % 20) / 100e0 as pct_urb_hi,
               (s_suppkey % 16) / 1000e0 as wwtp_dens,
               abs(s_acctbal) as ws_area,
               0e0 as coal_mine_dens
        from {supplier}""",
    "tile_density": f"""
        select {_STATION.format("s_suppkey")} as station_number, s_nationkey * 1000e0 as tile_density
        from {{supplier}}""",
    "tile_obs": """
        select site_id, datetime, flow_cfs, 0.1e0 + k / 100e0 as tp_mgl, k / 84e0 as dop_mgl,
               case when event_id % 50 = 0 then null else 1e0 end as nh3_mgl,
               2 * k as tss_mgl, 3 * k as no2_no3_mgl, 4 * k as tkn_mgl, 5 * k as chloride_mgl
        from (select event_id,
                     'T' || cast(user_id % 12 as varchar(20))
                       || (case when user_id % 4 = 0 then '-F' else '-T' end) as site_id,
                     {later_ts} as datetime,
                     case when day(ts) = 15 or event_type = 'error' then 0e0
                          else value / 100 end as flow_cfs,
                     {k} as k
              from {events}) as readings""",
    "field_chem": """
        select o_orderkey as sample_id, 'F' || cast(o_custkey as varchar(20)) as site_id,
               cast(o_orderdate as date) as date,
               case o_orderstatus when 'F' then 'LS' when 'O' then 'CO' else 'BE' end as basin,
               case when o_orderkey % 17 = 0 then null else o_totalprice / 1000 end as srp
        from {orders}""",
    "field_areas": """
        select 'F' || cast(c_custkey as varchar(20)) as site_id, abs(c_acctbal) as ws_area
        from {customer}""",
    "field_sites": """
        select 'F' || cast(c_custkey as varchar(20)) as site_id,
               case c_custkey % 5 when 0 then 33400 when 1 then 33600 when 2 then 46006
                    when 3 then 46003 else 55800 end as fcode,
               case c_custkey % 7 when 0 then 'lake' when 1 then 'wetland' else ' ' end as outlet_typ
        from {customer}""",
    "bundle_order": """
        select o_orderkey as comid, o_totalprice as price, 1e0 as WsAreaSqKm,
               length(o_orderpriority) as priority_length
        from {orders}""",
    "bundle_lines": """
        select l_orderkey as comid, count(*) as line_count, max(l_quantity) as quantity_max,
               2e0 as WsAreaSqKm
        from {lineitem} group by l_orderkey""",
    "bundle_returns": """
        select l_orderkey as comid, max(l_discount) as discount_max, min(l_tax) as tax_min
        from {lineitem} where l_returnflag = 'R' group by l_orderkey""",
    "bundle_area": """
        select o_orderkey as comid, abs(c_acctbal) as WsAreaSqKm
        from {orders} join {customer} on o_custkey = c_custkey""",
    "predictors": """
        select p_type || '20' || lpad(cast(p_size as varchar(20)), 2, '0')
                 || (case when p_partkey % 2 = 0 then 'Ws' else 'Cat' end) as predictor,
               max(length(p_name) * 1e0 / (1 + p_size)) as importance
        from {part} group by 1
        union all
        select 'Tile_density' as predictor, avg(p_size) * 1e0 as importance from {part}""",
    "metric_defs": """
        select distinct p_type || '[Year][AOI]' as metric_name, 'All of ' || p_type as description
        from {part}
        union
        select distinct left(p_type, 4) || '[AOI]' as metric_name,
               'Kind ' || left(p_type, 4) as description
        from {part}""",
    "features": """
        select p_partkey as row_id,
               cents / 100e0 / line_count as target,
               cast(quantity as double) / line_count as f1,
               cast(p_size as double) as f2,
               cast(percents as double) / line_count as f3,
               case when p_partkey % 9 = 0 then null else p_retailprice / 100 end as temp1,
               0e0 as zero1,
               case when p_partkey % 10 = 3 then p_size * 1e0 else null end as sparse1,
               2e0 * p_size + cast(quantity as double) / line_count as planted
        from {part} join (
          select l_partkey, count(*) as line_count,
                 cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as cents,
                 cast(sum(cast(round(l_quantity) as bigint)) as bigint) as quantity,
                 cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as percents
          from {lineitem} group by l_partkey) as lines
        on p_partkey = l_partkey""",
}

#: Tables a view joins by sorting on Spark: their files are small for their rows, so that Spark would
#: collect millions of rows on the driver to broadcast them.
SORTED = {"features": ("part",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One analysis table on Spark."""
    text = VIEWS[name]
    used = [t for t in TABLES if "{%s}" % t in text]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    frames |= {t: frames[t].hint("merge") for t in SORTED.get(name, ())}
    for word, sql in SPARK_WORDS.items():
        text = text.replace("{%s}" % word, sql)
    return spark.sql(text, **frames)


def duck_view(name: str) -> str:
    """The same table as DuckDB SQL text."""
    text = VIEWS[name]
    for word, sql in DUCK_WORDS.items():
        text = text.replace("{%s}" % word, sql)
    text = re.sub(r"\{(\w+)\}", r"\1", text)
    return text.replace("`", '"')
