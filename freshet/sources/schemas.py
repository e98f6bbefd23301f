"""Explicit schemas of the input files; ids are text so leading zeros survive."""

from __future__ import annotations

# Input file layouts.
RAW_SAMPLES = (
    "`Station` string, `Station number` string, `Sample date` string, "
    "`Daily Conc. (mg/L)` string, `Flow (cfs)` string, `Data type` string"
)
TILE_READINGS = (
    "site_id string, datetime timestamp_ntz, flow_cfs double, tss_mgl double, tp_mgl double, "
    "dop_mgl double, no2_no3_mgl double, nh3_mgl double, tkn_mgl double, chloride_mgl double"
)
GAGES = "Station_number bigint, Site_name string, COMID bigint, Area_Km2 double"
FIELD_CHEMISTRY = "site_id string, date string, srp double"
WATERSHED_AREAS = (
    "OID_ int, OBJECTID int, Site_ID string, Shape_Leng double, Shape_Area double, WS_area double"
)
TILE_DENSITY = (
    "OID_ int, ORIG_FID int, HydroID string, usgs_id string, station_ALL_clean bigint, "
    "name_ALL_clean string, Area_Km2 double, QC_Flag string, QC_complete string, "
    "Area_Km2_retab double, Shape_Length double, Shape_Area double, Tile_density double"
)
METRIC_DEFINITIONS = "metric_name string, description string"
