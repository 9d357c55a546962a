"""Explicit schemas of the stored tables."""

FORECAST = (
    "station string, model string, cycle_utc timestamp, valid_utc timestamp, lead_hours int, "
    "sw1_height_ft double, sw1_period_s double, sw1_direction_deg double, "
    "sw2_height_ft double, sw2_period_s double, sw2_direction_deg double, "
    "combined_height_m double, combined_period_s double, combined_direction_deg double, "
    "ingest_utc timestamp")

OBS = ("station string, valid_utc timestamp, partition int, hs_m double, tp_s double, "
       "dp_deg double, source string, ingest_utc timestamp")

BIAS = "station string, lead_hours int, variable string, bias double, s double, c double, n long"

# Hourly JSON: one array per variable, all aligned with time.
HOURLY_WAVES = (
    "station string, hourly struct<time:array<string>,"
    + ",".join(f"{p}_{x}:array<double>" for p in ("swell_wave", "secondary_swell_wave", "tertiary_swell_wave", "wave")
               for x in ("height", "period", "direction"))
    + ",wave_peak_period:array<double>>")

TIDE = "station string, predictions array<struct<t:string,v:string,type:string>>"

GEOJSON = ("type string, features array<struct<type:string,properties:struct<site_name:string,TIME:string,"
           "significant_wave_height:double,peak_wave_period:double,peak_wave_direction:double,instrument:string>>>")

MODEL_META = (
    "name string, scope string, trained_utc string, n_train_rows long, n_test_rows long, coverage_frac double, "
    "metrics map<string, struct<"
    + ",".join(f"{v}:struct<mae:double,rmse:double,bias:double,n:long>" for v in (
        "sw1_height_ft", "sw1_period_s", "sw1_direction_deg", "sw2_height_ft", "sw2_period_s", "sw2_direction_deg"))
    + ",surfer:map<string,struct<sens:double,spec:double,ppv:double,npv:double,tp:long,fp:long,tn:long,fn:long,n:long>>>>")
