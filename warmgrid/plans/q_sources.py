"""Readers, writers and streams; each query exports derived data first and reads it back."""

import uuid

from pyspark.sql import functions as F

from warmgrid.operators import rollup as A
from warmgrid.plans.q_learn import mpc_hours
from warmgrid.plans.q_rollup import simple_base
from warmgrid.plans.registry import query
from warmgrid.session import checkpoint_root
from warmgrid.sources import tables as S
from warmgrid.sources.fixture_tables import add_oracle_tables


def scratch(t, name):
    return f"{checkpoint_root(t.spark)}/warmgrid/{t.spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


CSV_COLUMNS = ["site_id", "timestamp", "temperature", "energy", "wind_speed", "wind_gust", "is_auxiliary", "cloud_coverage"]
CSV_MAP = {x: x for x in CSV_COLUMNS}


def csv_export(t):
    """History as a user would upload it: text, local and offset timestamps, some broken cells."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    h = t.hourly_log.select(
        "site_id", F.when(F.col("hour") % 2 == 0, F.concat(stamp, F.lit("+00:00"))).when(F.col("hour") == 23, F.lit("never")).otherwise(stamp).alias("timestamp"),
        F.when(F.col("n") % 7 == 0, F.lit("n/a")).otherwise(F.col("temp").cast("string")).alias("temperature"),
        F.when(F.col("n") % 5 == 0, F.lit("")).otherwise(F.col("actual_kwh").cast("string")).alias("energy"),
        F.col("effective_wind").cast("string").alias("wind_speed"), F.when(F.col("hour") % 3 == 0, (F.col("effective_wind") + 2).cast("string")).alias("wind_gust"),
        F.when(F.col("auxiliary_active"), "Yes").otherwise("0").alias("is_auxiliary"), F.when(F.col("hour") % 4 != 0, F.col("cloud_coverage").cast("string")).alias("cloud_coverage"))
    path = scratch(t, "history_csv")
    h.write.option("header", True).csv(path)
    return path


add_oracle_tables(csv_hours="""
SELECT *, effective_wind + CASE WHEN hour % 3 = 0 THEN 1.2 ELSE 0 END AS ew FROM hourly_log WHERE hour <> 23""")
EW_BUCKET = "CASE WHEN round(ew + 1e-9, 6) >= 10.8 THEN 'extreme_wind' WHEN round(ew + 1e-9, 6) >= 8 THEN 'high_wind' ELSE 'normal' END"


@query("read_history_csv", "S1", "site_id:i ts:t temp:f actual_kwh:f effective_wind:f wind_bucket:s tdd:f auxiliary_active:b", f"""
SELECT site_id, ts, temp, actual_kwh, ew AS effective_wind, {EW_BUCKET} AS wind_bucket, round(abs(17 - temp) / 24 + 1e-9, 3) AS tdd, auxiliary_active FROM csv_hours WHERE n % 7 <> 0 AND n % 5 <> 0""")
def _(t):
    return S.read_history_csv(t.spark, csv_export(t), CSV_MAP, CSV_COLUMNS, t.sites)


@query("read_weather_csv", "S2", "site_id:i ts:t temp:f effective_wind:f tdd:f solar_factor:f", """
SELECT site_id, ts, CASE WHEN n % 7 <> 0 THEN temp END AS temp, ew AS effective_wind, CASE WHEN n % 7 <> 0 THEN round(abs(17 - temp) / 24 + 1e-9, 3) END AS tdd, CASE WHEN hour % 4 <> 0 THEN solar_factor END AS solar_factor FROM csv_hours""")
def _(t):
    return S.read_weather_csv(t.spark, csv_export(t), CSV_MAP, CSV_COLUMNS, t.sites)


@query("write_daily_csv", "S3", "site_id:i local_date:s kwh:f temp:f vec_temp_00:f vec_actual_12:f vec_wind_23:f", """
SELECT a.site_id, strftime(a.local_date, '%Y-%m-%d') AS local_date, kwh, a.temp, t0 AS vec_temp_00, a12 AS vec_actual_12, w23 AS vec_wind_23 FROM day_agg a JOIN (
SELECT site_id, local_date, avg(temp) FILTER (hour = 0) AS t0, sum(actual_kwh) FILTER (hour = 12) AS a12, avg(effective_wind) FILTER (hour = 23) AS w23 FROM hourly_log GROUP BY 1, 2) h ON a.site_id = h.site_id AND a.local_date = h.local_date""")
def _(t):
    path = scratch(t, "daily_csv")
    S.write_daily_csv(A.daily_scalars(t.hourly_log).join(A.hourly_vectors(t.hourly_log), ["site_id", "local_date"]), path)
    return t.spark.read.option("header", True).csv(path)


@query("write_hourly_csv", "S4", "site_id:i unit_0_actual:f unit_1_actual:f unit_1_expected:f temp:f hour:i", """
SELECT h.site_id, coalesce(max(u.actual_kwh) FILTER (unit_id = 'unit_0'), 0) AS unit_0_actual, coalesce(max(u.actual_kwh) FILTER (unit_id = 'unit_1'), 0) AS unit_1_actual, coalesce(max(u.expected_kwh) FILTER (unit_id = 'unit_1'), 0) AS unit_1_expected, any_value(h.temp) AS temp, any_value(h.hour) AS hour
FROM hourly_log h JOIN hourly_unit u ON h.site_id = u.site_id AND h.ts = u.ts GROUP BY h.site_id, h.ts""")
def _(t):
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct("unit_id", v)))
    maps = t.hourly_unit.groupBy("site_id", "ts").agg(entry("actual_kwh").alias("unit_breakdown"), entry("expected_kwh").alias("unit_expected_breakdown"))
    path = scratch(t, "hourly_csv")
    S.write_hourly_csv(t.hourly_log.select("site_id", "ts", "hour", "temp").join(maps, ["site_id", "ts"]), ["unit_0", "unit_1"], path)
    return t.spark.read.option("header", True).csv(path)


@query("state_json_model", "S6 F13", "site_id:i temp_key:i wind_bucket:s kwh:f", "SELECT site_id, temp_key, wind_bucket, kwh FROM simple_base")
def _(t):
    path = scratch(t, "state_json")
    S.write_state_json(simple_base(t), t.daily, path)
    return S.read_state_json(t.spark, path)[0]


@query("state_json_daily", "S6", "site_id:i local_date:d kwh:f tdd:f temp:f wind:f", "SELECT site_id, local_date, kwh, tdd, temp, wind FROM daily_history")
def _(t):
    path = scratch(t, "state_json")
    S.write_state_json(simple_base(t), t.daily, path)
    return S.read_state_json(t.spark, path)[1]


@query("read_forecast", "S7 F1 F9", "site_id:i ts:t source:s temperature:f cloud_used:f sun_elev:f sun_azim:f", """
SELECT f.site_id, f.ts, source, temperature, coalesce(f.cloud_coverage, CASE condition WHEN 'rainy' THEN 95 WHEN 'sunny' THEN 0 WHEN 'partlycloudy' THEN 50 END, 50) AS cloud_used, s.sun_elev, s.sun_azim FROM forecast_items f JOIN site_solar s ON f.site_id = s.site_id AND f.ts = s.ts""")
def _(t):
    path = scratch(t, "forecast")
    t.forecast.write.parquet(path)
    return S.read_forecast(t.spark, path, t.sites)


@query("read_mpc", "S8", "site_id:i local_date:d hour:i slot:s kwh_el_sh:f", """
WITH m AS (SELECT site_id, local_date, hour, actual_kwh AS el FROM hourly_unit WHERE unit_id = 'unit_0'),
b AS (SELECT *, 'live' AS slot, 9999 AS r FROM m WHERE day(local_date) % 3 = 0 UNION ALL SELECT site_id, local_date, hour, el * 0.9, '2300', 2300 FROM m WHERE day(local_date) % 2 = 0 UNION ALL SELECT site_id, local_date, hour, el * 0.8, '2200', 2200 FROM m),
n AS (SELECT site_id, local_date, slot, r, count(*) AS n FROM b GROUP BY 1, 2, 3, 4), k AS (SELECT *, row_number() OVER (PARTITION BY site_id, local_date ORDER BY r DESC) AS rk FROM n)
SELECT b.site_id, b.local_date, b.hour, b.slot, b.el AS kwh_el_sh FROM b JOIN k ON b.site_id = k.site_id AND b.local_date = k.local_date AND b.slot = k.slot WHERE rk = 1 AND n >= 12""")
def _(t):
    m = mpc_hours(t)
    live = m.filter(F.dayofmonth("local_date") % 3 == 0)
    snap = lambda d, s, f: d.withColumns({"slot": F.lit(s), "kwh_el_sh": F.col("kwh_el_sh") * f})
    return S.read_mpc(live, snap(m.filter(F.dayofmonth("local_date") % 2 == 0), "2300", 0.9).unionByName(snap(m, "2200", 0.8)), min_hours=12)
