"""Joins, table merges and ranked reports."""

from pyspark.sql import functions as F

from warmgrid.operators import joins as J
from warmgrid.operators import merges as U
from warmgrid.operators import rollup as A
from warmgrid.operators import topk as K
from warmgrid.plans.q_rollup import simple_base
from warmgrid.plans.registry import query
from warmgrid.sources.fixture_tables import add_oracle_tables

add_oracle_tables(
    # means without auxiliary heat: temperatures and buckets that never occurred are its gaps
    patchy_base="""
SELECT site_id, CAST(round_even(temp, 0) AS INT) AS temp_key, wind_bucket, round(avg(actual_kwh) + 1e-9, 5) AS kwh, min(ts) AS first_ts, count(*) AS n
FROM hourly_log WHERE NOT auxiliary_active GROUP BY 1, 2, 3""",
    unit_cells="""
SELECT u.*, CAST(round_even(h.temp, 0) AS INT) AS temp_key, h.wind_bucket, h.auxiliary_active, h.solar_factor, h.temp
FROM hourly_unit u JOIN hourly_log h ON u.site_id = h.site_id AND u.ts = h.ts""",
)


def keyed(t):
    return t.hourly_log.withColumn("temp_key", F.rint("temp").cast("int"))


def patchy_base(t):
    h = keyed(t).filter(~F.col("auxiliary_active"))
    return h.groupBy("site_id", "temp_key", "wind_bucket").agg(
        F.round(F.avg("actual_kwh") + 1e-9, 5).alias("kwh"), F.min("ts").alias("first_ts"), F.count("*").alias("n"))


def unit_cells(t):
    return t.stored("unit_cells", lambda: build_unit_cells(t))


def build_unit_cells(t):
    h = keyed(t).select("site_id", "ts", "temp_key", "wind_bucket", "auxiliary_active", "solar_factor", "temp")
    return t.hourly_unit.join(h, ["site_id", "ts"])


@query("attach_model", "J1", "site_id:i ts:t model_kwh:f", """
SELECT h.site_id, h.ts, m.kwh AS model_kwh FROM hourly_log h LEFT JOIN patchy_base m
ON h.site_id = m.site_id AND m.temp_key = CAST(round_even(h.temp, 0) AS INT) AND m.wind_bucket = h.wind_bucket""")
def _(t):
    return J.attach_model(keyed(t), patchy_base(t))


FALLBACK_SQL = """
WITH wide AS (SELECT site_id, temp_key, max(kwh) FILTER (wind_bucket = 'normal') AS nn, max(kwh) FILTER (wind_bucket = 'high_wind') AS hh,
   max(kwh) FILTER (wind_bucket = 'extreme_wind') AS ee, min(first_ts) AS f FROM {model} GROUP BY 1, 2),
tk AS (SELECT DISTINCT site_id, CAST(round_even(temp, 0) AS INT) AS temp_key FROM hourly_log),
near AS (SELECT * FROM (SELECT t.site_id, t.temp_key, w.temp_key AS nk, w.nn, w.hh, w.ee,
   row_number() OVER (PARTITION BY t.site_id, t.temp_key ORDER BY abs(t.temp_key - w.temp_key), w.f, w.temp_key) AS rn
   FROM tk t JOIN wide w ON t.site_id = w.site_id AND t.temp_key <> w.temp_key) WHERE rn = 1),
h AS (SELECT *, CAST(round_even(temp, 0) AS INT) AS temp_key, abs(17.0 - temp) AS dt FROM hourly_log),
j AS (SELECT h.*, o.nn AS o_n, o.hh AS o_h, o.ee AS o_e, near.nk,
   CASE wind_bucket WHEN 'normal' THEN o.nn WHEN 'high_wind' THEN o.hh ELSE o.ee END AS exact,
   CASE wind_bucket WHEN 'normal' THEN a.nn WHEN 'high_wind' THEN a.hh ELSE a.ee END AS lo,
   CASE wind_bucket WHEN 'normal' THEN b.nn WHEN 'high_wind' THEN b.hh ELSE b.ee END AS hi,
   CASE wind_bucket WHEN 'normal' THEN coalesce(near.nn, near.hh, near.ee) WHEN 'high_wind' THEN coalesce(near.hh, near.nn, near.ee)
     ELSE coalesce(near.ee, near.hh, near.nn) END AS nv,
   CASE wind_bucket WHEN 'extreme_wind' THEN coalesce(o.hh, o.nn) ELSE o.nn END AS calm
 FROM h LEFT JOIN wide o ON h.site_id = o.site_id AND h.temp_key = o.temp_key LEFT JOIN wide a ON h.site_id = a.site_id AND a.temp_key = h.temp_key - 1
 LEFT JOIN wide b ON h.site_id = b.site_id AND b.temp_key = h.temp_key + 1 LEFT JOIN near ON h.site_id = near.site_id AND h.temp_key = near.temp_key)
SELECT site_id, ts, coalesce(exact, CASE WHEN dt <= 4 THEN coalesce((lo + hi) / 2, lo, hi, calm) END,
  CASE WHEN nv IS NULL THEN coalesce(o_n, o_h, o_e, 0) WHEN nv <= 0.001 THEN 0 WHEN abs(17 - nk) < CASE WHEN dt > 4 THEN 1.0 ELSE 0.5 END THEN nv
   ELSE round(nv * dt / abs(17 - nk) + 1e-9, 3) END) AS predicted FROM j"""


@query("attach_model_with_fallback", "J2", "site_id:i ts:t predicted:f", FALLBACK_SQL.format(model="patchy_base"))
def _(t):
    return J.attach_model_with_fallback(keyed(t), patchy_base(t))


@query("blend_sources", "J3", "site_id:i ts:t _source:s temperature:f wind_speed:f", """
SELECT coalesce(p.site_id, s.site_id) AS site_id, coalesce(p.ts, s.ts) AS ts, CASE WHEN p.ts IS NOT NULL AND p.ts < DATE '2024-01-14' THEN 'primary' ELSE 'secondary' END AS _source,
 CASE WHEN p.ts IS NOT NULL AND p.ts < DATE '2024-01-14' THEN p.temperature ELSE s.temperature END AS temperature,
 CASE WHEN p.ts IS NOT NULL AND p.ts < DATE '2024-01-14' THEN p.wind_speed ELSE s.wind_speed END AS wind_speed
FROM (SELECT * FROM forecast_items WHERE source = 'primary') p FULL JOIN (SELECT * FROM forecast_items WHERE source = 'secondary') s ON p.site_id = s.site_id AND p.ts = s.ts
WHERE s.ts IS NOT NULL OR p.ts < DATE '2024-01-14'""")
def _(t):
    p, s = (t.forecast.filter(F.col("source") == x).select("site_id", "ts", "temperature", "wind_speed") for x in ("primary", "secondary"))
    return J.blend_sources(p, s, F.to_date(F.lit("2024-01-10")))


@query("merge_live_reference", "J4", "site_id:i local_date:d hour:i filled:b temperature:f", """
SELECT coalesce(l.site_id, r.site_id) AS site_id, coalesce(l.local_date, r.local_date) AS local_date, coalesce(l.hour, r.hour) AS hour, l.hour IS NULL AS filled, coalesce(l.temperature, r.temperature) AS temperature
FROM (SELECT * FROM forecast_items WHERE source = 'primary') l FULL JOIN (SELECT * FROM forecast_items WHERE source = 'secondary') r
ON l.site_id = r.site_id AND l.local_date = r.local_date AND l.hour = r.hour""")
def _(t):
    l, r = (t.forecast.filter(F.col("source") == x).select("site_id", "local_date", "hour", "temperature") for x in ("primary", "secondary"))
    return J.merge_live_reference(l, r)


@query("same_week_last_year", "J5 F12", "site_id:i local_date:d ly_date:d kwh:f ly_kwh:f", """
WITH d AS (SELECT site_id, local_date, kwh, isoyear(local_date) AS y, weekofyear(local_date) AS w, isodow(local_date) AS wd FROM daily_history),
x AS (SELECT *, CAST(make_date(y - 1, 1, 4) AS DATE) AS j4, least(w, weekofyear(make_date(y - 1, 12, 28))) AS lw FROM d),
a AS (SELECT *, j4 - CAST(isodow(j4) - 1 AS INT) + CAST((lw - 1) * 7 + wd - 1 AS INT) AS ly FROM x)
SELECT a.site_id, a.local_date, a.ly AS ly_date, a.kwh, p.kwh AS ly_kwh FROM a LEFT JOIN daily_history p ON a.site_id = p.site_id AND p.local_date = a.ly""")
def _(t):
    return J.same_period_last_year(t.daily, "week", ["kwh"])


@query("same_day_last_year", "J5", "site_id:i local_date:d ly_month_kwh:f ly_day_kwh:f", """
SELECT d.site_id, d.local_date, m.kwh AS ly_month_kwh, y.kwh AS ly_day_kwh FROM daily_history d
LEFT JOIN daily_history m ON m.site_id = d.site_id AND m.local_date = CAST(d.local_date - INTERVAL 1 YEAR AS DATE)
LEFT JOIN daily_history y ON y.site_id = d.site_id AND y.local_date = d.local_date - 365""")
def _(t):
    m = J.same_period_last_year(t.daily, "month", ["kwh"]).select("site_id", "local_date", F.col("ly_kwh").alias("ly_month_kwh"))
    d = J.same_period_last_year(t.daily, "day", ["kwh"]).select("site_id", "local_date", F.col("ly_kwh").alias("ly_day_kwh"))
    return m.join(d, ["site_id", "local_date"])


@query("hours_vs_forecast", "J6", "site_id:i ts:t temp:f plan_temp:f plan_wind:f", """
SELECT h.site_id, h.ts, h.temp, f.temperature AS plan_temp, f.wind_speed AS plan_wind FROM hourly_log h JOIN forecast_items f
ON h.site_id = f.site_id AND h.local_date = f.local_date AND h.hour = f.hour AND f.source = 'primary'""")
def _(t):
    return J.hours_vs_forecast(t.hourly_log, t.forecast.filter(F.col("source") == "primary"))


def weather_import(t):
    f = t.forecast.filter(F.col("source") == "secondary")
    return f.select("site_id", "ts", "local_date", "hour", F.col("temperature").alias("temp"), F.lit(None).cast("double").alias("tdd"),
                    F.col("wind_speed").alias("effective_wind"), F.lit(None).cast("string").alias("wind_bucket"), F.lit(None).cast("double").alias("solar_factor"))


@query("weather_only_update", "J7", "site_id:i ts:t updated:b temp:f effective_wind:f tdd:f", """
SELECT h.site_id, h.ts, f.ts IS NOT NULL AS updated, coalesce(f.temperature, h.temp) AS temp, coalesce(f.wind_speed, h.effective_wind) AS effective_wind, h.tdd
FROM hourly_log h LEFT JOIN forecast_items f ON h.site_id = f.site_id AND h.ts = f.ts AND f.source = 'secondary'""")
def _(t):
    return J.weather_only_update(t.hourly_log, weather_import(t))


@query("weather_only_days", "J7 S2", "site_id:i local_date:d rows:i temp:f wind:f solar_factor:f", """
SELECT site_id, local_date, count(*) AS rows, round(avg(temp) + 1e-9, 1) AS temp, round(avg(effective_wind) + 1e-9, 1) AS wind, round(avg(solar_factor) + 1e-9, 3) AS solar_factor
FROM hourly_log WHERE day(local_date) % 3 = 0 GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(t):
    kept = t.hourly_log.filter(F.dayofmonth("local_date") % 3 != 0)
    return J.weather_only_days(kept, t.hourly_log)


@query("insert_missing", "J8", "site_id:i ts:t temp:f actual_kwh:f", """
SELECT h.site_id, h.ts, h.temp, h.actual_kwh FROM hourly_log h
UNION ALL SELECT f.site_id, f.ts, f.temperature, NULL FROM forecast_items f ANTI JOIN hourly_log k ON f.site_id = k.site_id AND f.ts = k.ts WHERE source = 'primary'""")
def _(t):
    imported = t.forecast.filter(F.col("source") == "primary").select("site_id", "ts", F.col("temperature").alias("temp"))
    return J.insert_missing(t.hourly_log, imported)


def originators(cells):
    return cells.filter((F.col("solar_factor") > 0.05) & ~F.col("auxiliary_active") & F.col("mode").isin("heating", "cooling"))


@query("lag_walk", "J9", "site_id:i unit_id:s lag:i n:i residual:f", """
SELECT o.site_id, o.unit_id, date_diff('hour', o.ts, t.ts) AS lag, count(*) AS n, sum(t.expected_kwh - t.actual_kwh) AS residual
FROM (SELECT * FROM unit_cells WHERE solar_factor > 0.05 AND NOT auxiliary_active AND mode IN ('heating','cooling')) o
JOIN unit_cells t ON o.site_id = t.site_id AND o.unit_id = t.unit_id AND t.ts BETWEEN o.ts AND o.ts + INTERVAL 6 HOUR
WHERE t.mode = o.mode AND NOT t.auxiliary_active AND (t.ts = o.ts OR t.solar_factor <= 0.05) GROUP BY 1, 2, 3""")
def _(t):
    u = unit_cells(t)
    return J.lag_walk(originators(u), u).groupBy("site_id", "unit_id", "lag").agg(F.count("*").alias("n"), F.sum("residual").alias("residual"))


@query("evening_tail", "J10", "site_id:i unit_id:s k:i n:i residual:f", """
WITH o AS (SELECT c.site_id, c.unit_id, c.mode, c.ts, min(d.ts) AS dark FROM unit_cells c JOIN hourly_log d ON c.site_id = d.site_id AND d.solar_factor < 0.05
  AND d.ts BETWEEN c.ts + INTERVAL 1 HOUR AND c.ts + INTERVAL 12 HOUR WHERE c.solar_factor > 0.05 AND NOT c.auxiliary_active AND c.mode IN ('heating','cooling') GROUP BY 1, 2, 3, 4)
SELECT o.site_id, o.unit_id, date_diff('hour', dark, t.ts) AS k, count(*) AS n, sum(expected_kwh - actual_kwh) AS residual FROM o JOIN unit_cells t
ON o.site_id = t.site_id AND o.unit_id = t.unit_id AND t.ts BETWEEN dark AND dark + INTERVAL 5 HOUR WHERE t.mode = o.mode AND NOT t.auxiliary_active GROUP BY 1, 2, 3""")
def _(t):
    u = unit_cells(t)
    return J.evening_tail(originators(u), u, t.hourly_log).groupBy("site_id", "unit_id", "k").agg(F.count("*").alias("n"), F.sum("residual").alias("residual"))


@query("recent_temps", "J11", "site_id:i at_ts:t n:i temps:s", """
SELECT site_id, at_ts, count(*) AS n, string_agg(printf('%.1f', temp), ',' ORDER BY ts) AS temps FROM (
SELECT a.site_id, a.ts AS at_ts, h.ts, h.temp, row_number() OVER (PARTITION BY a.site_id, a.ts ORDER BY h.ts DESC) AS rn FROM hourly_log a JOIN hourly_log h
ON a.site_id = h.site_id AND h.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts - INTERVAL 1 HOUR) WHERE rn <= 4 GROUP BY 1, 2""")
def _(t):
    at = t.hourly_log.select("site_id", F.col("ts").alias("at"))
    r = J.recent_temps(t.hourly_log, at, 4, 6).filter("temps is not null")
    return r.select("site_id", F.col("at").alias("at_ts"), F.size("temps").alias("n"), F.concat_ws(",", F.transform("temps", lambda x: F.format_string("%.1f", x))).alias("temps"))


@query("attach_synthetic", "J12", "site_id:i unit_id:s ts:t reference_kwh:f synthetic_used:b", """
SELECT u.site_id, u.unit_id, u.ts, CASE WHEN mpc_managed AND x.syn IS NOT NULL THEN x.syn ELSE u.actual_kwh END AS reference_kwh, mpc_managed AND x.syn IS NOT NULL AS synthetic_used
FROM hourly_unit u JOIN unit_dim d ON u.site_id = d.site_id AND u.unit_id = d.unit_id LEFT JOIN (SELECT site_id, local_date, hour, sum(actual_kwh) * 0.5 AS syn FROM hourly_log WHERE hour < 20 GROUP BY 1, 2, 3) x
ON u.site_id = x.site_id AND u.local_date = x.local_date AND u.hour = x.hour""")
def _(t):
    h = t.hourly_log.filter(F.col("hour") < 20)
    dist = h.groupBy("site_id", "local_date").agg(F.collect_list(F.struct("hour", (F.col("actual_kwh") * 0.5).alias("synthetic_kwh_el"))).alias("track_c_distribution"))
    return J.attach_synthetic(t.hourly_unit, dist, t.units)


@query("scope_join", "J13", "site_id:i unit_id:s ts:t aux_affected:b solar_affected:b screen_affected:b", """
SELECT u.site_id, u.unit_id, u.ts, coalesce(aux_affected, false) AS aux_affected, coalesce(solar_affected, false) AS solar_affected, coalesce(screen_affected, false) AS screen_affected
FROM hourly_unit u LEFT JOIN (SELECT * FROM unit_dim WHERE unit_id <> 'unit_3' OR site_id % 2 = 0) d ON u.site_id = d.site_id AND u.unit_id = d.unit_id""")
def _(t):
    known = t.units.filter((F.col("unit_id") != "unit_3") | (F.col("site_id") % 2 == 0))
    return J.scope_join(t.hourly_unit, known)


# --- ranked reports -------------------------------------------------------------

add_oracle_tables(unit_obs="""
SELECT site_id, unit_id, temp_key, wind_bucket, count(*) AS obs_count, round(avg(actual_kwh) + 1e-9, 5) AS kwh FROM unit_cells GROUP BY 1, 2, 3, 4""",
unit_dev="""
SELECT site_id, local_date, unit_id, round(a - e + 1e-9, 2) AS deviation, round(a + 1e-9, 2) AS actual, round(e + 1e-9, 2) AS expected, obs,
 CASE WHEN obs >= 20 THEN 'high' WHEN obs >= 5 THEN 'medium' ELSE 'low' END AS confidence,
 CASE WHEN obs >= 5 THEN CASE WHEN abs(a - e) < 0.2 THEN false ELSE abs(a - e) / (e + 1) > greatest(0.3, 0.75 - obs * 0.0225) END END AS unusual,
 CASE WHEN obs >= 5 THEN CASE WHEN abs(a - e) < 0.2 THEN 0 ELSE round(abs(a - e) / (e + 1) + 1e-9, 3) END END AS score
FROM (SELECT c.site_id, c.local_date, c.unit_id, sum(c.actual_kwh) AS a, sum(c.expected_kwh) AS e, avg(coalesce(o.obs_count, 0)) AS obs
 FROM unit_cells c LEFT JOIN unit_obs o ON c.site_id = o.site_id AND c.unit_id = o.unit_id AND c.temp_key = o.temp_key AND c.wind_bucket = o.wind_bucket GROUP BY 1, 2, 3)""")


def unit_obs(t):
    return unit_cells(t).groupBy("site_id", "unit_id", "temp_key", "wind_bucket").agg(
        F.count("*").alias("obs_count"), F.round(F.avg("actual_kwh") + 1e-9, 5).alias("kwh"))


@query("deviation_by_unit", "M10", "site_id:i local_date:d unit_id:s deviation:f actual:f expected:f obs:f confidence:s unusual:b score:f", "SELECT * FROM unit_dev")
def _(t):
    return K.deviation_by_unit(unit_cells(t), unit_obs(t))


@query("top_deviation_units", "K1", "site_id:i local_date:d unit_id:s deviation:f rank:i", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, local_date ORDER BY abs(deviation) DESC, unit_id) AS rank FROM unit_dev) WHERE rank <= 3""")
def _(t):
    return K.top_deviation_units(K.deviation_by_unit(unit_cells(t), unit_obs(t)))


@query("top_contributors", "K2", "site_id:i ts:t unit_id:s actual_kwh:f rank:i", """
SELECT * FROM (SELECT site_id, ts, unit_id, actual_kwh, row_number() OVER (PARTITION BY site_id, ts ORDER BY actual_kwh DESC, unit_id) AS rank FROM hourly_unit WHERE actual_kwh > 0) WHERE rank <= 3""")
def _(t):
    return K.top_contributors(t.hourly_unit, "actual_kwh")


@query("extreme_days", "K4", "site_id:i month:s coldest:d warmest:d peak:d lightest:d", """
SELECT site_id, month, min(local_date) FILTER (rc = 1) AS coldest, min(local_date) FILTER (rw = 1) AS warmest, min(local_date) FILTER (rp = 1) AS peak, min(local_date) FILTER (rl = 1) AS lightest FROM (
SELECT *, row_number() OVER (w ORDER BY temp, local_date) AS rc, row_number() OVER (w ORDER BY temp DESC, local_date) AS rw, row_number() OVER (w ORDER BY kwh DESC, local_date) AS rp,
 row_number() OVER (w ORDER BY kwh, local_date) AS rl FROM (SELECT *, strftime(local_date, '%Y-%m') AS month FROM daily_history) WINDOW w AS (PARTITION BY site_id, month)) GROUP BY 1, 2""")
def _(t):
    return K.extreme_days(t.daily.withColumn("month", F.date_format("local_date", "yyyy-MM")), ["site_id", "month"])


@query("model_diff_topk", "K5", "site_id:i temp_key:i wind_bucket:s before:f after:f delta:f rank:i buckets_changed:i", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY abs(delta) DESC, site_id, temp_key, wind_bucket) AS rank, count(*) OVER (PARTITION BY site_id) AS buckets_changed FROM (
SELECT *, round(after - before + 1e-9, 9) AS delta FROM (SELECT coalesce(a.site_id, b.site_id) AS site_id, coalesce(a.temp_key, b.temp_key) AS temp_key, coalesce(a.wind_bucket, b.wind_bucket) AS wind_bucket,
 coalesce(b.kwh, 0) AS before, coalesce(a.kwh, 0) AS after FROM simple_base a FULL JOIN patchy_base b ON a.site_id = b.site_id AND a.temp_key = b.temp_key AND a.wind_bucket = b.wind_bucket)
WHERE round(after - before + 1e-9, 9) <> 0)) WHERE rank <= 200""")
def _(t):
    return K.model_diff_topk(patchy_base(t), simple_base(t), ["site_id", "temp_key", "wind_bucket"], ["site_id"])


@query("bucket_flags_ranked", "K6", "site_id:i verdict:s temp_key:i wind_bucket:s delta_pct:f rank:i", """
SELECT *, row_number() OVER (PARTITION BY site_id, verdict ORDER BY abs(coalesce(delta_pct, 0)) DESC, temp_key, wind_bucket) AS rank FROM dark_cells WHERE verdict IN ('inflated','deflated')""")
def _(t):
    return K.bucket_flags_ranked(A.dark_hour_baseline(t.hourly_log, simple_base(t)))


@query("better_source", "K7", "site_id:i primary_p50:f secondary_p50:f better:s", """
SELECT site_id, p AS primary_p50, s AS secondary_p50, CASE WHEN s IS NULL THEN 'primary_only' WHEN p < s * 0.9 THEN 'primary' WHEN s < p * 0.9 THEN 'secondary' ELSE 'similar' END AS better FROM (
SELECT site_id, median(abs(actual_kwh - forecasted_kwh_primary)) AS p, median(abs(actual_kwh - forecasted_kwh_secondary)) AS s FROM hourly_log GROUP BY 1)""")
def _(t):
    h = t.hourly_log
    e = h.select("site_id", F.explode(F.array(F.struct(F.lit("primary").alias("source"), F.abs(F.col("actual_kwh") - F.col("forecasted_kwh_primary")).alias("e")),
                                              F.struct(F.lit("secondary").alias("source"), F.abs(F.col("actual_kwh") - F.col("forecasted_kwh_secondary")).alias("e")))).alias("x")).select("site_id", "x.*")
    return K.better_source(e.filter("e is not null").groupBy("site_id", "source").agg(F.median("e").alias("p50"), F.count("*").alias("samples")))


# --- merges ---------------------------------------------------------------------


@query("dedupe_hours", "U1", "site_id:i ts:t event_id:i temp:f", """
SELECT site_id, hr AS ts, event_id, temp FROM (SELECT *, row_number() OVER (PARTITION BY site_id, hr ORDER BY event_id) AS rn FROM sample_rows) WHERE rn = 1""")
def _(t):
    s = t.samples.select("site_id", F.col("hr").alias("ts"), "event_id", "temp")
    return U.dedupe_hours(s, "event_id")


@query("rename_unit", "U2", "site_id:i ts:t unit_id:s kwh:f", """
SELECT site_id, ts, CASE WHEN site_id = 0 AND unit_id = 'unit_1' THEN 'unit_2' ELSE unit_id END AS unit_id, sum(actual_kwh) AS kwh FROM hourly_unit GROUP BY 1, 2, 3""")
def _(t):
    # the new name is already in use: the two units' values add up
    maps = t.hourly_unit.groupBy("site_id", "ts").agg(F.map_from_entries(F.collect_list(F.struct("unit_id", "actual_kwh"))).alias("unit_breakdown"))
    return U.rename_unit(maps, 0, "unit_1", "unit_2").select("site_id", "ts", F.explode("unit_breakdown").alias("unit_id", "kwh"))


@query("redistribute_aux", "U3", "site_id:i unit_id:s temp_key:i wind_bucket:s kw:f", """
WITH aux AS (SELECT site_id, unit_id, temp_key, wind_bucket, kwh * 0.3 AS kw FROM unit_obs WHERE obs_count > 2),
stay AS (SELECT * FROM aux WHERE unit_id <> 'unit_1'), pool AS (SELECT site_id, temp_key, wind_bucket, kw AS pool FROM aux WHERE unit_id = 'unit_1' AND kw > 0),
tot AS (SELECT site_id, temp_key, wind_bucket, sum(kw) AS w FROM stay GROUP BY 1, 2, 3),
prim AS (SELECT site_id, arg_max(unit_id, kwh) AS unit_id FROM (SELECT site_id, unit_id, sum(actual_kwh) AS kwh FROM hourly_unit WHERE unit_id <> 'unit_1' GROUP BY 1, 2) GROUP BY 1),
addition AS (SELECT s.unit_id, s.site_id, s.temp_key, s.wind_bucket, pool * kw / w AS a FROM stay s JOIN pool USING (site_id, temp_key, wind_bucket) JOIN tot USING (site_id, temp_key, wind_bucket)
 UNION ALL SELECT prim.unit_id, p.site_id, p.temp_key, p.wind_bucket, pool FROM pool p JOIN prim ON p.site_id = prim.site_id ANTI JOIN tot ON p.site_id = tot.site_id AND p.temp_key = tot.temp_key AND p.wind_bucket = tot.wind_bucket)
SELECT coalesce(s.site_id, a.site_id) AS site_id, coalesce(s.unit_id, a.unit_id) AS unit_id, coalesce(s.temp_key, a.temp_key) AS temp_key, coalesce(s.wind_bucket, a.wind_bucket) AS wind_bucket,
 round(CASE WHEN a IS NULL THEN kw ELSE least(coalesce(kw, 0) + a, coalesce(o.kwh * 0.4, coalesce(kw, 0) + a)) END + 1e-9, 3) AS kw
FROM stay s FULL JOIN addition a ON s.site_id = a.site_id AND s.unit_id = a.unit_id AND s.temp_key = a.temp_key AND s.wind_bucket = a.wind_bucket
LEFT JOIN unit_obs o ON o.site_id = coalesce(s.site_id, a.site_id) AND o.unit_id = coalesce(s.unit_id, a.unit_id) AND o.temp_key = coalesce(s.temp_key, a.temp_key) AND o.wind_bucket = coalesce(s.wind_bucket, a.wind_bucket)""")
def _(t):
    obs = unit_obs(t)
    aux = obs.filter(F.col("obs_count") > 2).select(
        "site_id", "unit_id", "temp_key", "wind_bucket", (F.col("kwh") * 0.3).alias("kw"))
    removed = t.units.filter(F.col("unit_id") == "unit_1").select("site_id", "unit_id")
    usage = t.hourly_unit.groupBy("site_id", "unit_id").agg(F.sum("actual_kwh").alias("kwh"))
    return U.redistribute_aux(aux, obs.withColumn("kwh", F.col("kwh") * 0.4), removed, usage)


@query("drop_units", "U4", "site_id:i unit_id:s temp_key:i wind_bucket:s kwh:f", """
SELECT site_id, unit_id, temp_key, wind_bucket, kwh FROM unit_obs WHERE NOT (unit_id = 'unit_2' AND site_id % 2 = 0) AND site_id <> 1""")
def _(t):
    victims = t.units.filter((F.col("unit_id") == "unit_2") & (F.col("site_id") % 2 == 0))
    return U.reset_model(U.drop_units(unit_obs(t), victims), site=1)


@query("merge_model", "U6", "site_id:i unit_id:s s:f had_prior:b", """
WITH o AS (SELECT site_id, unit_id, sum(actual_kwh) / 100 AS s FROM hourly_unit WHERE unit_id <> 'unit_3' GROUP BY 1, 2), n AS (SELECT site_id, unit_id, avg(actual_kwh) * 8 AS s FROM hourly_unit WHERE unit_id <> 'unit_0' GROUP BY 1, 2)
SELECT coalesce(o.site_id, n.site_id) AS site_id, coalesce(o.unit_id, n.unit_id) AS unit_id, round(CASE WHEN n.s IS NULL THEN o.s WHEN coalesce(o.s, 0) > 1e-6 THEN 0.3 * least(5, n.s) + 0.7 * o.s ELSE least(5, n.s) END + 1e-9, 5) AS s,
 coalesce(o.s, 0) > 1e-6 AS had_prior FROM o FULL JOIN n ON o.site_id = n.site_id AND o.unit_id = n.unit_id""")
def _(t):
    u = t.hourly_unit
    old = u.filter("unit_id <> 'unit_3'").groupBy("site_id", "unit_id").agg((F.sum("actual_kwh") / 100).alias("s"))
    new = u.filter("unit_id <> 'unit_0'").groupBy("site_id", "unit_id").agg((F.avg("actual_kwh") * 8).alias("s"))
    return U.merge_model(old, new, ["site_id", "unit_id"], ["s"])


@query("normalize_legacy", "U5", "site_id:i local_date:d kwh:f tdd:f temp:f wind:f aux_impact_kwh:f", """
SELECT site_id, local_date, CASE WHEN site_id % 2 = 0 THEN kwh ELSE kwh + 1 END AS kwh, tdd, temp, NULL AS wind, 0.0 AS aux_impact_kwh FROM daily_history""")
def _(t):
    old = t.daily.filter("site_id % 2 = 0").select("site_id", "local_date", F.col("kwh").cast("string").alias("load"), F.col("tdd").cast("string").alias("hdd"), "temp")
    new = t.daily.filter("site_id % 2 = 1").select("site_id", "local_date", (F.col("kwh") + 1).alias("kwh"), "tdd", "temp")
    return U.normalize_legacy(old.unionByName(new, allowMissingColumns=True))


@query("stratify_coefficients", "U5", "site_id:i unit_id:s regime:s s:f learned:b", """
SELECT site_id, unit_id, regime, CASE WHEN regime = 'heating' THEN x ELSE 0.4 END AS s, regime = 'heating' AND x > 0 AS learned
FROM (SELECT site_id, unit_id, avg(actual_kwh) AS x, unnest(['heating', 'cooling']) AS regime FROM hourly_unit GROUP BY 1, 2)""")
def _(t):
    raw = t.hourly_unit.groupBy("site_id", "unit_id").agg(F.avg("actual_kwh").alias("scalar"))
    return U.stratify_coefficients(raw.withColumns({x: F.lit(None).cast("double") for x in "sew"}))
