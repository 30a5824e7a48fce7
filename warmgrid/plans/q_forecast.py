"""Forecast tables and accuracy."""

from pyspark.sql import functions as F

from warmgrid.operators import forecast as X
from warmgrid.operators import score as M
from warmgrid.plans.q_score import models, score_hours, score_sql
from warmgrid.plans.registry import query
from warmgrid.sources.fixture_tables import add_oracle_tables

add_oracle_tables(
    day_sources="""
SELECT site_id, local_date, source, count(*) AS hours, round(sum(f) + 1e-9, 2) AS forecast, round(sum(g) + 1e-9, 2) AS actual, round(sum(e) + 1e-9, 2) AS error, round(sum(abs(e)) + 1e-9, 2) AS abs_error,
 round(coalesce(sum(w), 0) + 1e-9, 2) AS weather_error, round(coalesce(sum(abs(w)), 0) + 1e-9, 2) AS abs_weather_error, arg_max(entity, ts) AS entity FROM (
SELECT site_id, local_date, source, ts, entity, g, coalesce(fg, fn) AS f, CASE WHEN fg IS NOT NULL THEN g ELSE actual_kwh END - coalesce(fg, fn) AS e, expected_kwh + aux_impact_kwh - fg AS w FROM (
 SELECT *, actual_kwh + aux_impact_kwh - guest_impact_kwh AS g, 'primary' AS source, primary_entity AS entity, forecasted_kwh_primary AS fn, forecasted_kwh_gross_primary AS fg FROM hourly_log
 UNION ALL SELECT *, actual_kwh + aux_impact_kwh - guest_impact_kwh, 'secondary', secondary_entity, forecasted_kwh_secondary, forecasted_kwh_gross_secondary FROM hourly_log) WHERE fn IS NOT NULL) GROUP BY 1, 2, 3""",
    current_sources="""
SELECT * FROM day_sources WHERE entity = CASE WHEN source = 'secondary' THEN 'met_c' WHEN site_id % 2 = 0 THEN 'met_a' ELSE 'met_b' END""",
    accuracy_days="""
SELECT h.*, round(s.kwh + 1e-9, 2) AS forecast_kwh, round(g + 1e-9, 2) AS actual_kwh, round(n + 1e-9, 2) AS net_actual_kwh, round(m + 1e-9, 2) AS modeled_kwh, round(g - s.kwh + 1e-9, 2) AS error_kwh, round(abs(g - s.kwh) + 1e-9, 2) AS abs_error_kwh FROM (
SELECT site_id, local_date, sum(actual_kwh + aux_impact_kwh - guest_impact_kwh) AS g, sum(actual_kwh) AS n, sum(expected_kwh + aux_impact_kwh) AS m, arg_max(primary_entity, ts) AS primary_entity,
 round(avg(abs(e)) FILTER (hour BETWEEN 6 AND 21) + 1e-9, 2) AS day_mae, round(avg(abs(e)) FILTER (hour NOT BETWEEN 6 AND 21) + 1e-9, 2) AS night_mae FROM (
 SELECT *, CASE WHEN forecasted_kwh_gross IS NOT NULL THEN actual_kwh + aux_impact_kwh - guest_impact_kwh - forecasted_kwh_gross ELSE actual_kwh - guest_impact_kwh - forecasted_kwh END AS e FROM hourly_log) GROUP BY 1, 2) h
JOIN (SELECT site_id, local_date, sum(expected_kwh) * 1.02 AS kwh FROM hourly_log GROUP BY 1, 2) s ON h.site_id = s.site_id AND h.local_date = s.local_date""")


def current_sources(t):
    """The providers in use now; some sites had another one earlier in the month."""
    primary = t.sites.select("site_id", F.lit("primary").alias("source"), F.when(F.col("site_id") % 2 == 0, "met_a").otherwise("met_b").alias("entity"))
    return primary.unionAll(t.sites.select("site_id", F.lit("secondary").alias("source"), F.lit("met_c").alias("entity")))


def snapshot(t):
    return t.hourly_log.groupBy("site_id", "local_date").agg((F.sum("expected_kwh") * 1.02).alias("kwh"), F.lit("primary").alias("source"))


def history(t):
    return X.daily_accuracy(t.hourly_log, snapshot(t))


@query("daily_accuracy", "A15", "site_id:i local_date:d forecast_kwh:f actual_kwh:f net_actual_kwh:f modeled_kwh:f error_kwh:f abs_error_kwh:f day_mae:f night_mae:f primary_entity:s",
       "SELECT * FROM accuracy_days")
def _(t):
    return history(t)


@query("source_breakdown", "A15 F13", "site_id:i local_date:d source:s hours:i forecast:f actual:f error:f abs_error:f weather_error:f abs_weather_error:f", "SELECT * FROM day_sources")
def _(t):
    m = X.accuracy_map(X.source_breakdown(t.hourly_log))
    return m.select("site_id", "local_date", F.explode("source_breakdown").alias("source", "v")).select("site_id", "local_date", "source", "v.*")


@query("backfill_accuracy", "A16", "site_id:i local_date:d forecast_kwh:f actual_kwh:f error_kwh:f abs_error_kwh:f source:s", """
WITH n AS (SELECT site_id, local_date, forecast_source, count(*) AS n, min(ts) AS t0 FROM hourly_log GROUP BY 1, 2, 3),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, local_date ORDER BY n DESC, t0) AS rk FROM n) WHERE rk = 1),
d AS (SELECT site_id, local_date, round(sum(expected_kwh) + 1e-9, 2) AS f, round(sum(actual_kwh) + 1e-9, 2) AS a FROM hourly_log GROUP BY 1, 2)
SELECT d.site_id, d.local_date, f AS forecast_kwh, a AS actual_kwh, round(a - f + 1e-9, 2) AS error_kwh, abs(round(a - f + 1e-9, 2)) AS abs_error_kwh, forecast_source AS source FROM d JOIN s ON d.site_id = s.site_id AND d.local_date = s.local_date WHERE d.local_date <> DATE '2024-01-20'""")
def _(t):
    return X.backfill_accuracy(t.hourly_log, F.to_date(F.lit("2024-01-20")))


@query("forecast_uncertainty", "D12", "site_id:i p50:f p95:f samples:i", """
SELECT s.site_id, coalesce(p50, 1.0) AS p50, coalesce(p95, 2.0) AS p95, coalesce(n, 0) AS samples FROM site_dim s LEFT JOIN (
SELECT site_id, round(quantile_cont(abs_error_kwh, 0.5) + 1e-9, 2) AS p50, round(quantile_cont(abs_error_kwh, 0.95) + 1e-9, 2) AS p95, count(*) AS n FROM accuracy_days WHERE primary_entity = CASE WHEN site_id = 3 THEN 'met_z' WHEN site_id % 2 = 0 THEN 'met_a' ELSE 'met_b' END GROUP BY 1) q ON s.site_id = q.site_id""")
def _(t):
    cur = t.sites.select("site_id", F.when(F.col("site_id") == 3, "met_z").when(F.col("site_id") % 2 == 0, "met_a").otherwise("met_b").alias("primary_entity"))
    return X.forecast_uncertainty(history(t), cur)


@query("source_uncertainty", "D12", "site_id:i source:s p50:f p95:f samples:i", """
SELECT site_id, source, round(quantile_cont(abs_error, 0.5) + 1e-9, 2) AS p50, round(quantile_cont(abs_error, 0.95) + 1e-9, 2) AS p95, count(*) AS samples FROM current_sources GROUP BY 1, 2""")
def _(t):
    return X.source_uncertainty(X.source_breakdown(t.hourly_log), current_sources(t))


@query("period_accuracy", "W13", "site_id:i source:s days:i samples:i hourly_mae:f hourly_mape:f daily_mae:f daily_mape:f weather_mae:f weather_bias:f", """
SELECT site_id, source, days, n AS samples, round(h / n + 1e-9, 2) AS hourly_mae, round(h / a * 100 + 1e-9, 1) AS hourly_mape, round(d / n + 1e-9, 2) AS daily_mae, round(d / a * 100 + 1e-9, 1) AS daily_mape, round(w + 1e-9, 2) AS weather_mae, round(b + 1e-9, 2) AS weather_bias FROM (
SELECT site_id, source, days, count(*) AS n, sum(abs_error) AS h, sum(abs(error)) AS d, sum(actual) AS a, avg(abs(weather_error)) AS w, avg(weather_error) AS b FROM current_sources JOIN (SELECT unnest([7, 30]) AS days) ON local_date >= DATE '2024-01-30' - CAST(days AS INT) GROUP BY 1, 2, 3)""")
def _(t):
    return X.period_accuracy(X.source_breakdown(t.hourly_log), F.to_date(F.lit("2024-01-30")), current_sources(t))


@query("week_horizon_error", "W14", "site_id:i samples:i p50:f p95:f", """
WITH p AS (SELECT site_id, local_date AS made_on, expected_kwh * 1.5 AS x FROM daily_history WHERE local_date BETWEEN DATE '1998-06-30' - 90 AND DATE '1998-06-30' - 7),
w AS (SELECT p.site_id, p.made_on, count(*) AS n, abs(sum(d.kwh) - 7 * any_value(x)) AS err FROM p JOIN daily_history d ON d.site_id = p.site_id AND d.local_date BETWEEN p.made_on AND p.made_on + 6 GROUP BY 1, 2 HAVING count(*) = 7)
SELECT site_id, count(*) AS samples, round(quantile_cont(err, 0.5) + 1e-9, 2) AS p50, round(quantile_cont(err, 0.95) + 1e-9, 2) AS p95 FROM w GROUP BY 1""")
def _(t):
    plans = t.daily.select("site_id", F.col("local_date").alias("made_on"), F.array_repeat(F.col("expected_kwh") * 1.5, 7).alias("planned_kwh"))
    return X.week_horizon_error(plans, t.daily.select("site_id", "local_date", F.col("kwh").alias("actual_kwh")), F.to_date(F.lit("1998-06-30")))


# --- plans ------------------------------------------------------------------------

add_oracle_tables(
    plan_weather="""
WITH f AS (SELECT * FROM forecast_items WHERE source = 'primary' AND local_date >= DATE '2024-01-21'), l AS (SELECT site_id, ts, temp FROM hourly_log WHERE local_date < DATE '2024-01-21'),
u AS (SELECT * FROM l UNION ALL SELECT site_id, ts, temperature FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM u),
i AS (SELECT a.site_id, a.ts, sum(b.temp * exp(-(a.p - b.p) / 4.0)) / sum(exp(-(a.p - b.p) / 4.0)) AS it FROM o a JOIN o b ON a.site_id = b.site_id AND b.ts BETWEEN a.ts - INTERVAL 4 HOUR AND a.ts GROUP BY 1, 2),
c AS (SELECT f.*, it, coalesce(cloud_coverage, CASE condition WHEN 'rainy' THEN 95 WHEN 'sunny' THEN 0 WHEN 'partlycloudy' THEN 50 END, 50) AS cloud, wind_speed + greatest(0, wind_gust_speed - wind_speed) * 0.6 AS ew FROM f JOIN i ON f.site_id = i.site_id AND f.ts = i.ts),
s AS (SELECT c.*, x.sun_elev, x.sun_azim, CASE WHEN x.sun_elev <= 0 THEN 0.0 ELSE cos(radians(greatest(1.0, x.sun_elev))) * pow(0.7, 1 / sin(radians(greatest(1.0, x.sun_elev)))) END * (1 - 0.75 * pow(cloud / 100, 3.4)) AS sky
 FROM c JOIN site_solar x ON c.site_id = x.site_id AND c.ts = x.ts)
SELECT site_id, ts, local_date, hour, it AS temp, CAST(round_even(it, 0) AS INT) AS temp_key, ew AS effective_wind, CASE WHEN ew >= 10.8 THEN 'extreme_wind' WHEN ew >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket, false AS auxiliary_active,
 round(sky * greatest(0, -cos(radians(sun_azim))) + 1e-9, 5) AS pot_s, round(sky * greatest(0, sin(radians(sun_azim))) + 1e-9, 5) AS pot_e, round(sky * greatest(0, -sin(radians(sun_azim))) + 1e-9, 5) AS pot_w FROM s""",
    plan_modes="SELECT site_id, unit_id, ts, mode FROM hourly_unit",
    plan_scores=score_sql("plan_weather", "plan_modes"))


def plan_weather(t):
    return t.stored("plan_weather", lambda: X.forecast_weather(
        t.forecast.filter("source = 'primary' and local_date >= '2024-01-21'"), t.hourly_log.filter("local_date < '2024-01-21'"), t.sites))


@query("forecast_hours", "X1 S7", "site_id:i ts:t total_kwh:f base_kwh:f solar_kwh:f heating_kwh:f cooling_kwh:f", "SELECT * FROM plan_scores")
def _(t):
    return X.forecast_hours(plan_weather(t), t.hourly_unit, models(t))


@query("forecast_day", "X2", "site_id:i local_date:d hour:i how:s temperature:f wind_speed:f", """
WITH w AS (SELECT site_id, local_date, unnest(range(24)) AS hour FROM (SELECT DISTINCT site_id, local_date FROM forecast_items)),
i AS (SELECT * FROM forecast_items WHERE source = 'primary'), d AS (SELECT site_id, local_date, avg(temperature) AS temperature, avg(wind_speed) AS wind_speed FROM forecast_items GROUP BY 1, 2),
j AS (SELECT w.*, (SELECT max(hour) FROM i WHERE i.site_id = w.site_id AND i.local_date = w.local_date AND i.hour <= w.hour) AS prev, (SELECT min(hour) FROM i WHERE i.site_id = w.site_id AND i.local_date = w.local_date AND i.hour > w.hour) AS nxt FROM w)
SELECT j.site_id, j.local_date, j.hour, CASE WHEN prev = j.hour THEN 'item' WHEN coalesce(prev, nxt) IS NOT NULL THEN 'filled' ELSE 'daily' END AS how, coalesce(i.temperature, d.temperature) AS temperature, coalesce(i.wind_speed, d.wind_speed) AS wind_speed
FROM j LEFT JOIN i ON i.site_id = j.site_id AND i.local_date = j.local_date AND i.hour = coalesce(prev, nxt) JOIN d ON d.site_id = j.site_id AND d.local_date = j.local_date""")
def _(t):
    items = t.forecast.filter(F.col("source") == "primary")
    daily = t.forecast.groupBy("site_id", "local_date").agg(F.avg("temperature").alias("temperature"), F.avg("wind_speed").alias("wind_speed"))
    return X.forecast_day(items, t.forecast.select("site_id", "local_date").distinct(), daily)


@query("forecast_week", "X3 K4", "site_id:i days:i planned_days:i kwh:f temp:f coldest:d peak:d range_min:f range_max:f confidence:s", """
WITH w AS (SELECT site_id, k, DATE '1998-06-15' + CAST(k AS INT) AS local_date, DATE '1997-06-16' + CAST(k AS INT) AS ly FROM (SELECT DISTINCT site_id FROM daily_history), (SELECT unnest(range(7)) AS k)),
x AS (SELECT w.*, p.kwh IS NOT NULL AS ok, coalesce(p.kwh, l.kwh) AS kwh, CASE WHEN p.kwh IS NOT NULL THEN p.temp ELSE l.temp END AS temp FROM w LEFT JOIN (SELECT * FROM daily_history WHERE day(local_date) <> 18) p ON p.site_id = w.site_id AND p.local_date = w.local_date
 LEFT JOIN daily_history l ON l.site_id = w.site_id AND l.local_date = w.ly),
y AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY temp, k) AS rc, row_number() OVER (PARTITION BY site_id ORDER BY kwh DESC, k) AS rp FROM x WHERE kwh IS NOT NULL)
SELECT site_id, count(*) AS days, count(*) FILTER (ok) AS planned_days, sum(kwh) AS kwh, avg(temp) AS temp, min(local_date) FILTER (rc = 1) AS coldest, min(local_date) FILTER (rp = 1) AS peak, greatest(0, sum(kwh) - 3.5) AS range_min, sum(kwh) + 3.5 AS range_max,
 CASE WHEN site_id = 0 THEN 'low' ELSE 'high' END AS confidence FROM y GROUP BY 1""")
def _(t):
    plan = t.daily.filter(F.dayofmonth("local_date") != 18).select("site_id", "local_date", "kwh", "temp")
    u = t.daily.select("site_id").distinct().withColumns({"p50": F.lit(1.0), "p95": F.lit(3.5), "samples": F.when(F.col("site_id") == 0, 3).otherwise(20)})
    return X.forecast_week(plan, t.daily, u, F.to_date(F.lit("1998-06-15")))


@query("isolate_unit", "X4", "site_id:i ts:t isolated_kwh:f", """
SELECT h.site_id, h.ts, greatest(0, expected_kwh - o) AS isolated_kwh FROM hourly_log h JOIN (SELECT site_id, ts, coalesce(sum(actual_kwh) FILTER (unit_id <> 'unit_0'), 0) AS o FROM hourly_unit GROUP BY 1, 2) u ON h.site_id = u.site_id AND h.ts = u.ts""")
def _(t):
    return X.isolate_unit(t.hourly_unit.withColumnRenamed("actual_kwh", "net"), t.hourly_log.withColumnRenamed("expected_kwh", "total_kwh"), "unit_0")


add_oracle_tables(
    shadow_rows="""SELECT h.* REPLACE (f.temperature AS temp, CAST(round_even(f.temperature, 0) AS INT) AS temp_key, CASE WHEN f.wind_speed >= 10.8 THEN 'extreme_wind' WHEN f.wind_speed >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket, false AS auxiliary_active), f.source
 FROM score_hours h JOIN (SELECT site_id, ts, source, temperature, wind_speed FROM forecast_items UNION ALL SELECT p.site_id, p.ts, 'blended', p.temperature, p.wind_speed FROM forecast_items p WHERE source = 'primary') f ON h.site_id = f.site_id AND h.ts = f.ts""",
    shadow_scores=score_sql("shadow_rows", keys="site_id, ts, source"))


@query("shadow_forecasts", "X5", "site_id:i ts:t net_primary:f gross_primary:f net_secondary:f gross_secondary:f net_blended:f", """
SELECT site_id, ts, max(total_kwh) FILTER (source = 'primary') AS net_primary, max(total_kwh + solar_heating_kwh) FILTER (source = 'primary') AS gross_primary, max(total_kwh) FILTER (source = 'secondary') AS net_secondary,
 max(total_kwh + solar_heating_kwh) FILTER (source = 'secondary') AS gross_secondary, max(total_kwh) FILTER (source = 'blended') AS net_blended FROM shadow_scores GROUP BY 1, 2""")
def _(t):
    f = t.forecast.select("site_id", "ts", "source", "temperature", "wind_speed")
    f = f.unionByName(f.filter("source = 'primary'").withColumn("source", F.lit("blended")))
    h = score_hours(t).select("site_id", "ts", "pot_s", "pot_e", "pot_w").join(f, ["site_id", "ts"])
    w = M.with_cell(h.withColumnsRenamed({"temperature": "temp", "wind_speed": "effective_wind"}))
    return X.shadow_forecasts(w, t.hourly_unit, models(t))


@query("midnight_snapshot", "X6", "site_id:i local_date:d hour:i issued_at:t temperature:f", """
SELECT site_id, local_date, hour, issued_at, temperature FROM (SELECT *, rank() OVER (PARTITION BY site_id, local_date ORDER BY issued_at DESC) AS rk FROM (
SELECT *, CAST(local_date AS TIMESTAMP) - to_hours(CAST(CASE WHEN source = 'primary' THEN (site_id + day(local_date)) % 9 - 2 ELSE 3 END AS INT)) AS issued_at FROM forecast_items) WHERE issued_at <= CAST(local_date AS TIMESTAMP)) WHERE rk = 1""")
def _(t):
    # two overlapping plans a day; the primary one is sometimes issued after midnight, sometimes before the other
    back = F.when(F.col("source") == "primary", (F.col("site_id") + F.dayofmonth("local_date")) % 9 - 2).otherwise(3).cast("int")
    p = t.forecast.withColumn("issued_at", F.col("local_date").cast("timestamp_ntz") - F.make_dt_interval(hours=back))
    return X.midnight_snapshot(p.select("site_id", "local_date", "hour", "issued_at", "temperature", "source"))


@query("forecast_summary", "X7", "site_id:i local_date:d total_kwh:f peak_hour:i aux_hours:i top_units:s", """
WITH d AS (SELECT site_id, local_date, sum(expected_kwh) AS total_kwh, count(*) FILTER (aux_impact_kwh > 0) AS aux_hours FROM hourly_log GROUP BY 1, 2),
p AS (SELECT site_id, local_date, hour FROM (SELECT *, row_number() OVER (PARTITION BY site_id, local_date ORDER BY expected_kwh DESC, hour) AS rk FROM hourly_log) WHERE rk = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY site_id, local_date ORDER BY kwh DESC, unit_id) AS rk FROM (SELECT site_id, local_date, unit_id, round(sum(actual_kwh) + 1e-9, 1) AS kwh FROM hourly_unit GROUP BY 1, 2, 3) WHERE kwh > 0)
SELECT d.site_id, d.local_date, total_kwh, p.hour AS peak_hour, aux_hours, t AS top_units FROM d JOIN p ON d.site_id = p.site_id AND d.local_date = p.local_date JOIN (
SELECT site_id, local_date, string_agg(unit_id || ' ' || printf('%.1f', kwh), ', ' ORDER BY rk) AS t FROM u WHERE rk <= 3 GROUP BY 1, 2) q ON d.site_id = q.site_id AND d.local_date = q.local_date""")
def _(t):
    h = t.hourly_log.select("site_id", "ts", F.col("expected_kwh").alias("total_kwh"), F.col("aux_impact_kwh").alias("aux_kwh"))
    return X.forecast_summary(h, t.hourly_unit.withColumnRenamed("actual_kwh", "net"))


@query("daily_budget", "X8", "site_id:i local_date:d actual_so_far:f remaining:f budget_kwh:f gross_kwh:f", """
SELECT site_id, local_date, coalesce(sum(actual_kwh) FILTER (hour < 13), 0) AS actual_so_far, coalesce(sum(forecasted_kwh) FILTER (hour >= 13), 0) AS remaining,
 coalesce(sum(actual_kwh) FILTER (hour < 13), 0) + coalesce(sum(forecasted_kwh) FILTER (hour >= 13), 0) AS budget_kwh,
 coalesce(sum(actual_kwh + aux_impact_kwh - guest_impact_kwh) FILTER (hour < 13), 0) + coalesce(sum(forecasted_kwh * 1.1) FILTER (hour >= 13), 0) AS gross_kwh FROM hourly_log GROUP BY 1, 2""")
def _(t):
    plan = t.hourly_log.select("site_id", "local_date", "hour", F.col("forecasted_kwh").alias("kwh"), (F.col("forecasted_kwh") * 1.1).alias("kwh_gross"))
    return X.daily_budget(t.hourly_log, plan, 13)
