"""Window functions and time series."""

from pyspark.sql import functions as F

from warmgrid.operators import enrich as E
from warmgrid.operators import filters as P
from warmgrid.operators import timeseries as O
from warmgrid.plans.q_rollup import simple_base
from warmgrid.plans.registry import query
from warmgrid.sources.fixture_tables import add_oracle_tables


@query("meter_delta", "W1", "site_id:i unit_id:s event_id:i status:s delta_kwh:f", """
SELECT site_id, unit_id, event_id, status, CASE WHEN status = 'ok' THEN raw ELSE 0 END AS delta_kwh FROM (
SELECT *, CASE WHEN raw IS NULL THEN 'first' WHEN raw < 0 THEN 'reset' WHEN raw > 3 THEN 'spike' WHEN mode = 'dhw' THEN 'dhw' ELSE 'ok' END AS status FROM (
SELECT *, reading_kwh - lag(reading_kwh) OVER (PARTITION BY site_id, unit_id ORDER BY ts, event_id) AS raw FROM meter_rows))""")
def _(t):
    return O.meter_delta(t.meter)


add_oracle_tables(inertia_hours="""
SELECT a.site_id, a.ts, any_value(a.temp) AS temp, sum(b.temp * exp(-(a.p - b.p) / 4.0)) / sum(exp(-(a.p - b.p) / 4.0)) AS inertia_temp
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) a
JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) b
ON a.site_id = b.site_id AND b.ts BETWEEN a.ts - INTERVAL 4 HOUR AND a.ts GROUP BY 1, 2""")


@query("inertia", "W2", "site_id:i ts:t inertia_temp:f", "SELECT * FROM inertia_hours")
def _(t):
    return O.inertia(t.hourly_log)


@query("inertia_gaussian", "W3", "site_id:i ts:t gaussian_temp:f", """
SELECT site_id, ts, CASE WHEN p >= 6 THEN g END AS gaussian_temp FROM (
SELECT a.site_id, a.ts, a.p, sum(b.temp * exp(-power(5 - (a.p - b.p) - 2.5, 2) / 4.5)) / sum(exp(-power(5 - (a.p - b.p) - 2.5, 2) / 4.5)) AS g
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) a
JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) b
ON a.site_id = b.site_id AND b.p BETWEEN a.p - 5 AND a.p GROUP BY 1, 2, 3)""")
def _(t):
    return O.inertia_gaussian(t.hourly_log, 6)


@query("inertia_asymmetric", "W4", "site_id:i ts:t inertia_regime:s asymmetric_temp:f", """
WITH l AS (SELECT site_id, ts, temp AS x0, lag(temp,1) OVER w AS x1, lag(temp,2) OVER w AS x2, lag(temp,3) OVER w AS x3, lag(temp,4) OVER w AS x4
 FROM hourly_log WINDOW w AS (PARTITION BY site_id ORDER BY ts)),
r AS (SELECT *, CASE WHEN x0 < coalesce(x4,x3,x2,x1,x0) - 0.5 THEN 'shedding' WHEN x0 > coalesce(x4,x3,x2,x1,x0) + 0.5 THEN 'gaining' ELSE 'stable' END AS regime FROM l),
w AS (SELECT *, CASE regime WHEN 'shedding' THEN 0.2 WHEN 'gaining' THEN 0.5 ELSE 0.33 END AS w0, CASE regime WHEN 'shedding' THEN 0.3 WHEN 'gaining' THEN 0.5 ELSE 0.33 END AS w1,
 CASE regime WHEN 'shedding' THEN 0.3 WHEN 'gaining' THEN 0.0 ELSE 0.34 END AS w2, CASE regime WHEN 'shedding' THEN 0.2 ELSE 0.0 END AS w3 FROM r)
SELECT site_id, ts, regime AS inertia_regime, round((x0*w0 + coalesce(x1*w1,0) + coalesce(x2*w2,0) + coalesce(x3*w3,0)) /
 (w0 + CASE WHEN x1 IS NULL THEN 0 ELSE w1 END + CASE WHEN x2 IS NULL THEN 0 ELSE w2 END + CASE WHEN x3 IS NULL THEN 0 ELSE w3 END) + 1e-9, 2) AS asymmetric_temp FROM w""")
def _(t):
    return O.inertia_asymmetric(t.hourly_log)


@query("solar_battery", "W5", "site_id:i ts:t battery_state:f", """
SELECT a.site_id, a.ts, sum(b.solar_impact_kwh * 0.2 * power(0.8, a.p - b.p)) AS battery_state
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) a
JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) b
ON a.site_id = b.site_id AND b.p <= a.p GROUP BY 1, 2""")
def _(t):
    return O.solar_battery(t.hourly_log, 0.8)


@query("potential_battery", "W5", "site_id:i ts:t battery_s:f battery_e:f battery_w:f", """
WITH p AS (SELECT h.site_id, ts, row_number() OVER (PARTITION BY h.site_id ORDER BY ts) AS p,
  solar_vector_s / (0.3 + 0.7 * correction_percent / 100) AS ps,
  solar_vector_e / CASE WHEN screen_e THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS pe,
  solar_vector_w / CASE WHEN screen_w THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS pw
 FROM hourly_log h JOIN site_dim s ON h.site_id = s.site_id)
SELECT a.site_id, a.ts, sum(b.ps * 0.5 * power(0.5, a.p - b.p)) AS battery_s, sum(b.pe * 0.5 * power(0.5, a.p - b.p)) AS battery_e,
 sum(b.pw * 0.5 * power(0.5, a.p - b.p)) AS battery_w
FROM p a JOIN p b ON a.site_id = b.site_id AND b.p <= a.p AND b.p > a.p - 60 GROUP BY 1, 2""")
def _(t):
    return O.potential_battery(E.screen_potential(t.hourly_log, t.sites).select("site_id", "ts", "pot_s", "pot_e", "pot_w"))


@query("centered_average", "W6", "site_id:i ts:t centered_kwh:f", """
SELECT site_id, ts, (coalesce(lag(actual_kwh) OVER w, actual_kwh) + actual_kwh + coalesce(lead(actual_kwh) OVER w, actual_kwh)) / 3 AS centered_kwh
FROM hourly_log WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
def _(t):
    return O.centered_average(t.hourly_log)


@query("thermal_state", "W7", "site_id:i ts:t thermal_lag:f lag_status:s regime:s degrees_to_balance:f instant_tdd:f trend_rate:f trend:s", """
SELECT site_id, ts, lag AS thermal_lag, CASE WHEN lag > 0.5 THEN 'Shedding Heat' WHEN lag < -0.5 THEN 'Gaining Heat' ELSE 'Balanced' END AS lag_status,
 CASE WHEN round(abs(17 - it) + 1e-9, 6) > 4 THEN 'Cold' ELSE 'Mild' END AS regime, 17 - it AS degrees_to_balance, abs(17 - it) / 24 AS instant_tdd, rate AS trend_rate,
 CASE WHEN rate IS NULL THEN 'unknown' WHEN rate < -2 THEN 'falling_fast' WHEN rate < -0.5 THEN 'falling' WHEN rate > 2 THEN 'rising_fast' WHEN rate > 0.5 THEN 'rising' ELSE 'stable' END AS trend
FROM (SELECT site_id, ts, inertia_temp AS it, round(inertia_temp - temp + 1e-9, 6) AS lag,
 round(CASE WHEN lag(temp, 2) OVER w IS NOT NULL THEN (temp - lag(temp, 2) OVER w) / 2 ELSE temp - lag(temp) OVER w END + 1e-9, 6) AS rate
FROM inertia_hours WINDOW w AS (PARTITION BY site_id ORDER BY ts))""")
def _(t):
    return O.thermal_state(t.hourly_log)


@query("rolling_power", "W8", "site_id:i unit_id:s ts:t watts:i", """
SELECT u.site_id, u.unit_id, u.ts, round_even(round((u.actual_kwh + coalesce(l.actual_kwh, 0) * 0.75) * 1000 + 1e-9, 6), 0) AS watts
FROM hourly_unit u JOIN (SELECT site_id, ts, lag(ts) OVER (PARTITION BY site_id ORDER BY ts) AS pts FROM hourly_log) p ON u.site_id = p.site_id AND u.ts = p.ts
LEFT JOIN hourly_unit l ON l.site_id = u.site_id AND l.unit_id = u.unit_id AND l.ts = p.pts""")
def _(t):
    return O.rolling_power(t.hourly_unit, t.hourly_log, 0.25)


@query("rolling_efficiency", "W9", "site_id:i local_date:d efficiency:f", """
WITH d AS (SELECT site_id, local_date, tdd / 50 AS tdd, kwh, temp, expected_kwh / 24 AS rate FROM daily_history),
j AS (SELECT d.*, CASE WHEN d.tdd < 0.5 AND y.tdd > 0.01 THEN least(0.5 - d.tdd, y.tdd) ELSE 0 END AS take, y.tdd AS yt, y.kwh AS yk
 FROM d LEFT JOIN d y ON y.site_id = d.site_id AND y.local_date = d.local_date - 1),
k AS (SELECT *, tdd + take AS tt, kwh + CASE WHEN take > 0 THEN yk * take / yt ELSE 0 END AS kk, abs(17 - temp) / 24 AS th FROM j),
m AS (SELECT *, CASE WHEN tt > 0.001 THEN kk / tt END AS act, CASE WHEN th > 0.05 THEN rate / th END AS mod, power(tt / 0.1, 2) AS conf FROM k)
SELECT site_id, local_date, round(CASE WHEN tt >= 0.1 THEN act WHEN mod IS NULL THEN CASE WHEN tt > 0.05 THEN act END WHEN act IS NULL THEN mod
 ELSE mod * (1 - conf) + act * conf END + 1e-9, 3) AS efficiency FROM m""")
def _(t):
    d = t.daily.select("site_id", "local_date", (F.col("tdd") / 50).alias("tdd"), "kwh", "temp", (F.col("expected_kwh") / 24).alias("model_rate"))
    return O.rolling_efficiency(d)


@query("monotonicity", "W10", "site_id:i wind_bucket:s from_temp:i to_temp:i kwh_warm:f kwh_cold:f delta:f", """
SELECT site_id, wind_bucket, temp_key AS from_temp, nt AS to_temp, kwh AS kwh_warm, nk AS kwh_cold, kwh - nk AS delta FROM (
SELECT *, lead(temp_key) OVER w AS nt, lead(kwh) OVER w AS nk FROM simple_base WINDOW w AS (PARTITION BY site_id, wind_bucket ORDER BY temp_key DESC)) WHERE nk < kwh""")
def _(t):
    return O.monotonicity(simple_base(t))


@query("gap_fill_hour", "W11", "site_id:i ts:t missing_minutes:i gap_kwh:f", """
SELECT s.site_id, s.ts, 59 - lm AS missing_minutes, expected_kwh * (59 - lm) / 60 AS gap_kwh
FROM (SELECT site_id, hr AS ts, max(minute(ts)) AS lm FROM sample_rows GROUP BY 1, 2) s JOIN hourly_log h ON s.site_id = h.site_id AND s.ts = h.ts""")
def _(t):
    return O.gap_fill_hour(t.samples, t.hourly_log.select("site_id", "ts", F.col("expected_kwh").alias("rate")))


@query("load_trend", "W12", "site_id:i ts:t past:f future:f load_trend:s", """
WITH x AS (SELECT a.site_id, a.ts, avg(b.expected_kwh) AS past FROM hourly_log a JOIN hourly_log b ON a.site_id = b.site_id AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts GROUP BY 1, 2),
f AS (SELECT a.site_id, a.ts, avg(b.forecasted_kwh) AS future FROM hourly_log a JOIN hourly_log b ON a.site_id = b.site_id AND b.ts BETWEEN a.ts + INTERVAL 1 HOUR AND a.ts + INTERVAL 3 HOUR GROUP BY 1, 2),
p AS (SELECT x.*, future, round((future - past) / past * 100 + 1e-9, 6) AS pct FROM x LEFT JOIN f ON x.site_id = f.site_id AND x.ts = f.ts)
SELECT *, CASE WHEN future IS NULL THEN 'Unknown' WHEN past < 0.1 THEN CASE WHEN future > 0.5 THEN 'Increasing (Fast)' WHEN future > 0.1 THEN 'Increasing' ELSE 'Stable' END
 WHEN pct > 20 THEN 'Increasing (Fast)' WHEN pct > 5 THEN 'Increasing' WHEN pct < -20 THEN 'Easing (Fast)' WHEN pct < -5 THEN 'Easing' ELSE 'Stable' END AS load_trend FROM p""")
def _(t):
    return O.load_trend(t.hourly_log, t.hourly_log.select("site_id", "ts", F.col("forecasted_kwh").alias("kwh")))


@query("paired_loss", "W15", "site_id:i n_paired_hours:i mean_improvement:f lag1_autocorrelation:f std_error:f t_statistic:f threshold:f significant:b", """
WITH r AS (SELECT site_id, ts, power(actual_kwh - expected_kwh, 2) - power(actual_kwh - forecasted_kwh_primary, 2) AS d FROM hourly_log),
m AS (SELECT *, avg(d) OVER (PARTITION BY site_id) AS mu, lead(d) OVER (PARTITION BY site_id ORDER BY ts) AS nx FROM r),
a AS (SELECT site_id, count(*) AS n, avg(d) AS mi, sum((d - mu) * (d - mu)) / (count(*) - 1) AS v, sum((d - mu) * (nx - mu)) / (count(*) - 1) AS cv FROM m GROUP BY 1),
b AS (SELECT *, CASE WHEN n >= 10 AND v > 1e-12 THEN greatest(0, least(0.95, cv / v)) END AS r1 FROM a),
c AS (SELECT *, CASE WHEN n >= 10 AND v > 1e-12 THEN sqrt(v / n) * sqrt((1 + r1) / (1 - r1)) END AS se FROM b)
SELECT site_id, n AS n_paired_hours, mi AS mean_improvement, r1 AS lag1_autocorrelation, se AS std_error, mi / se AS t_statistic, 2 + sqrt(2 * ln(10)) AS threshold,
 coalesce(mi / se >= 2 + sqrt(2 * ln(10)), false) AS significant FROM c""")
def _(t):
    r = t.hourly_log.select("site_id", "ts", (F.col("actual_kwh") - F.col("expected_kwh")).alias("base_res"),
                            (F.col("actual_kwh") - F.col("forecasted_kwh_primary")).alias("cand_res"))
    return O.paired_loss(r, ["site_id"], n_candidates=10)


@query("stable_tdd_today", "W16", "site_id:i local_date:d hours:i temp_forecast:f tdd_stable:f", """
SELECT site_id, local_date, count(*) AS hours, round(avg(t) + 1e-9, 1) AS temp_forecast, round(avg(abs(17 - t)) + 1e-9, 1) AS tdd_stable FROM (
SELECT coalesce(l.site_id, f.site_id) AS site_id, coalesce(l.local_date, f.local_date) AS local_date, coalesce(l.temp, f.temperature) AS t
FROM (SELECT * FROM hourly_log WHERE hour < 14) l FULL JOIN (SELECT * FROM forecast_items WHERE source = 'primary') f
ON l.site_id = f.site_id AND l.local_date = f.local_date AND l.hour = f.hour) GROUP BY 1, 2""")
def _(t):
    return O.stable_tdd_today(t.hourly_log.filter(F.col("hour") < 14), t.forecast.filter(F.col("source") == "primary"))


@query("redistribute_solar", "W17", "site_id:i ts:t redistributed_kwh:f", """
WITH h AS (SELECT site_id, ts, solar_impact_kwh AS x, sun_elev < 30 AND solar_factor > 0.05 AS ok FROM hourly_log),
z AS (SELECT exp(-0.5) + exp(-1.0) + exp(-1.5) AS z)
SELECT h.site_id, h.ts, CASE WHEN h.ok THEN h.x * 0.6 ELSE h.x END + coalesce(tl, 0) AS redistributed_kwh FROM h LEFT JOIN (
 SELECT a.site_id, a.ts, sum(b.x * 0.4 * exp(-date_diff('hour', b.ts, a.ts) / 2.0) / z.z) AS tl FROM h a JOIN h b ON a.site_id = b.site_id AND b.ok
  AND b.ts BETWEEN a.ts - INTERVAL 3 HOUR AND a.ts - INTERVAL 1 HOUR JOIN z ON true GROUP BY 1, 2) q ON h.site_id = q.site_id AND h.ts = q.ts""")
def _(t):
    return O.redistribute_solar(t.hourly_log, "solar_impact_kwh", alpha=0.4)


@query("attenuate_hotspot", "W18", "site_id:i unit_id:s ts:t attenuated_kwh:f", """
SELECT u.site_id, u.unit_id, u.ts, h.solar_impact_kwh * CASE WHEN sun_elev > 30 AND correction_percent < 80 AND screen_affected THEN 0.75 ELSE 1 END AS attenuated_kwh
FROM hourly_unit u JOIN hourly_log h ON u.site_id = h.site_id AND u.ts = h.ts JOIN unit_dim d ON u.site_id = d.site_id AND u.unit_id = d.unit_id""")
def _(t):
    h = t.hourly_log.select("site_id", "ts", "sun_elev", "correction_percent", "solar_impact_kwh")
    d = t.units.select("site_id", "unit_id", "screen_affected")
    j = t.hourly_unit.join(h, ["site_id", "ts"]).join(d, ["site_id", "unit_id"])
    return O.attenuate_hotspot(j, "solar_impact_kwh", 0.25)


# --- scalar enrichments -------------------------------------------------------


@query("solar_geometry", "F1 F2 F3", "site_id:i ts:t sun_elev:f sun_azim:f solar_factor:f solar_vector_s:f solar_vector_e:f solar_vector_w:f", """
SELECT site_id, ts, sun_elev, sun_azim, solar_factor, solar_vector_s, solar_vector_e, solar_vector_w FROM site_solar""")
def _(t):
    return E.enrich_solar_factor(E.enrich_solar_geometry(t.site_inputs.drop("lat", "lon"), t.sites))


@query("irradiance", "F4", "site_id:i ts:t dni:f dhi:f dni_dhi_source:s", "SELECT site_id, ts, dni, dhi, dni_dhi_source FROM site_weather")
def _(t):
    return t.site_weather


POTENTIAL_SQL = """
SELECT u.site_id, u.unit_id, h.ts, h.local_date, CASE WHEN lo > sun_elev OR hi < sun_elev OR sun_elev <= 0 THEN 0 ELSE dni * cos(radians(sun_elev)) * greatest(0, -cos(radians(sun_azim))) * ts_ END AS p4_s,
 CASE WHEN sun_elev <= 0 THEN 0 ELSE dni * cos(radians(sun_elev)) * greatest(0, sin(radians(sun_azim))) * te END AS p4_e,
 CASE WHEN sun_elev <= 0 THEN 0 ELSE dni * cos(radians(sun_elev)) * greatest(0, -sin(radians(sun_azim))) * tw END AS p4_w,
 CASE WHEN sun_elev <= 0 THEN 0 ELSE dhi * 0.5 * (ts_ + te + tw) / 3 END AS p4_d
FROM hourly_unit u JOIN (SELECT h.*, 0.3 + 0.7 * correction_percent / 100 AS ts_, CASE WHEN screen_e THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS te,
  CASE WHEN screen_w THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS tw FROM hourly_log h JOIN site_dim s ON h.site_id = s.site_id) h
ON u.site_id = h.site_id AND u.ts = h.ts
JOIN (SELECT site_id, unit_id, CASE WHEN unit_id = 'unit_0' THEN 10.0 END AS lo, CASE WHEN unit_id <> 'unit_3' THEN 22.0 END AS hi FROM unit_dim) g
ON u.site_id = g.site_id AND u.unit_id = g.unit_id"""
add_oracle_tables(unit_potential_4d=POTENTIAL_SQL)


def unit_sun(t):
    """Unit-hours with sun position, irradiance and facade transmittance."""
    h = E.facade_transmittance(t.hourly_log, t.sites).select(
        "site_id", "ts", "temp", "wind_bucket", "sun_elev", "sun_azim", "dni", "dhi", "t_s", "t_e", "t_w", "solar_factor", "solar_vector_s", "solar_vector_e",
        "solar_vector_w", "auxiliary_active", "correction_percent", "dni_dhi_source", "cloud_coverage")
    return t.hourly_unit.join(h, ["site_id", "ts"])


def south_gates(t):
    return t.units.select("site_id", "unit_id", F.lit("s").alias("facade"), F.when(F.col("unit_id") == "unit_0", 10.0).alias("low"),
                          F.when(F.col("unit_id") != "unit_3", 22.0).alias("high"))


@query("potential_4d", "F5", "site_id:i unit_id:s ts:t p4_s:f p4_e:f p4_w:f p4_d:f", "SELECT * FROM unit_potential_4d")
def _(t):
    return E.enrich_potential_4d(unit_sun(t), south_gates(t))


@query("screen_potential", "F6", "site_id:i ts:t t_s:f t_e:f t_w:f pot_s:f pot_e:f pot_w:f", """
SELECT site_id, ts, t_s, t_e, t_w, solar_vector_s / t_s AS pot_s, solar_vector_e / t_e AS pot_e, solar_vector_w / t_w AS pot_w FROM (
SELECT h.*, 0.3 + 0.7 * correction_percent / 100 AS t_s, CASE WHEN screen_e THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS t_e,
 CASE WHEN screen_w THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS t_w FROM hourly_log h JOIN site_dim s ON h.site_id = s.site_id)""")
def _(t):
    return E.screen_potential(t.hourly_log, t.sites)


@query("saturate", "F7", "site_id:i unit_id:s ts:t applied:f wasted:f net:f", """
SELECT u.site_id, u.unit_id, u.ts, round(CASE WHEN heat THEN least(x, greatest(0, d)) WHEN cool THEN x ELSE 0 END + 1e-9, 3) AS applied,
 round(CASE WHEN heat THEN x - least(x, greatest(0, d)) ELSE 0 END + 1e-9, 3) AS wasted,
 round(CASE WHEN heat THEN greatest(0, d - least(x, greatest(0, d))) WHEN cool THEN d + x ELSE d END + 1e-9, 3) AS net
FROM (SELECT u.*, expected_base_kwh - 0.1 AS d, solar_impact_kwh * 2 AS x, mode LIKE '%heating' AS heat, mode LIKE '%cooling' AS cool
 FROM hourly_unit u JOIN (SELECT site_id AS s2, ts AS t2, solar_impact_kwh FROM hourly_log) ON site_id = s2 AND ts = t2) u""")
def _(t):
    h = t.hourly_log.select("site_id", "ts", (F.col("solar_impact_kwh") * 2).alias("solar"))
    return E.saturate_units(t.hourly_unit.join(h, ["site_id", "ts"]).withColumn("demand", F.col("expected_base_kwh") - 0.1))


def cop_params(t):
    return t.sites.select("site_id", F.lit(0.42).alias("eta_carnot"), (F.lit(35.0) + F.col("site_id") % 3).alias("lwt"), F.lit(0.85).alias("f_defrost"),
                          F.lit(7.0).alias("defrost_temp_threshold"), F.lit(70.0).alias("defrost_rh_threshold"))


add_oracle_tables(cop_hours="""
SELECT h.*, greatest(1, least(10, 0.42 * (35 + site_id % 3 + 273.15) / (35 + site_id % 3 - temp) * CASE WHEN temp < 7 AND humidity > 70 THEN 0.85 ELSE 1 END)) AS cop FROM hourly_log h""")


@query("cop_at_conditions", "F8", "site_id:i ts:t cop:f", "SELECT site_id, ts, cop FROM cop_hours")
def _(t):
    return E.cop_hours(t.hourly_log, cop_params(t))


@query("cloud_from_condition", "F9", "site_id:i ts:t source:s cloud_used:f", """
SELECT site_id, ts, source, coalesce(cloud_coverage, CASE condition WHEN 'rainy' THEN 95 WHEN 'sunny' THEN 0 WHEN 'partlycloudy' THEN 50 END, 50) AS cloud_used FROM forecast_items""")
def _(t):
    return E.fill_cloud(t.forecast)


SNR_SQL = """
SELECT h.*, CASE WHEN ns > 0 AND nu > 0 THEN greatest(0.1, 1 - 3 * solar_factor) * greatest(0, nu - ns) / nu ELSE greatest(0.1, 1 - 3 * solar_factor) END AS snr_weight
FROM hourly_log h JOIN (SELECT site_id, ts, count(*) FILTER (sd) AS ns, CASE WHEN count(*) FILTER (mode = 'heating' AND actual_kwh > 0) > 0
  THEN count(*) FILTER (mode = 'heating' AND actual_kwh > 0) ELSE count(*) END AS nu FROM (
 SELECT u.*, sqrt(h.solar_vector_s^2 + h.solar_vector_e^2 + h.solar_vector_w^2) >= 0.3 AND u.mode = 'heating' AND d.solar_affected
  AND ((expected_base_kwh > 0 AND u.actual_kwh < 0.03) OR (expected_base_kwh >= min_base AND u.actual_kwh < 0.15 * expected_base_kwh)) AS sd
 FROM hourly_unit u JOIN hourly_log h ON u.site_id = h.site_id AND u.ts = h.ts JOIN unit_dim d ON u.site_id = d.site_id AND u.unit_id = d.unit_id) GROUP BY 1, 2) q
ON h.site_id = q.site_id AND h.ts = q.ts"""
add_oracle_tables(snr_hours=SNR_SQL)


def snr_hours(t):
    return E.snr_weights(t.hourly_log, P.shutdown_flags(t.hourly_unit, t.hourly_log, t.units))


@query("snr_weight", "F10", "site_id:i ts:t snr_weight:f", "SELECT site_id, ts, snr_weight FROM snr_hours")
def _(t):
    return snr_hours(t)


@query("screen_recommendation", "F11", "site_id:i ts:t state:s", """
SELECT site_id, ts, CASE WHEN temp < 17 THEN CASE WHEN solar_factor > 0.1 THEN 'maximize_solar' ELSE 'insulate' END WHEN solar_factor > 0.1 THEN 'mitigate_solar' ELSE 'none' END AS state FROM hourly_log""")
def _(t):
    return E.screen_recommendation(t.hourly_log)


@query("calendar_parts", "F12", "site_id:i ts:t iso_year:i iso_week:i iso_weekday:i day_key:s local_ts:t utc_back:t", """
SELECT site_id, ts, isoyear(ts) AS iso_year, weekofyear(ts) AS iso_week, isodow(ts) AS iso_weekday, strftime(ts, '%Y-%m-%d') AS day_key,
 ts + INTERVAL 1 HOUR AS local_ts, ts AS utc_back FROM hourly_log""")
def _(t):
    return E.calendar_parts(t.hourly_log.select("site_id", "ts"), "Europe/Oslo")


@query("average_day_solar", "F14", "site_id:i local_date:d solar_factor:f solar_s:f solar_e:f solar_w:f", """
WITH h AS (SELECT *, 2 * pi() / 365 * (dayofyear(local_date) - 1 + (hour + 0.5 - 12) / 24) AS g FROM (
  SELECT site_id, local_date, 40.0 + site_id % 5 AS lat, unnest(range(24)) AS hour FROM (SELECT DISTINCT site_id, local_date FROM daily_history))),
d AS (SELECT *, radians(lat) AS la, radians((hour * 60 + 30 + 229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g))) / 4 - 180) AS ha,
 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl FROM h),
p AS (SELECT *, round(degrees(asin(sin(la) * sin(decl) + cos(la) * cos(decl) * cos(ha))) + 1e-9, 4) AS el,
 round(degrees(atan2(sin(ha), cos(ha) * sin(la) - tan(decl) * cos(la))) + 180 + 1e-9, 4) AS az FROM d),
s AS (SELECT *, CASE WHEN el <= 0 THEN 0 ELSE cos(radians(greatest(1, el))) * power(0.7, 1 / sin(radians(greatest(1, el)))) END * (1 - 0.75 * power(0.5, 3.4)) AS sky, abs(az - 180) AS dl FROM p)
SELECT site_id, local_date, avg(round(sky * CASE WHEN dl <= 75 THEN cos(dl / 75 * pi() / 2) * 0.9 + 0.1 WHEN dl <= 90 THEN 0.1 ELSE 0.05 END + 1e-9, 5)) AS solar_factor,
 avg(round(sky * greatest(0, -cos(radians(az))) + 1e-9, 5)) AS solar_s, avg(round(sky * greatest(0, sin(radians(az))) + 1e-9, 5)) AS solar_e,
 avg(round(sky * greatest(0, -sin(radians(az))) + 1e-9, 5)) AS solar_w FROM s GROUP BY 1, 2""")
def _(t):
    days = t.daily.select("site_id", "local_date").withColumns({"lat": 40.0 + F.col("site_id") % 5, "lon": F.lit(0.0)})
    return E.average_day_solar(days)
