"""Diagnostic reports."""

from pyspark.sql import functions as F

from warmgrid.operators import calibrate as C
from warmgrid.operators import enrich as E
from warmgrid.operators import reports as D
from warmgrid.operators import score as M
from warmgrid.plans.q_calibrate import diagnose_samples, fit_hours, prior_coeffs
from warmgrid.plans.q_rollup import simple_base
from warmgrid.plans.q_score import hours_4d, models, score_hours
from warmgrid.plans.q_timeseries import snr_hours
from warmgrid.plans.registry import query
from warmgrid.plans.q_learn import fold_sql
from warmgrid.sources.fixture_tables import add_oracle_tables

add_oracle_tables(
    inversions="""SELECT site_id, wind_bucket, temp_key, kwh - nk AS delta FROM (SELECT *, lead(kwh) OVER (PARTITION BY site_id, wind_bucket ORDER BY temp_key DESC) AS nk FROM simple_base) WHERE nk < kwh""",
    solar_corr="""SELECT site_id, count(*) AS hours, corr(solar_factor, greatest(0, actual_kwh - excluded_kwh) - expected_kwh) AS corr, avg(solar_factor) AS avg_solar, avg(greatest(0, actual_kwh - excluded_kwh) - expected_kwh) AS avg_error
 FROM hourly_log WHERE solar_factor > 0.01 GROUP BY 1 HAVING count(*) >= 10""",
    contaminated="""SELECT site_id, local_date, sum(actual_kwh) AS k FROM hourly_unit WHERE mode IN ('off','dhw','guest_heating','guest_cooling') GROUP BY 1, 2""")


@query("solar_error_correlation", "D1", "site_id:i hours:i corr:f avg_solar:f avg_error:f verdict:s", """
SELECT *, CASE WHEN round(corr + 1e-9, 3) > 0.15 THEN 'under_subtracting' WHEN round(corr + 1e-9, 3) < -0.15 THEN 'over_subtracting' ELSE 'calibrated' END AS verdict FROM solar_corr""")
def _(t):
    return D.solar_error_correlation(t.hourly_log)


@query("report_model", "D1", "site_id:i section:s key:s metric:s value:f", """
SELECT site_id, 'monotonicity' AS section, wind_bucket AS key, 'inversions' AS metric, CAST(count(*) AS DOUBLE) AS value FROM inversions GROUP BY 1, 3
UNION ALL SELECT site_id, 'monotonicity', wind_bucket, 'worst_delta', max(delta) FROM inversions GROUP BY 1, 3
UNION ALL SELECT site_id, 'coverage', wind_bucket, 'cells', count(*) FROM simple_base GROUP BY 1, 3 UNION ALL SELECT site_id, 'coverage', wind_bucket, 'temp_min', min(temp_key) FROM simple_base GROUP BY 1, 3
UNION ALL SELECT site_id, 'coverage', wind_bucket, 'temp_max', max(temp_key) FROM simple_base GROUP BY 1, 3 UNION ALL SELECT site_id, 'coverage', wind_bucket, 'pending', count(*) FILTER (n < 4) FROM simple_base GROUP BY 1, 3
UNION ALL SELECT site_id, 'mode_contamination', 'all', 'days', count(*) FROM contaminated GROUP BY 1 UNION ALL SELECT site_id, 'mode_contamination', 'all', 'excluded_kwh', sum(k) FROM contaminated GROUP BY 1
UNION ALL SELECT site_id, 'solar_correlation', v, unnest(['hours', 'correlation', 'avg_error_kwh']), unnest([CAST(hours AS DOUBLE), corr, avg_error]) FROM (SELECT *, CASE WHEN round(corr + 1e-9, 3) > 0.15 THEN 'under_subtracting' WHEN round(corr + 1e-9, 3) < -0.15 THEN 'over_subtracting' ELSE 'calibrated' END AS v FROM solar_corr)
UNION ALL SELECT site_id, 'base_health', verdict, 'cells', count(*) FROM dark_cells GROUP BY 1, 3""")
def _(t):
    return D.report_model(t.hourly_log, t.hourly_unit, simple_base(t))


add_oracle_tables(diag_rows="""SELECT l.*, 0.5 * ps + 0.3 * pe + 0.2 * pw AS modeled, impact - (0.5 * ps + 0.3 * pe + 0.2 * pw) AS residual FROM fit_labels l WHERE drop_reason IS NULL""")


def residual_rows(t):
    d = diagnose_samples(t)
    return d.withColumn("residual", F.col("impact") - (0.5 * F.col("ps") + 0.3 * F.col("pe") + 0.2 * F.col("pw")))


@query("report_solar", "D2", "site_id:i unit_id:s regime:s section:s key:s n:i bias:f implied:f modeled:f flag:s", """
WITH x AS (SELECT *, unnest(['all','time','screen','temp','saturation','shutdown']) AS section, unnest(['all', CASE WHEN hour < 12 THEN 'morning' ELSE 'afternoon' END, CASE WHEN correction_percent >= 80 THEN 'open' WHEN correction_percent < 20 THEN 'closed' ELSE 'partial' END,
 CAST(CAST(floor(temp / 5) * 5 AS INT) AS VARCHAR) || 'C', CASE WHEN saturated THEN 'saturated' ELSE 'free' END, CASE WHEN is_shutdown THEN 'shutdown' ELSE 'running' END]) AS key FROM diag_rows)
SELECT site_id, unit_id, regime, section, key, count(*) AS n, avg(impact - modeled) AS bias, avg(impact) AS implied, avg(modeled) AS modeled,
 CASE WHEN count(*) < 5 THEN 'thin' WHEN abs(round(avg(impact - modeled) + 1e-9, 9)) > 0.25 THEN 'biased' ELSE 'ok' END AS flag FROM x GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return D.report_solar(diagnose_samples(t), prior_coeffs(t))


@query("thermal_sensitivity", "D2", "site_id:i unit_id:s regime:s n:i slope:f corr:f", """
SELECT site_id, unit_id, regime, count(*) AS n, CASE WHEN var_pop(temp) > 1e-12 THEN covar_pop(impact, temp) / var_pop(temp) END AS slope, CASE WHEN stddev_pop(temp) > 1e-9 AND stddev_pop(impact) > 1e-9 THEN corr(impact, temp) END AS corr FROM diag_rows GROUP BY 1, 2, 3""")
def _(t):
    return D.thermal_sensitivity(diagnose_samples(t))


@query("elevation_residuals", "D3", "site_id:i unit_id:s band:s saturated:b n:i median_residual:f mad_residual:f mean_potential:f normalised:f", """
WITH b AS (SELECT *, CASE WHEN sun_elev < 15 THEN '0-15' WHEN sun_elev < 30 THEN '15-30' WHEN sun_elev < 45 THEN '30-45' ELSE '45-60' END AS band, sqrt(ps^2 + pe^2 + pw^2) AS mag FROM diag_rows WHERE sun_elev >= 0),
m AS (SELECT site_id, unit_id, band, saturated, count(*) AS n, median(residual) AS med, avg(mag) AS mp FROM b GROUP BY 1, 2, 3, 4),
d AS (SELECT b.site_id, b.unit_id, b.band, b.saturated, median(abs(residual - med)) AS mad FROM b JOIN m ON b.site_id = m.site_id AND b.unit_id = m.unit_id AND b.band = m.band AND b.saturated = m.saturated GROUP BY 1, 2, 3, 4)
SELECT m.site_id, m.unit_id, m.band, m.saturated, n, CASE WHEN n >= 5 THEN med END AS median_residual, CASE WHEN n >= 5 THEN mad END AS mad_residual, CASE WHEN n >= 5 THEN mp END AS mean_potential, CASE WHEN n >= 5 AND mp > 1e-3 THEN med / mp END AS normalised
FROM m JOIN d ON m.site_id = d.site_id AND m.unit_id = d.unit_id AND m.band = d.band AND m.saturated = d.saturated""")
def _(t):
    return D.elevation_residuals(residual_rows(t))


@query("hour_of_day_residuals", "D4", "site_id:i unit_id:s hour:i n:i mean_residual:f", """
SELECT site_id, unit_id, hour, count(*) AS n, avg(residual) AS mean_residual FROM diag_rows WHERE hour BETWEEN 6 AND 18 GROUP BY 1, 2, 3""")
def _(t):
    return D.hour_of_day_residuals(residual_rows(t))


@query("signal_agreement", "D5", "site_id:i cloud_regime:s n:i corr:f rmse:f bias:f", """
WITH p AS (SELECT *, 1361 * sin(radians(sun_elev)) * pow(0.7, 1 / greatest(sin(radians(sun_elev)), 0.087)) AS clear FROM hourly_log WHERE ghi_in IS NOT NULL AND sun_elev >= 5 AND solar_factor > 0.05),
q AS (SELECT site_id, 1 - 0.75 * pow(cloud_coverage / 100, 3.4) AS x, greatest(0, least(1.5, ghi_in / clear)) AS y, unnest(['all', CASE WHEN cloud_coverage < 30 THEN 'clear' WHEN cloud_coverage < 70 THEN 'broken' ELSE 'overcast' END]) AS cloud_regime FROM p WHERE clear >= 1)
SELECT site_id, cloud_regime, count(*) AS n, CASE WHEN count(*) >= 5 AND stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN corr(x, y) END AS corr, CASE WHEN count(*) >= 5 THEN sqrt(avg(power(x - y, 2))) END AS rmse, CASE WHEN count(*) >= 5 THEN avg(x) - avg(y) END AS bias FROM q GROUP BY 1, 2""")
def _(t):
    return D.signal_agreement(t.hourly_log)


@query("shadow_regression", "D6 A18", "site_id:i unit_id:s regime:s n:i std_3d:f std_4d:f improvement_pct:f")
def _(t):
    d = E.enrich_potential_4d(fit_hours(t)).withColumns({f"p4_{f}": F.col(f"p4_{f}") / 1000 for f in "sewd"})
    return D.shadow_regression(C.solar_samples(d, "diagnose").filter("drop_reason is null"))


add_oracle_tables(jitter="""SELECT site_id, temp_key, wind_bucket, st.b3 AS b3, st.b4 AS b4, st.n AS n, sqrt(st.q3 / st.n) AS step_3d_rms, sqrt(st.q4 / st.n) AS step_4d_rms FROM (""" + fold_sql(
    """SELECT h.site_id, h.ts, CAST(round_even(h.temp, 0) AS INT) AS temp_key, h.wind_bucket, coalesce(b.kwh, 0) AS seed, 0.01 * h.snr_weight AS r, greatest(0, actual_kwh + solar_normalization_delta) AS y3, greatest(0, actual_kwh + solar_normalization_delta_4d) AS y4
 FROM snr_hours h LEFT JOIN simple_base b ON b.site_id = h.site_id AND b.temp_key = CAST(round_even(h.temp, 0) AS INT) AND b.wind_bucket = h.wind_bucket WHERE solar_normalization_delta_4d IS NOT NULL AND NOT auxiliary_active""",
    "site_id, temp_key, wind_bucket", "ts", {x: f"CAST({x if x in ('seed', 'r', 'y3', 'y4') else 0} AS {'BIGINT' if x == 'n' else 'DOUBLE'})" for x in ("b3", "b4", "q3", "q4", "seed", "r", "y3", "y4", "n")},
    {"n": "a.n + 1", **{f"b{k}": f"CASE WHEN a.n = 0 THEN x.seed ELSE a.b{k} END + x.r * (x.y{k} - CASE WHEN a.n = 0 THEN x.seed ELSE a.b{k} END)" for k in (3, 4)},
     **{f"q{k}": f"a.q{k} + power(x.r * (x.y{k} - CASE WHEN a.n = 0 THEN x.seed ELSE a.b{k} END), 2)" for k in (3, 4)}}) + ")")


@query("shadow_base_jitter", "D7", "site_id:i temp_key:i wind_bucket:s n:i b3:f b4:f drift_kwh:f step_3d_rms:f step_4d_rms:f", "SELECT *, b4 - b3 AS drift_kwh FROM jitter")
def _(t):
    return D.shadow_base_jitter(snr_hours(t), simple_base(t))


@query("jitter_headline", "D7", "site_id:i cells:i rms_3d:f rms_4d:f", """
SELECT site_id, count(*) AS cells, sqrt(avg(step_3d_rms * step_3d_rms)) AS rms_3d, sqrt(avg(step_4d_rms * step_4d_rms)) AS rms_4d FROM jitter WHERE temp_key BETWEEN 7 AND 14 AND wind_bucket = 'normal' GROUP BY 1""")
def _(t):
    return D.jitter_headline(D.shadow_base_jitter(snr_hours(t), simple_base(t)))


@query("prediction_divergence", "D8", "site_id:i cloud_regime:s n:i mean_delta:f median_abs_delta:f p95_abs_delta:f mean_solar_delta:f mean_base:f", """
SELECT h.site_id, CASE WHEN dni < 50 THEN 'overcast' WHEN dni > 400 AND dhi / greatest(dni, 1) < 0.3 THEN 'clear' ELSE 'broken' END AS cloud_regime, count(*) AS n, avg(b.total_kwh - a.total_kwh) AS mean_delta, median(abs(b.total_kwh - a.total_kwh)) AS median_abs_delta,
 quantile_cont(abs(b.total_kwh - a.total_kwh), 0.95) AS p95_abs_delta, avg(b.solar_kwh - a.solar_kwh) AS mean_solar_delta, avg(a.base_kwh) AS mean_base
FROM hourly_log h JOIN scored_3d a ON h.site_id = a.site_id AND h.ts = a.ts JOIN scored_4d b ON h.site_id = b.site_id AND h.ts = b.ts WHERE sun_elev > 0 GROUP BY 1, 2""")
def _(t):
    m = models(t)
    a = M.predict_hours(score_hours(t).drop("carry_state"), t.hourly_unit, m)
    return D.prediction_divergence(t.hourly_log, a, M.predict_hours(hours_4d(t), t.hourly_unit, m, four_d=True))


@query("saturation_radius", "D8", "site_id:i clamped:b n:i median_clamped:f median_unclamped:f", """
SELECT h.site_id, wasted_kwh > 0.001 AS clamped, count(*) AS n, median(abs(actual_kwh - total_kwh)) AS median_clamped, median(abs(actual_kwh - (total_kwh - wasted_kwh))) AS median_unclamped
FROM hourly_log h JOIN scored_3d a ON h.site_id = a.site_id AND h.ts = a.ts WHERE temp BETWEEN 7 AND 14 GROUP BY 1, 2""")
def _(t):
    a = M.predict_hours(score_hours(t).drop("carry_state"), t.hourly_unit, models(t))
    return D.saturation_radius(t.hourly_log, a)


def driver_days(t):
    d = t.daily.select("site_id", "local_date", "temp", "wind", F.col("solar_impact_kwh").alias("solar_kwh"), "kwh",
                       F.when(F.col("site_id") % 3 == 1, "cooling").when(F.col("site_id") % 3 == 2, "mixed").otherwise("heating").alias("regime"))
    span = lambda a, b: d.filter(F.col("local_date").between(F.to_date(F.lit(a)), F.to_date(F.lit(b))))
    return D.driver_days(span("1998-03-01", "1998-04-30"), span("1997-03-01", "1997-04-30"))


add_oracle_tables(driver_rows="""
WITH p AS (SELECT site_id, local_date, temp, wind, solar_impact_kwh AS sol, kwh, row_number() OVER (PARTITION BY site_id ORDER BY local_date) AS i FROM daily_history WHERE local_date BETWEEN DATE '1998-03-01' AND DATE '1998-04-30'),
b AS (SELECT site_id, temp, wind, solar_impact_kwh AS sol, kwh, row_number() OVER (PARTITION BY site_id ORDER BY local_date) AS i FROM daily_history WHERE local_date BETWEEN DATE '1997-03-01' AND DATE '1997-04-30'),
j AS (SELECT p.*, b.kwh AS bk, round(p.temp - b.temp + 1e-9, 9) AS dt, round(p.wind - b.wind + 1e-9, 9) AS dw, round(p.sol - b.sol + 1e-9, 9) AS ds, round(p.kwh - b.kwh + 1e-9, 9) AS dk, CASE WHEN p.wind >= 10.8 THEN 2 WHEN p.wind >= 8 THEN 1 ELSE 0 END - CASE WHEN b.wind >= 10.8 THEN 2 WHEN b.wind >= 8 THEN 1 ELSE 0 END AS lv,
 CASE p.site_id % 3 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE -1 END AS ct, CASE p.site_id % 3 WHEN 0 THEN 1 END AS cw FROM p JOIN b ON p.site_id = b.site_id AND p.i = b.i)
SELECT *, CASE WHEN abs(dt) >= 5 THEN 3 WHEN abs(dt) >= 2.5 THEN 2 WHEN abs(dt) >= 1 THEN 1 ELSE 0 END AS i_temp, CASE WHEN abs(lv) >= 2 THEN 3 WHEN abs(lv) = 1 THEN 2 WHEN dw >= 2.5 THEN 1 ELSE 0 END AS i_wind,
 CASE WHEN abs(ds) >= 2 THEN 2 WHEN abs(ds) >= 0.5 THEN 1 ELSE 0 END AS i_solar, coalesce(abs(dt) >= 1 AND dt * ct * dk > 0, false) AS te, coalesce(abs(dw) >= 1 AND dw * cw * dk > 0, false) AS we, coalesce(abs(ds) >= 0.5 AND ds * ct * dk > 0, false) AS se FROM j""")


@query("driver_days", "D9", "site_id:i local_date:d d_temp:f d_wind:f d_kwh:f severity:s temp_explains:b wind_explains:b solar_explains:b", """
SELECT site_id, local_date, dt AS d_temp, dw AS d_wind, dk AS d_kwh, CASE WHEN i_temp + i_wind + i_solar >= 5 THEN 'severe' WHEN i_temp + i_wind + i_solar >= 3 THEN 'challenging' WHEN i_temp + i_wind + i_solar >= 1 THEN 'notable' ELSE 'normal' END AS severity,
 te AS temp_explains, we AS wind_explains, se AS solar_explains FROM driver_rows""")
def _(t):
    return driver_days(t)


@query("weather_drivers", "D9", "site_id:i days:i kwh:f base_kwh:f delta_pct:f severe:i top_factor:s top_votes:i label:s", """
WITH t AS (SELECT site_id, count(*) AS days, sum(kwh) AS kwh, sum(bk) AS bk, count(*) FILTER (i_temp + i_wind + i_solar >= 5) AS severe FROM driver_rows GROUP BY 1),
v AS (SELECT r.site_id, CASE WHEN te AND i_temp >= greatest(CASE WHEN we THEN i_wind ELSE 0 END, CASE WHEN se THEN i_solar ELSE 0 END) THEN 'temp' WHEN we AND i_wind >= CASE WHEN se THEN i_solar ELSE 0 END THEN 'wind' WHEN se THEN 'solar' END AS factor, greatest(CASE WHEN te THEN i_temp ELSE 0 END, CASE WHEN we THEN i_wind ELSE 0 END, CASE WHEN se THEN i_solar ELSE 0 END) AS rk
 FROM driver_rows r JOIN t ON r.site_id = t.site_id WHERE (t.kwh - t.bk) * dk > 0 AND (te OR we OR se)),
f AS (SELECT site_id, factor, max(rk) AS imp, count(*) AS n FROM v WHERE rk > 0 GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY imp DESC, n DESC, CASE factor WHEN 'temp' THEN 1 WHEN 'wind' THEN 2 ELSE 3 END) AS k FROM f)
SELECT t.site_id, days, kwh, bk AS base_kwh, (kwh - bk) / bk * 100 AS delta_pct, severe, factor AS top_factor, n AS top_votes,
 CASE WHEN abs((kwh - bk) / bk * 100) <= 5 THEN 'similar' WHEN factor IS NULL THEN CASE WHEN kwh > bk THEN 'higher' ELSE 'lower' END ELSE CASE WHEN kwh > bk THEN 'higher_' ELSE 'lower_' END || factor END AS label FROM t LEFT JOIN (SELECT * FROM o WHERE k = 1) o ON t.site_id = o.site_id""")
def _(t):
    return D.weather_drivers(driver_days(t))


@query("battery_health", "D10", "site_id:i n_hours:i mean_residual:f mean_expected:f std_residual:f relative:f assessment:s", """
WITH l AS (SELECT *, max(CASE WHEN solar_impact_kwh > 0.01 THEN hour END) OVER (PARTITION BY site_id, local_date) AS lh FROM hourly_log),
a AS (SELECT site_id, count(*) AS n, avg(actual_kwh - expected_kwh) AS m, avg(expected_kwh) AS e, stddev_samp(actual_kwh - expected_kwh) AS s FROM l WHERE hour BETWEEN lh + 1 AND lh + 6 GROUP BY 1)
SELECT site_id, n AS n_hours, m AS mean_residual, e AS mean_expected, s AS std_residual, abs(m) / e AS relative, CASE WHEN n < 30 THEN 'insufficient_data' WHEN abs(m) > 0.05 AND abs(m) / e > 0.1 THEN CASE WHEN m > 0 THEN 'too_slow' ELSE 'too_fast' END ELSE 'ok' END AS assessment FROM a""")
def _(t):
    return D.battery_health(t.hourly_log)


@query("readiness_4d", "D11", "site_id:i in_scope:i evaluated:i learned:i ready:b reason:s", """
WITH m AS (SELECT site_id, unit_id, arg_max(mode, ts) AS mode FROM hourly_unit GROUP BY 1, 2),
u AS (SELECT d.site_id, d.unit_id, CASE WHEN mode IN ('heating','guest_heating') THEN 'heating' WHEN mode IN ('cooling','guest_cooling') THEN 'cooling' END AS regime FROM unit_dim d JOIN m ON d.site_id = m.site_id AND d.unit_id = m.unit_id WHERE solar_affected),
a AS (SELECT u.site_id, count(*) AS s, count(u.regime) AS e, count(*) FILTER (u.regime IS NOT NULL AND coalesce(c.learned, false)) AS l FROM u LEFT JOIN m_solar c ON c.site_id = u.site_id AND c.unit_id = u.unit_id AND c.regime = u.regime GROUP BY 1)
SELECT site_id, s AS in_scope, e AS evaluated, l AS learned, CASE WHEN e > 0 THEN l = e END AS ready, CASE WHEN e = 0 THEN 'no_entities_in_active_regime' WHEN l < e THEN 'regimes_not_learned' ELSE 'all_active_regimes_learned' END AS reason FROM a""")
def _(t):
    modes = t.hourly_unit.groupBy("site_id", "unit_id").agg(F.max_by("mode", "ts").alias("mode"))
    return D.readiness_4d(t.units, modes, models(t).solar)


@query("irradiance_outage", "D11", "site_id:i examined:i real_hours:i share:f verdict:s", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts DESC) AS rn FROM hourly_log WHERE solar_factor > 0), a AS (SELECT site_id, count(*) AS n, count(*) FILTER (dni_dhi_source IN ('native','erbs_from_ghi')) AS r FROM d WHERE rn <= 24 GROUP BY 1)
SELECT s.site_id, n AS examined, r AS real_hours, CASE WHEN n >= 24 THEN r / n END AS share, CASE WHEN NOT use_4d THEN 'not_applicable' WHEN n < 24 THEN 'insufficient_data' WHEN r / n < 0.1 THEN 'raise' WHEN r / n >= 0.5 THEN 'clear' ELSE 'hold' END AS verdict FROM site_dim s LEFT JOIN a ON s.site_id = a.site_id""")
def _(t):
    return D.irradiance_outage(t.hourly_log, t.sites)
