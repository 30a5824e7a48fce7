"""Calibrations, sweeps and least-squares fits."""

from pyspark.sql import functions as F

from warmgrid.operators import calibrate as C
from warmgrid.operators import enrich as E
from warmgrid.operators import filters as P
from warmgrid.operators import learn as L
from warmgrid.operators import rollup as A
from warmgrid.operators import timeseries as W
from warmgrid.plans.q_learn import BASE_ROWS, CELL, fold_sql
from warmgrid.plans.q_rollup import simple_base
from warmgrid.plans.q_timeseries import snr_hours
from warmgrid.plans.registry import QUERIES, query
from warmgrid.sources.fixture_tables import add_oracle_tables

LABELLED = """SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p, CASE WHEN actual_kwh <= 0 THEN 1 WHEN solar_impact_kwh > 0.1 THEN 2
 WHEN auxiliary_active THEN 3 WHEN learning_status NOT IN ('active','success','model_updated') THEN 4 END AS reason FROM hourly_log"""
add_oracle_tables(
    labelled_hours=LABELLED,
    calm_cells="""SELECT site_id, temp_key, max(kwh) FILTER (wind_bucket = 'normal') AS cn, max(kwh) FILTER (wind_bucket = 'high_wind') AS ch, max(kwh) FILTER (wind_bucket = 'extreme_wind') AS ce FROM simple_base GROUP BY 1, 2""",
    tau_points="""
SELECT e.*, greatest(0, 17 - eff) / 24 AS x, greatest(0, actual_kwh - coalesce(CASE wind_bucket WHEN 'high_wind' THEN ch - cn WHEN 'extreme_wind' THEN ce - cn END, 0)) AS y FROM (
SELECT l.site_id, l.ts, l.temp, l.wind_bucket, l.actual_kwh, t.tau, sum(b.temp * exp(-(l.p - b.p) / t.tau)) / sum(exp(-(l.p - b.p) / t.tau)) AS eff
FROM labelled_hours l JOIN (SELECT unnest(range(1, 25)) AS tau) t ON l.p >= 5 * t.tau JOIN labelled_hours b ON b.site_id = l.site_id AND b.p BETWEEN l.p - 5 * t.tau + 1 AND l.p
WHERE l.reason IS NULL GROUP BY 1, 2, 3, 4, 5, 6) e LEFT JOIN calm_cells c ON e.site_id = c.site_id AND c.temp_key = CAST(round_even(round(eff + 1e-9, 9), 0) AS INT)""")


def regression_sql(rows: str, keys: str) -> str:
    return (f"SELECT {keys}, n AS points, round(CASE WHEN vy > 1e-12 THEN c * c / (vx * vy) ELSE 0 END + 1e-9, 4) AS r2, "
            f"round(sqrt(greatest(0, vy * (1 - CASE WHEN vy > 1e-12 THEN c * c / (vx * vy) ELSE 0 END))) + 1e-9, 4) AS rmse FROM ("
            f"SELECT {keys}, count(*) AS n, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS c FROM {rows} GROUP BY {keys}) WHERE n >= 10 AND vx > 1e-12")


@query("calibrate_inertia", "C1 K3", "site_id:i param:i points:i r2:f rmse:f rank:i", f"""
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY r2 DESC, param) AS rank FROM ({regression_sql("(SELECT *, tau AS param FROM tau_points)", "site_id, param")})""")
def _(t):
    lab = P.pure_hours(t.hourly_log)
    return C.best_kernel(C.kernel_sweep(lab, simple_base(t), C.exponential_kernels(range(1, 25))))


@query("calibrate_inertia_weekly", "C1", "site_id:i weeks:i tau_mean:f tau_std:f stability:s", f"""
WITH s AS ({regression_sql("(SELECT *, tau AS param, isoyear(ts) AS iy, weekofyear(ts) AS iw FROM tau_points)", "site_id, iy, iw, param")}),
b AS (SELECT *, row_number() OVER (PARTITION BY site_id, iy, iw ORDER BY r2 DESC, param) AS rk FROM s),
g AS (SELECT b.site_id, count(*) AS weeks, avg(param) AS tau_mean, stddev_pop(param) AS tau_std FROM b JOIN (SELECT site_id, isoyear(ts) AS iy, weekofyear(ts) AS iw FROM labelled_hours WHERE reason IS NULL GROUP BY 1, 2, 3 HAVING count(*) >= 20) k
 ON b.site_id = k.site_id AND b.iy = k.iy AND b.iw = k.iw WHERE rk = 1 GROUP BY 1)
SELECT *, CASE WHEN weeks < 2 THEN 'insufficient' WHEN tau_std <= 1.5 THEN 'high' WHEN tau_std <= 3 THEN 'medium' ELSE 'low' END AS stability FROM g""")
def _(t):
    return C.inertia_stability(P.pure_hours(t.hourly_log), simple_base(t))


@query("calibrate_inertia_bands", "C1", "site_id:i band:s param:i points:i r2:f rmse:f", f"""
WITH p AS (SELECT *, tau AS param, CASE WHEN round(17 - temp + 1e-9, 9) < 0 THEN '<0' ELSE CAST(CAST(floor(round(17 - temp + 1e-9, 9) / 5) * 5 AS INT) AS VARCHAR) || '-' || CAST(CAST(floor(round(17 - temp + 1e-9, 9) / 5) * 5 AS INT) + 5 AS VARCHAR) END AS band FROM tau_points)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, band ORDER BY r2 DESC, param) AS rk FROM ({regression_sql("p", "site_id, band, param")})) WHERE rk = 1""")
def _(t):
    return C.delta_t_bins(P.pure_hours(t.hourly_log), simple_base(t))


add_oracle_tables(
    kernel_weights="""
WITH k AS (SELECT 'exponential' AS family, tau AS param, j, exp(-j / tau) AS w FROM (SELECT tau, unnest(range(least(5 * tau, 168))) AS j FROM (SELECT unnest([1, 2, 3, 4, 6, 8, 12, 18, 24, 36, 48, 72]) AS tau))
 UNION ALL SELECT 'gaussian', h, j, CASE WHEN h <= 2 THEN 1.0 ELSE exp(-power(j - (h - 1) / 2.0, 2) / (2 * power(h / 4.0, 2))) END FROM (SELECT h, unnest(range(h)) AS j FROM (SELECT unnest(range(1, 25)) AS h)))
SELECT family, param, j, w / sum(w) OVER (PARTITION BY family, param) AS w, max(j) OVER (PARTITION BY family, param) AS last FROM k""",
    kernel_points="""
SELECT e.*, greatest(0, 17 - eff) / 24 AS x, greatest(0, actual_kwh - coalesce(CASE wind_bucket WHEN 'high_wind' THEN ch - cn WHEN 'extreme_wind' THEN ce - cn END, 0)) AS y FROM (
SELECT l.site_id, l.ts, l.wind_bucket, l.actual_kwh, k.family, k.param, sum(b.temp * k.w) AS eff FROM labelled_hours l JOIN kernel_weights k ON l.p > k.last JOIN labelled_hours b ON b.site_id = l.site_id AND b.p = l.p - k.j
WHERE l.reason IS NULL GROUP BY 1, 2, 3, 4, 5, 6) e LEFT JOIN calm_cells c ON e.site_id = c.site_id AND c.temp_key = CAST(round_even(round(eff + 1e-9, 9), 0) AS INT)""",
    asym_hours=QUERIES["inertia_asymmetric"].sql,
    asym_points="""
SELECT a.site_id, greatest(0, 17 - asymmetric_temp) / 24 AS x, greatest(0, actual_kwh - coalesce(CASE wind_bucket WHEN 'high_wind' THEN ch - cn WHEN 'extreme_wind' THEN ce - cn END, 0)) AS y
FROM labelled_hours l JOIN asym_hours a ON l.site_id = a.site_id AND l.ts = a.ts LEFT JOIN calm_cells c ON l.site_id = c.site_id AND c.temp_key = CAST(round_even(round(asymmetric_temp + 1e-9, 9), 0) AS INT) WHERE reason IS NULL AND p > 1""")


@query("calibrate_inertia_gaussian", "C1", "site_id:i family:s param:i points:i r2:f rmse:f", regression_sql("kernel_points", "site_id, family, param"))
def _(t):
    lab = P.pure_hours(t.hourly_log)
    ext = C.exponential_kernels([1, 2, 3, 4, 6, 8, 12, 18, 24, 36, 48, 72])
    return C.kernel_sweep(lab, simple_base(t), C.gaussian_kernels(range(1, 25)) + ext)


@query("calibrate_inertia_asymmetric", "C1", "site_id:i points:i r2:f rmse:f", regression_sql("asym_points", "site_id"))
def _(t):
    return C.asymmetric_fit(W.inertia_asymmetric(P.pure_hours(t.hourly_log)), simple_base(t))


add_oracle_tables(wind_mae="""
SELECT x.site_id, high, extreme, round(avg(abs(actual_kwh - kwh)) + 1e-9, 4) AS mae, count(*) AS valid_hours, count(*) FILTER (wb <> 'normal') AS windy_hours FROM (
SELECT h.site_id, h.ts, h.actual_kwh, c.high, c.extreme, CASE WHEN effective_wind >= c.extreme THEN 'extreme_wind' WHEN effective_wind >= c.high THEN 'high_wind' ELSE 'normal' END AS wb, CAST(round_even(temp, 0) AS INT) AS tk
FROM hourly_log h JOIN (SELECT 3 + 0.5 * i AS high, 5 + 0.5 * i + 0.5 * j AS extreme FROM (SELECT unnest(range(15)) AS i) a, (SELECT unnest(range(13)) AS j) b UNION ALL SELECT 8.0, 10.8) c ON true
WHERE actual_kwh > 0 AND solar_impact_kwh <= 0.1 AND NOT auxiliary_active) x JOIN simple_base m ON m.site_id = x.site_id AND m.temp_key = tk AND m.wind_bucket = wb AND m.kwh > 0 GROUP BY 1, 2, 3""")


@query("calibrate_wind", "C2 K3", "site_id:i high:f extreme:f mae:f valid_hours:i windy_hours:i rank:i", """
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY mae, high, extreme) AS rank FROM wind_mae""")
def _(t):
    return C.wind_sweep(P.pure_hours(t.hourly_log, "wind"), simple_base(t))


@query("wind_recommendation", "C2", "site_id:i best_high:f best_extreme:f best_mae:f current_mae:f improvement_pct:f quality:s", """
SELECT b.site_id, high AS best_high, extreme AS best_extreme, mae AS best_mae, cm AS current_mae, round(CASE WHEN cm > 0 THEN (cm - mae) / cm * 100 END + 1e-9, 1) AS improvement_pct,
 CASE WHEN windy_hours >= 100 THEN 'high' WHEN windy_hours >= 30 THEN 'medium' ELSE 'low' END AS quality FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY mae, high, extreme) AS rank FROM wind_mae) b
LEFT JOIN (SELECT site_id, mae AS cm FROM wind_mae WHERE high = 8 AND extreme = 10.8) c ON b.site_id = c.site_id WHERE rank = 1""")
def _(t):
    return C.wind_recommendation(C.wind_sweep(P.pure_hours(t.hourly_log, "wind"), simple_base(t)))


BATTERY_SQL = """
WITH f AS (SELECT site_id, local_date, max(hour) FILTER (solar_impact_kwh > 0.01) AS lh, min(hour) FILTER (solar_impact_kwh > 0.01) AS fh, arg_max(hour, solar_impact_kwh * 1000 - hour * 1e-6) FILTER (solar_impact_kwh > 0.01) AS ph FROM hourly_log GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY site_id, local_date ORDER BY hour) AS p FROM hourly_log),
w AS (SELECT o.*, CASE WHEN hour BETWEEN lh + 1 AND lh + 6 THEN 'tail' WHEN hour BETWEEN fh AND ph THEN 'morning' END AS win FROM o JOIN f ON o.site_id = f.site_id AND o.local_date = f.local_date),
s AS (SELECT w.site_id, w.ts, w.win, d.decay, any_value(w.actual_kwh - w.expected_kwh) AS br, sum(b.solar_impact_kwh * (1 - d.decay) * power(d.decay, w.p - b.p)) AS st, sum(b.solar_impact_kwh * 0.5 * power(0.5, w.p - b.p)) AS lv
 FROM w JOIN o b ON b.site_id = w.site_id AND b.local_date = w.local_date AND b.p <= w.p JOIN (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]) AS decay) d ON true WHERE w.win IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT site_id, win AS window_name, decay, count(*) AS hours, round(sqrt(avg(power(br + st - lv, 2))) + 1e-9, 6) AS rmse, round(sqrt(avg(br * br)) + 1e-9, 6) AS live_rmse FROM s GROUP BY 1, 2, 3"""


@query("battery_replay", "C3", "site_id:i window_name:s decay:f hours:i rmse:f live_rmse:f", BATTERY_SQL)
def _(t):
    r = C.battery_replay(t.hourly_log).withColumnRenamed("window", "window_name")
    return r.groupBy("site_id", "window_name", "decay").agg(F.count("*").alias("hours"), F.round(F.sqrt(F.avg(F.col("cand_res") ** 2)) + 1e-9, 6).alias("rmse"),
                                                            F.round(F.sqrt(F.avg(F.col("base_res") ** 2)) + 1e-9, 6).alias("live_rmse"))


@query("calibrate_battery", "C3 W15", "site_id:i best_decay:f rmse:f live_rmse:f hours:i morning_decay:f", f"""
WITH sw AS ({BATTERY_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY site_id, window_name ORDER BY rmse, decay) AS rk FROM sw WHERE hours >= 5)
SELECT t.site_id, t.decay AS best_decay, t.rmse, t.live_rmse, t.hours, m.decay AS morning_decay FROM (SELECT * FROM b WHERE rk = 1 AND window_name = 'tail') t LEFT JOIN (SELECT * FROM b WHERE rk = 1 AND window_name = 'morning') m ON t.site_id = m.site_id""")
def _(t):
    return C.calibrate_battery(t.hourly_log)


def wasted_hours(t):
    return t.hourly_log.withColumns({"solar_wasted_kwh": F.col("solar_impact_kwh") * 0.4, "has_heating": F.col("temp") < 17})


add_oracle_tables(carry_cells="""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p, CASE WHEN temp < 17 THEN solar_impact_kwh * 0.4 ELSE 0 END AS wk FROM hourly_log),
e AS (SELECT a.site_id, a.ts, sum(b.wk * 0.5 * power(0.5, a.p - b.p)) AS e FROM o a JOIN o b ON a.site_id = b.site_id AND b.p <= a.p AND b.p > a.p - 60 GROUP BY 1, 2),
r AS (SELECT o.site_id, k.k, CAST(floor(hour / 6) * 6 AS INT) AS hour_band, CAST(floor(temp / 5) * 5 AS INT) AS temp_band, CASE WHEN correction_percent >= 80 THEN 'open' WHEN correction_percent < 20 THEN 'closed' ELSE 'partial' END AS screen,
 actual_kwh - expected_kwh + k.k * e.e * 0.5 AS res FROM o JOIN e ON o.site_id = e.site_id AND o.ts = e.ts JOIN (SELECT round(i * 0.1, 1) AS k FROM (SELECT unnest(range(11)) AS i)) k ON true)
SELECT site_id, k, hour_band, temp_band, screen, count(*) AS n, sum(res) AS sum_residual, sum(res * res) AS sse FROM r GROUP BY 1, 2, 3, 4, 5""")


@query("carryover_sweep", "C4", "site_id:i k:f hour_band:i temp_band:i screen:s n:i sum_residual:f sse:f", "SELECT * FROM carry_cells")
def _(t):
    return C.carryover_sweep(wasted_hours(t))


@query("carryover_optimum", "C4", "site_id:i k:f n:i rmse:f rank:i", """
SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY rmse, k) AS rank FROM (SELECT site_id, k, sum(n) AS n, round(sqrt(sum(sse) / sum(n)) + 1e-9, 4) AS rmse FROM carry_cells GROUP BY 1, 2)""")
def _(t):
    return C.carryover_optimum(C.carryover_sweep(wasted_hours(t)))


# --- solar samples and fits -------------------------------------------------------

add_oracle_tables(
    fit_hours="""
SELECT u.site_id, u.unit_id, u.ts, u.local_date, u.hour, u.mode, u.actual_kwh, u.expected_base_kwh, h.auxiliary_active, CAST(round_even(h.temp, 0) AS INT) AS temp_key, d.min_base, h.sun_elev,
 solar_vector_s / t_s AS ps, solar_vector_e / t_e AS pe, solar_vector_w / t_w AS pw,
 sqrt(solar_vector_s^2 + solar_vector_e^2 + solar_vector_w^2) >= 0.3 AND u.mode = 'heating' AND d.solar_affected AND ((expected_base_kwh > 0 AND u.actual_kwh < 0.03) OR (expected_base_kwh >= min_base AND u.actual_kwh < 0.15 * expected_base_kwh)) AS is_shutdown,
 solar_vector_s, solar_vector_e, solar_vector_w, correction_percent, cloud_coverage, solar_factor, dni, dhi, ghi_in, temp, expected_kwh, screen_s, screen_e, screen_w
FROM hourly_unit u JOIN (SELECT h.* EXCLUDE (expected_kwh, actual_kwh), screen_s, screen_e, screen_w, 0.3 + 0.7 * correction_percent / 100 AS t_s, CASE WHEN screen_e THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS t_e,
 CASE WHEN screen_w THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS t_w FROM hourly_log h JOIN site_dim s ON h.site_id = s.site_id) h ON u.site_id = h.site_id AND u.ts = h.ts
JOIN unit_dim d ON u.site_id = d.site_id AND u.unit_id = d.unit_id""",
    fit_labels="""
SELECT *, CASE WHEN mode = 'heating' THEN expected_base_kwh - actual_kwh ELSE actual_kwh - expected_base_kwh END AS impact, CASE WHEN mode IN ('heating','cooling') THEN mode END AS regime,
 CASE WHEN mode NOT IN ('heating','cooling') THEN 'wrong_mode' WHEN auxiliary_active THEN 'auxiliary_active' WHEN sqrt(ps^2 + pe^2 + pw^2) <= 0.01 THEN 'low_magnitude' WHEN expected_base_kwh <= 0 THEN 'below_min_base'
 WHEN CASE WHEN mode = 'heating' THEN expected_base_kwh - actual_kwh ELSE actual_kwh - expected_base_kwh END <= 0 THEN 'non_positive_impact' END AS drop_reason,
 mode = 'heating' AND expected_base_kwh - actual_kwh >= 0.95 * expected_base_kwh AS saturated FROM fit_hours""",
    gram="""
SELECT site_id, unit_id, regime, count(*) AS n, sum(ps*ps) AS ss, sum(pe*pe) AS ee, sum(pw*pw) AS ww, sum(ps*pe) AS se, sum(ps*pw) AS sw, sum(pe*pw) AS ew, sum(ps*impact) AS sy, sum(pe*impact) AS ey, sum(pw*impact) AS wy, sum(impact*impact) AS yy,
 sum(ps) AS ds, sum(pe) AS de, sum(pw) AS dw FROM fit_labels WHERE drop_reason IS NULL GROUP BY 1, 2, 3""")


def build_fit_hours(t):
    h = E.screen_potential(t.hourly_log, t.sites).select(
        "site_id", "ts", "auxiliary_active", F.rint("temp").cast("int").alias("temp_key"), "temp", F.col("pot_s").alias("ps"), F.col("pot_e").alias("pe"), F.col("pot_w").alias("pw"),
        "solar_factor", "cloud_coverage", "correction_percent", "screen_s", "screen_e", "screen_w", "sun_elev", "sun_azim", "dni", "dhi", "ghi_in", "t_s", "t_e", "t_w", "dni_dhi_source")
    flagged = P.shutdown_flags(t.hourly_unit, t.hourly_log, t.units)
    vec = t.hourly_log.select("site_id", "ts", "solar_vector_s", "solar_vector_e", "solar_vector_w")
    return flagged.join(h, ["site_id", "ts"]).join(vec, ["site_id", "ts"])


def fit_hours(t):
    return t.stored("fit_hours", lambda: build_fit_hours(t))


def diagnose_samples(t):
    return C.solar_samples(fit_hours(t), "diagnose").filter("drop_reason is null")


def prior_coeffs(t):
    return t.units.select("site_id", "unit_id", F.explode(F.array(F.lit("heating"), F.lit("cooling"))).alias("regime"),
                          F.lit(0.5).alias("s"), F.lit(0.3).alias("e"), F.lit(0.2).alias("w"), F.lit(True).alias("learned"))


@query("solar_samples_diagnose", "P7", "site_id:i unit_id:s reason:s n:i", "SELECT site_id, unit_id, coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM fit_labels GROUP BY 1, 2, 3")
def _(t):
    return C.drop_counts(C.solar_samples(fit_hours(t), "diagnose"))


SAMPLES_SQL = """
WITH l AS (SELECT *, {shut} AS d0, impact - (0.5 * ps + 0.3 * pe + 0.2 * pw) AS res FROM fit_labels),
m AS (SELECT site_id, unit_id, regime, median(res) AS med, count(*) AS n FROM l WHERE d0 IS NULL AND NOT saturated GROUP BY 1, 2, 3),
k AS (SELECT l.site_id, l.unit_id, l.regime, median(abs(res - med)) AS mad FROM l JOIN m ON l.site_id = m.site_id AND l.unit_id = m.unit_id AND l.regime = m.regime WHERE d0 IS NULL AND NOT saturated GROUP BY 1, 2, 3),
x AS (SELECT l.*, coalesce(d0, CASE WHEN abs(res - coalesce(med, 0)) > CASE WHEN coalesce(n, 0) >= 20 THEN 5 * greatest(greatest(0.02, 0.05 * greatest(coalesce(min_base, 0.5), 0.1)), 1.4826 * mad) ELSE 10 END
  OR abs(actual_kwh - expected_base_kwh) > 10 * expected_base_kwh THEN 'outlier' END) AS d1 FROM l LEFT JOIN m ON l.site_id = m.site_id AND l.unit_id = m.unit_id AND l.regime = m.regime
  LEFT JOIN k ON l.site_id = k.site_id AND l.unit_id = k.unit_id AND l.regime = k.regime)
"""


@query("solar_samples", "P7", "site_id:i unit_id:s reason:s n:i", SAMPLES_SQL.format(
    shut="CASE WHEN drop_reason IN ('wrong_mode','auxiliary_active') THEN drop_reason WHEN is_shutdown THEN 'shutdown' ELSE drop_reason END") + """
SELECT site_id, unit_id, coalesce(d1, CASE WHEN saturated THEN 'saturated' END, 'kept') AS reason, count(*) AS n FROM x GROUP BY 1, 2, 3""")
def _(t):
    return C.drop_counts(C.solar_samples(fit_hours(t), "default", coeffs=prior_coeffs(t)))


@query("solar_samples_tobit", "P7", "site_id:i unit_id:s regime:s n:i censored:i impact:f", SAMPLES_SQL.format(shut="drop_reason") + """
SELECT site_id, unit_id, regime, count(*) AS n, count(*) FILTER (saturated) AS censored, sum(CASE WHEN saturated THEN 0.95 * expected_base_kwh ELSE impact END) AS impact FROM x WHERE d1 IS NULL GROUP BY 1, 2, 3""")
def _(t):
    d = C.solar_samples(fit_hours(t), "tobit", coeffs=prior_coeffs(t)).filter("drop_reason is null")
    return d.groupBy("site_id", "unit_id", "regime").agg(F.count("*").alias("n"), F.count_if("censored").alias("censored"), F.sum("impact").alias("impact"))


@query("normal_equations", "A18", "site_id:i unit_id:s regime:s n:i ss:f ee:f ww:f se:f sw:f ew:f sy:f ey:f wy:f", "SELECT * FROM gram")
def _(t):
    return A.normal_equations(diagnose_samples(t))


LS = """
WITH a AS (SELECT *, ss * (ee * ww - ew * ew) - se * (se * ww - ew * sw) + sw * (se * ew - ee * sw) AS det, sqrt(ds * ds + de * de + dw * dw) AS ln FROM {gram}),
b AS (SELECT *, ds / ln AS us, de / ln AS ue, dw / ln AS uw FROM a),
c AS (SELECT *, (us * sy + ue * ey + uw * wy) / (us * us * ss + ue * ue * ee + uw * uw * ww + 2 * (us * ue * se + us * uw * sw + ue * uw * ew)) AS line FROM b),
f AS (SELECT *, CASE WHEN abs(det) > 1e-6 THEN (sy * (ee * ww - ew * ew) - se * (ey * ww - ew * wy) + sw * (ey * ew - ee * wy)) / det ELSE line * us END AS s,
 CASE WHEN abs(det) > 1e-6 THEN (ss * (ey * ww - wy * ew) - sy * (se * ww - ew * sw) + sw * (se * wy - ey * sw)) / det ELSE line * ue END AS e,
 CASE WHEN abs(det) > 1e-6 THEN (ss * (ee * wy - ey * ew) - se * (se * wy - ey * sw) + sy * (se * ew - ee * sw)) / det ELSE line * uw END AS w FROM c)"""


@query("fit_solar_ls", "C5", "site_id:i unit_id:s regime:s n:i s:f e:f w:f method:s rmse:f", LS.format(gram="gram") + """
SELECT f.site_id, f.unit_id, f.regime, f.n, f.s, f.e, f.w, CASE WHEN abs(det) > 1e-6 THEN 'joint' ELSE 'collinear' END AS method, r.rmse FROM f JOIN (
SELECT l.site_id, l.unit_id, l.regime, sqrt(avg(power(impact - f.s * ps - f.e * pe - f.w * pw, 2))) AS rmse FROM fit_labels l JOIN f ON l.site_id = f.site_id AND l.unit_id = f.unit_id AND l.regime = f.regime WHERE drop_reason IS NULL GROUP BY 1, 2, 3) r
ON f.site_id = r.site_id AND f.unit_id = r.unit_id AND f.regime = r.regime""")
def _(t):
    return C.fit_solar_ls(diagnose_samples(t))


add_oracle_tables(chunk_rows="""SELECT *, least(2, (rn // greatest(1, n // 3))) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY site_id, unit_id, regime ORDER BY ts) - 1 AS rn, count(*) OVER (PARTITION BY site_id, unit_id, regime) AS n FROM fit_labels WHERE drop_reason IS NULL)""",
                  chunk_gram="""SELECT site_id, unit_id, regime, chunk, count(*) AS n, sum(ps*ps) AS ss, sum(pe*pe) AS ee, sum(pw*pw) AS ww, sum(ps*pe) AS se, sum(ps*pw) AS sw, sum(pe*pw) AS ew, sum(ps*impact) AS sy, sum(pe*impact) AS ey, sum(pw*impact) AS wy,
 sum(ps) AS ds, sum(pe) AS de, sum(pw) AS dw FROM chunk_rows GROUP BY 1, 2, 3, 4""")


@query("implied_coefficients", "C8", "site_id:i unit_id:s regime:s direction:s n:i fits:i lo:f hi:f verdict:s", LS.format(gram="chunk_gram") + """,
p AS (SELECT site_id, unit_id, regime, 's' AS direction, s AS v FROM f UNION ALL SELECT site_id, unit_id, regime, 'e', e FROM f UNION ALL SELECT site_id, unit_id, regime, 'w', w FROM f),
g AS (SELECT site_id, unit_id, regime, direction, count(v) AS fits, min(v) AS lo, max(v) AS hi, max(abs(v)) AS big FROM p GROUP BY 1, 2, 3, 4)
SELECT g.site_id, g.unit_id, g.regime, direction, gram.n, fits, lo, hi, CASE WHEN gram.n < 30 THEN 'too_few_hours' WHEN fits < 3 THEN 'insufficient_windows' WHEN round(big + 1e-9, 9) <= 0.05 THEN 'near_zero' WHEN lo < -0.05 AND hi > 0.05 THEN 'sign_flip'
 WHEN big > 3 * greatest(least(abs(lo), abs(hi)), 0.05) THEN 'unstable' ELSE 'stable' END AS verdict FROM g JOIN gram ON g.site_id = gram.site_id AND g.unit_id = gram.unit_id AND g.regime = gram.regime""")
def _(t):
    return C.implied_coefficients(diagnose_samples(t))


@query("apply_suggestion", "C9", "site_id:i unit_id:s regime:s new_s:f new_e:f new_w:f changed:b", LS.format(gram="chunk_gram") + """,
whole AS (SELECT * FROM (""" + LS.format(gram="gram") + """ SELECT * FROM f)),
p AS (SELECT site_id, unit_id, regime, 's' AS direction, s AS v FROM f UNION ALL SELECT site_id, unit_id, regime, 'e', e FROM f UNION ALL SELECT site_id, unit_id, regime, 'w', w FROM f),
g AS (SELECT site_id, unit_id, regime, direction, count(v) AS fits, min(v) AS lo, max(v) AS hi, max(abs(v)) AS big FROM p GROUP BY 1, 2, 3, 4),
ok AS (SELECT g.site_id, g.unit_id, g.regime, g.direction, least(5, greatest(0, CASE g.direction WHEN 's' THEN wh.s WHEN 'e' THEN wh.e ELSE wh.w END)) AS nv FROM g JOIN whole wh ON g.site_id = wh.site_id AND g.unit_id = wh.unit_id AND g.regime = wh.regime
 WHERE wh.n >= 30 AND fits >= 3 AND (round(big + 1e-9, 9) <= 0.05 OR (NOT (lo < -0.05 AND hi > 0.05) AND NOT big > 3 * greatest(least(abs(lo), abs(hi)), 0.05)))),
m AS (SELECT site_id, unit_id, unnest(['heating', 'cooling']) AS regime FROM unit_dim),
r AS (SELECT m.*, coalesce(max(nv) FILTER (direction = 's'), 0.5) AS new_s, coalesce(max(nv) FILTER (direction = 'e'), 0.3) AS new_e, coalesce(max(nv) FILTER (direction = 'w'), 0.2) AS new_w FROM m LEFT JOIN ok ON m.site_id = ok.site_id AND m.unit_id = ok.unit_id AND m.regime = ok.regime GROUP BY ALL)
SELECT *, new_s <> 0.5 OR new_e <> 0.3 OR new_w <> 0.2 AS changed FROM r""")
def _(t):
    return C.apply_suggestion(prior_coeffs(t), C.implied_coefficients(diagnose_samples(t)))


SWEEP = """
WITH v AS (SELECT *, unnest([0.05, 0.08, 0.12, 0.15, 0.2, 0.25]) AS floor FROM fit_labels WHERE drop_reason IS NULL),
x AS (SELECT site_id, unit_id, floor, impact, solar_vector_s / CASE WHEN screen_s THEN floor + (1 - floor) * correction_percent / 100 ELSE 1 END AS ps, solar_vector_e / CASE WHEN screen_e THEN floor + (1 - floor) * correction_percent / 100 ELSE 1 END AS pe,
 solar_vector_w / CASE WHEN screen_w THEN floor + (1 - floor) * correction_percent / 100 ELSE 1 END AS pw FROM v),
sw AS (SELECT site_id, unit_id, floor, count(*) AS n, sum(ps*ps) AS ss, sum(pe*pe) AS ee, sum(pw*pw) AS ww, sum(ps*pe) AS se, sum(ps*pw) AS sw, sum(pe*pw) AS ew, sum(ps*impact) AS sy, sum(pe*impact) AS ey, sum(pw*impact) AS wy, sum(ps) AS ds, sum(pe) AS de, sum(pw) AS dw FROM x GROUP BY 1, 2, 3),""" + LS.format(gram="sw").replace("WITH", "") + """,
r AS (SELECT x.site_id, x.unit_id, x.floor, any_value(f.n) AS n, round(sqrt(avg(power(impact - f.s * ps - f.e * pe - f.w * pw, 2))) + 1e-9, 4) AS rmse FROM x JOIN f ON x.site_id = f.site_id AND x.unit_id = f.unit_id AND x.floor = f.floor WHERE f.n >= 20 GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY site_id, unit_id ORDER BY rmse, floor) AS rank FROM r"""


@query("transmittance_sweep", "D14", "site_id:i unit_id:s floor:f n:i rmse:f rank:i", SWEEP)
def _(t):
    return C.transmittance_sweep(C.solar_samples(fit_hours(t), "diagnose").filter("drop_reason is null").drop("ps", "pe", "pw"))


def obstruction_samples(t, shutdown=False):
    d = C.solar_samples(E.enrich_potential_4d(fit_hours(t)), "diagnose").filter("drop_reason is null and not saturated").filter(F.col("is_shutdown") == shutdown)
    total = sum((F.col(f"p4_{f}") for f in "sewd"), F.lit(0.0))
    beams = F.array(*[F.struct(F.lit(f).alias("facade"), F.col(f"p4_{f}").alias("p")) for f in "sew"])
    d = d.withColumns({"_total": total, "_b": F.explode(beams)}).filter((F.col("_total") > 0) & (F.col("_b.p") / F.col("_total") > 0.4))
    return d.select("site_id", "unit_id", F.col("_b.facade").alias("facade"), F.col("sun_elev").alias("elev"), (F.col("_b.p") * 0.0005).alias("pred"),
                    (F.col("impact") - (F.col("_total") - F.col("_b.p")) * 0.0005).alias("residual"), "ts")


OBST_OUT = "site_id:i unit_id:s facade:s side:s crit:f n_above:i n_below:i gain:f learned:b"
OBST_ROWS = """
WITH b AS (SELECT l.*, dni * cos(radians(l.sun_elev)) AS beam, h.sun_azim AS az, 0.3 + 0.7 * l.correction_percent / 100 AS ts_, CASE WHEN l.screen_e THEN 0.3 + 0.7 * l.correction_percent / 100 ELSE 1 END AS te, CASE WHEN l.screen_w THEN 0.3 + 0.7 * l.correction_percent / 100 ELSE 1 END AS tw
 FROM fit_labels l JOIN (SELECT site_id, ts, sun_azim FROM hourly_log) h ON l.site_id = h.site_id AND l.ts = h.ts WHERE drop_reason IS NULL AND NOT saturated AND is_shutdown = {} AND l.sun_elev > 0),
p AS (SELECT *, beam * greatest(0, -cos(radians(az))) * ts_ AS a_s, beam * greatest(0, sin(radians(az))) * te AS a_e, beam * greatest(0, -sin(radians(az))) * tw AS a_w, dhi * 0.5 * (ts_ + te + tw) / 3 AS a_d FROM b),
f AS (SELECT *, 's' AS facade, a_s AS own FROM p UNION ALL SELECT *, 'e', a_e FROM p UNION ALL SELECT *, 'w', a_w FROM p)
SELECT site_id, unit_id, facade, sun_elev AS elev, own * 0.0005 AS pred, impact - (a_s + a_e + a_w + a_d - own) * 0.0005 AS residual, ts FROM f WHERE a_s + a_e + a_w + a_d > 0 AND own / (a_s + a_e + a_w + a_d) > 0.4"""
add_oracle_tables(
    obst_samples=OBST_ROWS.format("false"), obst_shutdowns=OBST_ROWS.format("true"),
    obst_proof="""
SELECT site_id, unit_id, facade, max(elev) FILTER (lo = 3) AS pmin, max(elev) FILTER (hi = 3) AS pmax FROM (SELECT *, row_number() OVER (PARTITION BY site_id, unit_id, facade ORDER BY elev) AS lo,
 row_number() OVER (PARTITION BY site_id, unit_id, facade ORDER BY elev DESC) AS hi FROM obst_shutdowns) GROUP BY 1, 2, 3""")


def obstruction_sql(allowed="true"):
    return f"""
WITH c AS (SELECT 'low' AS side, 5.0 + i AS crit FROM (SELECT unnest(range(36)) AS i) UNION ALL SELECT 'high', 15.0 + i FROM (SELECT unnest(range(56)) AS i)),
x AS (SELECT s.*, c.side, c.crit, elev > crit AS above, row_number() OVER (PARTITION BY site_id, unit_id, facade, side, crit, elev > crit ORDER BY abs(elev - crit), ts) AS rk FROM obst_samples s JOIN c ON true),
a AS (SELECT site_id, unit_id, facade, side, crit, count(*) FILTER (above) AS n_above, count(*) FILTER (NOT above) AS n_below, max(elev) - min(elev) AS span, sum(power(residual - pred, 2)) AS sn,
 sum(CASE WHEN (side = 'low') <> above THEN residual * residual ELSE power(residual - pred, 2) END) AS sg FROM x WHERE rk <= 20 GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT *, round(1 - sg / sn + 1e-9, 6) AS gain FROM a WHERE n_above >= 10 AND n_below >= 10 AND span <= 25 AND sn > 1e-12 AND {allowed})
SELECT site_id, unit_id, facade, side, crit, n_above, n_below, gain, gain >= 0.3 AND sqrt(sn / (n_above + n_below)) - sqrt(sg / (n_above + n_below)) >= 0.05 AS learned FROM (
SELECT *, row_number() OVER (PARTITION BY site_id, unit_id, facade, side ORDER BY gain DESC, crit) AS rk FROM b) WHERE rk = 1"""


@query("fit_obstruction", "C7", OBST_OUT, obstruction_sql())
def _(t):
    return C.fit_obstruction(obstruction_samples(t))


@query("fit_obstruction_bounded", "C7", OBST_OUT, obstruction_sql("""NOT EXISTS (SELECT 1 FROM obst_proof q WHERE q.site_id = a.site_id AND q.unit_id = a.unit_id AND q.facade = a.facade
 AND CASE WHEN a.side = 'low' THEN a.crit > q.pmin ELSE a.crit < q.pmax END)"""))
def _(t):
    return C.fit_obstruction(obstruction_samples(t), obstruction_samples(t, shutdown=True))


@query("obstruction_stability", "C7 P11", "site_id:i unit_id:s facade:s side:s crit:f agreeing:i stable_across_windows:b")
def _(t):
    return C.obstruction_stability(obstruction_samples(t), F.to_date(F.lit("2024-02-15")))


add_oracle_tables(trained_flat="SELECT site_id, temp_key, wind_bucket, st.v AS kwh FROM (" + fold_sql(
    BASE_ROWS.replace("0.1 * greatest(0, snr_weight)", "0.1"), CELL, "ts", {"v": "CAST(0 AS DOUBLE)", "x": "CAST(x AS DOUBLE)"},
    {"v": "CASE WHEN a.v <> 0 THEN round(a.v + 0.1 * (x.x - a.v) + 1e-9, 5) ELSE round(x.x + 1e-9, 5) END"}) + ")")


@query("ema_rule_comparison", "C10", "site_id:i cells:i rmse_a:f rmse_b:f share_worse:f", """
WITH d AS (SELECT site_id, CAST(round_even(temp, 0) AS INT) AS temp_key, wind_bucket, count(*) AS n, avg(greatest(0, actual_kwh - excluded_kwh)) AS dm FROM hourly_log WHERE solar_factor < 0.05 AND NOT auxiliary_active GROUP BY 1, 2, 3)
SELECT d.site_id, count(*) AS cells, sqrt(avg(power(a.kwh - dm, 2))) AS rmse_a, sqrt(avg(power(b.kwh - dm, 2))) AS rmse_b, avg(CASE WHEN round(abs(b.kwh - dm) - abs(a.kwh - dm) + 1e-9, 9) > 0 THEN 1.0 ELSE 0.0 END) AS share_worse
FROM d JOIN trained_flat a ON d.site_id = a.site_id AND d.temp_key = a.temp_key AND d.wind_bucket = a.wind_bucket JOIN trained_base b ON d.site_id = b.site_id AND d.temp_key = b.temp_key AND d.wind_bucket = b.wind_bucket WHERE d.n >= 5 GROUP BY 1""")
def _(t):
    flat = L.train_base(t.hourly_log.withColumn("snr_weight", F.lit(1.0)), lr=0.1, lift=False)
    return C.ema_rule_comparison(A.dark_hour_means(t.hourly_log), flat, L.train_base(snr_hours(t), lr=0.1))


@query("threshold_impact", "C11", "site_id:i unit_id:s hours:i fixed_rule:i unit_rule:i lost:i gained:i", """
SELECT u.site_id, u.unit_id, count(*) AS hours, count(*) FILTER (expected_base_kwh >= 0.3) AS fixed_rule, count(*) FILTER (expected_base_kwh >= min_base) AS unit_rule,
 count(*) FILTER (expected_base_kwh >= 0.3 AND NOT expected_base_kwh >= min_base) AS lost, count(*) FILTER (NOT expected_base_kwh >= 0.3 AND expected_base_kwh >= min_base) AS gained
FROM hourly_unit u JOIN unit_dim d ON u.site_id = d.site_id AND u.unit_id = d.unit_id WHERE mode = 'heating' GROUP BY 1, 2""")
def _(t):
    return C.threshold_impact(t.hourly_unit, t.units, 0.3)
