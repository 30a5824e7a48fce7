"""Learned-model builders that plain SQL can check."""

from pyspark.sql import functions as F

from warmgrid.operators import enrich as E
from warmgrid.operators import learn as L
from warmgrid.operators import timeseries as W
from warmgrid.plans.q_joins import unit_cells
from warmgrid.plans.q_timeseries import cop_params, snr_hours
from warmgrid.plans.registry import query
from warmgrid.sources.fixture_tables import add_oracle_tables

CELL = "site_id, temp_key, wind_bucket"


def fold_sql(source: str, keys: str, order: str, fields: dict[str, str], step: dict[str, str], extra: str = "") -> str:
    """A per-key ordered reduction; the accumulator is the same struct as the rows."""
    row = ", ".join(f"'{k}': {v}" for k, v in fields.items())
    nxt = ", ".join(f"'{k}': {step.get(k, 'x.' + k)}" for k in fields)
    init = ", ".join(f"'{k}': CAST(0 AS {'BIGINT' if k in ('n', 'set') else 'DOUBLE'})" for k in fields)
    return (f"SELECT {keys}, list_reduce(l, lambda a, x: {{{nxt}}}, {{{init}}}) AS st{extra} FROM ("
            f"SELECT {keys}, list({{{row}}} ORDER BY {order}) AS l, min({order}) AS t0 FROM ({source}) GROUP BY {keys})")


D = "CAST({} AS DOUBLE)".format
BASE_ROWS = """
SELECT site_id, ts, CAST(round_even(m, 0) AS INT) AS temp_key, wb AS wind_bucket, e AS x, greatest(0, e + dl) AS dark, 0.1 * greatest(0, snr_weight) AS r FROM (
SELECT *, round(avg(temp) OVER (PARTITION BY site_id ORDER BY ts ROWS 3 PRECEDING) + 1e-9, 9) AS m, greatest(0, actual_kwh - excluded_kwh) AS e,
 coalesce(solar_normalization_delta_4d, solar_normalization_delta, 0) AS dl, CASE WHEN effective_wind >= 10.8 THEN 'extreme_wind' WHEN effective_wind >= 8 THEN 'high_wind' ELSE 'normal' END AS wb FROM snr_hours)
WHERE learning_status <> 'disabled' AND learning_status NOT LIKE 'skipped%' AND NOT auxiliary_active"""

add_oracle_tables(
    trained_base="SELECT site_id, temp_key, wind_bucket, st.v AS kwh, st.n AS n FROM (" + fold_sql(
        BASE_ROWS, CELL, "ts", {"v": D(0), "x": D("x"), "d": D("dark"), "r": D("r"), "n": "CAST(0 AS BIGINT)"},
        {"v": "CASE WHEN a.v = 0 AND x.r <= 0 THEN a.v WHEN a.v <> 0 THEN round(a.v + x.r * (CASE WHEN a.v < x.d THEN x.d ELSE x.x END - a.v) + 1e-9, 5) ELSE round(x.d + 1e-9, 5) END",
         "n": "CASE WHEN a.v = 0 AND x.r <= 0 THEN a.n ELSE a.n + 1 END"}) + ") WHERE st.n > 0",
    trained_unit="SELECT site_id, unit_id, temp_key, wind_bucket, st.v AS kwh, st.n - 3 AS obs_count FROM (" + fold_sql(
        "SELECT site_id, unit_id, temp_key, CASE WHEN mode = 'cooling' THEN 'cooling' ELSE wind_bucket END AS wind_bucket, ts, actual_kwh AS x FROM unit_cells WHERE actual_kwh > 0 AND mode IN ('heating','cooling') AND NOT auxiliary_active",
        "site_id, unit_id, temp_key, wind_bucket", "ts", {"v": D(0), "x": D("x"), "s": D(0), "n": "CAST(0 AS BIGINT)"},
        {"s": "a.s + x.x", "n": "a.n + 1", "v": "CASE WHEN a.n < 3 THEN 0 WHEN a.n = 3 THEN round((a.s + x.x) / 4 + 1e-9, 5) ELSE round(a.v + 0.01 * (x.x - a.v) + 1e-9, 5) END"}) + ") WHERE st.n >= 4")


@query("train_base", "L1", "site_id:i temp_key:i wind_bucket:s kwh:f n:i", "SELECT * FROM trained_base")
def _(t):
    return L.train_base(snr_hours(t), lr=0.1)


@query("train_unit_model", "L3", "site_id:i unit_id:s temp_key:i wind_bucket:s kwh:f obs_count:i", "SELECT * FROM trained_unit")
def _(t):
    return L.train_unit_model(unit_cells(t))


def aux_cells(t):
    """Unit-hours with every fourth hour read as aux-heated, so cells fill at small scale."""
    return unit_cells(t).withColumn("auxiliary_active", F.col("hour") % 4 == 0)


@query("train_unit_aux", "L4", "site_id:i unit_id:s temp_key:i wind_bucket:s kw:f", """
SELECT site_id, unit_id, temp_key, wind_bucket, st.v AS kw FROM (""" + fold_sql(
    """SELECT u.site_id, u.unit_id, u.temp_key, u.wind_bucket, u.ts, m.kwh AS b, least(m.kwh, greatest(0, m.kwh - u.actual_kwh)) AS x FROM unit_cells u
 JOIN (SELECT site_id, unit_id, temp_key, wind_bucket, round(avg(actual_kwh) + 1e-9, 5) AS kwh FROM unit_cells WHERE hour % 4 <> 0 GROUP BY 1, 2, 3, 4) m
 ON u.site_id = m.site_id AND u.unit_id = m.unit_id AND u.temp_key = m.temp_key AND u.wind_bucket = m.wind_bucket
 WHERE u.hour % 4 = 0 AND u.mode IN ('heating','cooling') AND u.unit_id <> 'unit_3' AND m.kwh > 0.01""",
    "site_id, unit_id, temp_key, wind_bucket", "ts", {"v": D(0), "x": D("x"), "s": D(0), "b": D("b"), "n": "CAST(0 AS BIGINT)"},
    {"s": "a.s + x.x", "n": "a.n + 1", "v": "CASE WHEN a.n < 3 THEN 0 WHEN a.n = 3 THEN round((a.s + x.x) / 4 + 1e-9, 3) ELSE round(least(greatest(0, a.v + 0.01 * (x.x - a.v)), x.b) + 1e-9, 3) END"}) + ") WHERE st.n >= 4")
def _(t):
    cells = aux_cells(t)
    base = cells.filter("not auxiliary_active").groupBy(*L.UNIT_CELL).agg(F.round(F.avg("actual_kwh") + 1e-9, 5).alias("kwh"))
    return L.train_unit_aux(cells, base, t.units)


DAY_ROWS = """
SELECT *, kwh - aux_impact_kwh - coalesce(2.0 * (midnight_indoor_temp - lag(midnight_indoor_temp) OVER (PARTITION BY site_id ORDER BY local_date)), 0) AS q FROM daily_history"""


def learn_days(t):
    return t.daily.withColumnsRenamed({"aux_impact_kwh": "excluded_kwh"}).withColumn("solar_normalization_delta", F.col("solar_factor") * 2)


@query("train_daily_flat", "L5", "site_id:i temp_key:i wind_bucket:s kwh:f n:i", """
SELECT site_id, temp_key, wind_bucket, st.v AS kwh, st.n AS n FROM (""" + fold_sql(
    f"""SELECT site_id, local_date, CAST(round_even(temp, 0) AS INT) AS temp_key, CASE WHEN wind >= 10.8 THEN 'extreme_wind' WHEN wind >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket,
 greatest(0, q + solar_factor * 2) / 24 AS x FROM ({DAY_ROWS}) WHERE n_hours >= 22 AND tdd >= 0.5 AND q > 0""",
    CELL, "local_date", {"v": D(0), "x": D("x"), "n": "CAST(0 AS BIGINT)"},
    {"n": "a.n + 1", "v": "CASE WHEN a.v = 0 THEN round(x.x + 1e-9, 5) ELSE round(a.v + 0.01 * (x.x - a.v) + 1e-9, 5) END"}) + ")")
def _(t):
    return L.train_daily_flat(learn_days(t), thermal_mass=2.0)


@query("train_u_coefficient", "L6", "site_id:i u_coefficient:f n:i", """
SELECT site_id, st.v AS u_coefficient, st.n AS n FROM (""" + fold_sql(
    f"SELECT site_id, local_date, q / tdd AS x FROM ({DAY_ROWS}) WHERE n_hours >= 22 AND tdd >= 0.5 AND q > 0",
    "site_id", "local_date", {"v": D(0), "x": D("x"), "n": "CAST(0 AS BIGINT)"},
    {"n": "a.n + 1", "v": "CASE WHEN a.n = 0 THEN x.x ELSE a.v + 0.005 * (x.x - a.v) END"}) + ")")
def _(t):
    return L.train_u_coefficient(learn_days(t), thermal_mass=2.0)


SMEAR_CTES = """
felt AS (SELECT a.site_id, a.local_date, a.hour, least(1, sum(b.solar_factor * 0.5 * power(0.5, a.hour - b.hour))) AS felt FROM hourly_log a JOIN hourly_log b
 ON a.site_id = b.site_id AND a.local_date = b.local_date AND b.hour <= a.hour GROUP BY 1, 2, 3),
wts AS (SELECT h.site_id, h.local_date, h.hour, h.temp, h.humidity, abs(17 - i.inertia_temp) * CASE WHEN effective_wind >= 10.8 THEN 1.6 WHEN effective_wind >= 8 THEN 1.3 ELSE 1 END *
  CASE WHEN i.inertia_temp > 17 THEN greatest(0.1, 1 + felt * 0.5) ELSE least(1, greatest(0, 1 - felt)) END AS lw
 FROM hourly_log h JOIN felt f ON h.site_id = f.site_id AND h.local_date = f.local_date AND h.hour = f.hour JOIN inertia_hours i ON h.site_id = i.site_id AND h.ts = i.ts),
x AS (SELECT m.*, coalesce(lw, 0) AS lw, temp, humidity, sum(CASE WHEN mode <> 'dhw' THEN greatest(0, th) ELSE 0 END) OVER d AS tth, sum(CASE WHEN mode <> 'dhw' THEN greatest(0, el) ELSE 0 END) OVER d AS tel,
  sum(coalesce(lw, 0)) OVER d AS tw, count(*) OVER d AS n FROM mpc m LEFT JOIN wts w ON m.site_id = w.site_id AND m.local_date = w.local_date AND m.hour = w.hour WINDOW d AS (PARTITION BY m.site_id, m.local_date)),
y AS (SELECT *, CASE WHEN tw > 0 THEN tth * lw / tw ELSE tth / n END AS s, 35 + site_id % 3 AS lwt FROM x),
z AS (SELECT *, round(s / CASE WHEN lwt > coalesce(temp, 17) THEN greatest(1, least(10, 0.42 * (lwt + 273.15) / (lwt - coalesce(temp, 17)) * CASE WHEN coalesce(temp, 17) < 7 AND coalesce(humidity, 50) > 70 THEN 0.85 ELSE 1 END)) ELSE 1 END + 1e-9, 3) AS rw FROM y),
o AS (SELECT *, round(rw * CASE WHEN tel > 0 AND sum(rw) OVER (PARTITION BY site_id, local_date) > 0 THEN tel / sum(rw) OVER (PARTITION BY site_id, local_date) ELSE 1 END + 1e-9, 3) AS syn FROM z)"""
MPC_SQL = "mpc AS (SELECT site_id, local_date, hour, CASE WHEN mode = 'dhw' THEN 'dhw' ELSE 'sh' END AS mode, actual_kwh * 3.2 AS th, actual_kwh AS el FROM hourly_unit WHERE unit_id = 'unit_0')"
add_oracle_tables(synthetic_hours=f"WITH {MPC_SQL}, {SMEAR_CTES} SELECT site_id, local_date, hour, mode, lw, s, syn FROM o")


def mpc_hours(t):
    u = t.hourly_unit.filter("unit_id = 'unit_0'")
    return u.select("site_id", "local_date", "hour", F.when(F.col("mode") == "dhw", "dhw").otherwise("sh").alias("mode"),
                    (F.col("actual_kwh") * 3.2).alias("kwh_th_sh"), F.col("actual_kwh").alias("kwh_el_sh"))


def synthetic(t):
    return L.synthetic_baseline(mpc_hours(t), W.inertia(t.hourly_log), cop_params(t))


@query("synthetic_baseline", "L7", "site_id:i local_date:d hour:i mode:s loss_weight:f smeared_kwh_th:f synthetic_kwh_el:f", """
SELECT site_id, local_date, hour, mode, lw AS loss_weight, round(s + 1e-9, 3) AS smeared_kwh_th, syn AS synthetic_kwh_el FROM synthetic_hours""")
def _(t):
    return synthetic(t)


@query("smear_daily", "L8", "site_id:i local_date:d hour:i smeared_kwh_th:f synthetic_kwh_el:f", f"""
WITH mpc AS (SELECT site_id, local_date, unnest(range(24)) AS hour, 'sh' AS mode, q / 24 AS th, q / 24 AS el FROM (SELECT site_id, local_date, sum(actual_kwh) AS q FROM hourly_unit GROUP BY 1, 2)),
{SMEAR_CTES} SELECT site_id, local_date, hour, round(s + 1e-9, 3) AS smeared_kwh_th, syn AS synthetic_kwh_el FROM o""")
def _(t):
    d = t.hourly_unit.groupBy("site_id", "local_date").agg(F.sum("actual_kwh").alias("q_adjusted"))
    return L.smear_daily(d, W.inertia(t.hourly_log), cop_params(t))


add_oracle_tables(strategy_hours="""
WITH w AS (SELECT *, abs(17 - temp) * CASE WHEN effective_wind >= 10.8 THEN 1.6 WHEN effective_wind >= 8 THEN 1.3 ELSE 1 END *
  CASE WHEN temp > 17 THEN greatest(0.1, 1 + solar_factor * 0.5) ELSE least(1, greatest(0, 1 - solar_factor)) END AS lw FROM hourly_log),
v AS (SELECT *, CASE WHEN sum(lw) OVER d > 0 THEN lw / sum(lw) OVER d ELSE 1 / 24.0 END AS share FROM w WINDOW d AS (PARTITION BY site_id, local_date)),
u AS (SELECT h.*, strategy FROM hourly_unit h JOIN unit_dim d ON h.site_id = d.site_id AND h.unit_id = d.unit_id WHERE mode NOT IN ('off','dhw','guest_heating','guest_cooling')),
c AS (SELECT site_id, ts, actual_kwh AS dr, 0.0 AS sm FROM u WHERE strategy = 'direct' AND actual_kwh > 0
 UNION ALL SELECT u.site_id, u.ts, 0, syn FROM u JOIN synthetic_hours s ON u.site_id = s.site_id AND u.local_date = s.local_date AND u.hour = s.hour WHERE strategy = 'synthetic' AND syn > 0
 UNION ALL SELECT v.site_id, v.ts, 0, tot * share FROM (SELECT site_id, unit_id, local_date, sum(actual_kwh) AS tot FROM u WHERE strategy = 'weighted' GROUP BY 1, 2, 3) q JOIN v ON q.site_id = v.site_id AND q.local_date = v.local_date
  LEFT JOIN (SELECT * FROM hourly_unit WHERE mode IN ('off','dhw','guest_heating','guest_cooling')) b ON b.site_id = q.site_id AND b.unit_id = q.unit_id AND b.ts = v.ts WHERE b.ts IS NULL AND tot > 0 AND share > 0),
g AS (SELECT site_id, ts, sum(dr) AS dr, sum(sm) AS sm FROM c GROUP BY 1, 2)
SELECT g.site_id, g.ts, CAST(round_even(temp, 0) AS INT) AS temp_key, wind_bucket, dr AS direct, sm AS smear,
 CASE WHEN dr > 0 AND coalesce(solar_normalization_delta_4d, solar_normalization_delta, 0) <> 0 THEN greatest(0, dr + coalesce(solar_normalization_delta_4d, solar_normalization_delta, 0)) ELSE dr END + sm AS total_kwh
FROM g JOIN v ON g.site_id = v.site_id AND g.ts = v.ts""")


@query("strategy_contributions", "L9", "site_id:i ts:t temp_key:i wind_bucket:s direct:f smear:f total_kwh:f", "SELECT * FROM strategy_hours WHERE total_kwh > 0")
def _(t):
    return L.strategy_contributions(t.hourly_unit, t.hourly_log, t.units, synthetic(t))


@query("train_strategies", "L9", "site_id:i temp_key:i wind_bucket:s kwh:f samples:i", """
SELECT site_id, temp_key, wind_bucket, st.v AS kwh, st.n AS samples FROM (""" + fold_sql(
    "SELECT * FROM strategy_hours WHERE total_kwh > 0", CELL, "ts", {"v": D(0), "x": D("total_kwh"), "s": D(0), "n": "CAST(0 AS BIGINT)"},
    {"s": "a.s + x.x", "n": "a.n + 1", "v": "CASE WHEN a.n < 3 THEN 0 WHEN a.n = 3 THEN round((a.s + x.x) / 4 + 1e-9, 5) ELSE round(a.v + 0.01 * (x.x - a.v) + 1e-9, 5) END"}) + ") WHERE st.n >= 4")
def _(t):
    return L.train_strategies(L.strategy_contributions(t.hourly_unit, t.hourly_log, t.units, synthetic(t)))


@query("train_screen_policy", "L13", "site_id:i state:s az_bucket:i elev_bucket:i correction_percent:f", """
SELECT site_id, state, az_bucket, elev_bucket, st.v AS correction_percent FROM (""" + fold_sql(
    """SELECT site_id, CASE WHEN temp < 17 THEN CASE WHEN solar_factor > 0.1 THEN 'maximize_solar' ELSE 'insulate' END WHEN solar_factor > 0.1 THEN 'mitigate_solar' ELSE 'none' END AS state, ts,
  CAST(floor(sun_azim / 30) * 30 AS INT) % 360 AS az_bucket, CAST(floor(sun_elev / 10) * 10 AS INT) AS elev_bucket, correction_percent AS x FROM hourly_log WHERE sun_elev > 0 AND cloud_coverage < 20""",
    "site_id, state, az_bucket, elev_bucket", "ts", {"v": D(0), "x": D("x"), "n": "CAST(0 AS BIGINT)"},
    {"n": "a.n + 1", "v": "CASE WHEN a.n = 0 THEN x.x ELSE round(a.v + 0.1 * (x.x - a.v) + 1e-9, 1) END"}) + ") WHERE state <> 'none'")
def _(t):
    return L.train_screen_policy(E.screen_recommendation(t.hourly_log))
