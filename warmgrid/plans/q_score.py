"""Scoring queries: one SQL generator mirrors the whole score for every variant."""

from dataclasses import replace

from pyspark.sql import functions as F

from warmgrid.operators import enrich as E
from warmgrid.operators import joins as J
from warmgrid.operators import rollup as A
from warmgrid.operators import score as M
from warmgrid.plans.q_joins import keyed, unit_cells
from warmgrid.plans.q_timeseries import south_gates, unit_sun
from warmgrid.plans.registry import query
from warmgrid.sources.fixture_tables import add_oracle_tables

# --- the models the score reads: plain means; cells that never occurred are their gaps ---

add_oracle_tables(
    m_base="""SELECT site_id, CAST(round_even(temp, 0) AS INT) AS temp_key, wind_bucket, round(avg(actual_kwh) + 1e-9, 5) AS kwh, min(ts) AS first_ts
FROM hourly_log GROUP BY 1, 2, 3""",
    m_aux="""SELECT site_id, temp_key, wind_bucket, round(kwh * 0.3 + 1e-9, 5) AS kwh, first_ts FROM m_base""",
    m_unit="""SELECT site_id, unit_id, temp_key, CASE WHEN mode = 'cooling' THEN 'cooling' ELSE wind_bucket END AS wind_bucket, round(avg(actual_kwh) + 1e-9, 5) AS kwh, min(ts) AS first_ts
FROM unit_cells GROUP BY 1, 2, 3, 4""",
    m_unit_aux="""SELECT site_id, unit_id, temp_key, wind_bucket, round(kwh * 0.4 + 1e-9, 5) AS kwh, first_ts FROM m_unit""",
    m_solar="""SELECT site_id, unit_id, regime, round(x * 0.5 + 1e-9, 4) AS s, round(x * 0.3 + 1e-9, 4) AS e, round(x * 0.2 + 1e-9, 4) AS w, round(x * 0.0004 + 1e-9, 6) AS d,
 unit_id <> 'unit_3' OR regime = 'heating' AND site_id % 2 = 0 AS learned FROM (SELECT site_id, unit_id, CASE WHEN mode IN ('cooling','guest_cooling') THEN 'cooling' ELSE 'heating' END AS regime, avg(actual_kwh) AS x FROM hourly_unit GROUP BY 1, 2, 3)""",
    score_hours="""SELECT h.site_id, h.ts, h.local_date, h.hour, temp, CAST(round_even(temp, 0) AS INT) AS temp_key, effective_wind, wind_bucket, auxiliary_active, actual_kwh, solar_factor, cloud_coverage,
 solar_vector_s / t_s AS pot_s, solar_vector_e / t_e AS pot_e, solar_vector_w / t_w AS pot_w, CASE WHEN h.hour % 4 = 0 THEN 0.2 ELSE 0 END AS carry_state FROM (
 SELECT h.*, 0.3 + 0.7 * correction_percent / 100 AS t_s, CASE WHEN screen_e THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS t_e,
 CASE WHEN screen_w THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS t_w FROM hourly_log h JOIN site_dim s ON h.site_id = s.site_id) h""",
    score_modes="SELECT site_id, unit_id, ts, mode FROM hourly_unit",
)


def fallback_sql(rows: str, model: str, keys: str, out: str) -> str:
    """Every row of ``rows`` with the regime-aware lookup in ``model`` as column ``out``."""
    ks = [k.strip() for k in keys.split(",")]
    eq = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in ks)
    at = lambda p: f"CASE r.wind_bucket WHEN 'normal' THEN {p}.nn WHEN 'high_wind' THEN {p}.hh WHEN 'extreme_wind' THEN {p}.ee ELSE {p}.cc END"
    return f"""(WITH wide AS (SELECT {keys}, temp_key, max(kwh) FILTER (wind_bucket = 'normal') AS nn, max(kwh) FILTER (wind_bucket = 'high_wind') AS hh,
 max(kwh) FILTER (wind_bucket = 'extreme_wind') AS ee, max(kwh) FILTER (wind_bucket = 'cooling') AS cc, min(first_ts) AS f FROM {model} GROUP BY {keys}, temp_key),
tk AS (SELECT DISTINCT {keys}, temp_key FROM {rows}),
near AS (SELECT * FROM (SELECT {", ".join("t." + k for k in ks)}, t.temp_key, w.temp_key AS nk, w.nn, w.hh, w.ee, w.cc,
 row_number() OVER (PARTITION BY {", ".join("t." + k for k in ks)}, t.temp_key ORDER BY abs(t.temp_key - w.temp_key), w.f, w.temp_key) AS rn FROM tk t JOIN wide w ON {eq("t", "w")} AND t.temp_key <> w.temp_key) WHERE rn = 1),
j AS (SELECT r.*, abs(17.0 - r.temp) AS dt, near.nk, o.nn AS o_n, o.hh AS o_h, o.ee AS o_e, o.cc AS o_c, {at("o")} AS exact, {at("a")} AS lo, {at("b")} AS hi,
 CASE r.wind_bucket WHEN 'extreme_wind' THEN coalesce(o.hh, o.nn) WHEN 'cooling' THEN NULL ELSE o.nn END AS calm,
 CASE r.wind_bucket WHEN 'cooling' THEN near.cc WHEN 'normal' THEN coalesce(near.nn, near.hh, near.ee) WHEN 'high_wind' THEN coalesce(near.hh, near.nn, near.ee) ELSE coalesce(near.ee, near.hh, near.nn) END AS nv
 FROM {rows} r LEFT JOIN wide o ON {eq("r", "o")} AND r.temp_key = o.temp_key LEFT JOIN wide a ON {eq("r", "a")} AND a.temp_key = r.temp_key - 1
 LEFT JOIN wide b ON {eq("r", "b")} AND b.temp_key = r.temp_key + 1 LEFT JOIN near ON {eq("r", "near")} AND r.temp_key = near.temp_key)
SELECT * EXCLUDE (dt, nk, o_n, o_h, o_e, o_c, exact, lo, hi, calm, nv), coalesce(exact, CASE WHEN dt <= 4 THEN coalesce((lo + hi) / 2, lo, hi, calm) END,
 CASE WHEN nk IS NULL THEN CASE WHEN wind_bucket = 'cooling' THEN coalesce(o_c, 0) WHEN wind_bucket = 'extreme_wind' THEN coalesce(o_h, o_n, 0) ELSE coalesce(o_n, o_h, o_e, 0) END
  WHEN coalesce(nv, 0) <= 0.001 THEN 0 WHEN abs(17 - nk) < CASE WHEN dt > 4 THEN 1.0 ELSE 0.5 END THEN nv ELSE round(nv * dt / abs(17 - nk) + 1e-9, 3) END) AS {out} FROM j)"""


def score_sql(hours: str, modes: str = "score_modes", keys: str = "site_id, ts", solar: str = "3d", carry: bool = False) -> str:
    """The full score of the rows in table ``hours``."""
    ks = [k.strip() for k in keys.split(",")]
    hk = ", ".join(f"h.{k}" for k in ks)
    if solar == "3d":
        sol = """CASE WHEN NOT solar_affected THEN 0 WHEN coalesce(learned, false) THEN greatest(0, s * pot_s + e * pot_e + w * pot_w) WHEN u.regime = 'heating' THEN 0.35 * pot_s ELSE 0 END"""
        pots = "h.pot_s, h.pot_e, h.pot_w"
    else:
        sol = """CASE WHEN solar_affected AND coalesce(learned AND (s <> 0 OR e <> 0 OR w <> 0 OR d <> 0), false) THEN greatest(0, s * p4_s + e * p4_e + w * p4_w + d * p4_d) ELSE 0 END"""
        pots = "h.p4_s, h.p4_e, h.p4_w, h.p4_d"
    rnd = lambda x, n: f"round({x} + 1e-9, 3) AS {n}"
    release = "CASE WHEN carry_state > 0 AND heat_only > 0 THEN least(carry_state * 0.5, heat_only) ELSE 0 END" if carry else "0"
    return f"""
WITH uh AS (SELECT {hk}, h.temp, h.temp_key, h.auxiliary_active, {pots}, d.unit_id, d.aux_affected, d.solar_affected, coalesce(m.mode, 'heating') AS mode,
  CASE WHEN m.mode = 'cooling' THEN 'cooling' ELSE h.wind_bucket END AS wind_bucket, CASE WHEN m.mode IN ('cooling','guest_cooling') THEN 'cooling' ELSE 'heating' END AS regime
 FROM {hours} h JOIN unit_dim d ON h.site_id = d.site_id LEFT JOIN {modes} m ON m.site_id = h.site_id AND m.ts = h.ts AND m.unit_id = d.unit_id),
ub AS MATERIALIZED (SELECT * FROM {fallback_sql("uh", "m_unit", "site_id, unit_id", "base")}),
ua AS MATERIALIZED (SELECT * FROM {fallback_sql("ub", "m_unit_aux", "site_id, unit_id", "xa")}),
us AS (SELECT u.*, CASE WHEN auxiliary_active AND aux_affected THEN xa ELSE 0 END AS raw_aux, {sol} AS solar FROM ua u
 LEFT JOIN m_solar c ON u.site_id = c.site_id AND u.unit_id = c.unit_id AND u.regime = c.regime),
un AS (SELECT *, least(raw_aux, base) AS aap, raw_aux - least(raw_aux, base) AS aov, base - least(raw_aux, base) AS aft, mode IN ('heating','guest_heating') AS heat, mode IN ('cooling','guest_cooling') AS cool FROM us),
uf AS (SELECT *, round(CASE WHEN heat THEN least(solar, greatest(0, aft)) WHEN cool THEN solar ELSE 0 END + 1e-9, 3) AS ap, round(CASE WHEN heat THEN solar - least(solar, greatest(0, aft)) ELSE 0 END + 1e-9, 3) AS wa,
 round(CASE WHEN heat THEN greatest(0, aft - least(solar, greatest(0, aft))) WHEN cool THEN aft + solar WHEN mode = 'off' THEN 0 ELSE aft END + 1e-9, 3) AS net FROM un),
p AS (SELECT {keys}, sum(base) AS ub_, sum(aap) AS uax, sum(aov) AS uov, sum(ap) AS uap, sum(wa) AS uwa, sum(net) AS une, coalesce(sum(base) FILTER (aux_affected AND auxiliary_active), 0) AS bax,
 coalesce(sum(aft) FILTER (cool AND solar_affected), 0) AS bc, coalesce(sum(aft) FILTER (heat AND solar_affected), 0) AS bh,
 coalesce(sum(aft) FILTER (((cool OR heat) AND NOT solar_affected) OR (NOT cool AND NOT heat AND mode <> 'off')), 0) AS br, coalesce(sum(ap) FILTER (cool), 0) AS ac, coalesce(sum(ap) FILTER (NOT cool), 0) AS ah,
 coalesce(sum(net) FILTER (cool), 0) AS cn, coalesce(sum(net) FILTER (NOT cool), 0) AS hn, coalesce(sum(net) FILTER (heat), 0) AS heat_only FROM uf GROUP BY {keys}),
hb AS MATERIALIZED (SELECT * FROM {fallback_sql(hours, "m_base", "site_id", "gb")}),
ha AS MATERIALIZED (SELECT * FROM {fallback_sql("hb", "m_aux", "site_id", "gx")}),
j AS (SELECT {hk}, h.* EXCLUDE ({keys}), CASE WHEN auxiliary_active THEN gx ELSE 0 END AS ga, p.* EXCLUDE ({keys}) FROM ha h JOIN p ON {" AND ".join(f"h.{k} = p.{k}" for k in ks)}),
k AS (SELECT *, bh + bc + br > 1e-9 AS sp, greatest(0, gb - CASE WHEN bh + bc + br > 1e-9 THEN least(ga, gb * CASE WHEN ub_ > 0 THEN bax / ub_ ELSE 0 END) ELSE ga END) AS an FROM j),
l AS (SELECT *, CASE WHEN sp THEN least(ah, bh * an / (bh + bc + br)) ELSE ah END AS hap FROM k),
q AS (SELECT *, CASE WHEN sp THEN an - hap + ac ELSE greatest(0, an + ac - ah) END AS nt, {release} AS rel, CASE WHEN auxiliary_active AND ga - uax - uov > 0.001 THEN ga - uax - uov ELSE 0 END AS orp FROM l),
z AS (SELECT *, CASE WHEN rel > 0 THEN greatest(0, nt - rel) ELSE nt END AS tk_ FROM q)
SELECT {keys}, {rnd("tk_", "total_kwh")}, {rnd("gb", "base_kwh")}, {rnd("ga", "aux_kwh")}, {rnd("greatest(0, hn - rel)", "heating_kwh")}, {rnd("cn", "cooling_kwh")}, {rnd("uap - (ah - hap)", "solar_kwh")},
 {rnd("uwa + ah - hap", "wasted_kwh")}, {rnd("hap", "solar_heating_kwh")}, {rnd("ac", "solar_cooling_kwh")}, {rnd("rel", "release_kwh")}, {rnd("uov + orp", "unassigned_aux")}, {rnd("orp", "orphaned_aux")},
 {rnd("tk_ - greatest(0, une - rel)", "unspecified_kwh")} FROM z"""


def models(t) -> M.Models:
    h = keyed(t)
    r5 = lambda x: F.round(x + 1e-9, 5)
    base = h.groupBy("site_id", "temp_key", "wind_bucket").agg(r5(F.avg("actual_kwh")).alias("kwh"), F.min("ts").alias("first_ts"))
    base = t.stored("m_base", lambda b=base: b)
    aux = base.withColumn("kwh", r5(F.col("kwh") * 0.3))
    u = unit_cells(t).withColumn("wind_bucket", F.when(F.col("mode") == "cooling", "cooling").otherwise(F.col("wind_bucket")))
    ub = u.groupBy("site_id", "unit_id", "temp_key", "wind_bucket").agg(r5(F.avg("actual_kwh")).alias("kwh"), F.min("ts").alias("first_ts"))
    ub = t.stored("m_unit", lambda b=ub: b)
    ux = ub.withColumn("kwh", r5(F.col("kwh") * 0.4))
    regime = F.when(F.col("mode").isin("cooling", "guest_cooling"), "cooling").otherwise("heating")
    x = t.hourly_unit.groupBy("site_id", "unit_id", regime.alias("regime")).agg(F.avg("actual_kwh").alias("x"))
    sol = x.select("site_id", "unit_id", "regime", *[F.round(F.col("x") * k + 1e-9, 4).alias(n) for n, k in (("s", 0.5), ("e", 0.3), ("w", 0.2))],
                   F.round(F.col("x") * 0.0004 + 1e-9, 6).alias("d"), ((F.col("unit_id") != "unit_3") | ((F.col("regime") == "heating") & (F.col("site_id") % 2 == 0))).alias("learned"))
    sol = t.stored("m_solar", lambda b=sol: b)
    m = M.Models(base, aux, ub, ux, sol, t.stored("unit_dim", lambda: t.units))
    return replace(m, profiles=t.stored("m_profiles", lambda: M.site_profiles(m)))


def score_hours(t):
    return t.stored("score_hours", lambda: build_score_hours(t))


def build_score_hours(t):
    h = M.with_cell(E.screen_potential(t.hourly_log, t.sites))
    return h.withColumn("carry_state", F.when(F.col("hour") % 4 == 0, 0.2).otherwise(0.0))


SCORE_OUT = ("site_id:i ts:t total_kwh:f base_kwh:f aux_kwh:f heating_kwh:f cooling_kwh:f solar_kwh:f wasted_kwh:f solar_heating_kwh:f solar_cooling_kwh:f "
             "release_kwh:f unassigned_aux:f orphaned_aux:f unspecified_kwh:f")


@query("predict_hours", "M1", SCORE_OUT, score_sql("score_hours", carry=True))
def _(t):
    return M.predict_hours(score_hours(t), t.hourly_unit, models(t))


add_oracle_tables(
 unit_potential_ungated="""SELECT site_id, ts, CASE WHEN sun_elev <= 0 THEN 0 ELSE dni * cos(radians(sun_elev)) * greatest(0, -cos(radians(sun_azim))) * ts_ END AS p4_s,
 CASE WHEN sun_elev <= 0 THEN 0 ELSE dni * cos(radians(sun_elev)) * greatest(0, sin(radians(sun_azim))) * te END AS p4_e,
 CASE WHEN sun_elev <= 0 THEN 0 ELSE dni * cos(radians(sun_elev)) * greatest(0, -sin(radians(sun_azim))) * tw END AS p4_w,
 CASE WHEN sun_elev <= 0 THEN 0 ELSE dhi * 0.5 * (ts_ + te + tw) / 3 END AS p4_d FROM (SELECT h.*, 0.3 + 0.7 * correction_percent / 100 AS ts_, CASE WHEN screen_e THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS te,
  CASE WHEN screen_w THEN 0.3 + 0.7 * correction_percent / 100 ELSE 1 END AS tw FROM hourly_log h JOIN site_dim s ON h.site_id = s.site_id)""",
 score_4d_rows="SELECT h.*, p4_s, p4_e, p4_w, p4_d FROM score_hours h JOIN unit_potential_ungated p ON h.site_id = p.site_id AND h.ts = p.ts",
 scored_3d=score_sql("score_hours"), scored_4d=score_sql("score_4d_rows", solar="4d"))


def hours_4d(t):
    h = E.enrich_potential_4d(E.screen_potential(t.hourly_log, t.sites))
    return M.with_cell(h)


@query("predict_hours_4d", "M2", SCORE_OUT, "SELECT * FROM scored_4d")
def _(t):
    return M.predict_hours(hours_4d(t), t.hourly_unit, models(t), four_d=True)


add_oracle_tables(pure_hours="SELECT * REPLACE (false AS auxiliary_active) FROM score_hours", scored_pure=score_sql("pure_hours"))


@query("predict_pure_model", "M3", "site_id:i ts:t total_kwh:f solar_kwh:f", "SELECT site_id, ts, total_kwh, solar_kwh FROM scored_pure")
def _(t):
    return M.predict_pure_model(score_hours(t).drop("carry_state"), t.hourly_unit, models(t))


# --- three-branch modelled energy: January hours, vector days, bare days -----------

add_oracle_tables(
    point_rows="""
SELECT *, CAST(round_even(temp, 0) AS INT) AS temp_key, CASE WHEN effective_wind >= 10.8 THEN 'extreme_wind' WHEN effective_wind >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket,
 coalesce(solar_factor, 0) AS pot_s, 0.0 AS pot_e, 0.0 AS pot_w, false AS auxiliary_active FROM (
SELECT site_id, local_date, ts, 'log' AS branch, 1.0 AS mult, round(temp + 1e-9, 6) AS temp, abs(17 - temp) / 24 AS tdd_share, effective_wind, actual_kwh AS load, solar_factor FROM hourly_log WHERE day(local_date) <= 10
UNION ALL SELECT v.site_id, v.local_date, v.ts, 'vector', 1.0, round(CASE WHEN v.tdd * 24 > 0.1 THEN CASE WHEN temp >= 17 THEN 17 + v.tdd * 24 ELSE 17 - v.tdd * 24 END ELSE temp END + 1e-9, 6), v.tdd, effective_wind, actual_kwh, solar_factor
 FROM hourly_log v JOIN (SELECT site_id, local_date FROM hourly_log GROUP BY 1, 2 HAVING count(*) >= 20) g ON v.site_id = g.site_id AND v.local_date = g.local_date WHERE day(v.local_date) BETWEEN 11 AND 20 OR (day(v.local_date) > 20 AND day(v.local_date) % 2 = 0)
UNION ALL SELECT site_id, local_date, CAST(local_date AS TIMESTAMP), 'daily', 24.0, round(CASE WHEN tdd > 0.1 THEN CASE WHEN temp >= 17 THEN 17 + tdd ELSE 17 - tdd END ELSE temp END + 1e-9, 6), tdd, wind, kwh, solar_factor
 FROM day_agg d WHERE (day(local_date) > 20 AND day(local_date) % 2 = 1) OR (day(local_date) > 10 AND n_hours < 20))""",
    point_modes="""SELECT * FROM score_modes WHERE day(ts) <= 10 UNION ALL SELECT p.site_id, d.unit_id, p.ts, CASE WHEN temp < 17 THEN 'heating' ELSE 'cooling' END FROM point_rows p JOIN unit_dim d ON p.site_id = d.site_id WHERE branch <> 'log'""",
    point_scores=score_sql("point_rows", "point_modes"),
    modeled_days="""SELECT p.site_id, p.local_date, max(branch) AS branch, sum(s.total_kwh * mult) AS modeled_kwh, sum(s.solar_kwh * mult) AS solar_kwh, sum(tdd_share) AS tdd,
 CASE WHEN sum(load) > 0.001 THEN sum(temp * load) / sum(load) ELSE avg(temp) END AS temp, CASE WHEN sum(load) > 0.001 THEN sum(effective_wind * load) / sum(load) ELSE avg(effective_wind) END AS wind
 FROM point_rows p JOIN point_scores s ON p.site_id = s.site_id AND p.ts = s.ts GROUP BY 1, 2""")


def model_points(t):
    """Days 1-10 keep their log; later days only have vectors or (odd days past 20) bare totals."""
    d = F.dayofmonth("local_date")
    vec = A.hourly_vectors(t.hourly_log).filter((d <= 20) | (d % 2 == 0))
    daily = A.daily_scalars(t.hourly_log).select("site_id", "local_date", "temp", "tdd", "wind", "kwh", "solar_factor").join(vec, ["site_id", "local_date"], "left")
    log = t.hourly_log.filter(d <= 10)
    return M.modeled_points(log, daily, F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-31")))


def modeled_days(t):
    # the points feed the lookup grids, the unit fan-out and the final join: store them once
    pts = t.stored("model_points", lambda: model_points(t))
    return M.modeled_energy(pts, t.hourly_unit.filter(F.dayofmonth("local_date") <= 10), models(t))


@query("modeled_energy", "M4", "site_id:i local_date:d branch:s modeled_kwh:f solar_kwh:f tdd:f temp:f wind:f", "SELECT * FROM modeled_days")
def _(t):
    return modeled_days(t)


add_oracle_tables(pure_days="SELECT site_id, CAST(ts AS DATE) AS local_date, sum(total_kwh) AS modeled_kwh, sum(solar_kwh) AS solar_kwh FROM scored_pure GROUP BY 1, 2")


@query("modeled_totals", "M4", "site_id:i days:i modeled_kwh:f solar_kwh:f temp:f wind:f tdd:f", """
SELECT site_id, count(*) AS days, round(sum(modeled_kwh) + 1e-9, 2) AS modeled_kwh, round(sum(solar_kwh) + 1e-9, 2) AS solar_kwh, round(avg(temp) + 1e-9, 1) AS temp, round(avg(wind) + 1e-9, 1) AS wind,
 round(sum(tdd) + 1e-9, 1) AS tdd FROM modeled_days GROUP BY 1""")
def _(t):
    return M.modeled_totals(modeled_days(t))


@query("compare_periods", "M5", "site_id:i p1_kwh:f p2_kwh:f p1_deviation:f p2_deviation:f p1_deviation_pct:f p1_efficiency:f p2_efficiency:f p1_basis:s p2_basis:s delta_kwh:f delta_temp:f delta_wind:f", """
WITH a AS (SELECT site_id, sum(kwh) FILTER (y = 1) AS k1, sum(kwh) FILTER (y = 2) AS k2, sum(expected_kwh) FILTER (y = 1) AS m1, sum(expected_kwh) FILTER (y = 2) AS m2, sum(tdd) FILTER (y = 1) AS t1, sum(tdd) FILTER (y = 2) AS t2,
 avg(temp) FILTER (y = 1) AS c1, avg(temp) FILTER (y = 2) AS c2, avg(wind) FILTER (y = 1) AS w1, avg(wind) FILTER (y = 2) AS w2 FROM (
 SELECT *, CASE WHEN local_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31' THEN 1 WHEN local_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' THEN 2 END AS y FROM daily_history) GROUP BY 1)
SELECT site_id, k1 AS p1_kwh, k2 AS p2_kwh, round(k1 - m1 + 1e-9, 2) AS p1_deviation, round(k2 - m2 + 1e-9, 2) AS p2_deviation, round((k1 - m1) / m1 * 100 + 1e-9, 1) AS p1_deviation_pct, round(k1 / t1 + 1e-9, 3) AS p1_efficiency,
 round(k2 / t2 + 1e-9, 3) AS p2_efficiency, 'hybrid' AS p1_basis, 'actual' AS p2_basis, k1 - k2 AS delta_kwh, c1 - c2 AS delta_temp, w1 - w2 AS delta_wind FROM a""")
def _(t):
    d = lambda x: F.to_date(F.lit(x))
    days = t.daily.withColumnsRenamed({"expected_kwh": "modeled_kwh", "solar_impact_kwh": "solar_kwh"})
    return M.compare_periods(days, (d("1998-01-01"), d("1998-03-31")), (d("1997-01-01"), d("1997-03-31")), d("1998-03-20"))


add_oracle_tables(savings_rows="SELECT * REPLACE (variant = 1 AS auxiliary_active) FROM (SELECT *, unnest([0, 1]) AS variant FROM score_hours)",
                  savings_scores=score_sql("savings_rows", keys="site_id, ts, variant"),
                  calm_rows="SELECT * REPLACE (CASE WHEN variant = 1 THEN 'normal' ELSE wind_bucket END AS wind_bucket) FROM (SELECT *, unnest([0, 1]) AS variant FROM score_hours)",
                  calm_scores=score_sql("calm_rows", keys="site_id, ts, variant"))


@query("aux_savings", "M6", "site_id:i local_date:d normal_kwh:f aux_kwh:f savings_kwh:f hours:i missing_data:b", """
SELECT site_id, CAST(ts AS DATE) AS local_date, sum(n) AS normal_kwh, sum(a) AS aux_kwh, sum(n - a) AS savings_kwh, count(*) AS hours, bool_or(n = a AND n > 0 AND r = 0) AS missing_data FROM (
SELECT site_id, ts, sum(total_kwh) FILTER (variant = 0) AS n, sum(total_kwh) FILTER (variant = 1) AS a, sum(aux_kwh) FILTER (variant = 1) AS r FROM savings_scores GROUP BY 1, 2) GROUP BY 1, 2""")
def _(t):
    return M.aux_savings(score_hours(t).drop("carry_state"), t.hourly_unit, models(t))


@query("wind_penalty", "M7", "site_id:i local_date:d wind_penalty_kwh:f hours:i", """
SELECT site_id, CAST(ts AS DATE) AS local_date, sum(greatest(0, p)) AS wind_penalty_kwh, count(*) AS hours FROM (
SELECT site_id, ts, sum(CASE WHEN variant = 0 THEN total_kwh ELSE -total_kwh END) AS p FROM calm_scores GROUP BY 1, 2) GROUP BY 1, 2""")
def _(t):
    return M.wind_penalty(score_hours(t).drop("carry_state"), t.hourly_unit, models(t))


@query("hybrid_projection", "M8", "site_id:i local_date:d basis:s kwh:f", """
WITH w AS (SELECT site_id, CAST(unnest(range(DATE '1998-06-01', DATE '1998-07-01', INTERVAL 1 DAY)) AS DATE) AS local_date FROM (SELECT DISTINCT site_id FROM daily_history)),
x AS (SELECT *, CAST(make_date(isoyear(local_date) - 1, 1, 4) AS DATE) AS j4 FROM w),
y AS (SELECT *, j4 - CAST(isodow(j4) - 1 AS INT) + CAST((weekofyear(local_date) - 1) * 7 + isodow(local_date) - 1 AS INT) AS ly FROM x)
SELECT y.site_id, y.local_date, CASE WHEN y.local_date < DATE '1998-06-15' THEN 'modeled' WHEN f.kwh IS NOT NULL THEN 'forecast' WHEN l.expected_kwh IS NOT NULL THEN 'last_year' ELSE 'none' END AS basis,
 CASE WHEN y.local_date < DATE '1998-06-15' THEN coalesce(p.expected_kwh, 0) ELSE coalesce(f.kwh, l.expected_kwh, 0) END AS kwh
FROM y LEFT JOIN daily_history p ON p.site_id = y.site_id AND p.local_date = y.local_date LEFT JOIN (SELECT * FROM daily_history WHERE day(local_date) <= 20) f ON f.site_id = y.site_id AND f.local_date = y.local_date
LEFT JOIN daily_history l ON l.site_id = y.site_id AND l.local_date = y.ly""")
def _(t):
    d = lambda x: F.to_date(F.lit(x))
    plan = t.daily.filter(F.dayofmonth("local_date") <= 20).select("site_id", "local_date", "kwh")
    return M.hybrid_projection(t.daily.withColumnRenamed("expected_kwh", "modeled_kwh"), plan, d("1998-06-15"), d("1998-06-01"), d("1998-06-30"))


LY_SQL = """
SELECT n.site_id, m AS model_so_far, days_so_far, ly_total, ly_so_far, ly_remaining, m - coalesce(ly_so_far, 0) AS delta_so_far FROM (
SELECT site_id, sum(expected_kwh) AS m, count(*) AS days_so_far FROM daily_history WHERE local_date >= DATE '{s}' AND local_date < DATE '1998-06-18' GROUP BY 1) n FULL JOIN (
SELECT site_id, sum(kwh) AS ly_total, sum(kwh) FILTER (local_date < DATE '{x}') AS ly_so_far, sum(kwh) FILTER (local_date >= DATE '{x}') AS ly_remaining FROM daily_history WHERE local_date BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1) l ON n.site_id = l.site_id"""
LY_OUT = "site_id:i model_so_far:f days_so_far:i ly_total:f ly_so_far:f ly_remaining:f delta_so_far:f"


@query("model_vs_last_year_week", "M9", LY_OUT, LY_SQL.format(s="1998-06-15", a="1997-06-16", b="1997-06-22", x="1997-06-19"))
def _(t):
    return M.model_vs_last_year(t.daily.withColumnRenamed("expected_kwh", "modeled_kwh"), t.daily, F.to_date(F.lit("1998-06-18")), "week")


@query("model_vs_last_year_month", "M9", LY_OUT, LY_SQL.format(s="1998-06-01", a="1997-06-01", b="1997-06-30", x="1997-06-18"))
def _(t):
    return M.model_vs_last_year(t.daily.withColumnRenamed("expected_kwh", "modeled_kwh"), t.daily, F.to_date(F.lit("1998-06-18")), "month")


@query("solar_delta", "M11", "site_id:i ts:t solar_delta:f", """
SELECT u.site_id, u.ts, sum(CASE WHEN u.mode = 'heating' THEN 1 ELSE -1 END * greatest(0, s * pot_s + e * pot_e + w * pot_w)) AS solar_delta FROM hourly_unit u JOIN score_hours h ON u.site_id = h.site_id AND u.ts = h.ts
JOIN m_solar c ON c.site_id = u.site_id AND c.unit_id = u.unit_id AND c.regime = u.mode WHERE u.mode IN ('heating','cooling') GROUP BY 1, 2""")
def _(t):
    pots = score_hours(t).select("site_id", "ts", "pot_s", "pot_e", "pot_w")
    return M.solar_delta(t.hourly_unit.join(pots, ["site_id", "ts"]), models(t).solar)


add_oracle_tables(
    revision_rows="""SELECT h.* REPLACE (CASE WHEN variant = 1 THEN f.temperature ELSE h.temp END AS temp, CAST(round_even(CASE WHEN variant = 1 THEN f.temperature ELSE h.temp END, 0) AS INT) AS temp_key,
 CASE WHEN CASE WHEN variant = 1 THEN f.wind_speed ELSE h.effective_wind END >= 10.8 THEN 'extreme_wind' WHEN CASE WHEN variant = 1 THEN f.wind_speed ELSE h.effective_wind END >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket)
 FROM (SELECT *, unnest([0, 1]) AS variant FROM score_hours) h JOIN forecast_items f ON h.site_id = f.site_id AND h.local_date = f.local_date AND h.hour = f.hour AND f.source = 'primary'""",
    revision_scores=score_sql("revision_rows", keys="site_id, ts, variant"))


@query("plan_revision", "M12", "site_id:i local_date:d hours:i revision_kwh:f temp_gap:f has_aux:b driver:s", """
SELECT *, CASE WHEN round(temp_gap + 1e-9, 6) > 1.5 THEN 'warmer' WHEN round(temp_gap + 1e-9, 6) < -1.5 THEN 'colder' END AS driver FROM (
SELECT h.site_id, h.local_date, count(*) AS hours, sum(rev) AS revision_kwh, avg(h.temp - f.temperature) AS temp_gap, bool_or(auxiliary_active) AS has_aux FROM score_hours h
JOIN forecast_items f ON h.site_id = f.site_id AND h.local_date = f.local_date AND h.hour = f.hour AND f.source = 'primary'
JOIN (SELECT site_id, ts, sum(CASE WHEN variant = 0 THEN total_kwh ELSE -total_kwh END) AS rev FROM revision_scores GROUP BY 1, 2) r ON h.site_id = r.site_id AND h.ts = r.ts GROUP BY 1, 2)""")
def _(t):
    h = J.hours_vs_forecast(score_hours(t).drop("carry_state"), t.forecast.filter("source = 'primary'"))
    return M.plan_revision(h, t.hourly_unit, models(t))
