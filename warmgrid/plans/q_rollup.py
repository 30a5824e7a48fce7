"""Aggregations."""

from pyspark.sql import functions as F

from warmgrid.operators import filters as P
from warmgrid.operators import rollup as O
from warmgrid.plans.registry import query
from warmgrid.sources.fixture_tables import add_oracle_tables

R = "round({} + 1e-9, {})"
add_oracle_tables(
    bucketed_samples="""
SELECT *, CASE WHEN effective_wind >= 10.8 THEN 'extreme_wind' WHEN effective_wind >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket
FROM (SELECT *, sp + greatest(0, coalesce(gu - sp, 0)) * 0.6 AS effective_wind FROM (
  SELECT *, CASE wind_unit WHEN 'km/h' THEN wind_speed / 3.6 WHEN 'mph' THEN wind_speed * 0.44704
              WHEN 'kn' THEN wind_speed * 0.514444 ELSE wind_speed END AS sp,
         CASE wind_unit WHEN 'km/h' THEN wind_gust / 3.6 WHEN 'mph' THEN wind_gust * 0.44704
              WHEN 'kn' THEN wind_gust * 0.514444 ELSE wind_gust END AS gu FROM sample_rows))""",
    day_regime="""
SELECT *, CASE WHEN h + c < 0.01 THEN 'idle' WHEN h / (h + c) >= 0.8 THEN 'heating' WHEN c / (h + c) >= 0.8 THEN 'cooling' ELSE 'mixed' END AS regime
FROM (SELECT site_id, local_date, count(DISTINCT unit_id) AS n_units,
  coalesce(sum(actual_kwh) FILTER (mode IN ('heating','guest_heating')), 0) AS h,
  coalesce(sum(actual_kwh) FILTER (mode IN ('cooling','guest_cooling')), 0) AS c FROM hourly_unit GROUP BY 1, 2)""",
    day_agg="""
SELECT a.*, round(r.h + 1e-9, 3) AS regime_heating_kwh, round(r.c + 1e-9, 3) AS regime_cooling_kwh, r.n_units,
  CASE WHEN round(r.h + 1e-9, 3) + round(r.c + 1e-9, 3) < 0.01 THEN 'idle'
   WHEN round(r.h + 1e-9, 3) / (round(r.h + 1e-9, 3) + round(r.c + 1e-9, 3)) >= 0.8 THEN 'heating'
   WHEN round(r.c + 1e-9, 3) / (round(r.h + 1e-9, 3) + round(r.c + 1e-9, 3)) >= 0.8 THEN 'cooling' ELSE 'mixed' END AS regime
FROM (SELECT site_id, local_date, count(*) AS n_hours, round(sum(actual_kwh) + 1e-9, 2) AS kwh, round(sum(expected_kwh) + 1e-9, 2) AS expected_kwh,
  round(sum(forecasted_kwh) + 1e-9, 2) AS forecasted_kwh, round(sum(aux_impact_kwh) + 1e-9, 2) AS aux_impact_kwh,
  round(sum(solar_impact_kwh) + 1e-9, 2) AS solar_impact_kwh, round(sum(guest_impact_kwh) + 1e-9, 2) AS guest_impact_kwh,
  round(sum(coalesce(solar_normalization_delta_4d, solar_normalization_delta)) + 1e-9, 5) AS solar_normalization_delta,
  round(sum(solar_normalization_delta_4d) + 1e-9, 5) AS solar_normalization_delta_4d,
  round(sum(solar_impact_4d_kwh) + 1e-9, 2) AS solar_impact_4d_kwh,
  round(CASE WHEN count(*) = count(thermodynamic_gross_kwh) THEN sum(thermodynamic_gross_kwh)
    ELSE sum(actual_kwh + aux_impact_kwh + CASE WHEN temp >= 17 THEN -solar_impact_kwh ELSE solar_impact_kwh END) END + 1e-9, 2) AS thermodynamic_gross_kwh,
  round(sum(tdd) + 1e-9, 1) AS tdd, round(avg(temp) + 1e-9, 1) AS temp, round(avg(effective_wind) + 1e-9, 1) AS wind,
  round(avg(solar_factor) + 1e-9, 3) AS solar_factor, round(sum(actual_kwh) - sum(expected_kwh) + 1e-9, 2) AS deviation,
  arg_max(primary_entity, ts) AS primary_entity, arg_max(crossover_day, ts) AS crossover_day
  FROM hourly_log GROUP BY 1, 2) a JOIN day_regime r ON a.site_id = r.site_id AND a.local_date = r.local_date""",
    simple_base="""
SELECT site_id, CAST(round_even(temp, 0) AS INT) AS temp_key, wind_bucket, round(avg(actual_kwh) * 1.1 + 1e-9, 5) AS kwh, count(*) AS n
FROM hourly_log WHERE NOT auxiliary_active GROUP BY 1, 2, 3""",
)


def simple_base(t):
    """A plain-mean cell model: input for operators that only need some model."""
    h = t.hourly_log.filter(~F.col("auxiliary_active"))
    return h.groupBy("site_id", F.rint("temp").cast("int").alias("temp_key"), "wind_bucket").agg(
        F.round(F.avg("actual_kwh") * 1.1 + 1e-9, 5).alias("kwh"), F.count("*").alias("n"))


@query("hourly_rollup", "A1",
       "site_id:i hr:t sample_count:i temp:f effective_wind:f wind_bucket:s n_normal:i n_high_wind:i n_extreme_wind:i aux_fraction:f "
       "auxiliary_active:b is_mixed_mode:b humidity:f dni:f dhi:f ghi:f cloud_coverage:f correction_percent:f solar_factor:f "
       "solar_vector_s:f solar_vector_e:f solar_vector_w:f solar_data_time:s", """
SELECT *, CASE WHEN effective_wind >= 10.8 THEN 'extreme_wind' WHEN effective_wind >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket,
  aux_fraction >= 0.8 AS auxiliary_active, aux_fraction > 0.2 AND aux_fraction < 0.8 AS is_mixed_mode FROM (
SELECT site_id, hr, count(*) AS sample_count, avg(temp) AS temp,
  list_sort(list(effective_wind))[CAST(ceil(0.9 * count(*)) AS INT)] AS effective_wind,
  count(*) FILTER (wind_bucket = 'normal') AS n_normal, count(*) FILTER (wind_bucket = 'high_wind') AS n_high_wind,
  count(*) FILTER (wind_bucket = 'extreme_wind') AS n_extreme_wind, avg(CASE WHEN aux_active THEN 1.0 ELSE 0.0 END) AS aux_fraction,
  avg(humidity) AS humidity, avg(dni) AS dni, avg(dhi) AS dhi, avg(ghi) AS ghi, avg(cloud_coverage) AS cloud_coverage,
  avg(correction_percent) AS correction_percent, avg(solar_factor) AS solar_factor, avg(solar_vector_s) AS solar_vector_s,
  avg(solar_vector_e) AS solar_vector_e, avg(solar_vector_w) AS solar_vector_w,
  arg_max(solar_data_time, ts) FILTER (solar_data_time IS NOT NULL) AS solar_data_time
FROM bucketed_samples GROUP BY 1, 2)""")
def _(t):
    return O.hourly_rollup(P.enrich_wind(t.samples))


DAY_OUT = ("site_id:i local_date:d n_hours:i kwh:f expected_kwh:f forecasted_kwh:f aux_impact_kwh:f solar_impact_kwh:f guest_impact_kwh:f "
           "solar_normalization_delta:f solar_normalization_delta_4d:f solar_impact_4d_kwh:f thermodynamic_gross_kwh:f tdd:f temp:f wind:f "
           "solar_factor:f deviation:f primary_entity:s crossover_day:i regime_heating_kwh:f regime_cooling_kwh:f n_units:i regime:s")


@query("daily_rollup", "A2", DAY_OUT, "SELECT * FROM day_agg")
def _(t):
    return O.daily_rollup(t.hourly_log, t.hourly_unit, maps=False)


@query("daily_unit_maps", "A2 F13", "site_id:i local_date:d unit_id:s kwh:f expected_kwh:f", """
SELECT site_id, local_date, unit_id, round(sum(actual_kwh) + 1e-9, 3) AS kwh, round(sum(expected_kwh) + 1e-9, 3) AS expected_kwh
FROM hourly_unit GROUP BY 1, 2, 3""")
def _(t):
    d = O.daily_rollup(t.hourly_log, t.hourly_unit)
    return d.select("site_id", "local_date", "unit_expected_breakdown", F.explode("unit_breakdown").alias("unit_id", "kwh")).withColumn(
        "expected_kwh", F.element_at("unit_expected_breakdown", F.col("unit_id")))


@query("hourly_vectors", "A3 F13",
       "site_id:i local_date:d hour:i temp:f wind:f tdd:f actual_kwh:f solar_rad:f solar_norm_delta:f solar_norm_delta_4d:f dni:f dhi:f", """
SELECT d.site_id, d.local_date, s.hour, temp, wind, tdd, actual_kwh, solar_rad, solar_norm_delta, solar_norm_delta_4d, dni, dhi
FROM (SELECT site_id, local_date, unnest(range(24)) AS hour FROM (SELECT DISTINCT site_id, local_date FROM hourly_log)) s
JOIN (SELECT DISTINCT site_id, local_date FROM hourly_log) d USING (site_id, local_date)
LEFT JOIN (SELECT site_id, local_date, hour, avg(temp) AS temp, avg(effective_wind) AS wind, sum(tdd) AS tdd, sum(actual_kwh) AS actual_kwh,
  avg(solar_factor) AS solar_rad, sum(solar_normalization_delta) AS solar_norm_delta, round(sum(solar_normalization_delta_4d) + 1e-9, 5) AS solar_norm_delta_4d,
  round(avg(dni) + 1e-9, 2) AS dni, round(avg(dhi) + 1e-9, 2) AS dhi FROM hourly_log GROUP BY 1, 2, 3) x
ON s.site_id = x.site_id AND s.local_date = x.local_date AND s.hour = x.hour""")
def _(t):
    v = O.hourly_vectors(t.hourly_log)
    z = F.arrays_zip(*[f"hourly_vectors.{f}" for f in O.VECTOR_FIELDS])
    return v.select("site_id", "local_date", F.posexplode(z).alias("hour", "z")).select("site_id", "local_date", "hour", "z.*")


@query("backfill_daily", "A4", "site_id:i local_date:d from_log:b kwh:f temp:f", """
SELECT coalesce(o.site_id, n.site_id) AS site_id, coalesce(o.local_date, n.local_date) AS local_date,
  CASE WHEN n.kwh IS NULL THEN false WHEN o.kwh IS NULL THEN n_hours >= 20 ELSE NOT (abs(n.kwh - o.kwh) > greatest(1, 0.05 * o.kwh) AND o.kwh > n.kwh) END AS from_log,
  CASE WHEN n.kwh IS NOT NULL AND (o.kwh IS NULL OR NOT (abs(n.kwh - o.kwh) > greatest(1, 0.05 * o.kwh) AND o.kwh > n.kwh)) THEN n.kwh ELSE o.kwh END AS kwh,
  CASE WHEN n.kwh IS NOT NULL AND (o.kwh IS NULL OR NOT (abs(n.kwh - o.kwh) > greatest(1, 0.05 * o.kwh) AND o.kwh > n.kwh)) THEN n.temp ELSE o.temp END AS temp
FROM (SELECT site_id, local_date, kwh * CASE WHEN day(local_date) % 2 = 0 THEN 1.2 ELSE 0.9 END AS kwh, temp FROM day_agg) o
FULL JOIN (SELECT * FROM day_agg) n ON o.site_id = n.site_id AND o.local_date = n.local_date
WHERE o.kwh IS NOT NULL OR n_hours >= 20""")
def _(t):
    fresh = O.daily_scalars(t.hourly_log)
    stored = fresh.withColumn(
        "kwh", F.col("kwh") * F.when(F.dayofmonth("local_date") % 2 == 0, 1.2).otherwise(0.9))
    return O.backfill_daily(stored, fresh, ["kwh", "temp"])


@query("thermal_regime", "A5", "site_id:i local_date:d regime_heating_kwh:f regime_cooling_kwh:f regime:s dominant:s", """
SELECT site_id, local_date, h AS regime_heating_kwh, c AS regime_cooling_kwh, regime,
 CASE WHEN h + c >= 0.01 THEN CASE WHEN h >= c THEN 'heating' ELSE 'cooling' END END AS dominant FROM day_regime""")
def _(t):
    return O.thermal_regime(t.hourly_unit)


@query("period_totals", "A6", "site_id:i days:i kwh:f temp:f wind:f avg_tdd:f efficiency:f", """
SELECT site_id, count(*) AS days, round(sum(kwh) + 1e-9, 3) AS kwh, round(avg(temp) + 1e-9, 1) AS temp, round(avg(wind) + 1e-9, 1) AS wind,
 round(avg(tdd) + 1e-9, 1) AS avg_tdd, round(CASE WHEN sum(tdd) > 0.01 THEN sum(kwh) / sum(tdd) END + 1e-9, 3) AS efficiency
FROM daily_history WHERE local_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY 1""")
def _(t):
    return O.period_totals(t.daily, F.to_date(F.lit("1997-01-01")), F.to_date(F.lit("1997-12-31")))


TODATE_SQL = """
WITH days AS (SELECT DATE '1998-06-17' AS d),
spans AS (SELECT 'today' AS period, d AS a, d AS b, 1 AS live FROM days UNION ALL SELECT 'week', greatest(DATE '1998-06-15', DATE '1998-06-01'), d, 1 FROM days
 UNION ALL SELECT 'month', DATE '1998-06-01', d, 1 FROM days UNION ALL SELECT 'last_year_day', DATE '1997-06-17', DATE '1997-06-17', 0 FROM days
 UNION ALL SELECT 'last_year_week', DATE '1997-06-16', DATE '1997-06-22', 0 FROM days UNION ALL SELECT 'last_year_month', DATE '1997-06-01', DATE '1997-06-30', 0 FROM days
 UNION ALL SELECT 'yesterday', d - 1, d - 1, 0 FROM days UNION ALL SELECT 'last_7d', d - 7, d - 1, 0 FROM days UNION ALL SELECT 'last_30d', d - 30, d - 1, 0 FROM days)
SELECT site_id, period, count(*) AS rows, round(avg(temp) + 1e-9, 1) AS temp, round(avg(wind) + 1e-9, 1) AS wind,
 CASE WHEN max(live) = 0 THEN round(avg(tdd) + 1e-9, 1) END AS avg_tdd,
 CASE WHEN max(live) = 0 AND sum(tdd) > 0.01 THEN round(sum(kwh) / sum(tdd) + 1e-9, 3) END AS efficiency
FROM daily_history JOIN spans ON local_date BETWEEN a AND b GROUP BY 1, 2"""


@query("todate_stats", "A7", "site_id:i period:s rows:i temp:f wind:f avg_tdd:f efficiency:f", TODATE_SQL)
def _(t):
    live = t.daily.withColumnRenamed("wind", "effective_wind")
    return O.todate_stats(live, t.daily, F.to_date(F.lit("1998-06-17")))


@query("typical_day", "A8", "site_id:i samples:i typical_kwh:f confidence:s", """
SELECT d.site_id, count(*) AS samples, round(CASE WHEN count(*) >= 3 THEN median(kwh + aux_impact_kwh) END + 1e-9, 1) AS typical_kwh,
 CASE WHEN count(*) < 3 THEN 'low' WHEN count(*) >= 7 THEN 'high' ELSE 'medium' END AS confidence
FROM daily_history d JOIN (SELECT site_id, avg(wind) AS mw FROM daily_history GROUP BY 1) m ON d.site_id = m.site_id
WHERE abs(temp - 5.0) <= 1 AND abs(wind - mw) < 2 GROUP BY 1""")
def _(t):
    return O.typical_day(t.daily, 5.0)


@query("max_daily", "A9", "site_id:i max_kwh:f", "SELECT site_id, max(kwh) AS max_kwh FROM daily_history GROUP BY 1")
def _(t):
    return O.max_daily(t.daily)


@query("stress_index", "A9", "site_id:i local_date:d stress_index:f band:s", """
SELECT site_id, local_date, round(x + 1e-9, 1) AS stress_index, CASE WHEN x < 30 THEN 'light' WHEN x < 60 THEN 'moderate' WHEN x < 90 THEN 'heavy' ELSE 'extreme' END AS band
FROM (SELECT p.site_id, local_date, 100 * (expected_kwh + aux_impact_kwh) / m AS x FROM daily_history p
 JOIN (SELECT site_id, max(kwh) AS m FROM daily_history GROUP BY 1) mx ON p.site_id = mx.site_id)""")
def _(t):
    plan = t.daily.select("site_id", "local_date", (F.col("expected_kwh") + F.col("aux_impact_kwh")).alias("gross_kwh"))
    return O.stress_index(t.daily, plan)


@query("accumulated_impacts", "A10",
       "site_id:i local_date:d solar_impact_kwh:f guest_impact_kwh:f aux_impact_kwh:f thermodynamic_gross_kwh:f heating_kwh:f cooling_kwh:f", """
SELECT h.*, r.h AS heating_kwh, r.c AS cooling_kwh FROM (SELECT site_id, local_date, sum(solar_impact_kwh) AS solar_impact_kwh, sum(guest_impact_kwh) AS guest_impact_kwh,
 sum(aux_impact_kwh) AS aux_impact_kwh, coalesce(sum(thermodynamic_gross_kwh), 0) AS thermodynamic_gross_kwh FROM hourly_log GROUP BY 1, 2) h
JOIN day_regime r ON h.site_id = r.site_id AND h.local_date = r.local_date""")
def _(t):
    return O.accumulated_impacts(t.hourly_log, t.hourly_unit)


@query("mode_contamination", "A11", "site_id:i local_date:d excluded_hours:i excluded_kwh:f n_dhw:i n_guest_heating:i n_cooling:i", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY local_date DESC) AS rk FROM (
 SELECT site_id, local_date, count(*) FILTER (mode IN ('dhw','guest_heating')) AS excluded_hours, sum(actual_kwh) FILTER (mode IN ('dhw','guest_heating')) AS excluded_kwh,
  count(*) FILTER (mode = 'dhw') AS n_dhw, count(*) FILTER (mode = 'guest_heating') AS n_guest_heating, count(*) FILTER (mode = 'cooling') AS n_cooling
 FROM hourly_unit GROUP BY 1, 2) WHERE excluded_hours > 0) WHERE rk <= 10""")
def _(t):
    return O.mode_contamination(t.hourly_unit)


@query("source_mix", "A12", "site_id:i source:s hours:i pct:f is_dominant:b real_source_share:f verdict:s", """
SELECT c.site_id, source, hours, round(100.0 * hours / total + 1e-9, 1) AS pct,
 row_number() OVER (PARTITION BY c.site_id ORDER BY hours DESC, source) = 1 AS is_dominant, round(rl / total + 1e-9, 4) AS real_source_share,
 CASE WHEN total < 50 THEN 'insufficient_data' WHEN rl / total >= 0.8 THEN CASE WHEN use_4d THEN 'enabled_and_supported' ELSE 'disabled_but_supported' END
  WHEN use_4d THEN 'enabled_but_unsupported' ELSE 'disabled_and_unsupported' END AS verdict
FROM (SELECT *, sum(hours) OVER (PARTITION BY site_id) AS total, coalesce(sum(hours) FILTER (source IN ('native','erbs_from_ghi')) OVER (PARTITION BY site_id), 0) AS rl FROM (
 SELECT site_id, dni_dhi_source AS source, count(*) AS hours FROM hourly_log WHERE solar_factor > 0 GROUP BY 1, 2)) c JOIN site_dim s ON c.site_id = s.site_id""")
def _(t):
    return O.source_mix(t.hourly_log, t.sites)


add_oracle_tables(dark_cells="""
SELECT b.site_id, b.temp_key, b.wind_bucket, round(b.kwh + 1e-9, 4) AS stored_kwh, coalesce(n_dark, 0) AS n_dark_hours,
 CASE WHEN n_dark >= 10 THEN round(dm + 1e-9, 4) END AS dark_mean_kwh, CASE WHEN n_dark >= 10 THEN round(pct + 1e-9, 1) END AS delta_pct,
 CASE WHEN coalesce(n_dark, 0) < 10 THEN 'unverifiable' WHEN pct IS NULL OR pct > 15 THEN 'inflated' WHEN pct < -15 THEN 'deflated' ELSE 'ok' END AS verdict
FROM (SELECT b.*, n_dark, dm, CASE WHEN abs(dm) > 0.01 THEN 100 * (b.kwh - dm) / dm WHEN abs(b.kwh) <= 0.01 THEN 0 END AS pct FROM simple_base b LEFT JOIN (
 SELECT site_id, CAST(round_even(temp, 0) AS INT) AS temp_key, wind_bucket, count(*) AS n_dark, avg(greatest(0, actual_kwh - excluded_kwh)) AS dm
 FROM hourly_log WHERE solar_factor < 0.05 AND NOT auxiliary_active GROUP BY 1, 2, 3) d
ON b.site_id = d.site_id AND b.temp_key = d.temp_key AND b.wind_bucket = d.wind_bucket) b""")


@query("dark_hour_baseline", "A13", "site_id:i temp_key:i wind_bucket:s stored_kwh:f n_dark_hours:i dark_mean_kwh:f delta_pct:f verdict:s",
       "SELECT * FROM dark_cells")
def _(t):
    return O.dark_hour_baseline(t.hourly_log, simple_base(t))


@query("dark_hour_noise_floor", "A14", "site_id:i unit_id:s n:i p10:f median:f status:s effective:f", """
SELECT site_id, unit_id, n, p10, med AS median, status, CASE WHEN status = 'updated' THEN round(greatest(0.03, least(prior * 1.5, greatest(prior * 0.5, greatest(0.03, p10)))) + 1e-9, 5) ELSE prior END AS effective FROM (
SELECT d.site_id, d.unit_id, d.min_base AS prior, n, p10, med, CASE WHEN lh < 336 THEN 'insufficient_log_data' WHEN coalesce(n, 0) < 20 THEN 'skipped_low_samples'
  WHEN med > 0 AND p10 > 0.9 * med THEN 'rejected_constant_load' WHEN p10 > 1.5 THEN 'rejected_above_ceiling' ELSE 'updated' END AS status
FROM unit_dim d LEFT JOIN (SELECT site_id, unit_id, len(v) AS n, v[greatest(1, CAST(ceil(0.1 * len(v)) AS INT))] AS p10, v[len(v) // 2 + 1] AS med FROM (
  SELECT u.site_id, u.unit_id, list_sort(list(u.actual_kwh)) AS v FROM hourly_unit u JOIN hourly_log h ON u.site_id = h.site_id AND u.ts = h.ts
  WHERE NOT h.auxiliary_active AND h.solar_factor < 0.05 AND u.mode = 'heating' GROUP BY 1, 2)) q ON d.site_id = q.site_id AND d.unit_id = q.unit_id
JOIN (SELECT site_id, count(*) AS lh FROM hourly_log GROUP BY 1) l ON d.site_id = l.site_id)""")
def _(t):
    return O.dark_hour_noise_floor(t.hourly_unit, t.hourly_log, t.units)


@query("unit_daily", "A17", "site_id:i unit_id:s local_date:d kwh:f expected_kwh:f hours:i lifetime_kwh:f", """
SELECT *, sum(kwh) OVER (PARTITION BY site_id, unit_id ORDER BY local_date) AS lifetime_kwh FROM (
SELECT site_id, unit_id, local_date, sum(actual_kwh) AS kwh, sum(expected_kwh) AS expected_kwh, count(*) AS hours FROM hourly_unit GROUP BY 1, 2, 3)""")
def _(t):
    return O.unit_daily(t.hourly_unit)


@query("count_learnable_units", "A19", "site_id:i ts:t n_learnable:i", """
SELECT u.site_id, ts, CASE WHEN count(*) FILTER (mode = 'heating' AND expected_base_kwh >= min_base) > 0
 THEN count(*) FILTER (mode = 'heating' AND expected_base_kwh >= min_base) ELSE count(*) END AS n_learnable
FROM hourly_unit u JOIN unit_dim d ON u.site_id = d.site_id AND u.unit_id = d.unit_id GROUP BY 1, 2""")
def _(t):
    return O.count_learnable_units(t.hourly_unit, t.units)


@query("plan_coverage", "A20", "site_id:i wind_bucket:s cells:i temp_min:i temp_max:i observations:i pending:i", """
SELECT site_id, wind_bucket, count(*) AS cells, min(temp_key) AS temp_min, max(temp_key) AS temp_max, sum(n) AS observations, count(*) FILTER (n < 4) AS pending
FROM simple_base GROUP BY 1, 2""")
def _(t):
    return O.plan_coverage(simple_base(t))


@query("fleet_rollup", "A21", "month:s regime:s level:i site_days:i kwh:f tdd:f", """
SELECT month, regime, grouping(month, regime) AS level, count(*) AS site_days, sum(kwh) AS kwh, sum(tdd) AS tdd FROM (
SELECT strftime(local_date, '%Y-%m') AS month, kwh, tdd, CASE WHEN h + c < 0.01 THEN 'idle' WHEN h / (h + c) >= 0.8 THEN 'heating' WHEN c / (h + c) >= 0.8 THEN 'cooling' ELSE 'mixed' END AS regime
FROM (SELECT *, regime_heating_kwh AS h, regime_cooling_kwh AS c FROM daily_history)) GROUP BY ROLLUP (month, regime)""")
def _(t):
    return O.fleet_rollup(t.daily)
