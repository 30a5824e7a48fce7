"""Enrichments, filters and cascades."""

from pyspark.sql import functions as F

from warmgrid.operators import filters as O
from warmgrid.plans.registry import query

@query("enrich_wind", "P1", "site_id:i event_id:i effective_wind:f wind_bucket:s", """
SELECT site_id, event_id, eff AS effective_wind,
       CASE WHEN eff >= 10.8 THEN 'extreme_wind' WHEN eff >= 8 THEN 'high_wind' ELSE 'normal' END AS wind_bucket
FROM (SELECT *, sp + greatest(0, coalesce(gu - sp, 0)) * 0.6 AS eff FROM (
  SELECT *, CASE wind_unit WHEN 'km/h' THEN wind_speed / 3.6 WHEN 'mph' THEN wind_speed * 0.44704
              WHEN 'kn' THEN wind_speed * 0.514444 ELSE wind_speed END AS sp,
         CASE wind_unit WHEN 'km/h' THEN wind_gust / 3.6 WHEN 'mph' THEN wind_gust * 0.44704
              WHEN 'kn' THEN wind_gust * 0.514444 ELSE wind_gust END AS gu FROM sample_rows))""")
def _(t):
    return O.enrich_wind(t.samples)


@query("enrich_tdd", "P2", "site_id:i ts:t tdd:f side:s", """
SELECT site_id, ts, abs(17.0 - temp) / 24 AS tdd, CASE WHEN temp >= 17 THEN 'cooling' ELSE 'heating' END AS side FROM hourly_log""")
def _(t):
    return O.enrich_tdd(t.hourly_log)


@query("filter_days_back", "P3", "site_id:i ts:t temp:f", """
SELECT site_id, ts, temp FROM hourly_log WHERE local_date >= DATE '2024-01-25' - 7""")
def _(t):
    return O.filter_days_back(t.hourly_log, 7, F.to_date(F.lit("2024-01-25")))


@query("pure_hours", "P4", "site_id:i reason:s hours:i", """
SELECT site_id, coalesce(reason, 'pure') AS reason, count(*) AS hours FROM (
 SELECT site_id, CASE WHEN actual_kwh <= 0 THEN 'zero_or_negative_consumption' WHEN solar_impact_kwh > 0.1 THEN 'solar_interference'
   WHEN auxiliary_active THEN 'auxiliary_active' WHEN learning_status NOT IN ('active','success','model_updated') THEN 'learning_status_exclusion' END AS reason
 FROM hourly_log) GROUP BY 1, 2""")
def _(t):
    return O.discard_counts(O.pure_hours(t.hourly_log))


@query("learnable_hours", "P5", "site_id:i ts:t learning_status:s", """
SELECT site_id, ts, learning_status FROM hourly_log
WHERE NOT (learning_status = 'disabled' OR learning_status LIKE 'skipped%' OR learning_status = 'cooldown_post_aux')""")
def _(t):
    return O.learnable_hours(t.hourly_log)


@query("exclude_modes", "P6", "site_id:i ts:t total_kwh:f excluded_kwh:f learning_kwh:f", """
SELECT *, greatest(0, total_kwh - excluded_kwh) AS learning_kwh FROM (
SELECT site_id, ts, sum(actual_kwh) AS total_kwh,
  coalesce(sum(actual_kwh) FILTER (mode IN ('off','dhw','guest_heating','guest_cooling')), 0) AS excluded_kwh
FROM hourly_unit GROUP BY 1, 2)""")
def _(t):
    return O.exclude_modes(t.hourly_unit)


SHUTDOWN_SQL = """
SELECT u.*, sqrt(h.solar_vector_s^2 + h.solar_vector_e^2 + h.solar_vector_w^2) AS magnitude, d.solar_affected, d.min_base,
  sqrt(h.solar_vector_s^2 + h.solar_vector_e^2 + h.solar_vector_w^2) >= 0.3 AND u.mode = 'heating' AND d.solar_affected
  AND ((expected_base_kwh > 0 AND u.actual_kwh < 0.03) OR (expected_base_kwh >= min_base AND u.actual_kwh < 0.15 * expected_base_kwh)) AS is_shutdown
FROM hourly_unit u JOIN hourly_log h ON u.site_id = h.site_id AND u.ts = h.ts
JOIN unit_dim d ON u.site_id = d.site_id AND u.unit_id = d.unit_id"""


@query("shutdown_flags", "P8", "site_id:i ts:t unit_id:s magnitude:f is_shutdown:b",
       f"SELECT site_id, ts, unit_id, magnitude, is_shutdown FROM ({SHUTDOWN_SQL})")
def _(t):
    return O.shutdown_flags(t.hourly_unit, t.hourly_log, t.units)


@query("shutdown_arrays", "P8 F13", "site_id:i ts:t units:s n:i",
       f"""SELECT site_id, ts, coalesce(string_agg(unit_id, ',' ORDER BY unit_id) FILTER (is_shutdown), '') AS units,
 count(*) FILTER (is_shutdown) AS n FROM ({SHUTDOWN_SQL}) GROUP BY 1, 2""")
def _(t):
    df = O.shutdown_arrays(O.shutdown_flags(t.hourly_unit, t.hourly_log, t.units))
    return df.select("site_id", "ts", F.concat_ws(",", "solar_dominant_entities").alias("units"),
                     F.size("solar_dominant_entities").alias("n"))


@query("sanitize_coefficients", "P9", "site_id:i unit_id:s s:f e:f w:f", """
SELECT site_id, unit_id, greatest(0, sum(k_unit - 50) / 100) AS s, greatest(0, sum(actual_kwh - 0.7)) AS e, 0.0 AS w
FROM unit_hours GROUP BY 1, 2""")
def _(t):
    raw = t.unit_hours.groupBy("site_id", "unit_id").agg(
        (F.sum(F.col("k_unit") - 50) / 100).alias("s"), F.sum(F.col("actual_kwh") - 0.7).alias("e"),
        F.lit(None).cast("double").alias("w"))
    return O.sanitize_coefficients(raw)


@query("mode_default", "P10", "site_id:i mode:s hours:i kwh:f", """
SELECT site_id, CASE WHEN mode = 'heating' OR hour % 7 = 0 THEN 'heating' ELSE mode END AS mode, count(*) AS hours, sum(actual_kwh) AS kwh
FROM hourly_unit GROUP BY 1, 2""")
def _(t):
    sparse = t.hourly_unit.withColumn("mode", F.when((F.col("mode") != "heating") & (F.col("hour") % 7 != 0), F.col("mode")))
    return O.mode_default(sparse).groupBy("site_id", "mode").agg(F.count("*").alias("hours"), F.sum("actual_kwh").alias("kwh"))


@query("explode_units", "P10 F13", "site_id:i ts:t unit_id:s actual_kwh:f expected_kwh:f mode:s", """
SELECT site_id, ts, unit_id, actual_kwh, expected_kwh, mode FROM hourly_unit""")
def _(t):
    entry = lambda v: F.map_from_entries(F.collect_list(F.struct("unit_id", v)))
    sparse = F.map_from_entries(F.collect_list(F.when(F.col("mode") != "heating", F.struct("unit_id", "mode"))))
    log = t.hourly_unit.groupBy("site_id", "ts").agg(
        entry("actual_kwh").alias("unit_breakdown"), entry("expected_kwh").alias("unit_expected_breakdown"),
        sparse.alias("unit_modes"))
    return O.explode_units(log)


@query("plausible_gate", "P11", "site_id:i unit_id:s side:s applicable:b applicable_reason:s", """
SELECT site_id, unit_id, side, reason IS NULL AS applicable, reason AS applicable_reason FROM (
SELECT *, CASE WHEN NOT learned THEN 'not_learned' WHEN gain < 0.3 THEN 'below_sse_threshold'
  WHEN NOT (elev BETWEEN CASE side WHEN 'low' THEN 2 ELSE 20 END AND CASE side WHEN 'low' THEN 20 ELSE 60 END) THEN 'physically_implausible'
  WHEN NOT stable THEN 'single_window_only' END AS reason
FROM (SELECT site_id, unit_id, CASE WHEN hour < 12 THEN 'low' ELSE 'high' END AS side, count(*) > 20 AS learned,
       avg(k_unit) / 100 - 0.15 AS gain, min(k_unit) * 4 + 10 AS elev, count(*) % 2 = 0 AS stable
      FROM unit_hours GROUP BY 1, 2, 3, hour))""")
def _(t):
    b = t.unit_hours.groupBy("site_id", "unit_id", "hour").agg(
        (F.count("*") > 20).alias("learned"), (F.avg("k_unit") / 100 - 0.15).alias("sse_improvement_ratio"),
        (F.min("k_unit") * 4 + 10).alias("best_critical_elev"), (F.count("*") % 2 == 0).alias("stable_across_windows"))
    return O.plausible_gate(b.withColumn("side", F.when(F.col("hour") < 12, "low").otherwise("high")))


@query("interference_flags", "P12", "site_id:i ts:t is_mixed:b is_dual:b final_status:s", """
SELECT site_id, ts, m AS is_mixed, d AS is_dual, CASE WHEN learning_status = 'cooldown_post_aux' THEN learning_status
  WHEN m THEN 'skipped_mixed_mode' WHEN d THEN 'skipped_dual_interference' ELSE learning_status END AS final_status
FROM (SELECT *, aux_fraction > 0.2 AND aux_fraction < 0.8 AS m, solar_impact_kwh > 0.1 AND aux_impact_kwh > 0.1 AS d FROM hourly_log)""")
def _(t):
    return O.interference_flags(t.hourly_log)


@query("display_solar", "P13", "site_id:i ts:t display_solar_kwh:f", """
SELECT h.site_id, ts, CASE WHEN use_4d THEN coalesce(solar_impact_4d_kwh, solar_impact_kwh, 0) ELSE coalesce(solar_impact_kwh, 0) END AS display_solar_kwh
FROM hourly_log h JOIN site_dim s ON h.site_id = s.site_id""")
def _(t):
    return O.display_solar(t.hourly_log, t.sites)
