"""Canonical telemetry tables derived from the generic parquet test tables.

The rules are in FIXTURES.md. A site is a block of thirty consecutive users
(twenty suppliers for the multi-year daily table), so the number of sites, not
the density of one site, grows with the data. Each rule is one SQL text that
both Spark and the comparison database can run; only JSON access differs. The
solar columns are the exception: Spark gets them from the library's own
enrichers, the oracle from an independent formula.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warmgrid.operators import enrich as E
from warmgrid.session import stored_table

READINGS = """
SELECT event_id, CAST(floor(user_id / 30) AS BIGINT) AS site_id,
       concat('unit_', CAST(user_id % 4 AS VARCHAR(2))) AS unit_id,
       ts, date_trunc('hour', ts) AS hr, event_type, value,
       CAST({k} AS DOUBLE) AS k,
       CASE event_type WHEN 'click' THEN 'heating' WHEN 'view' THEN 'heating'
            WHEN 'signup' THEN 'cooling' WHEN 'purchase' THEN 'guest_heating'
            ELSE 'dhw' END AS mode
FROM {events}
"""

UNIT_HOURS = """
SELECT site_id, unit_id, hr AS ts, CAST(hr AS DATE) AS local_date, hour(hr) AS hour,
       max_by(mode, event_id) AS mode,
       round(sum(value) / 100 + 1e-9, 4) AS actual_kwh,
       avg(k) AS k_unit
FROM {readings} GROUP BY site_id, unit_id, hr
"""

SITE_HOURS = """
SELECT site_id, hr AS ts, CAST(hr AS DATE) AS local_date, hour(hr) AS hour,
       count(*) AS n, min(event_id) AS first_event,
       sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n_err,
       avg(k) AS k_avg,
       round(8 - 8 * cos(2 * pi() * (hour(hr) - 4) / 24) + (avg(k) - 50) / 5 + 1e-9, 1) AS temp,
       round(avg(k) * 0.14 + 1e-9, 3) AS effective_wind,
       round(avg(k) + 1e-9, 2) AS cloud_coverage,
       round(40 + 0.6 * avg(k) + 1e-9, 2) AS humidity,
       round(100 - 0.5 * avg(k) + 1e-9, 1) AS correction_percent
FROM {readings} GROUP BY site_id, hr
"""

SITE_INPUTS = """
SELECT h.*, 40.0 + site_id % 5 AS lat, 0.0 AS lon,
       CASE WHEN n % 3 = 0 THEN round(k_avg * 6 + 1e-9, 2) END AS ghi_in,
       CASE WHEN n % 3 = 1 THEN round(k_avg * 7 + 1e-9, 2) END AS dni_in,
       CASE WHEN n % 3 = 1 THEN round(k_avg * 2 + 1e-9, 2) END AS dhi_in,
       n_err >= 0.8 * n AS auxiliary_active,
       n_err / n AS aux_fraction,
       CASE WHEN effective_wind >= 10.8 THEN 'extreme_wind'
            WHEN effective_wind >= 8.0 THEN 'high_wind' ELSE 'normal' END AS wind_bucket,
       round(abs(17.0 - temp) / 24 + 1e-9, 6) AS tdd,
       CASE WHEN n % 11 = 0 THEN 'disabled' WHEN n_err / n > 0.2 AND n_err / n < 0.8 THEN 'skipped_mixed_mode'
            WHEN n_err >= 0.8 * n THEN 'active_aux' ELSE 'active' END AS learning_status
FROM {site_hours} h
"""

SOLAR_FORMULA = """
SELECT *, CASE WHEN sun_elev <= 0 THEN 0 ELSE round(
           clear * (CASE WHEN az_delta <= 75 THEN cos(az_delta / 75 * (pi() / 2)) * 0.9 + 0.1
                         WHEN az_delta <= 90 THEN 0.1 ELSE 0.05 END) * cloud_f + 1e-9, 5) END AS solar_factor,
       CASE WHEN sun_elev <= 0 THEN 0 ELSE round(clear * cloud_f * greatest(0.0, -cos(radians(sun_azim))) + 1e-9, 5) END AS solar_vector_s,
       CASE WHEN sun_elev <= 0 THEN 0 ELSE round(clear * cloud_f * greatest(0.0, sin(radians(sun_azim))) + 1e-9, 5) END AS solar_vector_e,
       CASE WHEN sun_elev <= 0 THEN 0 ELSE round(clear * cloud_f * greatest(0.0, -sin(radians(sun_azim))) + 1e-9, 5) END AS solar_vector_w
FROM (
  SELECT *, CASE WHEN sun_elev <= 0 THEN 0.0 ELSE
             cos(radians(greatest(1.0, sun_elev))) * pow(0.7, 1 / sin(radians(greatest(1.0, sun_elev)))) END AS clear,
         1 - 0.75 * pow(cloud_coverage / 100, 3.4) AS cloud_f,
         CASE WHEN abs(sun_azim - 180) > 180 THEN 360 - abs(sun_azim - 180) ELSE abs(sun_azim - 180) END AS az_delta
  FROM (
    SELECT *, round(degrees(asin(sin(la) * sin(decl) + cos(la) * cos(decl) * cos(ha))) + 1e-9, 4) AS sun_elev,
           round(degrees(atan2(sin(ha), cos(ha) * sin(la) - tan(decl) * cos(la))) + 180 + 1e-9, 4) AS sun_azim
    FROM (
      SELECT *, radians(lat) AS la, radians((hour * 60 + 30 + 4 * lon + 229.18 * (0.000075 + 0.001868 * cos(g)
               - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g))) / 4 - 180) AS ha,
             0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g)
             + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS decl
      FROM (SELECT *, 2 * pi() / 365 * (dayofyear(ts) - 1 + (hour + 0.5 - 12) / 24) AS g FROM {site_inputs}))))
"""

IRRADIANCE_FORMULA = """
SELECT * EXCLUDE (g, la, ha, decl, clear, cloud_f, az_delta, kt, sine, ext, ghi_used, kd),
       round(CASE WHEN dni_dhi_source = 'native' THEN dni_in
            WHEN kt IS NULL THEN 0 ELSE greatest(0, (ghi_used - kd * ghi_used) / sine) END + 1e-9, 3) AS dni,
       round(CASE WHEN dni_dhi_source = 'native' THEN dhi_in
            WHEN ghi_used IS NULL OR ghi_used <= 0 THEN 0 WHEN kt IS NULL THEN ghi_used ELSE kd * ghi_used END + 1e-9, 3) AS dhi
FROM (
  SELECT *, CASE WHEN least(kt, 1.0) <= 0.22 THEN 1 - 0.09 * least(kt, 1.0)
                 WHEN least(kt, 1.0) <= 0.8 THEN 0.9511 - 0.1604 * kt + 4.388 * pow(kt, 2) - 16.638 * pow(kt, 3) + 12.336 * pow(kt, 4)
                 ELSE 0.165 END AS kd
  FROM (
    SELECT *, CASE WHEN ghi_used > 0 AND ext >= 1 THEN ghi_used / ext END AS kt
    FROM (
      SELECT *, CASE WHEN dni_dhi_source = 'erbs_from_ghi' THEN ghi_in
                  WHEN dni_dhi_source = 'kasten_synthetic' THEN greatest(0, ext * pow(0.7, 1 / sine) * cloud_f) END AS ghi_used
      FROM (
        SELECT *, sin(radians(sun_elev)) AS sine,
             1367 * (1 + 0.033 * cos(2 * pi() * dayofyear(ts) / 365)) * sin(radians(sun_elev)) AS ext,
             CASE WHEN sun_elev <= 0 THEN 'no_sun' WHEN ghi_in > 0 THEN 'erbs_from_ghi'
                  WHEN dni_in IS NOT NULL AND dhi_in IS NOT NULL THEN 'native' ELSE 'kasten_synthetic' END AS dni_dhi_source
        FROM {site_solar}))))
"""

HOUR_TOTAL_COLUMNS = {
    "actual_kwh": "round(sum(actual_kwh) + 1e-9, 4)",
    "n_units": "count(*)",
    "guest_impact_kwh": "round(sum(CASE WHEN mode = 'guest_heating' THEN actual_kwh ELSE 0 END) + 1e-9, 4)",
    "excluded_kwh": "round(sum(CASE WHEN mode IN ('dhw', 'guest_heating', 'guest_cooling', 'off') THEN actual_kwh ELSE 0 END) + 1e-9, 4)",
}

LOG_COLUMNS = {
    "expected_kwh": "round(n_units * (0.2 + 0.03 * abs(17.0 - temp)) + 1e-9, 4)",
    "forecasted_kwh": "round(n_units * (0.2 + 0.03 * abs(17.0 - temp)) * 1.05 + 1e-9, 4)",
    "aux_impact_kwh": "CASE WHEN auxiliary_active THEN round(0.1 * n_err + 1e-9, 4) ELSE 0.0 END",
    "solar_impact_kwh": "round(0.35 * (solar_vector_s + solar_vector_e + solar_vector_w) + 1e-9, 4)",
    "solar_impact_4d_kwh": "CASE WHEN dni_dhi_source IN ('native', 'erbs_from_ghi') THEN round((dni * 0.4 + dhi * 0.2) / 1000 + 1e-9, 4) END",
    "solar_normalization_delta": "round(0.3 * solar_factor + 1e-9, 5)",
    "solar_normalization_delta_4d":
        "CASE WHEN dni_dhi_source IN ('native', 'erbs_from_ghi') THEN round((dni * 0.3 + dhi * 0.1) / 1000 + 1e-9, 5) END",
    "thermodynamic_gross_kwh": "CASE WHEN n % 5 <> 0 THEN round(actual_kwh + 0.3 * solar_factor + 1e-9, 4) END",
    "forecasted_kwh_gross": "CASE WHEN n % 4 <> 0 THEN round(n_units * (0.2 + 0.03 * abs(17.0 - temp)) * 1.1 + 1e-9, 4) END",
    "forecasted_kwh_primary": "round(n_units * (0.2 + 0.03 * abs(17.0 - temp)) * 0.95 + 1e-9, 4)",
    "forecasted_kwh_gross_primary": "CASE WHEN n % 4 <> 0 THEN round(n_units * (0.2 + 0.03 * abs(17.0 - temp)) * 0.98 + 1e-9, 4) END",
    "forecasted_kwh_secondary": "CASE WHEN n % 2 = 0 THEN round(n_units * (0.2 + 0.03 * abs(17.0 - temp)) * 1.15 + 1e-9, 4) END",
    "forecasted_kwh_gross_secondary": "CASE WHEN n % 4 = 2 THEN round(n_units * (0.2 + 0.03 * abs(17.0 - temp)) * 1.2 + 1e-9, 4) END",
    "forecast_source": "CASE WHEN n % 3 = 0 THEN 'secondary' ELSE 'primary' END",
    "primary_entity": "CASE WHEN site_id % 3 = 0 AND local_date < DATE '2024-01-12' THEN 'met_old' WHEN site_id % 2 = 0 THEN 'met_a' ELSE 'met_b' END",
    "secondary_entity": "'met_c'",
    "crossover_day": "4",
}


def _log_sql() -> str:
    totals = ", ".join(f"{e} AS {n}" for n, e in HOUR_TOTAL_COLUMNS.items())
    extra = ", ".join(f"{e} AS {n}" for n, e in LOG_COLUMNS.items())
    return (f"SELECT *, {extra} FROM (SELECT h.*, t.* EXCLUDE (site_id, ts) FROM site_weather h JOIN "
            f"(SELECT site_id, ts, {totals} FROM unit_hours GROUP BY site_id, ts) t ON h.site_id = t.site_id AND h.ts = t.ts)")


HOURLY_UNIT = """
SELECT u.site_id, u.unit_id, u.ts, u.local_date, u.hour, u.mode, u.actual_kwh,
       round(0.2 + 0.03 * abs(17.0 - h.temp) + 1e-9, 4) AS expected_base_kwh,
       round(greatest(0.0, 0.2 + 0.03 * abs(17.0 - h.temp) - 0.3 * h.solar_factor) + 1e-9, 4) AS expected_kwh
FROM {unit_hours} u JOIN {site_weather} h ON u.site_id = h.site_id AND u.ts = h.ts
"""

UNITS = """
SELECT site_id, unit_id, unit_id <> 'unit_3' AS aux_affected, unit_id <> 'unit_2' AS solar_affected,
       unit_id <> 'unit_1' AS screen_affected, unit_id = 'unit_0' AS mpc_managed,
       CASE WHEN unit_id = 'unit_1' THEN 0.3 ELSE 0.15 END AS min_base,
       CASE unit_id WHEN 'unit_0' THEN 'synthetic' WHEN 'unit_1' THEN 'weighted' ELSE 'direct' END AS strategy
FROM (SELECT DISTINCT site_id, unit_id FROM {unit_hours}) u
"""

SITES = """
SELECT site_id, 40.0 + site_id % 5 AS lat, 0.0 AS lon, 17.0 AS balance_point, site_id % 2 = 0 AS use_4d,
       true AS screen_s, site_id % 2 = 0 AS screen_e, site_id % 3 = 0 AS screen_w
FROM (SELECT DISTINCT site_id FROM {unit_hours}) s
"""

DAILY = """
SELECT CAST(floor(l_suppkey / 20) AS BIGINT) AS site_id, CAST(l_shipdate AS DATE) AS local_date,
       round(sum(l_quantity) / 10 + 1e-9, 3) AS kwh,
       round(avg(l_quantity) - 20 + 1e-9, 1) AS temp,
       round(avg(l_tax) * 100 + 1e-9, 2) AS wind,
       round(avg(l_discount) * 5 + 1e-9, 3) AS solar_factor,
       round(sum(l_discount) + 1e-9, 3) AS aux_impact_kwh,
       round(sum(l_tax) * 3 + 1e-9, 3) AS solar_impact_kwh,
       round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / 40 + 1e-9, 3) AS regime_cooling_kwh,
       round(sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0 END) / 10 + 1e-9, 3) AS regime_heating_kwh,
       round(sum(l_quantity) / 10 * 0.9 + 1.0 + 1e-9, 3) AS expected_kwh,
       round(abs(17 - (avg(l_quantity) - 20)) + 1e-9, 2) AS tdd,
       CAST(count(*) + 17 AS INT) AS n_hours,
       round(20 + avg(l_tax) * 20 + 1e-9, 2) AS midnight_indoor_temp
FROM {lineitem} GROUP BY 1, 2
"""

FORECAST = """
SELECT site_id, hr AS ts, CAST(hr AS DATE) AS local_date, hour(hr) AS hour, source,
       round(8 - 8 * cos(2 * pi() * (hour(hr) - 4) / 24) + (avg(k) - 50) / 4 + 1e-9, 1) AS temperature,
       round(avg(k) * 0.12 + 1e-9, 3) AS wind_speed, round(avg(k) * 0.15 + 1e-9, 3) AS wind_gust_speed,
       CASE WHEN count(*) % 2 = 0 THEN round(avg(k) + 1e-9, 2) END AS cloud_coverage,
       CASE WHEN min(event_id) % 3 = 0 THEN 'rainy' WHEN min(event_id) % 3 = 1 THEN 'sunny' ELSE 'partlycloudy' END AS condition,
       min(event_id) AS first_event
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'secondary' END AS source FROM {readings}) tagged
GROUP BY site_id, hr, source
"""


SAMPLES = """
SELECT event_id, site_id, ts, hr, k,
       round(8 - 8 * cos(2 * pi() * (hour(hr) - 4) / 24) + (k - 50) / 5 + 1e-9, 1) AS temp,
       k * 0.2 AS wind_speed, CASE WHEN event_id % 3 = 0 THEN k * 0.3 END AS wind_gust,
       CASE event_id % 5 WHEN 0 THEN 'm/s' WHEN 1 THEN 'km/h' WHEN 2 THEN 'mph' WHEN 3 THEN 'kn' ELSE 'furlong' END AS wind_unit,
       CASE WHEN event_id % 4 <> 0 THEN 40 + 0.6 * k END AS humidity,
       CASE WHEN event_id % 2 = 0 THEN k END AS cloud_coverage,
       CASE WHEN event_id % 3 = 1 THEN k * 6 END AS ghi,
       CASE WHEN event_id % 3 = 2 THEN k * 7 END AS dni, CASE WHEN event_id % 3 = 2 THEN k * 2 END AS dhi,
       event_type = 'error' AS aux_active, 100 - k / 2 AS correction_percent,
       k / 200 AS solar_factor, k / 300 AS solar_vector_s, k / 400 AS solar_vector_e, k / 500 AS solar_vector_w,
       CASE WHEN event_id % 2 = 1 THEN concat('e', CAST(event_id AS VARCHAR(12))) END AS solar_data_time
FROM {readings}
"""

METER = """
SELECT site_id, unit_id, ts, event_id, mode,
       CASE WHEN event_id % 97 = 0 THEN 0.5 ELSE round(
         (dayofyear(ts) * 24 + hour(ts) + minute(ts) / 60 + second(ts) / 3600) * 0.5 + k * 0.005 + 1e-9, 4) END AS reading_kwh
FROM {readings}
"""


def _oracle() -> dict[str, str]:
    def t(text: str, **kw: str) -> str:
        return text.format(**kw)

    return {
        "readings": t(READINGS, events="events", k="json_extract_string(props, '$.k')"),
        "unit_hours": t(UNIT_HOURS, readings="readings"),
        "site_hours": t(SITE_HOURS, readings="readings"),
        "site_inputs": t(SITE_INPUTS, site_hours="site_hours"),
        "site_solar": t(SOLAR_FORMULA, site_inputs="site_inputs"),
        "site_weather": t(IRRADIANCE_FORMULA, site_solar="site_solar"),
        "hourly_log": _log_sql(),
        "hourly_unit": t(HOURLY_UNIT, unit_hours="unit_hours", site_weather="site_weather"),
        "sample_rows": t(SAMPLES, readings="readings"),
        "meter_rows": t(METER, readings="readings"),
        "unit_dim": t(UNITS, unit_hours="unit_hours"),
        "site_dim": t(SITES, unit_hours="unit_hours"),
        "daily_history": t(DAILY, lineitem="lineitem"),
        "forecast_items": t(FORECAST, readings="readings"),
    }


ORACLE_TABLES: dict[str, str] = _oracle()


def add_oracle_tables(**tables: str) -> None:
    """Shared oracle tables of other modules (learned models, score inputs)."""
    ORACLE_TABLES.update(tables)


class FixtureTables:
    """Lazily built canonical DataFrames over one test-data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    @cached_property
    def readings(self) -> DataFrame:
        text = READINGS.replace("{k}", "get_json_object(props, '$.k')")
        return self.sql(text, events=self.raw("events"))

    @cached_property
    def unit_hours(self) -> DataFrame:
        return self.sql(UNIT_HOURS, readings=self.readings)

    @cached_property
    def site_inputs(self) -> DataFrame:
        return self.sql(SITE_INPUTS, site_hours=self.sql(SITE_HOURS, readings=self.readings))

    @cached_property
    def site_weather(self) -> DataFrame:
        df = E.enrich_solar_geometry(self.site_inputs)
        return E.enrich_irradiance(E.enrich_solar_factor(df))

    @cached_property
    def hourly_log(self) -> DataFrame:
        return self.stored("hourly_log", self.build_hourly_log)

    def stored(self, name: str, build) -> DataFrame:
        """A derived table written once per application, as a deployment would keep it."""
        return stored_table(self.spark, self.sf_dir, name, build)

    def build_hourly_log(self) -> DataFrame:
        """Weather and unit totals of each hour.

        The aggregate sits above the solar columns on purpose: later filters on
        them stay filters on finished values instead of being rewritten into
        copies of the whole sun-position expression below it.
        """
        weather = self.site_weather
        units = self.unit_hours.select("site_id", "ts", "mode", "actual_kwh")
        j = weather.select("site_id", "ts", F.struct(*weather.columns).alias("w")).join(units, ["site_id", "ts"])
        totals = [f"{expr} AS {name}" for name, expr in HOUR_TOTAL_COLUMNS.items()]
        merged = j.groupBy("site_id", "ts").agg(F.any_value("w").alias("w"), *[F.expr(x) for x in totals])
        flat = merged.select("w.*", *HOUR_TOTAL_COLUMNS)
        extra = [f"{expr} AS {name}" for name, expr in LOG_COLUMNS.items()]
        return flat.selectExpr("*", *extra)

    @cached_property
    def hourly_unit(self) -> DataFrame:
        hours = self.hourly_log.select("site_id", "ts", "temp", "solar_factor")
        return self.stored("hourly_unit", lambda: self.sql(HOURLY_UNIT, unit_hours=self.unit_hours, site_weather=hours))

    @cached_property
    def samples(self) -> DataFrame:
        return self.sql(SAMPLES, readings=self.readings)

    @cached_property
    def meter(self) -> DataFrame:
        return self.sql(METER, readings=self.readings)

    @cached_property
    def units(self) -> DataFrame:
        return self.sql(UNITS, unit_hours=self.hourly_unit)

    @cached_property
    def sites(self) -> DataFrame:
        return self.sql(SITES, unit_hours=self.hourly_unit)

    @cached_property
    def daily(self) -> DataFrame:
        return self.sql(DAILY, lineitem=self.raw("lineitem"))

    @cached_property
    def forecast(self) -> DataFrame:
        return self.sql(FORECAST, readings=self.readings)
