"""Streaming jobs, drained over the event table or over derived hour tables."""

import uuid

from pyspark.sql import functions as F


from warmgrid.plans.q_sequential import live_hours, solar_rows
from warmgrid.plans.registry import query
from warmgrid.session import checkpoint_root
from warmgrid.sources import tables as S
from warmgrid.sources.fixture_tables import METER, READINGS, SAMPLES
from warmgrid.streaming import jobs as J
from warmgrid.streaming.ordered import ordered_stream
from warmgrid.streaming.run import drain


def event_stream(t):
    """The raw events as a file stream, with the canonical reading columns."""
    raw = S.file_stream(t.spark, t.sf_dir, "events.parquet", t.raw("events").schema)
    d = t.sql(READINGS.replace("{k}", "get_json_object(props, '$.k')"), events=raw)
    # watermarks need a zoned timestamp
    return d.withColumns({"ts": F.col("ts").cast("timestamp"), "hr": F.col("hr").cast("timestamp")})


def sample_stream(t):
    return t.sql(SAMPLES, readings=event_stream(t))


def table_stream(t, name, build):
    """A derived hour table, written once and read as a stream of its files."""
    df = build()
    path = f"{checkpoint_root(t.spark)}/warmgrid/{t.spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(path)
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).parquet(path)


CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR AS w FROM readings)"


def passed(table: str) -> str:
    """Condition on the rows that the watermark of a fold over ``table`` has passed."""
    return f"ts < (SELECT max(ts) - INTERVAL 2 HOUR FROM {table})"


@query("stream_hourly_rollup", "T1 S9", "site_id:i ts:t sample_count:i temp:f humidity:f cloud_coverage:f effective_wind:f aux_fraction:f", f"""
SELECT site_id, hr AS ts, count(*) AS sample_count, avg(temp) AS temp, avg(humidity) AS humidity, avg(cloud_coverage) AS cloud_coverage, quantile_disc(effective_wind, 0.9) AS effective_wind,
 avg(CASE WHEN aux_active THEN 1.0 ELSE 0.0 END) AS aux_fraction FROM bucketed_samples WHERE hr + INTERVAL 1 HOUR <= (SELECT w FROM {CLOSED}) GROUP BY 1, 2""")
def _(t):
    return drain(t.spark, J.stream_hourly_rollup(sample_stream(t)), "hours")


@query("stream_meter_delta", "T2 S9", "site_id:i unit_id:s event_id:i status:s delta_kwh:f", f"""
SELECT site_id, unit_id, event_id, status, CASE WHEN status = 'ok' THEN raw ELSE 0 END AS delta_kwh FROM (
SELECT *, CASE WHEN raw IS NULL THEN 'first' WHEN raw < 0 THEN 'reset' WHEN raw > 3 THEN 'spike' WHEN mode = 'dhw' THEN 'dhw' ELSE 'ok' END AS status FROM (
SELECT *, reading_kwh - lag(reading_kwh) OVER (PARTITION BY site_id, unit_id ORDER BY ts, event_id) AS raw FROM meter_rows) WHERE {passed('meter_rows')})""")
def _(t):
    m = t.sql(METER, readings=event_stream(t))
    return drain(t.spark, ordered_stream(m, ["site_id", "unit_id"], J.MeterDelta()), "deltas")


@query("stream_daily_rollup", "T3", "site_id:i local_date:d n_hours:i temp:f samples:i complete:b", f"""
SELECT site_id, CAST(hr AS DATE) AS local_date, count(*) AS n_hours, avg(temp) AS temp, sum(n) AS samples, count(*) >= 20 AS complete FROM (SELECT site_id, hr, count(*) AS n, avg(temp) AS temp FROM sample_rows GROUP BY 1, 2)
GROUP BY 1, 2 HAVING CAST(hr AS DATE) + INTERVAL 1 DAY <= (SELECT w FROM {CLOSED})""")
def _(t):
    return drain(t.spark, J.stream_daily_rollup(sample_stream(t)), "days")


@query("stream_touched_days", "T3", "site_id:i local_date:d kwh:f n:i", "SELECT site_id, CAST(hr AS DATE) AS local_date, sum(value) / 100 AS kwh, count(*) AS n FROM readings GROUP BY 1, 2")
def _(t):
    path = f"{checkpoint_root(t.spark)}/warmgrid/{t.spark.sparkContext.applicationId}/{uuid.uuid4().hex}/days"

    def build(touched):
        d = t.readings.withColumns({"local_date": F.col("hr").cast("date"), "site_bucket": J.site_bucket()})
        d = d.join(touched, ["site_bucket", "local_date"], "left_semi")
        return d.groupBy("site_id", "site_bucket", "local_date").agg((F.sum("value") / 100).alias("kwh"), F.count("*").alias("n"))

    s = event_stream(t).select("site_id", F.col("ts").cast("date").alias("local_date"))
    q = s.writeStream.foreachBatch(J.touched_days_writer(path, build)).option("checkpointLocation", path + "_cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(path)


COOLDOWN_SQL = """
WITH RECURSIVE u AS (SELECT h.site_id, h.ts, sum(h.actual_kwh) AS a, sum(h.expected_base_kwh) AS e FROM hourly_unit h JOIN unit_dim d ON h.site_id = d.site_id AND h.unit_id = d.unit_id WHERE d.aux_affected GROUP BY 1, 2),
o AS (SELECT l.site_id, l.ts, CAST(epoch(l.ts) / 3600 AS BIGINT) AS h, l.aux_fraction >= 0.5 AS aux, coalesce(u.a, 0) AS a, coalesce(u.e, 0) AS e, row_number() OVER (PARTITION BY l.site_id ORDER BY l.ts) AS p
 FROM hourly_log l LEFT JOIN u ON u.site_id = l.site_id AND u.ts = l.ts),
c AS (SELECT site_id, ts, p, aux, false AS locked, CAST(NULL AS BIGINT) AS since FROM o WHERE p = 1
 UNION ALL SELECT site_id, ts, p, aux, s1 IS NOT NULL, CASE WHEN s1 IS NOT NULL AND (h - s1 >= 6 OR (h - s1 >= 2 AND e > 0.01 AND a / e >= 0.92)) THEN NULL ELSE s1 END FROM (
  SELECT o.*, CASE WHEN o.aux AND NOT c.aux THEN NULL WHEN c.aux AND NOT o.aux THEN o.h ELSE c.since END AS s1 FROM c JOIN o ON o.site_id = c.site_id AND o.p = c.p + 1))
SELECT site_id, ts, locked FROM c"""


def cooldown_hours(t):
    return J.cooldown_inputs(t.hourly_log.withColumn("auxiliary_active", F.col("aux_fraction") >= 0.5), t.hourly_unit, t.units)


@query("stream_cooldown", "T4", "site_id:i ts:t locked:b", f"{COOLDOWN_SQL} WHERE {passed('hourly_log')}")
def _(t):
    return drain(t.spark, ordered_stream(table_stream(t, "cool", lambda: cooldown_hours(t)), ["site_id"], J.Cooldown()), "cooldown")


@query("cooldown_batch", "T4", "site_id:i ts:t locked:b", COOLDOWN_SQL)
def _(t):
    return J.cooldown_batch(cooldown_hours(t))


@query("stream_battery", "T5", "site_id:i ts:t battery_state:f", f"""
SELECT a.site_id, a.ts, sum(b.solar_impact_kwh * 0.5 * power(0.5, a.p - b.p)) AS battery_state
FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) a
JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM hourly_log) b ON a.site_id = b.site_id AND b.p <= a.p AND b.p > a.p - 60 WHERE a.{passed('hourly_log')} GROUP BY 1, 2""")
def _(t):
    h = table_stream(t, "sun", lambda: t.hourly_log.select("site_id", "ts", "solar_impact_kwh"))
    return drain(t.spark, ordered_stream(h, ["site_id"], J.Battery()), "battery")


@query("stream_learn_site", "T6", "site_id:i ts:t status:s cell_kwh:f")
def _(t):
    return drain(t.spark, ordered_stream(table_stream(t, "live", lambda: live_hours(t)), ["site_id"], J.SiteLearner(0.1)), "learn_site")


@query("stream_learn_units", "T6", "site_id:i unit_id:s regime:s ts:t outlier:b s:f e:f w:f")
def _(t):
    cols = ["site_id", "unit_id", "regime", "ts", "ps", "pe", "pw", "expected_base_kwh", "actual_kwh", "raw_impact", "min_base", "is_shutdown", "battery_s", "battery_e", "battery_w"]
    s = table_stream(t, "solar", lambda: solar_rows(t).select(*cols))
    return drain(t.spark, ordered_stream(s, ["site_id", "unit_id", "regime"], J.UnitSolarLearner()), "learn_units")


@query("stream_dedupe", "T7 U1", "site_id:i ts:t", "SELECT DISTINCT site_id, hr AS ts FROM readings")
def _(t):
    s = event_stream(t).select("site_id", F.col("hr").alias("ts"))
    return drain(t.spark, J.stream_dedupe(s), "dedupe")


@query("stream_forecast_join", "T8", "site_id:i ts:t sample_count:i temp:f plan_temp:f temp_gap:f", f"""
SELECT h.*, f.temperature AS plan_temp, h.temp - f.temperature AS temp_gap FROM (SELECT site_id, hr AS ts, count(*) AS sample_count, avg(temp) AS temp FROM bucketed_samples WHERE hr + INTERVAL 1 HOUR <= (SELECT w FROM {CLOSED}) GROUP BY 1, 2) h
LEFT JOIN forecast_items f ON h.site_id = f.site_id AND h.ts = f.ts AND f.source = 'primary'""")
def _(t):
    plan = t.forecast.filter("source = 'primary'").withColumn("ts", F.col("ts").cast("timestamp"))
    return drain(t.spark, J.stream_forecast_join(J.stream_hourly_rollup(sample_stream(t)), plan), "versus_plan")


@query("stream_outage_alert", "T9", "site_id:i ts:t raised:b share:f", f"""
WITH RECURSIVE d AS (SELECT site_id, ts, CAST(CASE WHEN day(local_date) BETWEEN 8 AND 20 AND dni_dhi_source <> 'no_sun' THEN 0 WHEN dni_dhi_source IN ('native','erbs_from_ghi','kasten_synthetic') THEN 1 ELSE 0 END AS DOUBLE) AS good FROM hourly_log WHERE solar_factor > 0),
w AS (SELECT *, avg(good) OVER (PARTITION BY site_id ORDER BY ts ROWS 23 PRECEDING) AS share, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS p FROM d),
c AS (SELECT site_id, ts, p, share, false AS raised, false AS changed FROM w WHERE p = 23
 UNION ALL SELECT w.site_id, w.ts, w.p, w.share, CASE WHEN w.share < 0.1 THEN true WHEN w.share >= 0.5 THEN false ELSE c.raised END, CASE WHEN w.share < 0.1 THEN true WHEN w.share >= 0.5 THEN false ELSE c.raised END <> c.raised
 FROM c JOIN w ON w.site_id = c.site_id AND w.p = c.p + 1)
SELECT site_id, ts, raised, share FROM c WHERE changed AND {passed('hourly_log')}""")
def _(t):
    def hours():
        bad = F.dayofmonth("local_date").between(8, 20)
        return t.hourly_log.select("site_id", "ts", "solar_factor", F.when(bad & (F.col("dni_dhi_source") != "no_sun"), "kasten_synthetic").when(
            F.col("dni_dhi_source") == "kasten_synthetic", "native").otherwise(F.col("dni_dhi_source")).alias("dni_dhi_source"))

    return drain(t.spark, ordered_stream(table_stream(t, "irr", hours), ["site_id"], J.OutageAlert()), "outage")


@query("stream_late_data", "T10", "site_id:i late:b n:i", """
SELECT site_id, ts < TIMESTAMP '2024-01-10 00:00:00' AS late, count(*) AS n FROM readings GROUP BY 1, 2""")
def _(t):
    base = f"{checkpoint_root(t.spark)}/warmgrid/{t.spark.sparkContext.applicationId}/{uuid.uuid4().hex}/late"
    horizon = F.lit("2024-01-10 00:00:00").cast("timestamp")

    def write(batch, batch_id):
        fresh, late = J.split_late(batch.select("site_id", "ts"), horizon)
        both = fresh.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
        both.write.mode("overwrite").partitionBy("late").parquet(f"{base}/batch={batch_id}")

    q = event_stream(t).writeStream.foreachBatch(write).option("checkpointLocation", base + "_cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return S.read_appended(t.spark, base).groupBy("site_id", "late").agg(F.count("*").alias("n"))


@query("heating_sessions", "T11", "site_id:i unit_id:s mode:s start_ts:t readings:i value:f", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY site_id, unit_id, mode ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM readings),
s AS (SELECT *, sum(new) OVER (PARTITION BY site_id, unit_id, mode ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT site_id, unit_id, mode, min(ts) AS start_ts, count(*) AS readings, sum(value) AS value FROM s GROUP BY site_id, unit_id, mode, run HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT w FROM {CLOSED})""")
def _(t):
    return drain(t.spark, J.heating_sessions(event_stream(t)), "sessions")


@query("append_hourly_sink", "S5", "site_id:i ts:t temp:f n:i extra:f", """
SELECT site_id, ts, temp, n, CASE WHEN day(local_date) > 15 THEN effective_wind END AS extra FROM hourly_log""")
def _(t):
    root = f"{checkpoint_root(t.spark)}/warmgrid/{t.spark.sparkContext.applicationId}/{uuid.uuid4().hex}/log"
    cols = ["site_id", "ts", "temp", "n"]
    d = F.dayofmonth("local_date")
    old = table_stream(t, "log_old", lambda: t.hourly_log.filter(d <= 15).select(*cols))
    new = table_stream(t, "log_new", lambda: t.hourly_log.filter(d > 15).select(*cols, F.col("effective_wind").alias("extra")))
    # a schema change starts a new writer; readers merge both generations
    for i, s in enumerate((old, new)):
        S.append_sink(s, f"{root}/generation={i}", f"{root}_cp{i}", ["site_id", "ts"]).trigger(availableNow=True).start().awaitTermination()
    return S.read_appended(t.spark, root)
