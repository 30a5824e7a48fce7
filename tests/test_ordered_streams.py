"""Keyed folds over shuffled micro-batches, with a restart, against their batch twins."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import norm
from warmgrid.operators import sequential as S
from warmgrid.operators import timeseries as O
from warmgrid.plans.q_sequential import live_hours, solar_rows
from warmgrid.plans.q_streaming import cooldown_hours
from warmgrid.sources.fixture_tables import FixtureTables
from warmgrid.streaming import jobs as J
from warmgrid.streaming.ordered import fold_states, late_rows, ordered_stream
from warmgrid.streaming.run import drain

SF = "/root/testdata/sf0.001"
DELAY = 3  # days


@pytest.fixture(scope="module")
def t(spark):
    return FixtureTables(spark, SF)


def day_files(df, folder, days, order):
    """One file for each of ``days`` in the order given; a row may be at most two files from its place."""
    for n, k in enumerate(order):
        df.where(F.datediff("ts", F.lit(days[0])) == days[1] + k).coalesce(1).write.parquet(f"{folder}/part={n:03d}")


def shuffled(n, rng):
    """0 .. n - 1 with neighbours exchanged."""
    order = list(range(n))
    for i in range(0, n - 2, 3):
        part = order[i : i + 3]
        rng.shuffle(part)
        order[i : i + 3] = part
    return order


def run_in_batches(spark, df, keys, processor, folder, start=None):
    """Drain two halves of shuffled day files, three at a time, stopping in between; the rows, and the progress reports."""
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = df.agg(F.min("ts").cast("date"), F.max("ts").cast("date")).first()
    days = (last - first).days + 1
    half, rng, reports = days // 2, random.Random(1), []
    for at, size in ((0, half), (half, days - half)):
        day_files(df, f"{folder}/in/half={at}", (first, at), shuffled(size, rng))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/in/half=*/part=*").select(*df.columns)
        out = drain(spark, ordered_stream(stream, keys, processor, f"{DELAY} days", start), "x", folder=f"{folder}/run", reports=reports)
    assert sum(r.numInputRows > 0 for r in reports) >= 6 and late_rows(reports) == 0
    return out, df.agg(F.max("ts") - F.expr(f"INTERVAL {DELAY} DAYS")).first()[0]


def same(a, b):
    a, b = (norm([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in x.collect()], x.columns) for x in (a, b.select(a.columns)))
    assert a and a == b


def test_meter_delta(spark, t, tmp_path):
    df = t.meter.select("site_id", "unit_id", "ts", "event_id", "reading_kwh", "mode")
    out, edge = run_in_batches(spark, df, ["site_id", "unit_id"], J.MeterDelta(), tmp_path)
    twin = O.meter_delta(t.meter).join(df.where(F.col("ts").cast("timestamp") < F.lit(edge)).select("event_id"), "event_id", "left_semi")
    same(out, twin)


def test_battery(spark, t, tmp_path):
    df = t.hourly_log.select("site_id", "ts", "solar_impact_kwh")
    out, edge = run_in_batches(spark, df, ["site_id"], J.Battery(), tmp_path)
    state, want = {}, []
    for r in df.orderBy("site_id", "ts").collect():
        state[r["site_id"]] = 0.5 * state.get(r["site_id"], 0.0) + 0.5 * (r["solar_impact_kwh"] or 0.0)
        want.append((r["site_id"], r["ts"], state[r["site_id"]]))
    twin = spark.createDataFrame(want, "site_id long, ts timestamp_ntz, battery_state double").withColumn("ts", F.col("ts").cast("timestamp"))
    same(out, twin.where(F.col("ts") < F.lit(edge)))


def test_cooldown(spark, t, tmp_path):
    hours = cooldown_hours(t)
    out, edge = run_in_batches(spark, hours, ["site_id"], J.Cooldown(), tmp_path)
    same(out, J.cooldown_batch(hours).where(F.col("ts") < F.lit(edge)))
    assert out.where("locked").count()


def test_outage(spark, t, tmp_path):
    bad = F.dayofmonth("local_date").between(8, 20)
    source = F.when(bad & (F.col("dni_dhi_source") != "no_sun"), "kasten_synthetic").when(F.col("dni_dhi_source") == "kasten_synthetic", "native").otherwise(F.col("dni_dhi_source"))
    df = t.hourly_log.select("site_id", "ts", "solar_factor", source.alias("dni_dhi_source"))
    out, edge = run_in_batches(spark, df, ["site_id"], J.OutageAlert(), tmp_path)
    twin = J.OutageAlert()
    pdf = df.where(F.col("ts").cast("timestamp") < F.lit(edge)).withColumn("ts", F.col("ts").cast("timestamp")).toPandas()
    want = pd.concat([twin.fold((k,), {}, g.sort_values("ts")) for k, g in pdf.groupby("site_id")])
    got = out.toPandas()
    assert len(want) and sorted(map(tuple, got[["site_id", "ts", "raised"]].values.tolist())) == sorted(map(tuple, want[["site_id", "ts", "raised"]].values.tolist()))


def test_unit_solar_learner(spark, t, tmp_path):
    cols = ["site_id", "unit_id", "regime", "ts", "ps", "pe", "pw", "expected_base_kwh", "actual_kwh", "raw_impact", "min_base", "is_shutdown", "battery_s", "battery_e", "battery_w"]
    rows = solar_rows(t)
    keys = ["site_id", "unit_id", "regime"]
    out, edge = run_in_batches(spark, rows.select(*cols), keys, J.UnitSolarLearner(), tmp_path)
    last = out.groupBy(*keys).agg(F.max_by(F.struct("s", "e", "w"), "ts").alias("c")).select(*keys, "c.*")
    twin = S.train_solar_nlms(rows.where(F.col("ts").cast("timestamp") < F.lit(edge))).select(*keys, "s", "e", "w")
    want = {tuple(r)[:3]: tuple(r)[3:] for r in twin.collect()}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in last.collect()}
    assert got and all(want[k] == pytest.approx(v, abs=1e-6) for k, v in got.items())


def test_site_learner_goes_on_from_a_batch(spark, t, tmp_path):
    hours = live_hours(t).withColumn("ts", F.col("ts").cast("timestamp"))
    cut = F.lit("2024-01-12 07:00:00").cast("timestamp")
    first = S.site_states(hours.where(F.col("ts") < cut), 0.1)
    first.write.parquet(f"{tmp_path}/states")
    begun = spark.read.parquet(f"{tmp_path}/states")
    out, edge = run_in_batches(spark, hours.where(F.col("ts") >= cut), ["site_id"], J.SiteLearner(0.1), tmp_path, begun)
    states = fold_states(spark, f"{tmp_path}/run", ["site_id"])
    whole = S.site_states(hours.where(F.col("ts") < F.lit(edge)), 0.1)
    # half batch and half stream: the same document, learning order included
    assert {r["site_id"]: json.loads(r["doc"]) for r in states.collect()} == {r["site_id"]: json.loads(r["doc"]) for r in whole.collect()}
    # and the stream's state feeds a batch again
    rest = S.train_base_live(hours.where(F.col("ts") >= F.lit(edge)), 0.1, states)
    same(rest, S.train_base_live(hours, 0.1))
    assert out.count() == hours.where((F.col("ts") >= cut) & (F.col("ts") < F.lit(edge))).count()


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    def file(n, rows):
        spark.createDataFrame(rows, "site_id long, ts string, solar_impact_kwh double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")

    reports = []
    for n, rows in enumerate([
        [(1, "2024-01-01 05:00:00", 1.0), (1, "2024-01-01 04:00:00", 2.0)],
        [(1, "2024-01-01 09:00:00", 4.0), (2, "2024-01-01 08:00:00", 1.0)],
        [(1, "2024-01-01 03:00:00", 100.0), (1, "2024-01-01 08:00:00", 8.0), (2, "2024-01-01 06:30:00", 50.0)],
        [(3, "2024-01-01 23:00:00", 0.0)],
    ]):
        file(n, rows)
        stream = spark.readStream.schema("site_id long, ts timestamp, solar_impact_kwh double").parquet(f"{tmp_path}/in/part=*")
        out = drain(spark, ordered_stream(stream, ["site_id"], J.Battery(), "2 hours"), "x", folder=f"{tmp_path}/run", reports=reports)
    got = {(r["site_id"], r["ts"].hour): r["battery_state"] for r in out.collect()}
    assert got == {(1, 4): 1.0, (1, 5): 1.0, (1, 8): 4.5, (1, 9): 4.25, (2, 8): 0.5}
    assert late_rows(reports) == 2
