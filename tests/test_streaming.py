"""Streams against their batch twins."""

import pandas as pd
from pyspark.sql import functions as F

from tests.compare import norm
from warmgrid.operators.sequential import SiteModel
from warmgrid.plans import QUERIES
from warmgrid.plans.registry import spark_query
from warmgrid.sources.fixture_tables import FixtureTables
from warmgrid.streaming.jobs import cooldown_step

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    df = spark_query(QUERIES[name])(spark, SF)
    return norm([tuple(r) for r in df.collect()], df.columns)


def test_cooldown_stream_equals_batch(spark):
    edge = FixtureTables(spark, SF).hourly_log.agg(F.date_format(F.max("ts") - F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    assert rows(spark, "stream_cooldown") == [r for r in rows(spark, "cooldown_batch") if r[2] < edge]


def test_meter_stream_equals_batch(spark):
    meter = FixtureTables(spark, SF).meter
    edge = meter.agg(F.max("ts") - F.expr("INTERVAL 2 HOURS")).first()[0]
    passed = {r[0] for r in meter.where(F.col("ts") < F.lit(edge)).select("event_id").collect()}
    assert rows(spark, "stream_meter_delta") == [r for r in rows(spark, "meter_delta") if r[1] in passed]


def test_cooldown_rules():
    doc, locked = {}, []
    for h, aux in enumerate([True, False, False, False, False, False, False, False, False]):
        locked.append(cooldown_step(doc, h, aux, 0.5, 1.0))
    assert locked == [False, True, True, True, True, True, True, True, False]
    doc = {}
    locked = [cooldown_step(doc, h, h == 0, 0.95, 1.0) for h in range(5)]
    assert locked == [False, True, True, True, False]
    doc = {}
    cooldown_step(doc, 0, True, 0, 1)
    cooldown_step(doc, 1, False, 0, 1)
    assert cooldown_step(doc, 2, True, 0, 1) is False


def test_site_learner_ends_where_batch_ends(spark):
    stream = spark_query(QUERIES["stream_learn_site"])(spark, SF).toPandas()
    assert len(stream) and stream["status"].notna().all()
    assert isinstance(SiteModel().dump(), dict) and isinstance(stream, pd.DataFrame)
