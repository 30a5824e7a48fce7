"""Rules that a query over the shared test tables would not tell apart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from warmgrid.operators import forecast as X
from warmgrid.operators import merges as U
from warmgrid.operators import rollup as A
from warmgrid.operators import topk as K
from warmgrid.sources import tables as S
from warmgrid.streaming.run import drain


def test_local_clock_of_a_zone_with_summer_time(spark):
    stamps = ["2024-01-10T00:30:00", "2024-03-31T03:30:00", "2024-10-27T02:30:00+02:00", "2024-10-27T02:30:00+01:00", "2024-07-01T12:00:00Z", "never"]
    raw = spark.createDataFrame([(s, "1", "2") for s in stamps], "timestamp string, temperature string, energy string")
    got = [(r["ts"], str(r["local_date"]), r["hour"]) for r in S._typed(raw, {x: x for x in raw.columns}, "Europe/Oslo").orderBy("ts").collect()]
    assert [x[1:] for x in got] == [("2024-01-10", 0), ("2024-03-31", 3), ("2024-07-01", 14), ("2024-10-27", 2), ("2024-10-27", 2)]
    assert (got[4][0] - got[3][0]) == dt.timedelta(hours=1) and got[0][0].hour == 23


def test_rename_to_a_name_in_use_adds_up(spark):
    df = spark.createDataFrame([(0, {"a": 1.0, "b": 2.0, "c": 4.0}, {"a": "off", "b": "on"}), (0, {"b": 5.0}, {"b": "on"}), (1, {"a": 1.0, "b": 2.0}, None)], "site_id long, kwh map<string,double>, mode map<string,string>")
    got = [(r["kwh"], r["mode"]) for r in U.rename_unit(df, 0, "a", "b").collect()]
    assert got == [({"b": 3.0, "c": 4.0}, {"b": "off"}), ({"b": 5.0}, {"b": "on"}), ({"a": 1.0, "b": 2.0}, None)]
    long = spark.createDataFrame([(0, "a", 1.0), (0, "b", 2.0), (1, "a", 8.0)], "site_id long, unit_id string, kwh double")
    merged = U.merge_renamed(U.rename_unit(long, 0, "a", "b"), ["site_id", "unit_id"], ["kwh"])
    assert sorted(map(tuple, merged.collect())) == [(0, "b", 3.0), (1, "a", 8.0)]


def test_model_changes_are_ranked_per_site(spark):
    keys = ["site_id", "temp_key"]
    before = spark.createDataFrame([(s, k, 0.0) for s in range(10) for k in range(500)], "site_id long, temp_key int, kwh double")
    after = before.withColumn("kwh", (F.col("temp_key") + 1).cast("double"))
    got = K.model_diff_topk(before, after, keys, ["site_id"]).groupBy("site_id").agg(F.count("*").alias("n"), F.min("delta").alias("least"), F.max("buckets_changed").alias("all")).collect()
    assert len(got) == 10 and {(r["n"], round(r["least"], 6), r["all"]) for r in got} == {(200, 301.0, 500)}


def test_all_contaminated_days_without_a_limit(spark):
    df = spark.createDataFrame([(0, dt.date(2024, 1, 1) + dt.timedelta(days=d), "dhw", 1.0) for d in range(30)], "site_id long, local_date date, mode string, actual_kwh double")
    assert A.mode_contamination(df).count() == 10 and A.mode_contamination(df, None).count() == 30


def test_midnight_plan_is_one_plan(spark):
    day = dt.date(2024, 1, 2)
    rows = [(0, day, h, dt.datetime(2024, 1, 1, 20), 1.0) for h in range(24)] + [(0, day, h, dt.datetime(2024, 1, 1, 23), 2.0) for h in range(1, 24)] + [(0, day, h, dt.datetime(2024, 1, 2, 1), 3.0) for h in range(24)]
    df = spark.createDataFrame(rows, "site_id long, local_date date, hour int, issued_at timestamp_ntz, kwh double")
    got = X.midnight_snapshot(df).collect()
    assert {r["kwh"] for r in got} == {2.0} and sorted(r["hour"] for r in got) == list(range(1, 24))


def test_accuracy_counts_the_current_provider_only(spark):
    rows = [(0, dt.date(2024, 1, d), "primary", "old" if d < 20 else "new", 9.0 if d < 20 else 1.0, 1.0, 10.0, 0.0) for d in range(5, 31)]
    b = spark.createDataFrame(rows, "site_id long, local_date date, source string, entity string, abs_error double, error double, actual double, weather_error double")
    now = spark.createDataFrame([(0, "primary", "new")], "site_id long, source string, entity string")
    got = {r["days"]: (r["samples"], r["hourly_mae"]) for r in X.period_accuracy(b, F.lit("2024-01-30").cast("date"), now).collect()}
    assert got == {7: (8, 1.0), 30: (11, 1.0)}
    assert [(r["p50"], r["samples"]) for r in X.source_uncertainty(b, now).collect()] == [(1.0, 11)]


def test_a_named_folder_lets_a_stream_resume(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    spark.range(5).write.parquet(source)
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    assert drain(spark, stream(), "x", folder=folder).count() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    assert sorted(r["id"] for r in drain(spark, stream(), "x", folder=folder).collect()) == list(range(8))


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    from warmgrid.session import stored_table

    folder = tmp_path / "sf"
    folder.mkdir()
    (folder / "a").write_text("1")
    build = lambda n: lambda: spark.range(n)
    assert stored_table(spark, str(folder), "t", build(3)).count() == 3
    assert stored_table(spark, str(folder), "t", build(4)).count() == 3
    (folder / "a").write_text("12")
    assert stored_table(spark, str(folder), "t", build(4)).count() == 4


@pytest.mark.parametrize("name", ["stream_learn_site", "stream_learn_units"])
def test_learners_return_finite_rows(spark, name):
    from warmgrid.plans import QUERIES
    from warmgrid.plans.registry import spark_query

    got = spark_query(QUERIES[name])(spark, "/root/testdata/sf0.001").toPandas()
    assert len(got) and not got.select_dtypes("number").isin([float("inf"), float("-inf")]).any().any()
