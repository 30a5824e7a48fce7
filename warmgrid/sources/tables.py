"""Readers and writers: CSV history, daily/hourly export, state documents, forecasts, heat-pump buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from warmgrid import constants as K
from warmgrid.functions import weather as W
from warmgrid.functions.numeric import rnd
from warmgrid.operators import enrich as E

TRUE_WORDS = ("1", "true", "yes", "on")


def _raw_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Every column as text, so a bad cell costs one value and not the scan."""
    schema = T.StructType([T.StructField(x, T.StringType()) for x in columns])
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def _typed(raw: DataFrame, mapping: dict[str, str], zone: str) -> DataFrame:
    """Mapped text columns to typed ones; a timestamp without offset is local time of ``zone``.

    ``ts`` is the instant in UTC; ``hour`` and ``local_date`` are those of the site's clock.
    """
    def num(name):
        return F.expr(f"try_cast(`{mapping[name]}` AS DOUBLE)") if name in mapping else F.lit(None).cast("double")

    text = F.col(mapping["timestamp"])
    parsed = F.try_to_timestamp(text)
    utc = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), parsed).otherwise(F.to_utc_timestamp(parsed, zone))
    aux = F.lower(F.col(mapping["is_auxiliary"])).isin(*TRUE_WORDS) if "is_auxiliary" in mapping else F.lit(False)
    site = F.expr(f"try_cast(`{mapping['site_id']}` AS BIGINT)") if "site_id" in mapping else F.lit(0).cast("long")
    d = raw.select(site.alias("site_id"), utc.alias("ts"), num("temperature").alias("temp"), num("energy").alias("actual_kwh"),
                   num("wind_speed").alias("wind_speed"), num("wind_gust").alias("wind_gust"), F.coalesce(aux, F.lit(False)).alias("auxiliary_active"),
                   num("cloud_coverage").alias("cloud_coverage"), rnd(num("direct_normal_irradiance"), 2).alias("dni"), rnd(num("diffuse_radiation"), 2).alias("dhi"))
    clock = F.from_utc_timestamp("ts", zone)
    return d.filter("ts is not null").withColumns({"hour": F.hour(clock), "local_date": F.to_date(clock)})


def read_history_csv(spark: SparkSession, path: str, mapping: dict[str, str], columns: list[str], sites: DataFrame, zone: str = "UTC") -> DataFrame:
    """Full-mode import: rows need energy and temperature; wind, buckets, degree-days and solar are derived."""
    d = _typed(_raw_csv(spark, path, columns), mapping, zone).filter("temp is not null and actual_kwh is not null")
    d = d.withColumn("effective_wind", W.effective_wind(F.coalesce("wind_speed", F.lit(0.0)), "wind_gust"))
    d = d.withColumns({"wind_bucket": W.wind_bucket("effective_wind"), "tdd": rnd(W.tdd_hour("temp"), 3),
                       "_cloud": F.coalesce("cloud_coverage", F.lit(K.DEFAULT_CLOUD))})
    d = E.enrich_solar_factor(E.enrich_solar_geometry(d, sites), "_cloud")
    return d.drop("_cloud", "lat", "lon")


def read_weather_csv(spark: SparkSession, path: str, mapping: dict[str, str], columns: list[str], sites: DataFrame, zone: str = "UTC") -> DataFrame:
    """Weather-only import: partial rows, absent fields stay NULL."""
    d = _typed(_raw_csv(spark, path, columns), {k: v for k, v in mapping.items() if k != "energy"}, zone)
    wind = F.when(F.col("wind_speed").isNotNull(), W.effective_wind("wind_speed", "wind_gust"))
    d = d.withColumn("effective_wind", wind)
    d = d.withColumns({"wind_bucket": F.when(F.col("effective_wind").isNotNull(), W.wind_bucket("effective_wind")), "tdd": rnd(W.tdd_hour("temp"), 3)})
    d = E.enrich_solar_factor(E.enrich_solar_geometry(d, sites))
    return d.drop("actual_kwh", "lat", "lon", "auxiliary_active")


def flat_daily(daily: DataFrame) -> DataFrame:
    """Scalar columns plus the 24 temperature, wind and energy slots as columns."""
    plain = [f.name for f in daily.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    vec = []
    if "hourly_vectors" in daily.columns:
        for name, field in (("temp", "temp"), ("wind", "wind"), ("actual", "actual_kwh")):
            vec += [F.try_element_at(F.col(f"hourly_vectors.{field}"), F.lit(h + 1)).alias(f"vec_{name}_{h:02d}") for h in range(24)]
    return daily.select(*plain, *vec)


def write_daily_csv(daily: DataFrame, path: str) -> None:
    flat_daily(daily).write.mode("overwrite").option("header", True).csv(path)


def flat_hourly(hourly: DataFrame, unit_ids: list[str]) -> DataFrame:
    """Scalar columns plus actual and expected energy per configured unit; an absent unit is 0."""
    plain = [f.name for f in hourly.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    units = []
    for i, u in enumerate(unit_ids):
        for col, name in (("unit_breakdown", "actual"), ("unit_expected_breakdown", "expected")):
            units.append(F.coalesce(F.try_element_at(F.col(col), F.lit(u)), F.lit(0.0)).alias(f"unit_{i}_{name}"))
    return hourly.select(*plain, *units)


def write_hourly_csv(hourly: DataFrame, unit_ids: list[str], path: str) -> None:
    flat_hourly(hourly, unit_ids).write.mode("overwrite").option("header", True).csv(path)


def append_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """Append a stream to an evolving Parquet table; a replayed batch overwrites its own folder.

    Column additions need no rewrite: old files simply lack the column.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


STATE_SCHEMA = ("site_id long, correlation_data map<string, map<string, double>>, "
                "daily_history map<string, struct<kwh: double, tdd: double, temp: double, wind: double>>")


def write_state_json(base_model: DataFrame, daily: DataFrame, path: str) -> None:
    """One state document per site: nested model cells and daily history."""
    cells = base_model.groupBy("site_id", "temp_key").agg(F.map_from_entries(F.collect_list(F.struct("wind_bucket", "kwh"))).alias("b"))
    model = cells.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("temp_key").cast("string"), "b"))).alias("correlation_data"))
    days = daily.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct(
        F.date_format("local_date", "yyyy-MM-dd"), F.struct("kwh", "tdd", "temp", "wind")))).alias("daily_history"))
    model.join(days, "site_id", "full").write.mode("overwrite").json(path)


def read_state_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """State documents back to the long model and daily tables.

    A document without model and history is not a backup and is dropped; malformed
    parts read as NULL and disappear when exploded.
    """
    doc = spark.read.schema(STATE_SCHEMA).option("mode", "PERMISSIVE").json(path)
    doc = doc.filter("correlation_data is not null or daily_history is not null")
    cells = doc.select("site_id", F.explode("correlation_data").alias("k", "b")).select("site_id", F.expr("try_cast(k AS INT)").alias("temp_key"), F.explode("b").alias("wind_bucket", "kwh"))
    cells = cells.filter("temp_key is not null and kwh >= 0")
    days = doc.select("site_id", F.explode("daily_history").alias("d", "v")).select("site_id", F.expr("try_cast(d AS DATE)").alias("local_date"), "v.*").filter("local_date is not null")
    return cells, days


def read_forecast(spark: SparkSession, path: str, sites: DataFrame) -> DataFrame:
    """Provider items with cloud cover resolved and the sun position attached."""
    f = spark.read.parquet(path)
    return E.enrich_solar_geometry(E.fill_cloud(f), sites)


def read_mpc(live: DataFrame, snapshots: DataFrame, min_hours: int = K.MPC_MIN_HOURS) -> DataFrame:
    """Heat-pump hours of each day: the live buffer, else the latest snapshot; thin days are rejected.

    Both inputs carry ``slot`` ('2200' < '2300' < '2355'); a live buffer outranks any.
    """
    cols = ["site_id", "local_date", "hour", "kwh_th_sh", "kwh_el_sh", "mode"]
    both = live.select(*cols, F.lit("live").alias("slot")).unionByName(snapshots.select(*cols, "slot"))
    rank = F.when(F.col("slot") == "live", 9999).otherwise(F.col("slot").cast("int"))
    n = both.groupBy("site_id", "local_date", "slot").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("r"))
    # the best source is chosen first; if it is too thin the day is rejected, not downgraded
    best = n.groupBy("site_id", "local_date").agg(F.max_by(F.struct("slot", "n"), "r").alias("b")).filter(F.col("b.n") >= min_hours)
    return both.join(best.select("site_id", "local_date", F.col("b.slot").alias("slot")), ["site_id", "local_date", "slot"])


def file_stream(spark: SparkSession, folder: str, file: str, schema: T.StructType, max_files: int = 64) -> DataFrame:
    """A folder as a stream; admission is bounded so one key's share of a micro-batch is too."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", file)
    return r.option("maxFilesPerTrigger", max_files).parquet(folder)
