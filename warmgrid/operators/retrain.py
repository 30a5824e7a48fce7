"""Retraining a fleet: each site by its configured track, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmgrid.operators import learn as L


def retrain(sites: DataFrame, hourly: DataFrame, daily: DataFrame, contributions: DataFrame) -> DataFrame:
    """Base tables by track: A hourly cells, B daily flat cells, C strategy sums.

    ``sites.track`` routes each site; the branches are disjoint semi-joins, so a site
    is only ever trained once.
    """
    def only(df: DataFrame, track: str) -> DataFrame:
        return df.join(sites.filter(F.col("track") == track).select("site_id"), "site_id", "left_semi")

    a = L.train_base(only(hourly, "A")).select("site_id", F.lit("A").alias("track"), "temp_key", "wind_bucket", "kwh", F.col("n").cast("long").alias("n"))
    b = L.train_daily_flat(only(daily, "B")).select("site_id", F.lit("B").alias("track"), "temp_key", "wind_bucket", "kwh", F.col("n").cast("long").alias("n"))
    c = L.train_strategies(only(contributions, "C")).select("site_id", F.lit("C").alias("track"), "temp_key", "wind_bucket", "kwh", F.col("samples").cast("long").alias("n"))
    return a.unionByName(b).unionByName(c)


def retrain_report(models: DataFrame) -> DataFrame:
    return models.groupBy("site_id", "track").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("updates"), F.avg("kwh").alias("mean_kwh"))
