"""Ranked and extreme-value reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions.numeric import nz, rnd


def deviation_by_unit(hourly_unit: DataFrame, observations: DataFrame, keys=("site_id", "local_date", "unit_id")) -> DataFrame:
    """Actual minus expected per unit, with confidence and the unusual-deviation flag."""
    d = hourly_unit.join(observations.select("site_id", "unit_id", "temp_key", "wind_bucket", "obs_count"),
                         ["site_id", "unit_id", "temp_key", "wind_bucket"], "left")
    a = d.groupBy(*keys).agg(F.sum("actual_kwh").alias("actual"), F.sum("expected_kwh").alias("expected"),
                             F.avg(nz("obs_count", 0)).alias("obs"))
    dev = F.col("actual") - F.col("expected")
    tol = F.greatest(F.lit(K.DEVIATION_TOL_MATURE), K.DEVIATION_TOL_NEW - F.col("obs") * (
        (K.DEVIATION_TOL_NEW - K.DEVIATION_TOL_MATURE) / K.DEVIATION_MATURITY))
    score = F.abs(dev) / (F.col("expected") + 1.0)
    judged = F.col("obs") >= K.DEVIATION_MIN_OBS
    small = F.abs(dev) < K.DEVIATION_MIN_KWH
    return a.select(
        *keys, rnd(dev, 2).alias("deviation"), rnd("actual", 2).alias("actual"), rnd("expected", 2).alias("expected"), "obs",
        F.when(F.col("obs") >= 20, "high").when(F.col("obs") >= 5, "medium").otherwise("low").alias("confidence"),
        F.when(judged, F.when(small, False).otherwise(score > tol)).alias("unusual"),
        F.when(judged, F.when(small, 0.0).otherwise(rnd(score, 3))).alias("score"))


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """Row number within keys; Spark keeps only each task's top k before the shuffle."""
    d = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return d if k is None else d.filter(F.col("rank") <= k)


def top_deviation_units(deviations: DataFrame, k: int = 3) -> DataFrame:
    return ranked(deviations, ["site_id", "local_date"], [F.abs("deviation").desc(), F.col("unit_id")], k)


def top_contributors(unit_hours: DataFrame, value: str, k: int = 3) -> DataFrame:
    """Largest units of each hour by net energy; zero contributions are left out."""
    return ranked(unit_hours.filter(F.col(value) > 0), ["site_id", "ts"], [F.col(value).desc(), F.col("unit_id")], k)


def extreme_days(days: DataFrame, group: list[str]) -> DataFrame:
    """Coldest, warmest, peak and lightest day of each group; the earliest wins a tie."""
    early = F.date_diff(F.lit("2200-01-01").cast("date"), F.col("local_date"))
    return days.groupBy(*group).agg(
        F.min_by("local_date", F.struct("temp", "local_date")).alias("coldest"),
        F.max_by("local_date", F.struct(F.col("temp"), early)).alias("warmest"),
        F.max_by("local_date", F.struct(F.col("kwh"), early)).alias("peak"),
        F.min_by("local_date", F.struct("kwh", "local_date")).alias("lightest"))


def model_diff_topk(before: DataFrame, after: DataFrame, keys: list[str], group: list[str], k: int = 200) -> DataFrame:
    """Largest ``k`` cell changes of each ``group`` between two model tables, and how many cells of it changed."""
    j = before.select(*keys, F.col("kwh").alias("b")).join(after.select(*keys, F.col("kwh").alias("a")), keys, "full")
    j = j.select(*keys, nz("b").alias("before"), nz("a").alias("after")).withColumn("delta", rnd(F.col("after") - F.col("before"), 9))
    changed = j.filter(F.col("delta") != 0)
    counts = changed.groupBy(*group).agg(F.count(F.lit(1)).alias("buckets_changed"))
    return ranked(changed, group, [F.abs("delta").desc(), *[F.col(x) for x in keys]], k).join(counts, group)


def bucket_flags_ranked(health: DataFrame) -> DataFrame:
    """Inflated and deflated cells, largest relative deviation first."""
    return ranked(health.filter(F.col("verdict").isin("inflated", "deflated")), ["site_id", "verdict"],
                  [F.abs(nz("delta_pct")).desc(), F.col("temp_key"), F.col("wind_bucket")])


def better_source(uncertainty: DataFrame) -> DataFrame:
    """primary, secondary or similar by median error with a ten percent margin."""
    a = uncertainty.groupBy("site_id").agg(*[
        F.max(F.when(F.col("source") == s, F.col(x))).alias(f"{s}_{x}") for s in ("primary", "secondary") for x in ("p50", "samples")])
    p, s = F.col("primary_p50"), F.col("secondary_p50")
    thin_p, thin_s = nz("primary_samples", 0) < K.CONFIDENCE_MIN_SAMPLES, nz("secondary_samples", 0) < K.CONFIDENCE_MIN_SAMPLES
    verdict = (F.when(s.isNull(), "primary_only").when(thin_p & thin_s, "gathering").when(thin_s, "primary_active")
               .when(thin_p, "secondary_active").when(p < s * K.COMPARISON_MARGIN, "primary")
               .when(s < p * K.COMPARISON_MARGIN, "secondary").otherwise("similar"))
    return a.withColumn("better", verdict)
