"""Row enrichments, filters and classification cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions import weather as W
from warmgrid.functions.numeric import c, nz


def enrich_wind(samples: DataFrame, gust_factor=K.WIND_GUST_FACTOR,
                high=K.HIGH_WIND, extreme=K.EXTREME_WIND) -> DataFrame:
    """Convert speeds to m/s, blend in gusts, and bucket the effective wind."""
    speed = W.speed_to_ms("wind_speed", "wind_unit")
    gust = W.speed_to_ms("wind_gust", "wind_unit")
    df = samples.withColumn("effective_wind", W.effective_wind(speed, gust, gust_factor))
    return df.withColumn("wind_bucket", W.wind_bucket("effective_wind", high, extreme))


def enrich_tdd(hourly: DataFrame, bp=K.BALANCE_POINT) -> DataFrame:
    return hourly.withColumns({"tdd": W.tdd_hour("temp", bp), "side": W.side("temp", bp)})


def filter_days_back(df: DataFrame, days: int | None, as_of: Column) -> DataFrame:
    """Rows of the last ``days`` days; None keeps everything."""
    return df if days is None else df.filter(F.col("local_date") >= F.date_sub(as_of, days))


def pure_hours(hourly: DataFrame, need: str = "status") -> DataFrame:
    """Label each hour with the first discard rule it hits (NULL means pure).

    ``need='status'`` also rejects hours whose learning status is not a plain
    success; ``need='wind'`` rejects hours without wind or temperature instead.
    """
    reason = (
        F.when(nz("actual_kwh") <= 0, F.lit("zero_or_negative_consumption"))
        .when(nz("solar_impact_kwh") > 0.1, F.lit("solar_interference"))
        .when(F.col("auxiliary_active"), F.lit("auxiliary_active"))
    )
    if need == "status":
        ok = F.coalesce(F.col("learning_status"), F.lit("active")).isin(
            "active", "success", "model_updated")
        reason = reason.when(~ok, F.lit("learning_status_exclusion"))
    else:
        missing = F.col("effective_wind").isNull() | F.col("temp").isNull()
        reason = reason.when(missing, F.lit("missing_wind_or_temp"))
    return hourly.withColumn("reason", reason)


def discard_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("site_id", F.coalesce("reason", F.lit("pure")).alias("reason")).agg(
        F.count(F.lit(1)).alias("hours"))


def is_poisoned(status, daily: bool = False) -> Column:
    s = F.coalesce(c(status), F.lit(""))
    bad = s.startswith("skipped_") | (s == "cooldown_post_aux")
    return bad if daily else bad | (s == "disabled")


def learnable_hours(hourly: DataFrame, daily: bool = False) -> DataFrame:
    return hourly.filter(~is_poisoned("learning_status", daily))


def exclude_modes(hourly_unit: DataFrame) -> DataFrame:
    """Per site-hour energy with the excluded modes taken out."""
    out = F.when(F.col("mode").isin(*K.EXCLUDED_MODES), F.col("actual_kwh")).otherwise(0.0)
    return hourly_unit.groupBy("site_id", "ts").agg(
        F.sum("actual_kwh").alias("total_kwh"), F.sum(out).alias("excluded_kwh"),
    ).withColumn("learning_kwh", F.greatest(F.lit(0.0), F.col("total_kwh") - F.col("excluded_kwh")))


def shutdown_flag(magnitude="magnitude", min_base="min_base") -> Column:
    """Unit is switched off by the sun: strong potential, heating, almost no draw."""
    actual, base = nz("actual_kwh"), nz("expected_base_kwh")
    thr = F.when(c(min_base) > 0, c(min_base)).otherwise(F.lit(K.SHUTDOWN_MIN_BASE))
    parasitic = (base > 0) & (actual < K.SHUTDOWN_ACTUAL_FLOOR)
    throttled = (base >= thr) & (actual < K.SHUTDOWN_RATIO * base)
    return (
        (c(magnitude) >= K.SHUTDOWN_MIN_MAGNITUDE) & (F.col("mode") == "heating")
        & F.col("solar_affected") & (parasitic | throttled)
    )


def shutdown_flags(hourly_unit: DataFrame, hourly: DataFrame, units: DataFrame) -> DataFrame:
    """Unit-hours with the shutdown flag; needs the hour's solar vector."""
    mag = F.sqrt(sum((F.col(f"solar_vector_{f}") * F.col(f"solar_vector_{f}")) for f in "sew"))
    sun = hourly.select("site_id", "ts", mag.alias("magnitude"))
    dims = units.select("site_id", "unit_id", "solar_affected", "min_base")
    return (
        hourly_unit.join(sun, ["site_id", "ts"]).join(dims, ["site_id", "unit_id"])
        .withColumn("is_shutdown", shutdown_flag())
    )


def shutdown_arrays(flagged: DataFrame) -> DataFrame:
    """Back to one row per hour; an hour has as many entries as the site has units."""
    return flagged.groupBy("site_id", "ts").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_shutdown"), F.col("unit_id")))).alias("solar_dominant_entities"))


def sanitize_coefficients(coeffs: DataFrame, cols=("s", "e", "w")) -> DataFrame:
    return coeffs.withColumns({x: F.greatest(F.lit(0.0), nz(x)) for x in cols})


def mode_default(hourly_unit: DataFrame) -> DataFrame:
    return hourly_unit.withColumn("mode", F.coalesce("mode", F.lit("heating")))


def explode_units(hourly: DataFrame) -> DataFrame:
    """``hourly_unit`` from the sparse maps of the hourly log, mode defaulting to heating."""
    df = hourly.select("site_id", "ts", "unit_modes", "unit_expected_breakdown",
                       F.explode("unit_breakdown").alias("unit_id", "actual_kwh"))
    return df.select(
        "site_id", "ts", "unit_id", "actual_kwh",
        F.coalesce(F.element_at("unit_modes", F.col("unit_id")), F.lit("heating")).alias("mode"),
        F.element_at("unit_expected_breakdown", F.col("unit_id")).alias("expected_kwh"),
    )


def plausible_gate(boundaries: DataFrame) -> DataFrame:
    """Apply-gate of a learned obstruction boundary, with the first failing check."""
    lo = F.when(F.col("side") == "low", K.OBSTRUCTION_LOW_RANGE[0]).otherwise(K.OBSTRUCTION_HIGH_RANGE[0])
    hi = F.when(F.col("side") == "low", K.OBSTRUCTION_LOW_RANGE[1]).otherwise(K.OBSTRUCTION_HIGH_RANGE[1])
    inside = F.coalesce(F.col("best_critical_elev").between(lo, hi), F.lit(False))
    reason = (
        F.when(~F.coalesce(F.col("learned"), F.lit(False)), F.lit("not_learned"))
        .when(nz("sse_improvement_ratio") < K.OBSTRUCTION_SSE_GAIN, F.lit("below_sse_threshold"))
        .when(~inside, F.lit("physically_implausible"))
        .when(~F.col("stable_across_windows"), F.lit("single_window_only"))
    )
    return boundaries.withColumns({"applicable": reason.isNull(), "applicable_reason": reason})


def interference_flags(hourly: DataFrame) -> DataFrame:
    """Mixed-mode and dual-interference flags and the status they force."""
    f = F.col("aux_fraction")
    mixed = (f > K.MIXED_LOW) & (f < K.MIXED_HIGH)
    dual = (nz("solar_impact_kwh") > K.DUAL_INTERFERENCE) & (nz("aux_impact_kwh") > K.DUAL_INTERFERENCE)
    s = F.col("learning_status")
    final = (
        F.when(s == "cooldown_post_aux", s)
        .when(mixed, F.lit("skipped_mixed_mode"))
        .when(dual, F.lit("skipped_dual_interference"))
        .otherwise(s)
    )
    return hourly.withColumns({"is_mixed": mixed, "is_dual": dual, "final_status": final})


def display_solar(hourly: DataFrame, sites: DataFrame) -> DataFrame:
    """4D solar value where the site asks for it and it exists, else 3D, else 0."""
    flags = sites.select("site_id", "use_4d")
    three = nz("solar_impact_kwh")
    pick = F.when(F.col("use_4d"), F.coalesce("solar_impact_4d_kwh", three)).otherwise(three)
    return hourly.join(flags, "site_id", "left").withColumn("display_solar_kwh", pick)
