"""Forecast tables: plans, accuracy, uncertainty, budgets and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions import weather as W
from warmgrid.functions.numeric import nz, rnd
from warmgrid.operators import enrich as E
from warmgrid.operators.score import Models, predict_hours, with_cell
from warmgrid.operators.rollup import last_year_iso
from warmgrid.operators.timeseries import inertia

SOURCES = ("primary", "secondary")


# --- accuracy ---------------------------------------------------------------------------


def daily_accuracy(hourly: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Forecast error of each day against its frozen plan, with day and night error.

    Gross demand (meter plus aux minus guest) is compared with the plan; an hour with
    only a net forecast is compared net.
    """
    gross = nz("actual_kwh") + nz("aux_impact_kwh") - nz("guest_impact_kwh")
    has_gross = F.col("forecasted_kwh_gross").isNotNull()
    err = F.when(has_gross, gross - F.col("forecasted_kwh_gross")).otherwise(nz("actual_kwh") - nz("guest_impact_kwh") - nz("forecasted_kwh"))
    daytime = F.col("hour").between(6, 21)
    a = hourly.groupBy("site_id", "local_date").agg(
        F.sum(gross).alias("_g"), F.sum(nz("actual_kwh")).alias("_n"), F.sum(nz("expected_kwh") + nz("aux_impact_kwh")).alias("_m"),
        rnd(F.avg(F.when(daytime, F.abs(err))), 2).alias("day_mae"), rnd(F.avg(F.when(~daytime, F.abs(err))), 2).alias("night_mae"),
        *[F.max_by(x, "ts").alias(x) for x in ("primary_entity", "secondary_entity")])
    j = a.join(snapshot.select("site_id", "local_date", F.col("kwh").alias("_f"), "source"), ["site_id", "local_date"])
    e = F.col("_g") - F.col("_f")
    return j.select("site_id", "local_date", rnd("_f", 2).alias("forecast_kwh"), rnd("_g", 2).alias("actual_kwh"), rnd("_n", 2).alias("net_actual_kwh"),
                    rnd("_m", 2).alias("modeled_kwh"), rnd(e, 2).alias("error_kwh"), rnd(F.abs(e), 2).alias("abs_error_kwh"),
                    "day_mae", "night_mae", "source", "primary_entity", "secondary_entity")


def source_breakdown(hourly: DataFrame) -> DataFrame:
    """Per day and provider: hours, forecast, actual, error and weather error."""
    gross = nz("actual_kwh") + nz("aux_impact_kwh") - nz("guest_impact_kwh")
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.col(f"forecasted_kwh_{s}").alias("net"), F.col(f"forecasted_kwh_gross_{s}").alias("gross"), F.col(f"{s}_entity").alias("entity")) for s in SOURCES])
    d = hourly.select("site_id", "local_date", "ts", gross.alias("g"), nz("actual_kwh").alias("n"), (nz("expected_kwh") + nz("aux_impact_kwh")).alias("m"), F.explode(rows).alias("f"))
    d = d.filter("f.net is not null")
    f = F.coalesce("f.gross", "f.net")
    err = F.when(F.col("f.gross").isNotNull(), F.col("g")).otherwise(F.col("n")) - f
    werr = F.when(F.col("f.gross").isNotNull(), F.col("m") - F.col("f.gross"))
    return d.groupBy("site_id", "local_date", F.col("f.source").alias("source")).agg(
        F.count(F.lit(1)).alias("hours"), rnd(F.sum(f), 2).alias("forecast"), rnd(F.sum("g"), 2).alias("actual"), rnd(F.sum(err), 2).alias("error"),
        rnd(F.sum(F.abs(err)), 2).alias("abs_error"), rnd(nz(F.sum(werr)), 2).alias("weather_error"), rnd(nz(F.sum(F.abs(werr))), 2).alias("abs_weather_error"), F.max_by("f.entity", "ts").alias("entity"))


def for_current_provider(breakdown: DataFrame, current: DataFrame) -> DataFrame:
    """Only days whose provider is the one in use now; ``current`` has site_id, source and entity."""
    return breakdown.join(current.select("site_id", "source", "entity"), ["site_id", "source", "entity"], "left_semi")


def accuracy_map(breakdown: DataFrame) -> DataFrame:
    """The breakdown as one map per day (at most two entries)."""
    entry = F.struct("hours", "forecast", "actual", "error", "abs_error", "weather_error", "abs_weather_error")
    return breakdown.groupBy("site_id", "local_date").agg(F.map_from_entries(F.collect_list(F.struct("source", entry))).alias("source_breakdown"))


def backfill_accuracy(hourly: DataFrame, as_of: Column) -> DataFrame:
    """Synthetic daily forecast history from logged expectations; today is left out."""
    h = hourly.filter(F.col("primary_entity").isNotNull() & (F.col("local_date") != as_of))
    n = h.groupBy("site_id", "local_date", "forecast_source").agg(
        F.count("forecast_source").alias("n"), F.sum("actual_kwh").alias("a"), F.sum("expected_kwh").alias("e"), F.min("ts").alias("t0"))
    # most frequent provider; the one seen first wins a tie
    d = n.groupBy("site_id", "local_date").agg(
        rnd(F.sum("e"), 2).alias("forecast_kwh"), rnd(F.sum("a"), 2).alias("actual_kwh"),
        F.max_by("forecast_source", F.struct(F.col("n"), -F.unix_timestamp(F.col("t0").cast("timestamp")))).alias("source"))
    d = d.withColumn("error_kwh", rnd(F.col("actual_kwh") - F.col("forecast_kwh"), 2))
    return d.withColumns({"abs_error_kwh": F.abs("error_kwh"), "source": F.coalesce("source", F.lit("primary"))})


def forecast_uncertainty(history: DataFrame, current: DataFrame) -> DataFrame:
    """Median and 95th percentile of daily absolute error, for the provider in use now."""
    h = history.join(current.select("site_id", "primary_entity"), ["site_id", "primary_entity"], "left_semi")
    p = F.percentile("abs_error_kwh", F.array(F.lit(0.5), F.lit(0.95)))
    a = h.groupBy("site_id").agg(p.alias("p"), F.count(F.lit(1)).alias("samples"))
    j = current.select("site_id").distinct().join(a, "site_id", "left")
    return j.select("site_id", F.coalesce(rnd(F.col("p")[0], 2), F.lit(K.UNCERTAINTY_P50)).alias("p50"),
                    F.coalesce(rnd(F.col("p")[1], 2), F.lit(K.UNCERTAINTY_P95)).alias("p95"), nz("samples", 0).alias("samples"))


def source_uncertainty(breakdown: DataFrame, current: DataFrame) -> DataFrame:
    breakdown = for_current_provider(breakdown, current)
    p = F.percentile("abs_error", F.array(F.lit(0.5), F.lit(0.95)))
    a = breakdown.groupBy("site_id", "source").agg(p.alias("p"), F.count(F.lit(1)).alias("samples"))
    return a.select("site_id", "source", rnd(F.col("p")[0], 2).alias("p50"), rnd(F.col("p")[1], 2).alias("p95"), "samples")


def period_accuracy(breakdown: DataFrame, as_of: Column, current: DataFrame, days=(7, 30)) -> DataFrame:
    """Trailing MAE, MAPE and weather error of the current provider of each kind, both windows in one scan."""
    breakdown = for_current_provider(breakdown, current)
    tags = F.array_compact(F.array(*[F.when(F.col("local_date") >= F.date_sub(as_of, d), F.lit(d)) for d in days]))
    b = breakdown.filter(F.col("local_date") >= F.date_sub(as_of, max(days))).withColumn("days", F.explode(tags))
    a = b.groupBy("site_id", "source", "days").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("abs_error").alias("_h"), F.sum(F.abs("error")).alias("_d"), F.sum("actual").alias("_a"),
        F.avg(F.abs("weather_error")).alias("_w"), F.avg("weather_error").alias("_b"))

    def pct(x):
        return rnd(F.when(F.col("_a") > 0, F.col(x) / F.col("_a") * 100).otherwise(0.0), 1)

    return a.select("site_id", "source", "days", "samples", rnd(F.col("_h") / F.col("samples"), 2).alias("hourly_mae"), pct("_h").alias("hourly_mape"),
                    rnd(F.col("_d") / F.col("samples"), 2).alias("daily_mae"), pct("_d").alias("daily_mape"), rnd("_w", 2).alias("weather_mae"), rnd("_b", 2).alias("weather_bias"))


def week_horizon_error(plans: DataFrame, history: DataFrame, as_of: Column, window: int = 90) -> DataFrame:
    """Error of seven-day sums over fully scored weeks: median and 95th percentile."""
    p = plans.filter(F.col("made_on").between(F.date_sub(as_of, window), F.date_sub(as_of, 7)) & (F.size("planned_kwh") == 7))
    p = p.select("site_id", "made_on", F.posexplode("planned_kwh").alias("k", "planned")).withColumn("local_date", F.date_add("made_on", F.col("k")))
    j = p.join(history.select("site_id", "local_date", "actual_kwh"), ["site_id", "local_date"])
    w = j.groupBy("site_id", "made_on").agg(F.count("actual_kwh").alias("n"), F.abs(F.sum("planned") - F.sum("actual_kwh")).alias("err")).filter("n = 7")
    q = F.percentile("err", F.array(F.lit(0.5), F.lit(0.95)))
    return w.groupBy("site_id").agg(F.count(F.lit(1)).alias("samples"), q.alias("p")).select(
        "site_id", "samples", rnd(F.col("p")[0], 2).alias("p50"), rnd(F.col("p")[1], 2).alias("p95"))


# --- plans ------------------------------------------------------------------------------


def forecast_weather(forecast: DataFrame, hourly: DataFrame, sites: DataFrame) -> DataFrame:
    """Forecast hours with rolled-in thermal inertia, wind, cloud, sun and screens open.

    Inertia is one window over logged then forecast hours of each site.
    """
    cols = ["site_id", "ts", "temp"]
    past = hourly.select(*cols, F.lit(True).alias("_log"))
    ahead = forecast.select("site_id", "ts", F.col("temperature").alias("temp"), F.lit(False).alias("_log"))
    ahead = ahead.join(past.select("site_id", "ts"), ["site_id", "ts"], "left_anti")
    rolled = inertia(past.unionByName(ahead)).filter("not _log").select("site_id", "ts", "inertia_temp")
    f = forecast.join(rolled, ["site_id", "ts"])
    f = E.fill_cloud(f).withColumns({"temp": F.col("inertia_temp"), "effective_wind": W.effective_wind("wind_speed", "wind_gust_speed"), "correction_percent": F.lit(100.0)})
    f = E.enrich_solar_factor(E.enrich_solar_geometry(f, sites), "cloud_used")
    return with_cell(E.screen_potential(f, sites))


def forecast_hours(weather: DataFrame, modes: DataFrame, models: Models, force_aux: bool = False) -> DataFrame:
    """Hourly plan of the forecast weather; aux is ignored unless forced."""
    return predict_hours(weather.withColumn("auxiliary_active", F.lit(force_aux)), modes, models)


def forecast_day(items: DataFrame, days: DataFrame, daily_items: DataFrame | None = None) -> DataFrame:
    """Exactly 24 weather rows per wanted day: gaps repeat the last known item, else the daily item.

    Leading gaps take the first item of the day.
    """
    want = days.select("site_id", "local_date").withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    got = items.select("site_id", "local_date", "hour", F.struct("temperature", "wind_speed").alias("x"))
    j = want.join(got, ["site_id", "local_date", "hour"], "left")
    day = Window.partitionBy("site_id", "local_date").orderBy("hour")
    filled = F.coalesce(F.last("x", ignorenulls=True).over(day.rowsBetween(Window.unboundedPreceding, 0)),
                        F.first("x", ignorenulls=True).over(day.rowsBetween(0, Window.unboundedFollowing)))
    j = j.withColumns({"y": filled, "how": F.when(F.col("x").isNotNull(), "item").when(filled.isNotNull(), "filled")})
    if daily_items is not None:
        d = daily_items.select("site_id", "local_date", F.struct("temperature", "wind_speed").alias("d"))
        j = j.join(d, ["site_id", "local_date"], "left").withColumns({
            "how": F.coalesce("how", F.when(F.col("d").isNotNull(), F.lit("daily"))), "y": F.coalesce("y", "d")})
    return j.filter("y is not null").select("site_id", "local_date", "hour", "how", "y.*")


def forecast_week(day_plans: DataFrame, history: DataFrame, uncertainty: DataFrame, as_of: Column) -> DataFrame:
    """Seven days ahead with last-year fallback, extremes, p95 range and confidence."""
    sites = day_plans.select("site_id").distinct()
    want = sites.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("local_date", F.date_add(as_of, F.col("k")))
    want = want.withColumn("ly_date", last_year_iso(F.col("local_date")))
    ly = history.select("site_id", F.col("local_date").alias("ly_date"), F.struct("kwh", "temp").alias("l"))
    p = day_plans.select("site_id", "local_date", F.struct("kwh", "temp").alias("p"))
    j = want.join(p, ["site_id", "local_date"], "left").join(ly, ["site_id", "ly_date"], "left")
    j = j.withColumns({"reliable": F.col("p").isNotNull(), "x": F.coalesce("p", "l")}).filter("x is not null")
    early = -F.col("k")
    a = j.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("days"), F.count_if("reliable").alias("planned_days"), F.sum("x.kwh").alias("kwh"), F.avg("x.temp").alias("temp"),
        F.min_by("local_date", F.struct("x.temp", "k")).alias("coldest"), F.max_by("local_date", F.struct(F.col("x.temp"), early)).alias("warmest"),
        F.max_by("local_date", F.struct(F.col("x.kwh"), early)).alias("peak"), F.min_by("local_date", F.struct("x.kwh", "k")).alias("lightest"))
    u = a.join(uncertainty, "site_id", "left")
    spread = nz("p95", K.UNCERTAINTY_P95)
    conf = (F.when(nz("samples", 0) < K.CONFIDENCE_MIN_SAMPLES, "low").when((F.col("samples") >= K.CONFIDENCE_HIGH_SAMPLES) & (F.col("p50") < K.CONFIDENCE_HIGH_ERROR), "high")
            .when(F.col("p50") < K.CONFIDENCE_MEDIUM_ERROR, "medium").otherwise("low"))
    return u.withColumns({"range_min": F.greatest(F.lit(0.0), F.col("kwh") - spread), "range_max": F.col("kwh") + spread, "confidence": conf})


def isolate_unit(unit_plan: DataFrame, hour_plan: DataFrame, unit: str) -> DataFrame:
    """What the site plan leaves for one unit: total minus the other units, never negative."""
    rest = unit_plan.groupBy("site_id", "ts").agg(F.sum(F.when(F.col("unit_id") != unit, F.col("net")).otherwise(0.0)).alias("others"))
    return hour_plan.join(rest, ["site_id", "ts"]).withColumn("isolated_kwh", F.greatest(F.lit(0.0), F.col("total_kwh") - F.col("others")))


def shadow_forecasts(weather_by_source: DataFrame, modes: DataFrame, models: Models) -> DataFrame:
    """Score every provider (and the blend) in one plan, net and gross, one row per hour."""
    s = predict_hours(weather_by_source.withColumn("auxiliary_active", F.lit(False)), modes, models, ["site_id", "ts", "source"])
    aggs = []
    for x in ("primary", "secondary", "blended"):
        here = F.col("source") == x
        aggs += [F.max(F.when(here, F.col("total_kwh"))).alias(f"net_{x}"), F.max(F.when(here, F.col("total_kwh") + F.col("solar_heating_kwh"))).alias(f"gross_{x}")]
    return s.groupBy("site_id", "ts").agg(*aggs)


def midnight_snapshot(plans: DataFrame) -> DataFrame:
    """The last plan issued at or before midnight of each site-day, as a whole: hours of earlier plans don't fill it up."""
    known = plans.filter(F.col("issued_at") <= F.col("local_date").cast("timestamp_ntz"))
    last = known.groupBy("site_id", "local_date").agg(F.max("issued_at").alias("issued_at"))
    return known.join(last, ["site_id", "local_date", "issued_at"])


def forecast_summary(hour_plan: DataFrame, unit_plan: DataFrame, k: int = 3) -> DataFrame:
    """Per day: total, peak hour and the largest units as text."""
    d = F.col("ts").cast("date")
    day = hour_plan.groupBy("site_id", d.alias("local_date")).agg(
        F.sum("total_kwh").alias("total_kwh"), F.max_by(F.hour("ts"), F.struct(F.col("total_kwh"), -F.hour("ts"))).alias("peak_hour"),
        F.count_if(F.col("aux_kwh") > 0).alias("aux_hours"))
    u = unit_plan.groupBy("site_id", d.alias("local_date"), "unit_id").agg(rnd(F.sum("net"), 1).alias("kwh")).filter("kwh > 0")
    w = Window.partitionBy("site_id", "local_date").orderBy(F.col("kwh").desc(), "unit_id")
    top = u.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    label = F.concat("unit_id", F.lit(" "), F.format_string("%.1f", F.col("kwh")))
    text = top.groupBy("site_id", "local_date").agg(F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.struct("rk", label.alias("t")))), lambda x: x["t"])).alias("top_units"))
    return day.join(text, ["site_id", "local_date"], "left")


def daily_budget(hourly: DataFrame, plan: DataFrame, now_hour: int) -> DataFrame:
    """Actual so far plus the remaining plan, net and gross, per site-day."""
    a = hourly.filter(F.col("hour") < now_hour).groupBy("site_id", "local_date").agg(
        F.sum("actual_kwh").alias("actual"), F.sum(nz("actual_kwh") + nz("aux_impact_kwh") - nz("guest_impact_kwh")).alias("gross"))
    p = plan.filter(F.col("hour") >= now_hour).groupBy("site_id", "local_date").agg(F.sum("kwh").alias("plan"), F.sum("kwh_gross").alias("plan_gross"))
    j = a.join(p, ["site_id", "local_date"], "full")
    return j.select("site_id", "local_date", nz("actual").alias("actual_so_far"), nz("plan").alias("remaining"), (nz("actual") + nz("plan")).alias("budget_kwh"),
                    (nz("gross") + nz("plan_gross")).alias("gross_kwh"))
