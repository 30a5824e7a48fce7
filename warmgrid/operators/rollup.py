"""Aggregations: samples to hours, hours to days, periods, units and fleets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions import weather as W
from warmgrid.functions.numeric import c, nearest_rank, nz, rnd, sum_if

BEST_DELTA = "coalesce(solar_normalization_delta_4d, solar_normalization_delta, 0.0)"


def hourly_rollup(samples: DataFrame, high=K.HIGH_WIND, extreme=K.EXTREME_WIND) -> DataFrame:
    """Samples to hours: means, nearest-rank p90 wind, bucket counts, aux share.

    Two phases: partial counts per distinct wind value, then the rank over those
    values, so an hour with very many samples never gathers them in one task.
    """
    keys = ["site_id", "hr"]
    s = samples.withColumn("hr", F.date_trunc("hour", "ts"))
    means = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[F.avg(x).alias(x) for x in ("temp", "solar_factor", "solar_vector_s", "solar_vector_e", "solar_vector_w",
                                      "correction_percent", "humidity", "dni", "dhi", "ghi", "cloud_coverage")],
        *[F.count_if(F.col("wind_bucket") == b).alias(f"n_{b}") for b in K.WIND_BUCKETS],
        F.avg(F.col("aux_active").cast("double")).alias("aux_fraction"),
        F.max_by("solar_data_time", F.when(F.col("solar_data_time").isNotNull(), F.col("ts"))).alias("solar_data_time"),
    )
    counts = s.groupBy(*keys, "effective_wind").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*keys)
    run = F.sum("m").over(w.orderBy("effective_wind"))
    ranked = counts.select(*keys, "effective_wind", run.alias("upto"), F.sum("m").over(w).alias("n"))
    p90 = ranked.filter(F.col("upto") >= F.ceil(F.lit(0.9) * F.col("n"))).groupBy(*keys).agg(
        F.min("effective_wind").alias("effective_wind"))
    return means.join(p90, keys).withColumns({
        "wind_bucket": W.wind_bucket("effective_wind", high, extreme),
        "auxiliary_active": F.col("aux_fraction") >= K.MIXED_HIGH,
        "is_mixed_mode": (F.col("aux_fraction") > K.MIXED_LOW) & (F.col("aux_fraction") < K.MIXED_HIGH),
    })


def regime_split_cols() -> dict[str, Column]:
    return {
        "regime_heating_kwh": sum_if(F.col("mode").isin(*K.HEATING_MODES), "actual_kwh"),
        "regime_cooling_kwh": sum_if(F.col("mode").isin(*K.COOLING_MODES), "actual_kwh"),
    }


def regime_label(heating, cooling) -> Column:
    """heating, cooling, mixed or idle from an energy split."""
    total = c(heating) + c(cooling)
    return (
        F.when(total < K.ENERGY_GUARD, F.lit("idle"))
        .when(c(heating) / total >= K.REGIME_DOMINANCE, F.lit("heating"))
        .when(c(cooling) / total >= K.REGIME_DOMINANCE, F.lit("cooling"))
        .otherwise(F.lit("mixed"))
    )


def thermal_regime(hourly_unit: DataFrame, keys=("site_id", "local_date")) -> DataFrame:
    df = hourly_unit.groupBy(*keys).agg(*[v.alias(k) for k, v in regime_split_cols().items()])
    return df.withColumns({
        "regime": regime_label("regime_heating_kwh", "regime_cooling_kwh"),
        "dominant": F.when(F.col("regime_heating_kwh") + F.col("regime_cooling_kwh") >= K.ENERGY_GUARD,
                           F.when(F.col("regime_heating_kwh") >= F.col("regime_cooling_kwh"), "heating").otherwise("cooling")),
    })


def daily_scalars(hourly: DataFrame, bp=K.BALANCE_POINT) -> DataFrame:
    """Sums, means and provenance of each site-day."""
    rebuilt = nz("actual_kwh") + nz("aux_impact_kwh") + F.when(
        nz("temp") >= bp, -nz("solar_impact_kwh")).otherwise(nz("solar_impact_kwh"))

    def total(x):
        return F.sum(nz(x))

    df = hourly.groupBy("site_id", "local_date").agg(
        F.count(F.lit(1)).alias("n_hours"),
        *[rnd(total(f"{x}"), 2).alias(out) for x, out in (
            ("actual_kwh", "kwh"), ("expected_kwh", "expected_kwh"), ("forecasted_kwh", "forecasted_kwh"),
            ("aux_impact_kwh", "aux_impact_kwh"), ("solar_impact_kwh", "solar_impact_kwh"),
            ("guest_impact_kwh", "guest_impact_kwh"))],
        rnd(F.sum(F.expr(BEST_DELTA)), 5).alias("solar_normalization_delta"),
        rnd(F.sum("solar_normalization_delta_4d"), 5).alias("solar_normalization_delta_4d"),
        rnd(F.sum("solar_impact_4d_kwh"), 2).alias("solar_impact_4d_kwh"),
        rnd(F.when(F.bool_and(F.col("thermodynamic_gross_kwh").isNotNull()), F.sum("thermodynamic_gross_kwh"))
            .otherwise(F.sum(rebuilt)), 2).alias("thermodynamic_gross_kwh"),
        rnd(total("tdd"), 1).alias("tdd"),
        rnd(F.avg("temp"), 1).alias("temp"),
        rnd(F.avg(nz("effective_wind")), 1).alias("wind"),
        rnd(F.avg(nz("solar_factor")), 3).alias("solar_factor"),
        rnd(total("actual_kwh") - total("expected_kwh"), 2).alias("deviation"),
        *[F.max_by(x, "ts").alias(x) for x in ("primary_entity", "secondary_entity", "crossover_day")],
    )
    return df


def daily_rollup(hourly: DataFrame, hourly_unit: DataFrame, bp=K.BALANCE_POINT, maps: bool = True) -> DataFrame:
    """Daily history: scalars from the hourly log, unit maps and regime split from unit-hours.

    Both inputs shrink by partial aggregation before their shuffle on (site, day).
    """
    per_unit = hourly_unit.groupBy("site_id", "local_date", "unit_id").agg(
        F.sum("actual_kwh").alias("u_kwh"), F.sum("expected_kwh").alias("u_exp"),
        *[v.alias(k) for k, v in regime_split_cols().items()])
    aggs = [
        rnd(F.sum("regime_heating_kwh"), 3).alias("regime_heating_kwh"),
        rnd(F.sum("regime_cooling_kwh"), 3).alias("regime_cooling_kwh"),
        F.count(F.lit(1)).alias("n_units"),
    ]
    if maps:
        entries = F.collect_list(F.struct("unit_id", rnd("u_kwh", 3).alias("v")))
        expected = F.collect_list(F.struct("unit_id", rnd("u_exp", 3).alias("v")))
        aggs += [F.map_from_entries(F.sort_array(entries)).alias("unit_breakdown"),
                 F.map_from_entries(F.sort_array(expected)).alias("unit_expected_breakdown")]
    by_unit = per_unit.groupBy("site_id", "local_date").agg(*aggs)
    df = daily_scalars(hourly, bp).join(by_unit, ["site_id", "local_date"], "left")
    return df.withColumn("regime", regime_label(nz("regime_heating_kwh"), nz("regime_cooling_kwh")))


VECTOR_FIELDS = ("temp", "wind", "tdd", "actual_kwh", "solar_rad", "solar_norm_delta",
                 "solar_norm_delta_4d", "dni", "dhi")


def hourly_slots(hourly: DataFrame) -> DataFrame:
    """One row per (site, day, hour slot): states averaged, energies summed."""
    return hourly.groupBy("site_id", "local_date", "hour").agg(
        F.avg("temp").alias("temp"), F.avg(nz("effective_wind")).alias("wind"),
        F.sum(nz("tdd")).alias("tdd"), F.sum(nz("actual_kwh")).alias("actual_kwh"),
        F.avg(nz("solar_factor")).alias("solar_rad"),
        F.sum(nz("solar_normalization_delta")).alias("solar_norm_delta"),
        rnd(F.sum("solar_normalization_delta_4d"), 5).alias("solar_norm_delta_4d"),
        rnd(F.avg("dni"), 2).alias("dni"), rnd(F.avg("dhi"), 2).alias("dhi"),
    )


def hourly_vectors(hourly: DataFrame) -> DataFrame:
    """24-slot arrays per site-day; a missing hour stays NULL. At most 24 rows per group."""
    slots = hourly_slots(hourly)
    packed = F.map_from_entries(F.collect_list(F.struct("hour", F.struct(*VECTOR_FIELDS))))
    df = slots.groupBy("site_id", "local_date").agg(packed.alias("m"))
    arrays = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.try_element_at(F.col("m"), h))
    df = df.select("site_id", "local_date", arrays.alias("slots"))
    return df.select("site_id", "local_date", F.struct(*[F.col(f"slots.{f}").alias(f) for f in VECTOR_FIELDS]).alias("hourly_vectors"))


def backfill_daily(daily: DataFrame, fresh: DataFrame, cols: list[str]) -> DataFrame:
    """Merge days re-aggregated from hours into the daily history.

    A new day needs 20 hours. An existing day is replaced unless its stored total
    exceeds the re-aggregated one by more than max(1 kWh, 5 %).
    """
    old = daily.select("site_id", "local_date", F.struct(*cols).alias("old"))
    new = fresh.select("site_id", "local_date", "n_hours", F.struct(*cols).alias("new"))
    j = old.join(new, ["site_id", "local_date"], "full")
    pruned = (F.abs(F.col("new.kwh") - F.col("old.kwh")) > F.greatest(F.lit(1.0), 0.05 * F.col("old.kwh"))) & (
        F.col("old.kwh") > F.col("new.kwh"))
    take = F.when(F.col("new").isNull(), False).when(F.col("old").isNull(), F.col("n_hours") >= K.MIN_DAY_HOURS).otherwise(~pruned)
    j = j.withColumn("from_log", take).filter(F.col("old").isNotNull() | F.col("from_log"))
    pick = F.when(F.col("from_log"), F.col("new")).otherwise(F.col("old"))
    return j.select("site_id", "local_date", "from_log", pick.alias("p")).select("site_id", "local_date", "from_log", "p.*")


def period_totals(daily: DataFrame, start: Column, end: Column) -> DataFrame:
    """Actual kWh, mean temperature and wind, and kWh per degree-day of a period."""
    d = daily.filter(F.col("local_date").between(start, end))
    return d.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("days"), rnd(F.sum("kwh"), 3).alias("kwh"),
        rnd(F.avg("temp"), 1).alias("temp"), rnd(F.avg("wind"), 1).alias("wind"),
        rnd(F.avg("tdd"), 1).alias("avg_tdd"),
        rnd(F.when(F.sum("tdd") > K.ENERGY_GUARD, F.sum("kwh") / F.sum("tdd")), 3).alias("efficiency"))


def todate_stats(hourly: DataFrame, daily: DataFrame, as_of: Column) -> DataFrame:
    """Today / week / month to date, the same periods last year, and trailing efficiency.

    One conditional-aggregate scan of each input; the output is long (period rows).
    """
    week = F.date_trunc("week", as_of).cast("date")
    month = F.trunc(as_of, "month")
    h = hourly.filter((F.col("local_date") >= F.least(week, month)) & (F.col("local_date") <= as_of))
    actual = _periods(h, {"today": F.col("local_date") == as_of,
                          "week": (F.col("local_date") >= week) & (F.col("local_date") >= month),
                          "month": F.col("local_date") >= month}, "effective_wind")
    ly_day = F.add_months(as_of, -12)
    ly_week = last_year_iso(week)
    ly_month = F.add_months(month, -12)
    last = _periods(daily.filter(F.col("local_date") >= F.date_sub(as_of, 400)), {
        "last_year_day": F.col("local_date") == ly_day,
        "last_year_week": F.col("local_date").between(ly_week, F.date_add(ly_week, 6)),
        "last_year_month": F.col("local_date").between(ly_month, F.last_day(ly_month)),
        "yesterday": F.col("local_date") == F.date_sub(as_of, 1),
        "last_7d": F.col("local_date").between(F.date_sub(as_of, 7), F.date_sub(as_of, 1)),
        "last_30d": F.col("local_date").between(F.date_sub(as_of, 30), F.date_sub(as_of, 1)),
    }, "wind", energy=True)
    return actual.unionByName(last)


def _periods(df: DataFrame, periods: dict[str, Column], wind: str, energy: bool = False) -> DataFrame:
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in periods.items()]))
    tdd = F.col("tdd") if energy else F.lit(None).cast("double")
    kwh = F.col("kwh") if energy else F.lit(None).cast("double")
    x = df.select("site_id", "temp", F.col(wind).alias("wind"), tdd.alias("tdd"), kwh.alias("kwh"), F.explode(tags).alias("period"))
    return x.groupBy("site_id", "period").agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.avg("temp"), 1).alias("temp"), rnd(F.avg("wind"), 1).alias("wind"),
        rnd(F.avg("tdd"), 1).alias("avg_tdd"),
        rnd(F.when(F.sum("tdd") > K.ENERGY_GUARD, F.sum("kwh") / F.sum("tdd")), 3).alias("efficiency"))


def last_year_iso(day: Column) -> Column:
    """Same ISO week and weekday one ISO year earlier; week 53 falls back to 52."""
    year = F.extract(F.lit("YEAROFWEEK"), day)
    week = F.weekofyear(day)
    jan4 = F.make_date(year - 1, F.lit(1), F.lit(4))
    monday1 = F.date_sub(jan4, F.weekday(jan4))
    last_week = F.weekofyear(F.make_date(year - 1, F.lit(12), F.lit(28)))
    return F.date_add(monday1, ((F.least(week, last_week) - 1) * 7 + F.weekday(day)).cast("int"))


def typical_day(daily: DataFrame, temp: float) -> DataFrame:
    """Median aux-free consumption of days near ``temp`` in calm wind, with confidence."""
    avg_wind = daily.filter(F.col("wind").isNotNull()).groupBy("site_id").agg(F.avg("wind").alias("mean_wind"))
    d = daily.filter(F.abs(F.col("temp") - temp) <= K.TYPICAL_TEMP_TOL).join(avg_wind, "site_id")
    d = d.filter(F.abs(nz("wind") - F.col("mean_wind")) < K.TYPICAL_WIND_TOL)
    n = F.count(F.lit(1))
    return d.groupBy("site_id").agg(
        n.alias("samples"),
        rnd(F.when(n >= K.TYPICAL_MIN_SAMPLES, F.median(F.col("kwh") + nz("aux_impact_kwh"))), 1).alias("typical_kwh"),
        F.when(n < K.TYPICAL_MIN_SAMPLES, "low").when(n >= K.TYPICAL_HIGH_SAMPLES, "high").otherwise("medium").alias("confidence"))


def max_daily(daily: DataFrame) -> DataFrame:
    return daily.groupBy("site_id").agg(F.max("kwh").alias("max_kwh"))


def stress_index(daily: DataFrame, plan: DataFrame) -> DataFrame:
    """Planned gross energy as a share of the largest day on record, in bands."""
    idx = F.when(F.col("max_kwh") > 0, 100.0 * F.col("gross_kwh") / F.col("max_kwh"))
    lo, mid, hi = K.STRESS_BANDS
    band = F.when(idx < lo, "light").when(idx < mid, "moderate").when(idx < hi, "heavy").otherwise("extreme")
    return plan.join(max_daily(daily), "site_id").withColumns({"stress_index": rnd(idx, 1), "band": F.when(idx.isNotNull(), band)})


def accumulated_impacts(hourly: DataFrame, hourly_unit: DataFrame) -> DataFrame:
    """Day totals of solar, guest, aux, heating, cooling and gross energy."""
    h = hourly.groupBy("site_id", "local_date").agg(*[
        F.sum(nz(x)).alias(x) for x in ("solar_impact_kwh", "guest_impact_kwh", "aux_impact_kwh", "thermodynamic_gross_kwh")])
    u = thermal_regime(hourly_unit)
    return h.join(u, ["site_id", "local_date"], "left").withColumns({
        "heating_kwh": nz("regime_heating_kwh"), "cooling_kwh": nz("regime_cooling_kwh")})


def mode_contamination(hourly_unit: DataFrame, last: int | None = 10) -> DataFrame:
    """Excluded-mode hours and kWh per day, for the latest (or all) contaminated days of each site."""
    bad = F.col("mode").isin(*K.EXCLUDED_MODES)
    d = hourly_unit.groupBy("site_id", "local_date").agg(
        F.count_if(bad).alias("excluded_hours"), sum_if(bad, "actual_kwh").alias("excluded_kwh"),
        *[F.count_if(F.col("mode") == m).alias(f"n_{m}") for m in ("cooling", "off", "dhw", "guest_heating", "guest_cooling")],
    ).filter(F.col("excluded_hours") > 0)
    if last is None:
        return d
    w = Window.partitionBy("site_id").orderBy(F.col("local_date").desc())
    return d.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= last)


def source_mix(hourly: DataFrame, sites: DataFrame) -> DataFrame:
    """Share of daylight hours per irradiance source and whether it supports the 4D model."""
    day = nz("solar_factor") > 0
    src = F.col("dni_dhi_source")
    n = hourly.filter(day & src.isNotNull()).groupBy("site_id", src.alias("source")).agg(F.count(F.lit(1)).alias("hours"))
    w = Window.partitionBy("site_id")
    total = F.sum("hours").over(w)
    real = F.sum(F.when(F.col("source").isin("native", "erbs_from_ghi"), F.col("hours")).otherwise(0)).over(w)
    top = F.row_number().over(w.orderBy(F.col("hours").desc(), "source")) == 1
    df = n.select("site_id", "source", "hours", rnd(100.0 * F.col("hours") / total, 1).alias("pct"),
                  total.alias("total"), (real / total).alias("share"), top.alias("is_dominant"))
    df = df.join(sites.select("site_id", "use_4d"), "site_id")
    ok = F.col("share") >= K.REAL_SOURCE_SHARE
    verdict = (F.when(F.col("total") < K.SOURCE_MIX_MIN_HOURS, "insufficient_data")
               .when(ok & F.col("use_4d"), "enabled_and_supported").when(ok, "disabled_but_supported")
               .when(F.col("use_4d"), "enabled_but_unsupported").otherwise("disabled_and_unsupported"))
    return df.withColumns({"real_source_share": rnd("share", 4), "verdict": verdict})


def dark_hour_means(hourly: DataFrame) -> DataFrame:
    """Mean dark, aux-free, mode-filtered energy per model cell."""
    dark = (F.col("solar_factor") < K.DARK_SOLAR_FACTOR) & ~F.col("auxiliary_active") & F.col("actual_kwh").isNotNull()
    ref = F.greatest(F.lit(0.0), F.col("actual_kwh") - nz("excluded_kwh"))
    return hourly.filter(dark).groupBy("site_id", F.rint("temp").cast("int").alias("temp_key"), "wind_bucket").agg(
        F.count(F.lit(1)).alias("n_dark_hours"), F.avg(ref).alias("dark_mean"))


def dark_hour_baseline(hourly: DataFrame, base_model: DataFrame, min_hours: int = 10, tol_pct: float = 15.0) -> DataFrame:
    """Stored cells against measured dark hours, with a verdict per cell."""
    j = base_model.select("site_id", "temp_key", "wind_bucket", F.col("kwh").alias("stored_kwh")).join(
        dark_hour_means(hourly), ["site_id", "temp_key", "wind_bucket"], "left")
    delta = F.col("stored_kwh") - F.col("dark_mean")
    pct = F.when(F.abs(F.col("dark_mean")) > 0.01, 100.0 * delta / F.col("dark_mean")).when(
        F.abs(F.col("stored_kwh")) <= 0.01, F.lit(0.0))
    n = F.coalesce("n_dark_hours", F.lit(0))
    # NULL pct with enough hours means the ratio is unbounded: inflated
    verdict = (F.when(n < min_hours, "unverifiable").when(pct.isNull() | (pct > tol_pct), "inflated")
               .when(pct < -tol_pct, "deflated").otherwise("ok"))
    enough = n >= min_hours
    return j.select("site_id", "temp_key", "wind_bucket", rnd("stored_kwh", 4).alias("stored_kwh"), n.alias("n_dark_hours"),
                    F.when(enough, rnd("dark_mean", 4)).alias("dark_mean_kwh"), F.when(enough, rnd(pct, 1)).alias("delta_pct"),
                    verdict.alias("verdict"))


def dark_hour_noise_floor(hourly_unit: DataFrame, hourly: DataFrame, units: DataFrame) -> DataFrame:
    """Calibrated noise floor per unit from the nearest-rank p10 of dark heating hours.

    Ranks come from counts per distinct value, so no unit's samples are gathered.
    """
    log_hours = hourly.groupBy("site_id").agg(F.count(F.lit(1)).alias("log_hours"))
    dark = hourly.filter(~F.col("auxiliary_active") & (nz("solar_factor") < K.DARK_SOLAR_FACTOR)).select("site_id", "ts")
    s = hourly_unit.filter((F.coalesce("mode", F.lit("heating")) == "heating") & (F.col("actual_kwh") >= 0)).join(
        dark, ["site_id", "ts"], "left_semi")
    v = s.groupBy("site_id", "unit_id", "actual_kwh").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("site_id", "unit_id")
    v = v.select("*", F.sum("m").over(w.orderBy("actual_kwh")).alias("upto"), F.sum("m").over(w).alias("n"))

    def at(rank):
        return F.min(F.when(F.col("upto") >= rank, F.col("actual_kwh")))

    q = v.groupBy("site_id", "unit_id").agg(
        F.max("n").alias("n"), at(F.greatest(F.ceil(F.lit(0.1) * F.col("n")), F.lit(1))).alias("p10"),
        at(F.floor(F.col("n") / 2) + 1).alias("median"))
    j = units.select("site_id", "unit_id", F.col("min_base").alias("prior")).join(q, ["site_id", "unit_id"], "left").join(log_hours, "site_id")
    status = (F.when(F.col("log_hours") < K.MIN_BASE_LOG_HOURS, "insufficient_log_data")
              .when(F.coalesce("n", F.lit(0)) < K.MIN_BASE_SAMPLES, "skipped_low_samples")
              .when((F.col("median") > 0) & (F.col("p10") > K.MIN_BASE_P10_MEDIAN * F.col("median")), "rejected_constant_load")
              .when(F.col("p10") > K.MIN_BASE_CEILING, "rejected_above_ceiling").otherwise("updated"))
    floor = F.lit(K.MIN_BASE_FLOOR)
    cand = F.greatest(floor, F.col("p10"))
    limited = F.when(F.col("prior") > 0, F.greatest(floor, F.least(
        F.col("prior") * (1 + K.MIN_BASE_RATE_LIMIT), F.greatest(F.col("prior") * (1 - K.MIN_BASE_RATE_LIMIT), cand)))).otherwise(cand)
    return j.withColumn("status", status).withColumn(
        "effective", F.when(F.col("status") == "updated", rnd(limited, 5)).otherwise(F.col("prior")))


def unit_daily(hourly_unit: DataFrame) -> DataFrame:
    """Unit-day energy with the running lifetime total (one row per unit-day)."""
    d = hourly_unit.groupBy("site_id", "unit_id", "local_date").agg(
        F.sum("actual_kwh").alias("kwh"), F.sum("expected_kwh").alias("expected_kwh"), F.count(F.lit(1)).alias("hours"))
    w = Window.partitionBy("site_id", "unit_id").orderBy("local_date").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("lifetime_kwh", F.sum("kwh").over(w))


def normal_equations(samples: DataFrame, keys=("site_id", "unit_id", "regime")) -> DataFrame:
    """Sums of the three-direction least-squares system: one partial + final aggregate."""
    s, e, w, y = F.col("ps"), F.col("pe"), F.col("pw"), F.col("impact")
    sums = {"ss": s * s, "ee": e * e, "ww": w * w, "se": s * e, "sw": s * w, "ew": e * w,
            "sy": s * y, "ey": e * y, "wy": w * y, "yy": y * y}
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])


def count_learnable_units(hourly_unit: DataFrame, units: DataFrame) -> DataFrame:
    """Heating units whose base reaches their threshold; the unit total where none does."""
    j = hourly_unit.join(units.select("site_id", "unit_id", "min_base"), ["site_id", "unit_id"])
    ok = (F.coalesce("mode", F.lit("heating")) == "heating") & (nz("expected_base_kwh") >= F.col("min_base"))
    return j.groupBy("site_id", "ts").agg(
        F.when(F.count_if(ok) > 0, F.count_if(ok)).otherwise(F.count(F.lit(1))).alias("n_learnable"))


def plan_coverage(base_model: DataFrame) -> DataFrame:
    return base_model.groupBy("site_id", "wind_bucket").agg(
        F.count(F.lit(1)).alias("cells"), F.min("temp_key").alias("temp_min"), F.max("temp_key").alias("temp_max"),
        F.sum("n").alias("observations"), F.count_if(F.col("n") < K.BUFFER_SIZE).alias("pending"))


def fleet_rollup(daily: DataFrame) -> DataFrame:
    """Fleet totals by month and regime with every subtotal level."""
    d = daily.select("site_id", F.date_format("local_date", "yyyy-MM").alias("month"),
                     regime_label("regime_heating_kwh", "regime_cooling_kwh").alias("regime"), "kwh", "tdd")
    return d.rollup("month", "regime").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("site_days"),
        F.sum("kwh").alias("kwh"), F.sum("tdd").alias("tdd"))
