"""Windowed and recurrent operators over hours, days and readings.

Hour-grain windows are per site or per unit; after the hourly rollup a key holds
one row per calendar hour, so a window never depends on the number of samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions.numeric import c, nz, rnd
from warmgrid.operators.scan import affine_scan, previous_row


def by_site():
    return Window.partitionBy("site_id").orderBy("ts")


def epoch_hours(ts="ts") -> Column:
    return F.floor(F.unix_timestamp(c(ts).cast("timestamp")) / 3600).cast("long")


def meter_delta(readings: DataFrame, max_delta: float = K.MAX_ENERGY_DELTA, block: str = "hour") -> DataFrame:
    """Cumulative readings to deltas; resets and spikes are dropped but re-baseline.

    Hot-water deltas keep the baseline moving and count as zero heating energy.
    """
    d = previous_row(readings, ["site_id", "unit_id"], "ts", ["ts", "event_id"], ["reading_kwh"], "prev", block)
    raw = F.col("reading_kwh") - F.col("prev.reading_kwh")
    status = (F.when(raw.isNull(), "first").when(raw < 0, "reset").when(raw > max_delta, "spike")
              .when(F.col("mode") == "dhw", "dhw").otherwise("ok"))
    return d.withColumn("status", status).withColumn(
        "delta_kwh", F.when(F.col("status") == "ok", raw).otherwise(F.lit(0.0))).drop("prev")


def _weighted(arr: Column, weight) -> Column:
    """Weighted mean of an array; ``weight(distance from newest)``."""
    n = F.size(arr)
    ws = F.transform(arr, lambda x, i: weight(n - 1 - i))
    num = F.aggregate(F.zip_with(arr, ws, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return num / F.aggregate(ws, F.lit(0.0), lambda s, x: s + x)


def inertia(hourly: DataFrame, tau: int = K.INERTIA_HOURS, out: str = "inertia_temp") -> DataFrame:
    """Causal exponential mean of at most 5*tau rows (cap 168), none older than tau hours."""
    rows = min(5 * tau, 168)
    w = Window.partitionBy("site_id").orderBy("_h").rangeBetween(-tau, 0)
    d = hourly.withColumn("_h", epoch_hours())
    arr = F.slice(F.reverse(F.collect_list("temp").over(w)), 1, rows)
    d = d.withColumn("_arr", F.reverse(arr))
    return d.withColumn(out, _weighted(F.col("_arr"), lambda k: F.exp(-k / F.lit(float(tau))))).drop("_h", "_arr")


def gaussian_weights(hours: int) -> list[float]:
    if hours <= 2:
        return [1.0 / hours] * hours
    mid, sigma = (hours - 1) / 2.0, hours / 4.0
    raw = [math.exp(-((i - mid) ** 2) / (2 * sigma * sigma)) for i in range(hours)]
    return [x / sum(raw) for x in raw]


def inertia_gaussian(hourly: DataFrame, hours: int, out: str = "gaussian_temp") -> DataFrame:
    """Bell-weighted mean of the last ``hours`` rows; NULL until that many exist."""
    w = gaussian_weights(hours)
    terms = [F.lag("temp", hours - 1 - i).over(by_site()) * w[i] for i in range(hours - 1)]
    total = F.col("temp") * w[-1]
    for x in terms:
        total = total + x
    return hourly.withColumn(out, total)


def inertia_asymmetric(hourly: DataFrame) -> DataFrame:
    """Slow four-row profile when falling, two rows when rising, three when stable."""
    d = hourly.withColumns({
        "_past": F.first("temp").over(by_site().rowsBetween(-4, 0)),
        "_tail": F.reverse(F.collect_list("temp").over(by_site().rowsBetween(-3, 0)))})
    regime = (F.when(F.col("temp") < F.col("_past") - 0.5, "shedding")
              .when(F.col("temp") > F.col("_past") + 0.5, "gaining").otherwise("stable"))
    d = d.withColumn("inertia_regime", regime)
    # fixed values: newest-first profile weights
    profile = (F.when(F.col("inertia_regime") == "shedding", F.array(*map(F.lit, (0.20, 0.30, 0.30, 0.20))))
               .when(F.col("inertia_regime") == "gaining", F.array(*map(F.lit, (0.50, 0.50))))
               .otherwise(F.array(*map(F.lit, (0.33, 0.33, 0.34)))))
    d = d.withColumn("_w", profile)
    n = F.least(F.size("_tail"), F.size("_w"))
    d = d.withColumn("_ws", F.slice("_w", F.lit(1), n)).withColumn("_ts", F.slice("_tail", F.lit(1), n))
    plus = lambda s, x: s + x
    num = F.aggregate(F.zip_with("_ts", "_ws", lambda t, w: t * w), F.lit(0.0), plus)
    eff = rnd(num / F.aggregate("_ws", F.lit(0.0), plus), 2)
    return d.withColumn("asymmetric_temp", eff).drop("_past", "_tail", "_w", "_ws", "_ts")


def solar_battery(hourly: DataFrame, decay: float = K.BATTERY_DECAY, feedback: float = 0.0) -> DataFrame:
    """Stored solar heat after each hour: EMA of the impact (plus wasted-heat feedback)."""
    x = nz("solar_impact_kwh")
    if feedback:
        x = x + F.when(F.col("has_heating"), feedback * nz("solar_wasted_kwh")).otherwise(0.0)
    return affine_scan(hourly, ["site_id"], "ts", F.lit(decay), {"battery_state": x * (1 - decay)})


def potential_battery(hourly: DataFrame, decay: float = K.BATTERY_DECAY) -> DataFrame:
    """The same EMA for each direction of the potential vector."""
    return affine_scan(hourly, ["site_id"], "ts", F.lit(decay), {f"battery_{f}": nz(f"pot_{f}") * (1 - decay) for f in "sew"})


def centered_average(hourly: DataFrame, col: str = "actual_kwh", out: str = "centered_kwh") -> DataFrame:
    x = F.col(col)
    return hourly.withColumn(out, (F.coalesce(F.lag(col).over(by_site()), x) + x + F.coalesce(F.lead(col).over(by_site()), x)) / 3.0)


def thermal_state(hourly: DataFrame, bp: float = K.BALANCE_POINT) -> DataFrame:
    """Lag of the inertia temperature, regime, and the two-row trend."""
    d = inertia(hourly).withColumns({
        "_old": F.coalesce(F.lag("temp", 2).over(by_site()), F.lag("temp", 1).over(by_site())),
        "_back": F.when(F.lag("temp", 2).over(by_site()).isNotNull(), 2).otherwise(1)})
    lag, rate = F.col("inertia_temp") - F.col("temp"), (F.col("temp") - F.col("_old")) / F.col("_back")
    lag = rnd(lag, 6)
    rate = rnd(rate, 6)
    need = F.abs(F.lit(bp) - F.col("inertia_temp"))
    return d.withColumns({
        "thermal_lag": lag,
        "lag_status": F.when(lag > 0.5, "Shedding Heat").when(lag < -0.5, "Gaining Heat").otherwise("Balanced"),
        "regime": F.when(rnd(need, 6) > 4.0, "Cold").otherwise("Mild"),
        "degrees_to_balance": bp - F.col("inertia_temp"), "instant_tdd": need / 24.0, "trend_rate": rate,
        "trend": F.when(rate.isNull(), "unknown").when(rate < -2, "falling_fast").when(rate < -0.5, "falling")
        .when(rate > 2, "rising_fast").when(rate > 0.5, "rising").otherwise("stable")}).drop("_old", "_back")


def rolling_power(hourly_unit: DataFrame, hourly: DataFrame, fraction_passed: float) -> DataFrame:
    """Sixty-minute rolling power in watts: this hour so far plus the rest of the last logged hour."""
    prev = hourly.select("site_id", "ts", F.lag("ts").over(by_site()).alias("prev_ts"))
    last = hourly_unit.select("site_id", "unit_id", F.col("ts").alias("prev_ts"), F.col("actual_kwh").alias("last_kwh"))
    d = hourly_unit.join(prev, ["site_id", "ts"]).join(last, ["site_id", "unit_id", "prev_ts"], "left")
    w = F.col("actual_kwh") + nz("last_kwh") * (1.0 - fraction_passed)
    return d.withColumn("watts", F.rint(rnd(w * 1000, 6)).cast("int"))


def rolling_efficiency(days: DataFrame, target: float = K.MIN_DAY_TDD, stable: float = 0.1) -> DataFrame:
    """kWh per degree-day today, borrowing from yesterday, blended with the model when thin."""
    y = days.select("site_id", F.date_add("local_date", 1).alias("local_date"), F.col("tdd").alias("y_tdd"), F.col("kwh").alias("y_kwh"))
    d = days.join(y, ["site_id", "local_date"], "left")
    enough = F.col("tdd") >= target
    has_y = ~enough & (F.col("y_tdd") > K.ENERGY_GUARD)
    take = F.when(has_y, F.least(target - F.col("tdd"), F.col("y_tdd"))).otherwise(0.0)
    kwh = F.col("kwh") + F.when(has_y, F.col("y_kwh") * take / F.col("y_tdd")).otherwise(0.0)
    d = d.withColumns({"_t": F.col("tdd") + take, "_k": kwh,
                       "_hourly": F.abs(K.BALANCE_POINT - F.col("temp")) / 24.0})
    actual = F.when(F.col("_t") > 0.001, F.col("_k") / F.col("_t"))
    model = F.when(F.col("_hourly") > 0.05, F.col("model_rate") / F.col("_hourly"))
    conf = F.pow(F.col("_t") / stable, 2)
    thin = (F.when(model.isNull(), F.when(F.col("_t") > 0.05, actual)).when(actual.isNull(), model)
            .otherwise(model * (1 - conf) + actual * conf))
    return d.withColumn("efficiency", rnd(F.when(F.col("_t") < stable, thin).otherwise(actual), 3)).drop("_t", "_k", "_hourly")


def monotonicity(base_model: DataFrame) -> DataFrame:
    """Adjacent cells of a wind bucket where the colder one uses less."""
    w = Window.partitionBy("site_id", "wind_bucket").orderBy(F.col("temp_key").desc())
    d = base_model.withColumns({"to_temp": F.lead("temp_key").over(w), "kwh_cold": F.lead("kwh").over(w)})
    d = d.filter(F.col("kwh_cold") < F.col("kwh"))
    return d.select("site_id", "wind_bucket", F.col("temp_key").alias("from_temp"), "to_temp",
                    F.col("kwh").alias("kwh_warm"), "kwh_cold", (F.col("kwh") - F.col("kwh_cold")).alias("delta"))


def gap_fill_hour(samples: DataFrame, rates: DataFrame) -> DataFrame:
    """Energy of the minutes missing at the end of each hour, at the hour's mean-input rate."""
    last = samples.groupBy("site_id", F.date_trunc("hour", "ts").alias("ts")).agg(F.max(F.minute("ts")).alias("last_minute"))
    d = last.join(rates, ["site_id", "ts"])
    missing = 60 - (F.col("last_minute") + 1)
    return d.withColumn("missing_minutes", missing).withColumn(
        "gap_kwh", F.when(F.col("rate") > 0, F.col("rate") * F.col("missing_minutes") / 60.0).otherwise(0.0))


def load_trend(hourly: DataFrame, plan: DataFrame) -> DataFrame:
    """Mean modelled load of the last three hours against the next three planned ones."""
    past_w = Window.partitionBy("site_id").orderBy("_h").rangeBetween(-2, 0)
    d = hourly.withColumn("_h", epoch_hours()).withColumn("past", F.avg("expected_kwh").over(past_w))
    ahead = plan.withColumn("_h", F.explode(F.array(*[epoch_hours() - k for k in (1, 2, 3)])))
    ahead = ahead.groupBy("site_id", "_h").agg(F.avg("kwh").alias("future"))
    d = d.join(ahead, ["site_id", "_h"], "left")
    pct = rnd((F.col("future") - F.col("past")) / F.col("past") * 100, 6)
    label = (F.when(F.col("future").isNull(), "Unknown")
             .when(F.col("past") < 0.1, F.when(F.col("future") > 0.5, "Increasing (Fast)").when(F.col("future") > 0.1, "Increasing").otherwise("Stable"))
             .when(pct > 20, "Increasing (Fast)").when(pct > 5, "Increasing").when(pct < -20, "Easing (Fast)")
             .when(pct < -5, "Easing").otherwise("Stable"))
    return d.withColumn("load_trend", label).drop("_h")


def paired_loss(residuals: DataFrame, keys: list[str], n_candidates: int = 1, min_hours: int = 10, min_t: float = 2.0) -> DataFrame:
    """Paired squared-residual improvement with lag-1 inflation and a selection penalty."""
    w = Window.partitionBy(*keys)
    d = residuals.withColumn("_d", F.col("base_res") * F.col("base_res") - F.col("cand_res") * F.col("cand_res"))
    d = d.withColumns({"_m": F.avg("_d").over(w), "_next": F.lead("_d").over(w.orderBy("ts"))})
    e, e1 = F.col("_d") - F.col("_m"), F.col("_next") - F.col("_m")
    n = F.count(F.lit(1))
    a = d.groupBy(*keys).agg(n.alias("n_paired_hours"), F.avg("_d").alias("mean_improvement"),
                             (F.sum(e * e) / F.greatest(n - 1, F.lit(1))).alias("_var"), (F.sum(e * e1) / F.greatest(n - 1, F.lit(1))).alias("_cov"))
    ok = (F.col("n_paired_hours") >= min_hours) & (rnd("_var", 12) > 0)
    r1 = F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.col("_cov") / F.when(F.col("_var") > 0, F.col("_var"))))
    a = a.withColumn("lag1_autocorrelation", F.when(ok, r1))
    infl = F.sqrt((1 + F.col("lag1_autocorrelation")) / (1 - F.col("lag1_autocorrelation")))
    a = a.withColumn("std_error", F.when(ok, F.sqrt(F.col("_var") / F.col("n_paired_hours")) * infl))
    thr = min_t + (math.sqrt(2 * math.log(n_candidates)) if n_candidates > 1 else 0.0)
    a = a.withColumns({"t_statistic": F.col("mean_improvement") / F.col("std_error"), "threshold": F.lit(thr)})
    return a.withColumn("significant", F.coalesce(F.col("t_statistic") >= thr, F.lit(False))).drop("_var", "_cov")


def stable_tdd_today(hourly: DataFrame, reference: DataFrame, bp: float = K.BALANCE_POINT) -> DataFrame:
    """Day degree-days from logged hours, with the reference forecast filling the rest."""
    live = hourly.groupBy("site_id", "local_date", "hour").agg(F.max_by("temp", "ts").alias("live"))
    ref = reference.groupBy("site_id", "local_date", "hour").agg(F.max_by("temperature", "ts").alias("ref"))
    j = live.join(ref, ["site_id", "local_date", "hour"], "full").withColumn("t", F.coalesce("live", "ref"))
    return j.groupBy("site_id", "local_date").agg(
        F.count(F.lit(1)).alias("hours"), rnd(F.avg("t"), 1).alias("temp_forecast"), rnd(F.avg(F.abs(bp - F.col("t"))), 1).alias("tdd_stable"))


def redistribute_solar(hours: DataFrame, impact: str, alpha: float, tau: float = 2.0, lags: int = 3) -> DataFrame:
    """Low-sun hours keep 1-alpha of their impact and release the rest over three hours.

    The tail is joined by timestamp, so a gap in the log contributes nothing.
    """
    raw = [math.exp(-k / tau) for k in range(1, lags + 1)]
    eligible = (F.col("sun_elev") < 30.0) & (F.col("solar_factor") > 0.05)
    d = hours.withColumns({"_h": epoch_hours(), "_ok": eligible})
    pairs = F.array(*[F.struct((F.col("_h") + k).alias("h"), F.lit(alpha * raw[k - 1] / sum(raw)).alias("w")) for k in range(1, lags + 1)])
    tail = d.filter("_ok").select("site_id", F.col(impact).alias("_x"), F.explode(pairs).alias("p"))
    tail = tail.groupBy("site_id", F.col("p.h").alias("_h")).agg(F.sum(F.col("_x") * F.col("p.w")).alias("tail_kwh"))
    own = F.when(F.col("_ok"), F.col(impact) * (1 - alpha)).otherwise(F.col(impact))
    return d.join(tail, ["site_id", "_h"], "left").withColumn("redistributed_kwh", own + nz("tail_kwh")).drop("_h", "_ok")


def attenuate_hotspot(unit_hours: DataFrame, impact: str, gamma: float) -> DataFrame:
    """Trim a screened unit's solar by gamma under high sun with screens mostly closed."""
    hot = (F.col("sun_elev") > 30.0) & (F.col("correction_percent") < 80.0) & F.col("screen_affected")
    return unit_hours.withColumn("attenuated_kwh", F.when(hot, F.col(impact) * (1 - gamma)).otherwise(F.col(impact)))
