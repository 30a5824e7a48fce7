"""Model builders: ordered folds over one row per calendar hour or day.

A fold that rounds or branches on its own state at each step cannot be split, so
it runs per model cell (or per site-unit) over hour-grain rows, which are
bounded by the calendar. Linear recurrences use the block scan instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions import weather as W
from warmgrid.functions.numeric import c, nz, rnd, temp_key
from warmgrid.operators.filters import is_poisoned
from warmgrid.operators.scan import affine_scan, ordered_fold

BEST_DELTA = "coalesce(solar_normalization_delta_4d, solar_normalization_delta, 0.0)"


def base_inputs(hourly: DataFrame, high=K.HIGH_WIND, extreme=K.EXTREME_WIND) -> DataFrame:
    """Learning rows: key from the mean of the last four temperatures, then the poisoned filter.

    Rows dropped later still feed the four-row mean. Wind is re-bucketed so a
    threshold change takes effect on replay.
    """
    w = Window.partitionBy("site_id").orderBy("ts").rowsBetween(-3, 0)
    d = hourly.filter(F.col("actual_kwh").isNotNull()).withColumn("_mean", rnd(F.avg("temp").over(w), 9))
    d = d.filter(~is_poisoned("learning_status"))
    return d.withColumns({
        "temp_key": temp_key("_mean"),
        "wind_bucket": F.when(F.col("effective_wind").isNotNull(), W.wind_bucket("effective_wind", high, extreme)).otherwise(F.col("wind_bucket")),
        "energy": F.greatest(F.lit(0.0), F.col("actual_kwh") - nz("excluded_kwh")), "delta": F.expr(BEST_DELTA)})


def train_base(hourly: DataFrame, lr: float = K.LEARNING_RATE, lift: bool = True) -> DataFrame:
    """Cell EMA with SNR-weighted rate and one-sided lift to the dark-equivalent target."""
    d = base_inputs(hourly).filter(~F.col("auxiliary_active"))
    d = d.select("site_id", "temp_key", "wind_bucket", "ts", F.col("energy").alias("x"),
                 F.greatest(F.lit(0.0), F.col("energy") + F.col("delta")).alias("dark"),
                 (F.lit(lr) * F.greatest(F.lit(0.0), nz("snr_weight", 1.0))).alias("r"))
    init = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n"), F.lit(None).cast(hourly.schema["ts"].dataType).alias("t0"))

    def step(s: Column, x: Column) -> Column:
        dark = x["dark"] if lift else x["x"]
        target = F.when(s["v"] < dark, dark).otherwise(x["x"])
        skip = (s["v"] == 0) & (x["r"] <= 0)
        new = F.when(s["v"] != 0, rnd(s["v"] + x["r"] * (target - s["v"]), 5)).otherwise(rnd(dark, 5))
        return F.struct(F.when(skip, s["v"]).otherwise(new).alias("v"), F.when(skip, s["n"]).otherwise(s["n"] + 1).alias("n"),
                        F.when(skip, s["t0"]).otherwise(F.coalesce(s["t0"], x["ts"])).alias("t0"))

    m = ordered_fold(d, ["site_id", "temp_key", "wind_bucket"], ["ts"], ["x", "dark", "r"], init, step)
    m = m.select("site_id", "temp_key", "wind_bucket", F.col("state.v").alias("kwh"), F.col("state.n").alias("n"), F.col("state.t0").alias("first_ts"))
    return m.filter("n > 0")


def buffered_fold(df: DataFrame, keys: list[str], value: str, rate: float, digits: int, cap: str | None = None) -> DataFrame:
    """Mean of the first four samples, then an EMA rounded at each step.

    ``cap`` bounds each sample and the result by a column (the unit's base cell).
    """
    fields = [value] + ([cap] if cap else [])
    init = F.struct(F.lit(None).cast("double").alias("v"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        y = F.least(x[value], x[cap]) if cap else x[value]
        n = s["n"] + 1
        total = s["s"] + y
        start = F.when(n == K.BUFFER_SIZE, rnd(total / K.BUFFER_SIZE, digits))
        nxt = s["v"] + rate * (y - s["v"])
        if cap:
            nxt = F.least(F.greatest(F.lit(0.0), nxt), x[cap])
        return F.struct(F.when(s["v"].isNull(), start).otherwise(rnd(nxt, digits)).alias("v"), total.alias("s"), n.alias("n"))

    m = ordered_fold(df, keys, ["ts"], fields, init, step)
    return m.select(*keys, F.col("state.v").alias("v"), F.col("state.n").alias("samples"))


def unit_inputs(unit_cells: DataFrame) -> DataFrame:
    """Unit-hours that feed the unit model; cooling hours go to the cooling bucket."""
    d = unit_cells.filter((F.col("actual_kwh") > 0) & F.col("mode").isin("heating", "cooling") & ~F.col("auxiliary_active"))
    return d.withColumn("wind_bucket", F.when(F.col("mode") == "cooling", F.lit(K.COOLING_BUCKET)).otherwise(F.col("wind_bucket")))


UNIT_CELL = ["site_id", "unit_id", "temp_key", "wind_bucket"]


def train_unit_model(unit_cells: DataFrame, lr: float = K.LEARNING_RATE) -> DataFrame:
    m = buffered_fold(unit_inputs(unit_cells), UNIT_CELL, "actual_kwh", min(lr, K.UNIT_RATE_CAP), 5)
    return m.filter("v is not null").select(
        *UNIT_CELL, F.col("v").alias("kwh"), (F.col("samples") - K.BUFFER_SIZE + 1).alias("obs_count"))


def train_unit_aux(unit_cells: DataFrame, unit_model: DataFrame, units: DataFrame, lr: float = K.LEARNING_RATE) -> DataFrame:
    """Aux reduction per unit cell: base minus aux-hour draw, capped by the base cell."""
    scope = units.filter("aux_affected").select("site_id", "unit_id")
    d = unit_cells.filter(F.col("auxiliary_active") & F.col("mode").isin("heating", "cooling")).join(scope, ["site_id", "unit_id"], "left_semi")
    base = unit_model.select(*UNIT_CELL, F.col("kwh").alias("base"))
    d = d.join(base, UNIT_CELL).filter(F.col("base") > K.ENERGY_GUARD)
    d = d.withColumn("implied", F.greatest(F.lit(0.0), F.col("base") - F.col("actual_kwh")))
    m = buffered_fold(d, UNIT_CELL, "implied", min(lr, K.UNIT_RATE_CAP), 3, cap="base")
    return m.filter("v is not null").select(*UNIT_CELL, F.col("v").alias("kw"), "samples")


def daily_learning_energy(daily: DataFrame, thermal_mass: float = 0.0) -> DataFrame:
    """Space-conditioning energy of a day after excluded modes and stored indoor heat."""
    prev = F.lag("midnight_indoor_temp").over(Window.partitionBy("site_id").orderBy("local_date"))
    q = F.col("kwh") - nz("excluded_kwh")
    if thermal_mass > 0:
        q = q - F.coalesce(thermal_mass * (F.col("midnight_indoor_temp") - prev), F.lit(0.0))
    d = daily.withColumn("q_adjusted", q)
    return d.filter((F.col("n_hours") >= K.LEARN_DAY_HOURS) & (F.col("tdd") >= K.MIN_DAY_TDD) & (F.col("q_adjusted") > 0))


def train_daily_flat(daily: DataFrame, lr: float = K.LEARNING_RATE, thermal_mass: float = 0.0) -> DataFrame:
    """One cell update per day from the hourly mean of the day's normalised energy."""
    d = daily_learning_energy(daily, thermal_mass)
    d = d.select("site_id", temp_key("temp").alias("temp_key"), W.wind_bucket("wind").alias("wind_bucket"), "local_date",
                 (F.greatest(F.lit(0.0), F.col("q_adjusted") + nz("solar_normalization_delta")) / 24.0).alias("x"))
    init = F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        new = F.when(s["v"] == 0, rnd(x["x"], 5)).otherwise(rnd(s["v"] + lr * (x["x"] - s["v"]), 5))
        return F.struct(new.alias("v"), (s["n"] + 1).alias("n"))

    m = ordered_fold(d, ["site_id", "temp_key", "wind_bucket"], ["local_date"], ["x"], init, step)
    return m.select("site_id", "temp_key", "wind_bucket", F.col("state.v").alias("kwh"), F.col("state.n").alias("n"))


def train_u_coefficient(daily: DataFrame, thermal_mass: float = 0.0, lr: float = K.DAILY_LEARNING_RATE) -> DataFrame:
    """Site heat-loss coefficient in kWh per degree-day; a linear recurrence, so block-scanned."""
    d = daily_learning_energy(daily, thermal_mass).withColumn("u", F.col("q_adjusted") / F.col("tdd"))
    first = d.groupBy("site_id").agg(F.min("local_date").alias("_first"))
    d = d.join(first, "site_id")
    opening = F.col("local_date") == F.col("_first")
    s = affine_scan(d, ["site_id"], "local_date", F.when(opening, 0.0).otherwise(1 - lr),
                    {"u_state": F.when(opening, F.col("u")).otherwise(lr * F.col("u"))})
    return s.groupBy("site_id").agg(F.max_by("u_state", "local_date").alias("u_coefficient"), F.count(F.lit(1)).alias("n"))


def loss_weights(hours: DataFrame, solar: str, bp: float = K.BALANCE_POINT) -> DataFrame:
    """Relative demand of each hour: temperature difference x wind x solar multiplier.

    ``solar`` is the fraction of sun felt; it lowers heating and raises cooling demand.
    """
    t = F.coalesce("inertia_temp", "temp", F.lit(bp))
    wind = F.when(nz("effective_wind") >= K.EXTREME_WIND, K.WIND_LOSS_FACTOR["extreme_wind"]).when(
        nz("effective_wind") >= K.HIGH_WIND, K.WIND_LOSS_FACTOR["high_wind"]).otherwise(K.WIND_LOSS_FACTOR["normal"])
    f = nz(solar)
    mult = F.when(t > bp, F.greatest(F.lit(0.1), 1.0 + f * 0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - f)))
    return hours.withColumn("loss_weight", F.abs(bp - t) * wind * mult)


def day_battery(hours: DataFrame, decay: float = K.BATTERY_DECAY) -> DataFrame:
    """Solar factor smoothed from midnight on, per day (at most 25 rows per group)."""
    w = Window.partitionBy("site_id", "local_date").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    rows = F.collect_list(F.struct("hour", nz("solar_factor").alias("x"))).over(w)
    state = F.aggregate(rows, F.struct(F.lit(-1).alias("h"), F.lit(0.0).alias("v")), lambda s, x: F.struct(
        x["hour"].cast("int").alias("h"), (s["v"] * F.pow(F.lit(decay), x["hour"] - s["h"]) + x["x"] * (1 - decay)).alias("v")))
    return hours.withColumn("solar_felt", F.least(F.lit(1.0), state["v"]))


def synthetic_baseline(mpc: DataFrame, hours: DataFrame, cop_params: DataFrame | None = None, bp: float = K.BALANCE_POINT) -> DataFrame:
    """Spread each day's thermal output over its hours by loss weight, then to electricity by COP.

    With COP parameters every hour uses its own COP and the day is rescaled to the
    metered electricity; without them the day's average COP applies.
    """
    w = loss_weights(day_battery(hours), "solar_felt", bp)
    w = w.select("site_id", "local_date", "hour", "temp", "humidity", "loss_weight")
    d = mpc.join(w, ["site_id", "local_date", "hour"], "left").withColumn("loss_weight", nz("loss_weight"))
    day = Window.partitionBy("site_id", "local_date")
    space = F.col("mode") != "dhw"
    d = d.withColumns({
        "_th": F.sum(F.when(space, F.greatest(F.lit(0.0), F.col("kwh_th_sh"))).otherwise(0.0)).over(day),
        "_el": F.sum(F.when(space, F.greatest(F.lit(0.0), F.col("kwh_el_sh"))).otherwise(0.0)).over(day),
        "_w": F.sum("loss_weight").over(day), "_n": F.count(F.lit(1)).over(day)})
    smeared = F.when(F.col("_w") > 0, F.col("_th") * F.col("loss_weight") / F.col("_w")).otherwise(F.col("_th") / F.col("_n"))
    d = d.withColumn("_s", smeared)
    daily_cop = F.when((F.col("_el") > 0) & (F.col("_th") > 0), F.col("_th") / F.col("_el")).otherwise(1.0)
    if cop_params is None:
        el = rnd(F.col("_s") / daily_cop, 3)
    else:
        p = cop_params.select("site_id", "eta_carnot", "lwt", "f_defrost", "defrost_temp_threshold", "defrost_rh_threshold")
        d = d.join(p, "site_id", "left")
        cop = W.carnot_cop(F.coalesce("temp", F.lit(bp)), F.coalesce("humidity", F.lit(50.0)), "eta_carnot", "lwt", nz("f_defrost", K.DEFROST_FACTOR),
                           nz("defrost_temp_threshold", K.DEFROST_TEMP), nz("defrost_rh_threshold", K.DEFROST_RH))
        d = d.withColumn("_raw", rnd(F.col("_s") / F.when(F.col("eta_carnot").isNull(), daily_cop).otherwise(cop), 3))
        total = F.sum("_raw").over(day)
        scale = F.when(F.col("eta_carnot").isNotNull() & (F.col("_el") > 0) & (total > 0), F.col("_el") / total).otherwise(1.0)
        el = rnd(F.col("_raw") * scale, 3)
    return d.select("site_id", "local_date", "hour", "mode", "loss_weight", rnd("_s", 3).alias("smeared_kwh_th"), el.alias("synthetic_kwh_el"))


def smear_daily(daily: DataFrame, hours: DataFrame, cop_params: DataFrame) -> DataFrame:
    """Daily meter total spread over 24 hours by loss weight and hourly COP."""
    q = daily.select("site_id", "local_date", (F.col("q_adjusted") / 24.0).alias("kwh_th_sh"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    flat = q.withColumns({"kwh_el_sh": F.col("kwh_th_sh"), "mode": F.lit("sh")})
    return synthetic_baseline(flat, hours, cop_params)


def strategy_contributions(unit_hours: DataFrame, hours: DataFrame, units: DataFrame, distribution: DataFrame) -> DataFrame:
    """Energy each hour contributes to the site model, by each unit's strategy.

    ``direct`` units use their meter, ``synthetic`` ones the day's distribution and
    ``weighted`` ones their day total by loss weight; excluded modes drop out.
    """
    day = Window.partitionBy("site_id", "local_date")
    w = loss_weights(hours.withColumn("inertia_temp", F.lit(None).cast("double")), "solar_factor")
    share = F.when(F.sum("loss_weight").over(day) > 0, F.col("loss_weight") / F.sum("loss_weight").over(day)).otherwise(1.0 / 24)
    w = w.withColumn("share", share).select("site_id", "ts", "local_date", "hour", "temp", "wind_bucket", "share", F.expr(BEST_DELTA).alias("delta"))
    ok = ~F.coalesce("mode", F.lit("heating")).isin(*K.EXCLUDED_MODES)
    u = unit_hours.filter(ok).join(units.select("site_id", "unit_id", "strategy"), ["site_id", "unit_id"])
    direct = u.filter("strategy = 'direct' and actual_kwh > 0").select("site_id", "ts", F.col("actual_kwh").alias("direct"), F.lit(0.0).alias("smear"))
    syn = u.filter("strategy = 'synthetic'").join(distribution.select("site_id", "local_date", "hour", "synthetic_kwh_el"), ["site_id", "local_date", "hour"])
    syn = syn.filter("synthetic_kwh_el > 0").select("site_id", "ts", F.lit(0.0).alias("direct"), F.col("synthetic_kwh_el").alias("smear"))
    total = u.filter("strategy = 'weighted'").groupBy("site_id", "local_date", "unit_id").agg(F.sum("actual_kwh").alias("total")).filter("total > 0")
    # hours where the unit sits in an excluded mode receive nothing; hours without a row default to heating
    blocked = unit_hours.filter(~ok).select("site_id", "unit_id", "ts")
    smear = total.join(w.select("site_id", "local_date", "ts", "share"), ["site_id", "local_date"]).join(blocked, ["site_id", "unit_id", "ts"], "left_anti")
    smear = smear.filter("share > 0").select("site_id", "ts", F.lit(0.0).alias("direct"), (F.col("total") * F.col("share")).alias("smear"))
    s = direct.unionByName(syn).unionByName(smear).groupBy("site_id", "ts").agg(
        F.sum("direct").alias("direct"), F.sum("smear").alias("smear"), F.max(F.col("direct") > 0).alias("has_direct"))
    s = s.join(w, ["site_id", "ts"])
    lifted = F.when(F.col("has_direct") & (F.col("delta") != 0), F.greatest(F.lit(0.0), F.col("direct") + F.col("delta"))).otherwise(F.col("direct"))
    return s.withColumns({"temp_key": temp_key("temp"), "total_kwh": lifted + F.col("smear")}).filter("total_kwh > 0")


def train_strategies(contributions: DataFrame, lr: float = K.LEARNING_RATE) -> DataFrame:
    """Buffered cell EMA over the strategy sums."""
    m = buffered_fold(contributions, ["site_id", "temp_key", "wind_bucket"], "total_kwh", lr, 5)
    return m.filter("v is not null").withColumnRenamed("v", "kwh")


def train_screen_policy(hours: DataFrame, lr: float = 0.1) -> DataFrame:
    """Preferred screen position per recommendation state and sun sector, clear sky only."""
    d = hours.filter((F.col("state") != "none") & (F.col("sun_elev") > 0) & (F.col("cloud_coverage") < 20))
    d = d.select("site_id", "state", (F.floor(F.pmod(F.col("sun_azim"), F.lit(360.0)) / 30) * 30).cast("int").alias("az_bucket"),
                 (F.floor(F.col("sun_elev") / 10) * 10).cast("int").alias("elev_bucket"), "ts", F.col("correction_percent").alias("x"))
    init = F.lit(None).cast("double")

    def step(s: Column, x: Column) -> Column:
        return F.when(s.isNull(), x["x"]).otherwise(rnd(s + lr * (x["x"] - s), 1))

    out = ordered_fold(d.withColumnRenamed("state", "rec"), ["site_id", "rec", "az_bucket", "elev_bucket"], ["ts"], ["x"], init, step)
    return out.select("site_id", F.col("rec").alias("state"), "az_bucket", "elev_bucket", F.col("state").alias("correction_percent"))
