"""Scoring learned models over hours.

``predict_hours`` is one plan: each site's models are packed into one row of dense arrays, hours
meet their site's row and their units' modes, fan out to units, are looked up by index and saturated,
and are summed again where they are; the site model's value is then allocated over the
partitions. Variants of the same hours (aux on/off, other weather) travel as an extra key through a single plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions import solar as S
from warmgrid.functions import weather as W
from warmgrid.functions.numeric import c, nz, rnd, sum_if, temp_key
from warmgrid.operators.joins import laddered, pack_model, slot_of
from warmgrid.operators.rollup import last_year_iso


@dataclass(frozen=True)
class Models:
    """Learned tables a score needs. ``solar`` has s, e, w (and d for the 4D model).

    ``profiles`` may hold ``site_profiles`` of the tables, stored; otherwise each score packs them anew.
    """

    base: DataFrame
    aux: DataFrame
    unit_base: DataFrame
    unit_aux: DataFrame
    solar: DataFrame
    units: DataFrame
    decay: float = K.BATTERY_DECAY
    profiles: DataFrame | None = None


def site_profiles(models: Models) -> DataFrame:
    """One row a site: packed ``base`` and ``aux`` models, and ``units`` with their scope, packed models and solar coefficients."""
    unit = ["site_id", "unit_id"]
    pack = lambda model, keys, name: pack_model(model, keys).select(*keys, F.struct("low", "slots").alias(name))
    four = F.col("d") if "d" in models.solar.columns else F.lit(None).cast("double").alias("d")
    coeffs = models.solar.select(*unit, "regime", F.struct("s", "e", "w", four, "learned").alias("c"))
    solar = coeffs.groupBy(*unit).agg(*[F.max(F.when(F.col("regime") == r, F.col("c"))).alias(f"sun_{r}") for r in ("heating", "cooling")])
    u = models.units.select(*unit, "aux_affected", "solar_affected").join(pack(models.unit_base, unit, "base"), unit, "left")
    u = u.join(pack(models.unit_aux, unit, "aux"), unit, "left").join(solar, unit, "left")
    units = u.groupBy("site_id").agg(F.collect_list(F.struct(*[c for c in u.columns if c != "site_id"])).alias("units"))
    return units.join(pack(models.base, ["site_id"], "base"), "site_id", "full").join(pack(models.aux, ["site_id"], "aux"), "site_id", "full")


def with_cell(hours: DataFrame) -> DataFrame:
    return hours.withColumns({"temp_key": temp_key("temp"), "wind_bucket": W.wind_bucket("effective_wind")})


def _solar_3d(d: DataFrame) -> DataFrame:
    """Unit solar from learned coefficients; unlearned heating uses the south default, unlearned cooling none."""
    known = F.coalesce(F.col("_sun.learned"), F.lit(False))
    impact = F.when(known, sum((F.col(f"_sun.{f}") * F.col(f"pot_{f}") for f in "sew"), F.lit(0.0))).when(F.col("regime") == "heating", K.SOLAR_COEFF_HEATING * F.col("pot_s")).otherwise(0.0)
    return d.withColumn("solar", F.when(F.col("solar_affected"), F.greatest(F.lit(0.0), impact)).otherwise(0.0))


def _solar_4d(d: DataFrame) -> DataFrame:
    """Unit solar of the beam/diffuse model: only explicitly learned regimes count."""
    c_ = {f: F.col(f"_sun.{f}") for f in "sewd"}
    live = F.coalesce(F.col("_sun.learned") & ((c_["s"] != 0) | (c_["e"] != 0) | (c_["w"] != 0) | (c_["d"] != 0)), F.lit(False))
    impact = sum((c_[f] * F.col(f"p4_{f}") for f in "sewd"), F.lit(0.0))
    return d.withColumn("solar", F.when(F.col("solar_affected") & live, F.greatest(F.lit(0.0), impact)).otherwise(0.0))


def score_units(hours: DataFrame, modes: DataFrame, models: Models, keys: list[str], four_d: bool = False) -> DataFrame:
    """Base, aux, solar and net per unit-hour, beside the site's ``g_base`` and ``g_aux``; a site without units has one row of an unknown unit."""
    profiles = models.profiles if models.profiles is not None else site_profiles(models)
    pots = [f"p4_{f}" for f in "sewd"] if four_d else [f"pot_{f}" for f in "sew"]
    # the units' modes come as one map an hour (the least mode of a repeated unit); the site's row is met last, so that its arrays are read
    # where they arrive: an expression that leaves generated code, as a lambda does, would copy them for every unit
    listed = modes.where("unit_id IS NOT NULL").groupBy("site_id", "ts").agg(F.sort_array(F.collect_list(F.struct("unit_id", "mode"))).alias("_all"))
    listed = listed.select("site_id", "ts", F.map_from_entries(F.expr("filter(_all, (m, i) -> i = 0 OR get(_all, i - 1).unit_id != m.unit_id)")).alias("_modes"))
    h = hours.select(*keys, "temp", "temp_key", "wind_bucket", "auxiliary_active", "carry_state", *pots).join(listed, ["site_id", "ts"], "left")
    d = h.join(profiles.select("site_id", *[F.col(x).alias(f"_p_{x}") for x in ("base", "aux", "units")]), "site_id", "left")
    d = d.withColumns({"_gb": slot_of("_p_base"), "_ga": F.when(F.col("auxiliary_active"), slot_of("_p_aux"))})
    d = d.withColumns({"g_base": laddered("_gb"), "g_aux": F.when(F.col("auxiliary_active"), laddered("_ga")).otherwise(0.0)})
    d = d.select(*h.columns, "g_base", "g_aux", F.explode_outer("_p_units").alias("u"))
    d = d.withColumn("mode", F.coalesce(F.try_element_at("_modes", F.col("u.unit_id")), F.lit("heating"))).drop("_modes").withColumnRenamed("wind_bucket", "_wb")
    d = d.withColumns({
        "unit_id": F.col("u.unit_id"), "aux_affected": F.col("u.aux_affected"), "solar_affected": F.col("u.solar_affected"),
        "wind_bucket": F.when(F.col("mode") == "cooling", F.lit(K.COOLING_BUCKET)).otherwise(F.col("_wb")),
        "regime": F.when(F.col("mode").isin(*K.COOLING_MODES), "cooling").otherwise("heating")})
    aided = F.col("auxiliary_active") & F.col("aux_affected")
    d = d.withColumns({
        "_b": slot_of("u.base"), "_a": F.when(aided, slot_of("u.aux")),
        "_sun": F.when(F.col("regime") == "cooling", F.col("u.sun_cooling")).otherwise(F.col("u.sun_heating"))})
    # all rows of an hour come together here, before they are scored and summed: as many bytes as partial
    # sums, and generated stages of a size that the JVM still compiles instead of one that it interprets
    d = d.drop("u").repartition(*keys).withColumns({
        "base": laddered("_b"), "raw_aux": F.when(F.col("auxiliary_active") & F.col("aux_affected"), laddered("_a")).otherwise(0.0)})
    d = (_solar_4d if four_d else _solar_3d)(d).drop("_sun", "_wb", "_b", "_a")
    d = d.withColumn("aux_applied", F.least("raw_aux", "base")).withColumns({
        "aux_overflow": F.col("raw_aux") - F.col("aux_applied"), "after_aux": F.col("base") - F.col("aux_applied")})
    s = S.saturate("after_aux", "solar", "mode")
    return d.withColumns({"applied": rnd(s["applied"], 3), "wasted": rnd(s["wasted"], 3), "net": rnd(s["net"], 3)})


def predict_hours(hours: DataFrame, modes: DataFrame, models: Models, keys: list[str] | None = None, four_d: bool = False) -> DataFrame:
    """Predicted energy of each hour with its attribution.

    The site model anchors the magnitude; unit models only decide how the anchor
    splits over heating-in-scope, cooling-in-scope and out-of-scope demand. Aux can
    remove at most the aux-affected share, heating solar at most its allocation.
    ``keys`` name an hour, site_id and ts among them.
    """
    keys = keys or ["site_id", "ts"]
    h = hours if "carry_state" in hours.columns else hours.withColumn("carry_state", F.lit(0.0))
    u = score_units(h, modes, models, keys, four_d)
    cool, heat = F.col("mode").isin(*K.COOLING_MODES), F.col("mode").isin(*K.HEATING_MODES)
    scoped = F.col("solar_affected")
    j = u.groupBy(*keys).agg(
        *[F.first(x).alias(x) for x in ("g_base", "g_aux", "auxiliary_active", "carry_state")],
        F.sum("base").alias("u_base"), F.sum("aux_applied").alias("u_aux"), F.sum("aux_overflow").alias("u_over"),
        F.sum("applied").alias("u_applied"), F.sum("wasted").alias("u_wasted"), F.sum("net").alias("u_net"),
        sum_if(F.col("aux_affected") & F.col("auxiliary_active"), "base").alias("b_aux"),
        sum_if(cool & scoped, "after_aux").alias("b_cool"), sum_if(heat & scoped, "after_aux").alias("b_heat"),
        sum_if(((cool | heat) & ~scoped) | (~cool & ~heat & (F.col("mode") != "off")), "after_aux").alias("b_rest"),
        sum_if(cool, "applied").alias("a_cool"), sum_if(~cool, "applied").alias("a_heat"),
        sum_if(cool, "net").alias("cool_net"), sum_if(~cool, "net").alias("heat_net"), sum_if(heat, "net").alias("heat_only")).na.fill(0.0)
    total = F.col("b_heat") + F.col("b_cool") + F.col("b_rest")
    frac = F.when(F.col("u_base") > 0, F.col("b_aux") / F.col("u_base")).otherwise(0.0)
    j = j.withColumn("_split", total > 1e-9).withColumn(
        "anchor", F.greatest(F.lit(0.0), F.col("g_base") - F.when(F.col("_split"), F.least(F.col("g_aux"), F.col("g_base") * frac)).otherwise(F.col("g_aux"))))
    j = j.withColumn("_per", F.when(F.col("_split"), F.col("anchor") / total).otherwise(0.0))
    j = j.withColumn("heat_applied", F.when(F.col("_split"), F.least(F.col("a_heat"), F.col("b_heat") * F.col("_per"))).otherwise(F.col("a_heat")))
    split_net = F.col("anchor") - F.col("heat_applied") + F.col("a_cool")
    # without unit data nothing is allocated: plain anchor with the summed solar effect
    j = j.withColumn("_net", F.when(F.col("_split"), split_net).otherwise(
        F.greatest(F.lit(0.0), F.col("anchor") + F.col("a_cool") - F.col("a_heat"))))
    release = F.when((F.col("carry_state") > 0) & (F.col("heat_only") > 0),
                     F.least(F.col("carry_state") * (1 - models.decay), F.col("heat_only"))).otherwise(0.0)
    j = j.withColumn("release", release).withColumn("clip", F.col("a_heat") - F.col("heat_applied"))
    zero = F.lit(0.0)
    orphan = F.when(F.col("auxiliary_active") & (F.col("g_aux") - F.col("u_aux") - F.col("u_over") > 0.001), F.col("g_aux") - F.col("u_aux") - F.col("u_over")).otherwise(0.0)
    total_kwh = F.when(F.col("release") > 0, F.greatest(zero, F.col("_net") - F.col("release"))).otherwise(F.col("_net"))
    unit_net = F.greatest(zero, F.col("u_net") - F.col("release"))
    return j.select(
        *keys, rnd(total_kwh, 3).alias("total_kwh"), rnd("g_base", 3).alias("base_kwh"), rnd("g_aux", 3).alias("aux_kwh"),
        rnd(F.greatest(zero, F.col("heat_net") - F.col("release")), 3).alias("heating_kwh"), rnd("cool_net", 3).alias("cooling_kwh"),
        rnd(F.col("u_applied") - F.col("clip"), 3).alias("solar_kwh"), rnd(F.col("u_wasted") + F.col("clip"), 3).alias("wasted_kwh"),
        rnd("heat_applied", 3).alias("solar_heating_kwh"), rnd("a_cool", 3).alias("solar_cooling_kwh"), rnd("release", 3).alias("release_kwh"),
        rnd(F.col("u_over") + orphan, 3).alias("unassigned_aux"), rnd(orphan, 3).alias("orphaned_aux"), rnd(total_kwh - unit_net, 3).alias("unspecified_kwh"))


def predict_pure_model(hours: DataFrame, modes: DataFrame, models: Models) -> DataFrame:
    """Logged weather and modes with aux off."""
    return predict_hours(hours.withColumn("auxiliary_active", F.lit(False)), modes, models)


def south_potential(factor, azimuth: float = K.SOLAR_AZIMUTH) -> dict[str, Column]:
    """Vector of a bare solar factor pointed at the site's main facade."""
    return {f"pot_{f}": nz(factor) * w for f, w in S.facade_weights(F.lit(azimuth)).items()}


def modeled_points(hourly: DataFrame, daily: DataFrame, start: Column, end: Column, bp: float = K.BALANCE_POINT) -> DataFrame:
    """Weather points to score for each day: log hours, else day vectors, else one daily point.

    ``daily`` may carry ``hourly_vectors``; twenty valid hours make them usable.
    A daily point stands for 24 hours and rebuilds its temperature from degree-days.
    """
    period = F.col("local_date").between(start, end)
    log = hourly.filter(period).select("site_id", "local_date", "ts", F.lit("log").alias("branch"), F.lit(1.0).alias("multiplier"), "temp",
                                       F.lit(None).cast("double").alias("tdd"), nz("effective_wind").alias("effective_wind"), nz("actual_kwh").alias("load"), "solar_factor")
    rest = daily.filter(period).join(log.select("site_id", "local_date").distinct(), ["site_id", "local_date"], "left_anti")
    if "hourly_vectors" in daily.columns:
        n = F.coalesce(F.size(F.filter("hourly_vectors.temp", lambda x: x.isNotNull())), F.lit(0))
        rest = rest.withColumn("_vec", n >= K.MIN_DAY_HOURS)
        v = rest.filter("_vec").select("site_id", "local_date", F.col("wind").alias("_w"), F.col("solar_factor").alias("_s"), F.posexplode(F.arrays_zip(
            *[F.col(f"hourly_vectors.{x}").alias(x) for x in ("temp", "tdd", "wind", "actual_kwh", "solar_rad")])).alias("h", "_z"))
        start_ts = F.col("local_date").cast("timestamp_ntz")
        vec = v.filter("_z.temp is not null").select(
            "site_id", "local_date", (start_ts + F.make_dt_interval(hours=F.col("h"))).alias("ts"), F.lit("vector").alias("branch"), F.lit(1.0).alias("multiplier"),
            F.col("_z.temp").alias("temp"), F.col("_z.tdd").alias("tdd"), F.coalesce("_z.wind", "_w").alias("effective_wind"), nz("_z.actual_kwh").alias("load"),
            F.coalesce("_z.solar_rad", "_s").alias("solar_factor"))
        flat = rest.filter("not _vec")
    else:
        vec, flat = None, rest
    day = flat.select("site_id", "local_date", F.col("local_date").cast("timestamp_ntz").alias("ts"), F.lit("daily").alias("branch"), F.lit(24.0).alias("multiplier"),
                      "temp", "tdd", F.col("wind").alias("effective_wind"), F.col("kwh").alias("load"), "solar_factor")
    pts = log.unionByName(day) if vec is None else log.unionByName(vec).unionByName(day)
    full = F.col("tdd") * F.when(F.col("multiplier") == 1.0, 24.0).otherwise(1.0)
    warm = F.col("temp") >= bp
    rebuilt = F.when(full > 0.1, F.when(warm, bp + full).otherwise(bp - full)).otherwise(F.col("temp"))
    gap = F.abs(bp - F.col("temp")) / F.when(F.col("multiplier") == 1.0, 24.0).otherwise(1.0)
    return pts.withColumns({"tdd_share": F.coalesce("tdd", gap), "temp": rnd(F.coalesce(rebuilt, "temp"), 6)})


def modeled_energy(points: DataFrame, modes: DataFrame, models: Models, bp: float = K.BALANCE_POINT) -> DataFrame:
    """Modelled kWh, solar, degree-days and load-weighted weather of the scored points, per site-day.

    Days without logged modes heat below the balance point and cool above it.
    """
    h = with_cell(points).withColumns({**south_potential("solar_factor"), "auxiliary_active": F.lit(False)})
    logged = modes.select("site_id", "unit_id", "ts", "mode")
    inferred = h.filter("branch <> 'log'").select("site_id", "ts", "temp").join(models.units.select("site_id", "unit_id"), "site_id")
    inferred = inferred.select("site_id", "unit_id", "ts", F.when(F.col("temp") < bp, "heating").otherwise("cooling").alias("mode"))
    s = predict_hours(h, logged.unionByName(inferred), models).select("site_id", "ts", "total_kwh", "solar_kwh")
    j = h.join(s, ["site_id", "ts"])
    heavy = F.sum("load") > 0.001

    def mean(x):
        return F.when(heavy, F.sum(F.col(x) * F.col("load")) / F.sum("load")).otherwise(F.avg(x))

    m = F.col("multiplier")
    return j.groupBy("site_id", "local_date").agg(
        F.max("branch").alias("branch"), F.sum(F.col("total_kwh") * m).alias("modeled_kwh"), F.sum(F.col("solar_kwh") * m).alias("solar_kwh"),
        F.sum("tdd_share").alias("tdd"), mean("temp").alias("temp"), mean("effective_wind").alias("wind"))


def modeled_totals(days: DataFrame, keys=("site_id",)) -> DataFrame:
    return days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), rnd(F.sum("modeled_kwh"), 2).alias("modeled_kwh"), rnd(F.sum("solar_kwh"), 2).alias("solar_kwh"),
        rnd(F.avg("temp"), 1).alias("temp"), rnd(F.avg("wind"), 1).alias("wind"), rnd(F.sum("tdd"), 1).alias("tdd"))


def compare_periods(days: DataFrame, p1: tuple[Column, Column], p2: tuple[Column, Column], as_of: Column) -> DataFrame:
    """Two periods side by side per site, with deviations, basis and deltas.

    ``days`` has actual and modelled values per site-day; both periods come from one
    conditional-aggregate scan.
    """
    aggs = []
    for i, (a, b) in enumerate((p1, p2), 1):
        inside = F.col("local_date").between(a, b)
        for x in ("kwh", "modeled_kwh", "solar_kwh", "aux_impact_kwh", "tdd"):
            aggs.append(F.sum(F.when(inside, F.col(x))).alias(f"p{i}_{x}"))
        aggs += [F.avg(F.when(inside, F.col("temp"))).alias(f"p{i}_temp"), F.avg(F.when(inside, F.col("wind"))).alias(f"p{i}_wind")]
    d = days.groupBy("site_id").agg(*aggs)
    cols = {}
    for i, (_, b) in enumerate((p1, p2), 1):
        kwh, mod, tdd = (F.col(f"p{i}_{x}") for x in ("kwh", "modeled_kwh", "tdd"))
        cols[f"p{i}_deviation"] = rnd(kwh - mod, 2)
        cols[f"p{i}_deviation_pct"] = rnd(F.when(mod > 0.1, (kwh - mod) / mod * 100), 1)
        cols[f"p{i}_efficiency"] = rnd(F.when(tdd > K.ENERGY_GUARD, kwh / tdd), 3)
        cols[f"p{i}_basis"] = F.when(b < as_of, F.when(nz(kwh) > 0.1, "actual").otherwise("modeled")).otherwise("hybrid")
    d = d.withColumns(cols)
    return d.withColumns({f"delta_{x}": F.col(f"p1_{x}") - F.col(f"p2_{x}") for x in ("kwh", "modeled_kwh", "temp", "wind")})


def aux_savings(hours: DataFrame, modes: DataFrame, models: Models) -> DataFrame:
    """Sum over hours of aux-off minus aux-on, per site-day, with a missing-data flag."""
    v = hours.drop("auxiliary_active").withColumn("auxiliary_active", F.explode(F.array(F.lit(False), F.lit(True))))
    v = v.withColumn("variant", F.col("auxiliary_active").cast("int"))
    s = predict_hours(v, modes, models, ["site_id", "ts", "variant"])
    w = s.groupBy("site_id", "ts").agg(
        F.sum(F.when(F.col("variant") == 0, F.col("total_kwh"))).alias("normal"), F.sum(F.when(F.col("variant") == 1, F.col("total_kwh"))).alias("aux"),
        F.sum(F.when(F.col("variant") == 1, F.col("aux_kwh"))).alias("reduction"))
    return w.groupBy("site_id", F.col("ts").cast("date").alias("local_date")).agg(
        F.sum("normal").alias("normal_kwh"), F.sum("aux").alias("aux_kwh"), F.sum(F.col("normal") - F.col("aux")).alias("savings_kwh"),
        F.count(F.lit(1)).alias("hours"), F.max((F.col("normal") == F.col("aux")) & (F.col("normal") > 0) & (F.col("reduction") == 0)).alias("missing_data"))


def wind_penalty(hours: DataFrame, modes: DataFrame, models: Models) -> DataFrame:
    """Extra energy of the hour's wind over a calm hour, never negative, per site-day."""
    v = hours.withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    v = v.withColumn("wind_bucket", F.when(F.col("variant") == 1, "normal").otherwise(F.col("wind_bucket")))
    s = predict_hours(v, modes, models, ["site_id", "ts", "variant"])
    signed = F.sum(F.when(F.col("variant") == 0, F.col("total_kwh")).otherwise(-F.col("total_kwh")))
    w = s.groupBy("site_id", "ts").agg(F.greatest(F.lit(0.0), signed).alias("penalty"))
    return w.groupBy("site_id", F.col("ts").cast("date").alias("local_date")).agg(F.sum("penalty").alias("wind_penalty_kwh"), F.count(F.lit(1)).alias("hours"))


def hybrid_projection(modeled: DataFrame, forecast_days: DataFrame, as_of: Column, start: Column, end: Column) -> DataFrame:
    """Past days modelled, today and later from the forecast, gaps from last year's aligned day.

    Every wanted day is generated per site; each takes the first source that has it.
    """
    sites = modeled.select("site_id").distinct()
    want = sites.withColumn("local_date", F.explode(F.sequence(start, end, F.expr("interval 1 day"))))
    want = want.withColumn("ly_date", last_year_iso(F.col("local_date")))
    past = modeled.select("site_id", "local_date", F.col("modeled_kwh").alias("past_kwh"))
    fut = forecast_days.select("site_id", "local_date", F.col("kwh").alias("plan_kwh"))
    ly = modeled.select("site_id", F.col("local_date").alias("ly_date"), F.col("modeled_kwh").alias("ly_kwh"))
    j = want.join(past, ["site_id", "local_date"], "left").join(fut, ["site_id", "local_date"], "left").join(ly, ["site_id", "ly_date"], "left")
    done = F.col("local_date") < as_of
    src = F.when(done, "modeled").when(F.col("plan_kwh").isNotNull(), "forecast").when(F.col("ly_kwh").isNotNull(), "last_year").otherwise("none")
    val = F.when(done, nz("past_kwh")).otherwise(F.coalesce("plan_kwh", "ly_kwh", F.lit(0.0)))
    return j.select("site_id", "local_date", src.alias("basis"), val.alias("kwh"))


def model_vs_last_year(modeled: DataFrame, daily: DataFrame, as_of: Column, kind: str) -> DataFrame:
    """Modelled period against the aligned period of last year, so far and remaining."""
    start = F.date_trunc("week", as_of).cast("date") if kind == "week" else F.trunc(as_of, "month") if kind == "month" else as_of
    ly_start = last_year_iso(start) if kind == "week" else F.add_months(start, -12) if kind == "month" else F.date_sub(start, 365)
    ly_end = F.date_add(ly_start, 6) if kind == "week" else F.last_day(ly_start) if kind == "month" else ly_start
    elapsed = F.date_diff(as_of, start)
    split = F.date_add(ly_start, elapsed)
    now = modeled.filter((F.col("local_date") >= start) & (F.col("local_date") < as_of)).groupBy("site_id").agg(F.sum("modeled_kwh").alias("model_so_far"), F.count(F.lit(1)).alias("days_so_far"))
    ly = daily.filter(F.col("local_date").between(ly_start, ly_end)).groupBy("site_id").agg(
        F.sum("kwh").alias("ly_total"), F.sum(F.when(F.col("local_date") < split, F.col("kwh"))).alias("ly_so_far"),
        F.sum(F.when(F.col("local_date") >= split, F.col("kwh"))).alias("ly_remaining"))
    return now.join(ly, "site_id", "full").withColumn("delta_so_far", nz("model_so_far") - nz("ly_so_far"))


def solar_delta(unit_hours: DataFrame, coeffs: DataFrame) -> DataFrame:
    """Heating minus cooling coefficient-times-potential per hour, over the given unit-hours."""
    d = unit_hours.withColumn("regime", F.when(F.col("mode") == "heating", "heating").when(F.col("mode") == "cooling", "cooling"))
    j = d.join(coeffs.select("site_id", "unit_id", "regime", "s", "e", "w"), ["site_id", "unit_id", "regime"])
    x = F.greatest(F.lit(0.0), sum((F.col(f) * F.col(f"pot_{f}") for f in "sew"), F.lit(0.0)))
    return j.groupBy("site_id", "ts").agg(F.sum(F.when(F.col("regime") == "heating", x).otherwise(-x)).alias("solar_delta"))


def plan_revision(hours: DataFrame, modes: DataFrame, models: Models) -> DataFrame:
    """Model on actual weather minus model on planned weather, per site-day, with its main driver.

    ``hours`` carries ``plan_temp`` and ``plan_wind`` from the planned-hour join.
    """
    both = F.array(F.struct(F.lit(0).alias("variant"), F.col("temp").alias("temp"), F.col("effective_wind").alias("effective_wind")),
                   F.struct(F.lit(1).alias("variant"), F.col("plan_temp").alias("temp"), F.col("plan_wind").alias("effective_wind")))
    v = hours.drop("variant").withColumn("_v", F.explode(both)).drop("temp", "effective_wind", "temp_key", "wind_bucket").select("*", "_v.*").drop("_v")
    s = predict_hours(with_cell(v), modes, models, ["site_id", "ts", "variant"])
    w = s.groupBy("site_id", "ts").agg(F.sum(F.when(F.col("variant") == 0, F.col("total_kwh")).otherwise(-F.col("total_kwh"))).alias("rev"))
    j = hours.join(w, ["site_id", "ts"])
    d = j.groupBy("site_id", F.col("ts").cast("date").alias("local_date")).agg(
        F.count(F.lit(1)).alias("hours"), F.sum("rev").alias("revision_kwh"), F.avg(F.col("temp") - F.col("plan_temp")).alias("temp_gap"),
        F.max("auxiliary_active").alias("has_aux"))
    t = rnd("temp_gap", 6)
    return d.withColumn("driver", F.when(t > 1.5, "warmer").when(t < -1.5, "colder"))
