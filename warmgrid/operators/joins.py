"""Joins: model lookup, forecast blending, calendar alignment, lag walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions.numeric import c, nz, rnd
from warmgrid.operators.rollup import last_year_iso
from warmgrid.operators.timeseries import epoch_hours

BUCKETS = (*K.WIND_BUCKETS, K.COOLING_BUCKET)


def attach_model(hours: DataFrame, model: DataFrame, keys=("site_id",), out: str = "model_kwh") -> DataFrame:
    """Exact cell lookup. No hint: the model grows with the fleet, so its size decides the join."""
    m = model.select(*keys, "temp_key", "wind_bucket", F.col("kwh").alias(out))
    return hours.join(m, [*keys, "temp_key", "wind_bucket"], "left")


# buckets that stand in for one, best first: at the same temperature, and at another
CALMER = {"extreme_wind": ("high_wind", "normal"), "high_wind": ("normal",), "normal": (), K.COOLING_BUCKET: ()}
STAND_IN = {"extreme_wind": ("extreme_wind", "high_wind", "normal"), "high_wind": ("high_wind", "normal", "extreme_wind"),
            "normal": ("normal", "high_wind", "extreme_wind"), K.COOLING_BUCKET: (K.COOLING_BUCKET,)}


def _first(cell: str, order: tuple[str, ...]) -> str:
    """SQL: the first value a cell has, of buckets in that order."""
    return f"coalesce({', '.join(f'{cell}.{b}' for b in order)})" if order else "CAST(NULL AS DOUBLE)"


def slot_in(cells: dict[str, dict[str, float]], key: int, bucket: str) -> dict:
    """What ``pack_model`` stores for a temperature and bucket, of cells in the order they were learned."""
    first = lambda cell, order: next((cell[b] for b in order if b in cell), None)
    own = cells.get(str(key), {})
    beside = [cell[bucket] for cell in (cells.get(str(key + step), {}) for step in (-1, 1)) if bucket in cell]
    far_key = min((int(k) for k, cell in cells.items() if cell and k != str(key)), key=lambda k: abs(k - key), default=None)
    far = first(own if far_key is None else cells[str(far_key)], STAND_IN[bucket])
    return {"exact": own.get(bucket), "mid": sum(beside) / len(beside) if beside else first(own, CALMER[bucket]), "far": far, "far_key": far_key}


def laddered_value(slot: dict, temp: float, bp: float = K.BALANCE_POINT) -> float:
    """``laddered`` for one slot outside a plan, where cells change from hour to hour."""
    dt, far = abs(bp - temp), slot["far"] or 0.0
    if slot["exact"] is not None:
        return slot["exact"]
    if dt <= 4.0 and slot["mid"] is not None:
        return slot["mid"]
    if slot["far_key"] is None or far <= 0.001:
        return far if slot["far_key"] is None else 0.0
    src = abs(bp - slot["far_key"])
    return far if src < (1.0 if dt > 4.0 else 0.5) else round(far * dt / src, 3)


def _slot(bucket: str) -> str:
    """SQL: what a lookup may need of temperature ``x`` and a bucket."""
    lo, hi, near = f"IF(x.below.temp_key = x.t - 1, x.below.{bucket}, NULL)", f"IF(x.above.temp_key = x.t + 1, x.above.{bucket}, NULL)", "x.near"
    return (f"named_struct('exact', x.own.{bucket}, 'mid', coalesce(({lo} + {hi}) / 2.0D, {lo}, {hi}, {_first('x.own', CALMER[bucket])}), "
            f"'far', IF({near} IS NULL, {_first('x.own', STAND_IN[bucket])}, {_first(near, STAND_IN[bucket])}), 'far_key', {near}.temp_key)")


def pack_model(model: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each model: ``low``, a temperature, and ``slots``, a dense array by temperature and bucket.

    Gaps are filled here, once: each slot has its own cell, the mean of the adjacent ones (or a calmer
    bucket), and the nearest other cell; equal distances go to the cell learned first, then to the
    lower temperature. The array spans the learnt temperatures and two more at both ends, which serve
    all that lies beyond. Its length is bounded by the range of temperatures.
    """
    wide = model.groupBy(*keys, "temp_key").agg(
        *[F.max(F.when(F.col("wind_bucket") == b, F.col("kwh"))).alias(b) for b in BUCKETS], F.min("first_ts").alias("first_ts"))
    per = wide.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("temp_key", "first_ts", *BUCKETS))).alias("c"))
    sides = """transform(sequence(c[0].temp_key - 2, c[size(c) - 1].temp_key + 2), t -> named_struct('t', t, 'own', get(filter(c, x -> x.temp_key = t), 0),
        'below', get(filter(reverse(c), x -> x.temp_key < t), 0), 'above', get(filter(c, x -> x.temp_key > t), 0)))"""
    low_wins = "x.above IS NULL OR x.t - x.below.temp_key < x.above.temp_key - x.t OR (x.t - x.below.temp_key = x.above.temp_key - x.t AND x.below.first_ts <= x.above.first_ts)"
    near = f"transform(s, x -> named_struct('t', x.t, 'own', x.own, 'below', x.below, 'above', x.above, 'near', IF(x.below IS NOT NULL AND ({low_wins}), x.below, x.above)))"
    slots = f"flatten(transform(n, x -> array({', '.join(_slot(b) for b in BUCKETS)})))"
    return per.withColumn("s", F.expr(sides)).withColumn("n", F.expr(near)).select(*keys, F.expr("c[0].temp_key - 2").alias("low"), F.expr(slots).alias("slots"))


def slot_of(packed: str, temp_key: str = "temp_key", bucket: str = "wind_bucket") -> Column:
    """The slot of a packed model (a struct of ``low`` and ``slots``) for a temperature and bucket."""
    step = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(BUCKETS))
    at = f"least(greatest({temp_key} - {packed}.low, 0), CAST(size({packed}.slots) / {len(BUCKETS)} AS INT) - 1) * {len(BUCKETS)} + CASE {bucket} {step} END"
    # least and greatest pass over nulls
    return F.expr(f"get({packed}.slots, IF({temp_key} IS NULL, NULL, {at}))")


def laddered(slot: str, temp: str = "temp", bp: float = K.BALANCE_POINT, scale: bool = True) -> Column:
    """Value of a slot by the regime-aware fallback ladder.

    Exact cell; within 4 degrees of the balance point the mean of the adjacent
    keys, then a calmer bucket at the same key; otherwise the nearest other key,
    scaled by the ratio of temperature differences.
    """
    dt, src = f"abs({bp}D - {temp})", f"abs({bp}D - {slot}.far_key)"
    scaled = f"""CASE WHEN {src} < CASE WHEN {dt} > 4.0D THEN 1.0D ELSE 0.5D END THEN {slot}.far
                 ELSE round({slot}.far * {dt} / {src} + 1e-9D, 3) END""" if scale else f"{slot}.far"
    return F.expr(f"""coalesce({slot}.exact, CASE WHEN {dt} <= 4.0D THEN {slot}.mid END,
        CASE WHEN {slot}.far_key IS NULL THEN coalesce({slot}.far, 0.0D) WHEN {slot}.far IS NULL OR {slot}.far <= 0.001D THEN 0.0D ELSE {scaled} END)""")


def attach_model_with_fallback(hours: DataFrame, model: DataFrame, keys: list[str] | None = None, temp: str = "temp",
                               bp: float = K.BALANCE_POINT, scale: bool = True, out: str = "predicted") -> DataFrame:
    """Cell lookup with the fallback ladder (``laddered``): one join by ``keys``, then an index."""
    keys = keys or ["site_id"]
    packed = pack_model(model, keys).select(*keys, F.struct("low", "slots").alias("_packed"))
    slot = hours.join(packed, keys, "left").withColumn("_slot", slot_of("_packed")).drop("_packed")
    return slot.withColumn(out, laddered("_slot", temp, bp, scale)).drop("_slot")


def blend_sources(primary: DataFrame, secondary: DataFrame, as_of: Column, crossover_day: int = K.CROSSOVER_DAY) -> DataFrame:
    """Primary before the crossover date, secondary elsewhere; a lone source is used whole."""
    cols = [x for x in primary.columns if x not in ("site_id", "ts")]
    p = primary.select("site_id", "ts", F.struct(*cols).alias("p"))
    s = secondary.select("site_id", "ts", F.struct(*cols).alias("s"))
    has2 = secondary.select("site_id").distinct().withColumn("has2", F.lit(True))
    j = p.join(s, ["site_id", "ts"], "full").join(has2, "site_id", "left")
    early = F.col("ts").cast("date") < F.date_add(as_of, crossover_day)
    use_p = F.col("p").isNotNull() & (early | F.col("has2").isNull())
    j = j.withColumn("_source", F.when(use_p, "primary").when(F.col("s").isNotNull(), "secondary")).filter("_source is not null")
    return j.withColumn("x", F.when(F.col("_source") == "primary", F.col("p")).otherwise(F.col("s"))).select("site_id", "ts", "_source", "x.*")


def merge_live_reference(live: DataFrame, ref: DataFrame, keys=("site_id", "local_date", "hour")) -> DataFrame:
    """Live hours win; reference hours fill the gaps."""
    cols = [x for x in live.columns if x not in keys]
    j = live.select(*keys, F.struct(*cols).alias("l")).join(ref.select(*keys, F.struct(*cols).alias("r")), list(keys), "full")
    return j.select(*keys, F.coalesce("l", "r").alias("x"), F.col("l").isNull().alias("filled")).select(*keys, "filled", "x.*")


def last_year_date(day: Column, kind: str) -> Column:
    """Aligned date: ISO week and weekday, calendar month and day, or 365 days back."""
    if kind == "week":
        return last_year_iso(day)
    return F.add_months(day, -12) if kind == "month" else F.date_sub(day, 365)


def same_period_last_year(daily: DataFrame, kind: str, cols: list[str]) -> DataFrame:
    ly = daily.select("site_id", F.col("local_date").alias("ly_date"), *[F.col(x).alias(f"ly_{x}") for x in cols])
    return daily.withColumn("ly_date", last_year_date(F.col("local_date"), kind)).join(ly, ["site_id", "ly_date"], "left")


def hours_vs_forecast(hourly: DataFrame, plan: DataFrame) -> DataFrame:
    """Each logged hour with the planned hour of the same date and hour."""
    p = plan.select("site_id", "local_date", "hour", F.col("temperature").alias("plan_temp"), F.col("wind_speed").alias("plan_wind"))
    return hourly.join(p, ["site_id", "local_date", "hour"])


WEATHER_FIELDS = ("temp", "tdd", "effective_wind", "wind_bucket", "solar_factor")


def weather_only_update(hourly: DataFrame, weather: DataFrame) -> DataFrame:
    """Overwrite weather fields of logged hours where the import carries them."""
    w = weather.select("site_id", "ts", F.lit(True).alias("updated"), *[F.col(x).alias(f"_{x}") for x in WEATHER_FIELDS])
    j = hourly.join(w, ["site_id", "ts"], "left")
    return j.withColumns({x: F.coalesce(f"_{x}", x) for x in WEATHER_FIELDS}).withColumn(
        "updated", F.coalesce("updated", F.lit(False))).drop(*[f"_{x}" for x in WEATHER_FIELDS])


def weather_only_days(hourly: DataFrame, weather: DataFrame) -> DataFrame:
    """Day means of imported days that have no logged hours and at least 20 rows."""
    logged = hourly.select("site_id", "local_date").distinct()
    w = weather.join(logged, ["site_id", "local_date"], "left_anti")
    return w.groupBy("site_id", "local_date").agg(
        F.count(F.lit(1)).alias("rows"), rnd(F.avg("temp"), 1).alias("temp"), rnd(F.avg("effective_wind"), 1).alias("wind"),
        rnd(F.sum("tdd"), 1).alias("tdd"), rnd(F.avg("solar_factor"), 3).alias("solar_factor"),
    ).filter(F.col("rows") >= K.MIN_DAY_HOURS)


def insert_missing(hourly: DataFrame, imported: DataFrame) -> DataFrame:
    new = imported.join(hourly, ["site_id", "ts"], "left_anti")
    return hourly.unionByName(new, allowMissingColumns=True)


def expanded(rows: DataFrame) -> DataFrame:
    """``rows`` of generated keys or lists, joined by sorting: the planner takes them for as small as the columns they came from, and would broadcast them."""
    return rows.hint("merge")


def lag_walk(originators: DataFrame, unit_hours: DataFrame, max_lag: int = 6) -> DataFrame:
    """Residual of each originator hour and of the following hours, by timestamp.

    A following hour counts if it has the same mode, no aux, and (beyond lag 0)
    no sun of its own. Each originator fans out to seven keys, then equi-joins.
    """
    o = originators.select("site_id", "unit_id", "mode", epoch_hours().alias("h0"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    o = o.withColumn("_h", F.col("h0") + F.col("lag"))
    t = unit_hours.select("site_id", "unit_id", epoch_hours().alias("_h"), F.col("mode").alias("t_mode"), "auxiliary_active", "solar_factor",
                          (F.col("expected_kwh") - F.col("actual_kwh")).alias("residual"))
    j = expanded(o).join(t, ["site_id", "unit_id", "_h"])
    ok = (F.col("t_mode") == F.col("mode")) & ~F.col("auxiliary_active") & ((F.col("lag") == 0) | (nz("solar_factor") <= 0.05))
    return j.filter(ok)


def evening_tail(originators: DataFrame, unit_hours: DataFrame, hourly: DataFrame, within: int = 12, length: int = 6) -> DataFrame:
    """Residuals from the first dark hour after each originator and the five after it."""
    h = hourly.select("site_id", epoch_hours().alias("h0"), nz("solar_factor").alias("sf"))
    w = Window.partitionBy("site_id").orderBy("h0").rangeBetween(1, within)
    first_dark = h.select("site_id", "h0", F.min(F.when(F.col("sf") < 0.05, F.col("h0"))).over(w).alias("dark"))
    o = originators.select("site_id", "unit_id", "mode", epoch_hours().alias("h0")).join(first_dark.filter("dark is not null"), ["site_id", "h0"])
    o = o.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("_h", F.col("dark") + F.col("k"))
    t = unit_hours.select("site_id", "unit_id", epoch_hours().alias("_h"), F.col("mode").alias("t_mode"), "auxiliary_active",
                          (F.col("expected_kwh") - F.col("actual_kwh")).alias("residual"))
    return expanded(o).join(t, ["site_id", "unit_id", "_h"]).filter((F.col("t_mode") == F.col("mode")) & ~F.col("auxiliary_active"))


def recent_temps(hourly: DataFrame, at: DataFrame, hours: int, max_gap: int) -> DataFrame:
    """The last ``hours`` logged temperatures no older than ``max_gap`` before each instant.

    Each instant looks at most ``max_gap`` hour keys back, so it expands to that many equi-join keys.
    Neither the keys nor the lists are sent whole to the driver.
    """
    a = at.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(max_gap)))).withColumn("_h", epoch_hours("at") - F.col("_k"))
    h = hourly.select("site_id", epoch_hours().alias("_h"), "temp")
    g = expanded(a).join(h, ["site_id", "_h"]).groupBy("site_id", "at").agg(F.sort_array(F.collect_list(F.struct("_h", "temp"))).alias("l"))
    tail = F.slice("l", -F.least(F.size("l"), F.lit(hours)), F.least(F.size("l"), F.lit(hours)))
    lists = g.select("site_id", "at", F.transform(tail, lambda x: x["temp"]).alias("temps"))
    return at.join(expanded(lists), ["site_id", "at"], "left")


def attach_synthetic(hourly_unit: DataFrame, distribution: DataFrame, units: DataFrame) -> DataFrame:
    """Replace the managed unit's meter with the day's synthetic hour, where one exists.

    ``distribution`` holds one array of (hour, synthetic_kwh_el) per site-day.
    """
    d = distribution.select("site_id", "local_date", F.explode("track_c_distribution").alias("x")).select(
        "site_id", "local_date", F.col("x.hour").alias("hour"), F.col("x.synthetic_kwh_el").alias("_syn"))
    m = units.select("site_id", "unit_id", "mpc_managed")
    j = hourly_unit.join(m, ["site_id", "unit_id"]).join(d, ["site_id", "local_date", "hour"], "left")
    used = F.col("mpc_managed") & F.col("_syn").isNotNull()
    return j.withColumns({"reference_kwh": F.when(used, F.col("_syn")).otherwise(F.col("actual_kwh")), "synthetic_used": used}).drop("_syn")


def scope_join(hourly_unit: DataFrame, units: DataFrame) -> DataFrame:
    """Aux, solar and screen membership per unit-hour; unknown units stay neutral."""
    s = units.select("site_id", "unit_id", "aux_affected", "solar_affected", "screen_affected")
    j = hourly_unit.join(s, ["site_id", "unit_id"], "left")
    return j.withColumns({x: F.coalesce(x, F.lit(False)) for x in ("aux_affected", "solar_affected", "screen_affected")})
