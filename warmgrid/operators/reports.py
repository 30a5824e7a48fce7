"""Diagnostic reports: several aggregates over one input, as long tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions.numeric import c, nz, rnd, safe_corr, safe_slope, temp_key
from warmgrid.functions.weather import cloud_attenuation, wind_bucket
from warmgrid.operators import rollup as A
from warmgrid.operators.calibrate import GROUP
from warmgrid.operators.scan import ordered_fold
from warmgrid.operators.timeseries import monotonicity

BANDS = ((0, 15), (15, 30), (30, 45), (45, 60), (60, 91))


def _long(df: DataFrame, section: str, key: Column, metrics: dict[str, Column], ids=("site_id",)) -> DataFrame:
    """Wide aggregates to (section, key, metric, value) rows."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in metrics.items()])
    return df.select(*ids, F.lit(section).alias("section"), key.cast("string").alias("key"), F.explode(rows).alias("r")).select(*ids, "section", "key", "r.*")


def solar_error_correlation(hourly: DataFrame) -> DataFrame:
    d = hourly.filter((F.col("solar_factor") > 0.01) & F.col("actual_kwh").isNotNull() & F.col("expected_kwh").isNotNull())
    err = F.greatest(F.lit(0.0), F.col("actual_kwh") - nz("excluded_kwh")) - F.col("expected_kwh")
    a = d.withColumn("err", err).groupBy("site_id").agg(
        F.count(F.lit(1)).alias("hours"), safe_corr("solar_factor", "err").alias("corr"), F.avg("solar_factor").alias("avg_solar"), F.avg("err").alias("avg_error"))
    return a.filter("hours >= 10").withColumn("verdict", F.when(rnd("corr", 3) > 0.15, "under_subtracting").when(
        rnd("corr", 3) < -0.15, "over_subtracting").otherwise("calibrated"))


def report_model(hourly: DataFrame, hourly_unit: DataFrame, base_model: DataFrame) -> DataFrame:
    """Model health as long rows: inversions, coverage, contamination, solar fit, cell verdicts."""
    inv = monotonicity(base_model).groupBy("site_id", "wind_bucket").agg(F.count(F.lit(1)).alias("n"), F.max("delta").alias("d"))
    cov = A.plan_coverage(base_model)
    bad = A.mode_contamination(hourly_unit, None).groupBy("site_id").agg(F.count(F.lit(1)).alias("n"), F.sum("excluded_kwh").alias("k"))
    sol = solar_error_correlation(hourly)
    dark = A.dark_hour_baseline(hourly, base_model).groupBy("site_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        _long(inv, "monotonicity", F.col("wind_bucket"), {"inversions": F.col("n"), "worst_delta": F.col("d")}),
        _long(cov, "coverage", F.col("wind_bucket"), {x: F.col(x) for x in ("cells", "temp_min", "temp_max", "pending")}),
        _long(bad, "mode_contamination", F.lit("all"), {"days": F.col("n"), "excluded_kwh": F.col("k")}),
        _long(sol, "solar_correlation", F.col("verdict"), {"hours": F.col("hours"), "correlation": F.col("corr"), "avg_error_kwh": F.col("avg_error")}),
        _long(dark, "base_health", F.col("verdict"), {"cells": F.col("n")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_solar(samples: DataFrame, coeffs: DataFrame) -> DataFrame:
    """Per unit and regime: modelled against implied solar over time of day, screens, temperature and load state.

    Each sample is tagged with every slice it belongs to, then one aggregate serves all.
    """
    d = samples.join(coeffs.select(*GROUP, "s", "e", "w"), GROUP, "left")
    d = d.withColumn("modeled", nz("s") * F.col("ps") + nz("e") * F.col("pe") + nz("w") * F.col("pw"))

    def tag(section, key):
        return F.struct(F.lit(section).alias("section"), key.alias("key"))

    screen = F.when(F.col("correction_percent") >= 80, "open").when(F.col("correction_percent") < 20, "closed").otherwise("partial")
    band = F.concat((F.floor(F.col("temp") / 5) * 5).cast("int").cast("string"), F.lit("C"))
    tags = F.array(
        tag("all", F.lit("all")), tag("time", F.when(F.col("hour") < 12, "morning").otherwise("afternoon")), tag("screen", screen), tag("temp", band),
        tag("saturation", F.when(F.col("saturated"), "saturated").otherwise("free")), tag("shutdown", F.when(F.col("is_shutdown"), "shutdown").otherwise("running")))
    a = d.withColumn("_t", F.explode(tags)).groupBy(*GROUP, F.col("_t.section").alias("section"), F.col("_t.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("impact") - F.col("modeled")).alias("bias"), F.avg("impact").alias("implied"), F.avg("modeled").alias("modeled"))
    return a.withColumn("flag", F.when(F.col("n") < 5, "thin").when(F.abs(rnd("bias", 9)) > 0.25, "biased").otherwise("ok"))


def thermal_sensitivity(samples: DataFrame) -> DataFrame:
    """Slope of implied solar against outdoor temperature per unit and regime."""
    return samples.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), safe_slope("impact", "temp").alias("slope"), safe_corr("impact", "temp").alias("corr"))


def elevation_residuals(samples: DataFrame, min_n: int = 5) -> DataFrame:
    """Median, MAD and mean potential per sun-elevation band, saturated hours apart."""
    band = F.lit(None).cast("string")
    for lo, hi in BANDS:
        band = F.when((F.col("sun_elev") >= lo) & (F.col("sun_elev") < hi), F.lit(f"{lo}-{min(hi, 90)}")).otherwise(band)
    mag = F.sqrt(F.col("ps") ** 2 + F.col("pe") ** 2 + F.col("pw") ** 2)
    d = samples.withColumns({"band": band, "mag": mag}).filter("band is not null")
    keys = ["site_id", "unit_id", "band", "saturated"]
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.median("residual").alias("med"), F.avg("mag").alias("mean_potential"))
    m = d.join(a.select(*keys, "med"), keys).groupBy(*keys).agg(F.median(F.abs(F.col("residual") - F.col("med"))).alias("mad"))
    j = a.join(m, keys)
    enough = F.col("n") >= min_n
    return j.select(*keys, "n", F.when(enough, F.col("med")).alias("median_residual"), F.when(enough, F.col("mad")).alias("mad_residual"),
                    F.when(enough, F.col("mean_potential")).alias("mean_potential"),
                    F.when(enough & (F.col("mean_potential") > 1e-3), F.col("med") / F.col("mean_potential")).alias("normalised"))


def hour_of_day_residuals(samples: DataFrame) -> DataFrame:
    return samples.filter(F.col("hour").between(6, 18)).groupBy("site_id", "unit_id", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"))


def cloud_regime(dni="dni", dhi="dhi") -> Column:
    return F.when(c(dni) < 50, "overcast").when((c(dni) > 400) & (c(dhi) / F.greatest(c(dni), F.lit(1.0)) < 0.3), "clear").otherwise("broken")


def signal_agreement(hourly: DataFrame, ghi: str = "ghi_in") -> DataFrame:
    """Measured global irradiance against the cloud-derived factor, per cloud regime and overall."""
    sine = F.sin(F.radians("sun_elev"))
    d = hourly.filter(F.col(ghi).isNotNull() & (F.col("sun_elev") >= 5)).withColumn("_clear", 1361.0 * sine * F.pow(F.lit(0.7), 1.0 / F.greatest(sine, F.lit(0.087))))
    d = d.withColumns({"x": cloud_attenuation("cloud_coverage"), "y": F.greatest(F.lit(0.0), F.least(F.lit(1.5), F.col(ghi) / F.col("_clear")))})
    d = d.filter((F.col("_clear") >= 1) & (F.col("solar_factor") > 0.05))
    reg = F.when(F.col("cloud_coverage") < 30, "clear").when(F.col("cloud_coverage") < 70, "broken").otherwise("overcast")
    d = d.withColumn("cloud_regime", F.explode(F.array(F.lit("all"), reg)))
    a = d.groupBy("site_id", "cloud_regime").agg(F.count(F.lit(1)).alias("n"), safe_corr("x", "y").alias("corr"),
                                                 F.sqrt(F.avg((F.col("x") - F.col("y")) ** 2)).alias("rmse"), (F.avg("x") - F.avg("y")).alias("bias"))
    return a.select("site_id", "cloud_regime", "n", *[F.when(F.col("n") >= 5, F.col(x)).alias(x) for x in ("corr", "rmse", "bias")])


# --- three- against four-direction regression ---------------------------------------------


def gram(samples: DataFrame, keys: list[str], cols: list[str], target: str) -> DataFrame:
    """Upper triangle of X'X, X'y and y'y per key as flat sums."""
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    aggs += [F.sum(F.col(a) * F.col(target)).alias(f"b_{i}") for i, a in enumerate(cols)]
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(target) ** 2).alias("yy"), *aggs)


def solve_gram(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Batch-solve one small system per row; singular systems give NULL."""
    k = len(names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys)
    schema += ", n long, " + ", ".join(f"{x} double" for x in names) + ", residual_std double"

    def run(batches):
        for pdf in batches:
            m = np.zeros((len(pdf), k, k))
            for i in range(k):
                for j in range(i, k):
                    m[:, i, j] = m[:, j, i] = pdf[f"g_{i}_{j}"]
            b = pdf[[f"b_{i}" for i in range(k)]].to_numpy(float)
            size = np.maximum(np.abs(np.einsum("nii->ni", m)).prod(axis=1), 1e-300)
            ok = np.abs(np.linalg.det(m)) / size > 1e-9
            x = np.full((len(pdf), k), np.nan)
            if ok.any():
                x[ok] = np.linalg.solve(m[ok], b[ok][..., None])[..., 0]
            sse = pdf["yy"].to_numpy(float) - (x * b).sum(axis=1)
            out = pdf[[*keys, "n"]].copy()
            for i, name in enumerate(names):
                out[name] = pd.Series(x[:, i], index=out.index).astype(object).where(ok, None)
            std = np.sqrt(np.maximum(sse, 0.0) / pdf["n"].to_numpy(float))
            out["residual_std"] = pd.Series(std, index=out.index).astype(object).where(ok, None)
            yield out

    return sums.mapInPandas(run, schema)


def shadow_regression(samples: DataFrame, names3=("ps", "pe", "pw"), names4=("p4_s", "p4_e", "p4_w", "p4_d")) -> DataFrame:
    """Both bases fitted to the same targets: residual spread of each per unit and regime."""
    three = solve_gram(gram(samples, GROUP, list(names3), "impact"), GROUP, ["s", "e", "w"])
    four = solve_gram(gram(samples, GROUP, list(names4), "impact"), GROUP, ["s4", "e4", "w4", "d4"])
    j = three.withColumnRenamed("residual_std", "std_3d").join(four.drop("n").withColumnRenamed("residual_std", "std_4d"), GROUP)
    return j.withColumn("improvement_pct", F.when(F.col("std_3d") > 1e-9, (F.col("std_3d") - F.col("std_4d")) / F.col("std_3d") * 100))


def shadow_base_jitter(hourly: DataFrame, base_model: DataFrame, lr: float = K.LEARNING_RATE) -> DataFrame:
    """Parallel cell averages driven by the 3D and the 4D delta: drift and step size per cell."""
    d = hourly.filter(F.col("solar_normalization_delta_4d").isNotNull() & F.col("solar_normalization_delta").isNotNull() & ~F.col("auxiliary_active"))
    seed = base_model.select("site_id", "temp_key", "wind_bucket", F.col("kwh").alias("seed"))
    d = d.withColumn("temp_key", temp_key("temp")).join(seed, ["site_id", "temp_key", "wind_bucket"], "left")
    zero = F.lit(0.0)
    d = d.select("site_id", "temp_key", "wind_bucket", "ts", nz("seed").alias("seed"), (lr * nz("snr_weight", 1.0)).alias("r"),
                 F.greatest(zero, F.col("actual_kwh") + F.col("solar_normalization_delta")).alias("y3"), F.greatest(zero, F.col("actual_kwh") + F.col("solar_normalization_delta_4d")).alias("y4"))
    init = F.struct(*[F.lit(None).cast("double").alias(x) for x in ("b3", "b4")], *[F.lit(0.0).alias(x) for x in ("q3", "q4")], F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        b3, b4 = F.coalesce(s["b3"], x["seed"]), F.coalesce(s["b4"], x["seed"])
        d3, d4 = x["r"] * (x["y3"] - b3), x["r"] * (x["y4"] - b4)
        return F.struct((b3 + d3).alias("b3"), (b4 + d4).alias("b4"), (s["q3"] + d3 * d3).alias("q3"), (s["q4"] + d4 * d4).alias("q4"), (s["n"] + 1).alias("n"))

    m = ordered_fold(d, ["site_id", "temp_key", "wind_bucket"], ["ts"], ["seed", "r", "y3", "y4"], init, step).select("site_id", "temp_key", "wind_bucket", "state.*")
    rms = {f"step_{k}d_rms": F.sqrt(F.col(f"q{k}") / F.col("n")) for k in (3, 4)}
    return m.withColumns({"drift_kwh": F.col("b4") - F.col("b3"), **rms}).withColumn("ratio", F.when(F.col("step_3d_rms") > 0, F.col("step_4d_rms") / F.col("step_3d_rms")))


def jitter_headline(cells: DataFrame) -> DataFrame:
    """Step size over the shoulder-season calm cells."""
    s = cells.filter(F.col("temp_key").between(7, 14) & (F.col("wind_bucket") == "normal"))
    a = s.groupBy("site_id").agg(F.count(F.lit(1)).alias("cells"), F.sqrt(F.avg(F.col("step_3d_rms") ** 2)).alias("rms_3d"), F.sqrt(F.avg(F.col("step_4d_rms") ** 2)).alias("rms_4d"))
    return a.withColumn("shoulder_ratio", F.when(F.col("rms_3d") > 0, F.col("rms_4d") / F.col("rms_3d")))


def prediction_divergence(hours: DataFrame, scored_3d: DataFrame, scored_4d: DataFrame) -> DataFrame:
    """4D minus 3D totals and solar per cloud regime over sunlit hours."""
    a = scored_3d.select("site_id", "ts", F.col("total_kwh").alias("t3"), F.col("solar_kwh").alias("s3"), "base_kwh")
    b = scored_4d.select("site_id", "ts", F.col("total_kwh").alias("t4"), F.col("solar_kwh").alias("s4"))
    j = hours.filter("sun_elev > 0").join(a, ["site_id", "ts"]).join(b, ["site_id", "ts"]).withColumn("cloud_regime", cloud_regime())
    j = j.withColumns({"dt": F.col("t4") - F.col("t3"), "ds": F.col("s4") - F.col("s3")})
    return j.groupBy("site_id", "cloud_regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dt").alias("mean_delta"), F.median(F.abs("dt")).alias("median_abs_delta"),
        F.percentile(F.abs("dt"), F.lit(0.95)).alias("p95_abs_delta"), F.avg("ds").alias("mean_solar_delta"), F.avg("base_kwh").alias("mean_base"))


def saturation_radius(hours: DataFrame, scored: DataFrame) -> DataFrame:
    """Median absolute residual with and without the demand clamp, on shoulder-temperature hours."""
    j = hours.filter(F.col("temp").between(7, 14)).join(scored.select("site_id", "ts", "total_kwh", "wasted_kwh"), ["site_id", "ts"])
    clamped = F.col("wasted_kwh") > 0.001
    free = F.col("total_kwh") - F.col("wasted_kwh")
    return j.groupBy("site_id", clamped.alias("clamped")).agg(
        F.count(F.lit(1)).alias("n"), F.median(F.abs(F.col("actual_kwh") - F.col("total_kwh"))).alias("median_clamped"), F.median(F.abs(F.col("actual_kwh") - free)).alias("median_unclamped"))


# --- weather drivers ------------------------------------------------------------------------

# fixed values: sign of consumption against each factor, per regime
CORRELATION = {"heating": {"temp": -1, "wind": 1, "solar": -1}, "cooling": {"temp": 1, "wind": None, "solar": 1}, "mixed": {}}


def _sign(factor: str) -> Column:
    reg = F.col("regime")
    return F.when(reg == "mixed", F.lit(None).cast("int")).when(reg == "cooling", F.lit(CORRELATION["cooling"][factor]).cast("int")).otherwise(F.lit(CORRELATION["heating"][factor]))


def driver_days(days: DataFrame, base: DataFrame) -> DataFrame:
    """Each day against the same-numbered day of the baseline period: impact classes, severity, causality."""
    w = Window.partitionBy("site_id").orderBy("local_date")
    p = days.withColumn("i", F.row_number().over(w))
    b = base.withColumn("i", F.row_number().over(w)).select("site_id", "i", *[F.col(x).alias(f"b_{x}") for x in ("temp", "wind", "solar_kwh", "kwh")])
    j = p.join(b, ["site_id", "i"])
    d = {x: rnd(nz(x) - nz(f"b_{x}"), 9) for x in ("temp", "wind", "solar_kwh", "kwh")}
    j = j.withColumns({"d_temp": d["temp"], "d_wind": d["wind"], "d_solar": d["solar_kwh"], "d_kwh": d["kwh"]})
    level = lambda x: F.when(wind_bucket(x) == "extreme_wind", 2).when(wind_bucket(x) == "high_wind", 1).otherwise(0)
    t, s = F.abs("d_temp"), F.abs("d_solar")
    steps = F.abs(level(nz("wind")) - level(nz("b_wind")))
    j = j.withColumns({
        "i_temp": F.when(t >= K.TEMP_EXTREME, 3).when(t >= K.TEMP_SIGNIFICANT, 2).when(t >= K.TEMP_MODERATE, 1).otherwise(0),
        "i_wind": F.when(steps >= 2, 3).when(steps == 1, 2).when(F.col("d_wind") >= 2.5, 1).otherwise(0),
        "i_solar": F.when(s >= K.SOLAR_SIGNIFICANT, 2).when(s >= K.SOLAR_MODERATE, 1).otherwise(0)})
    score = F.col("i_temp") + F.col("i_wind") + F.col("i_solar")
    j = j.withColumn("severity", F.when(score >= 5, "severe").when(score >= 3, "challenging").when(score >= 1, "notable").otherwise("normal"))
    for x, thr in (("temp", K.TEMP_MODERATE), ("wind", K.WIND_RELEVANCE), ("solar", K.SOLAR_MODERATE)):
        big = F.abs(f"d_{x}") >= thr
        push = F.col(f"d_{x}") * _sign(x) * F.col("d_kwh")
        j = j.withColumns({f"{x}_explains": F.coalesce(big & (push > 0), F.lit(False)), f"{x}_contradicts": F.coalesce(big & (push < 0), F.lit(False))})
    return j


def weather_drivers(days: DataFrame) -> DataFrame:
    """Period verdict per site: change, day counts, the leading driver by votes, and its label."""
    tot = days.groupBy("site_id").agg(
        F.sum("kwh").alias("kwh"), F.sum("b_kwh").alias("base_kwh"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("severe", "challenging", "notable", "normal")],
        *[F.avg(f"d_{x}").alias(f"mean_{x}") for x in ("temp", "wind", "solar")], F.count(F.lit(1)).alias("days"))
    tot = tot.withColumns({"delta_kwh": F.col("kwh") - F.col("base_kwh"), "delta_pct": F.when(F.col("base_kwh") > 0, (F.col("kwh") - F.col("base_kwh")) / F.col("base_kwh") * 100).otherwise(0.0)})
    v = days.join(tot.select("site_id", "delta_kwh"), "site_id").filter(F.col("delta_kwh") * F.col("d_kwh") > 0)
    # a day votes for its strongest explaining factor; temp, wind, solar in that order on a tie
    votes = F.array_compact(F.array(*[F.when(F.col(f"{x}_explains"), F.struct(F.col(f"i_{x}").alias("rank"), F.lit(o).alias("o"), F.lit(x).alias("factor")))
                                      for x, o in (("temp", 3), ("wind", 2), ("solar", 1))]))
    v = v.withColumn("_vs", F.sort_array(votes, asc=False)).filter(F.size("_vs") > 0).withColumn("_v", F.col("_vs")[0])
    f = v.filter("_v.rank > 0").groupBy("site_id", F.col("_v.factor").alias("factor"), F.col("_v.o").alias("o")).agg(F.max("_v.rank").alias("impact"), F.count(F.lit(1)).alias("votes"))
    top = f.groupBy("site_id").agg(F.max_by(F.struct("factor", "impact", "votes"), F.struct("impact", "votes", "o")).alias("t"))
    j = tot.join(top, "site_id", "left")
    up = F.col("delta_pct") > 0
    label = F.when(F.abs("delta_pct") <= 5, "similar").when(F.col("t").isNull(), F.when(up, "higher").otherwise("lower")).otherwise(
        F.concat_ws("_", F.when(up, "higher").otherwise("lower"), F.col("t.factor")))
    variability = F.when(F.col("severe") > 0, "high").when((F.col("challenging") > 0) | (F.col("notable") > 2), "medium").otherwise("low")
    return j.withColumns({"top_factor": F.col("t.factor"), "top_votes": F.col("t.votes"), "label": label, "variability": variability}).drop("t")


# --- battery, readiness, outage ----------------------------------------------------------------


def battery_health(hourly: DataFrame, hours_after: int = 6, min_hours: int = 30) -> DataFrame:
    """Mean residual of the hours after sunset, judged relative to their expected energy."""
    day = Window.partitionBy("site_id", "local_date")
    last = F.max(F.when(nz("solar_impact_kwh") > 0.01, F.col("hour"))).over(day)
    d = hourly.withColumn("_last", last).filter(F.col("hour").between(F.col("_last") + 1, F.col("_last") + hours_after))
    res = F.col("actual_kwh") - F.col("expected_kwh")
    a = d.groupBy("site_id").agg(F.count(F.lit(1)).alias("n_hours"), F.avg(res).alias("mean_residual"), F.avg("expected_kwh").alias("mean_expected"),
                                 F.stddev_samp(res).alias("std_residual"))
    rel = F.when(F.col("mean_expected") > 0, F.abs("mean_residual") / F.col("mean_expected"))
    off = (F.abs("mean_residual") > 0.05) & (rel > 0.10)
    return a.withColumns({"relative": rel, "assessment": F.when((F.col("n_hours") < min_hours) | rel.isNull(), "insufficient_data").when(
        off, F.when(F.col("mean_residual") > 0, "too_slow").otherwise("too_fast")).otherwise("ok")})


def readiness_4d(units: DataFrame, modes: DataFrame, coeffs: DataFrame) -> DataFrame:
    """Whether every in-scope unit of a site has learned its active regime."""
    u = units.filter("solar_affected").select("site_id", "unit_id").join(modes.select("site_id", "unit_id", "mode"), ["site_id", "unit_id"], "left")
    m = F.coalesce("mode", F.lit("heating"))
    u = u.withColumn("regime", F.when(m.isin(*K.HEATING_MODES), "heating").when(m.isin(*K.COOLING_MODES), "cooling"))
    live = F.col("learned") & ((F.col("s") != 0) | (F.col("e") != 0) | (F.col("w") != 0) | (F.col("d") != 0))
    j = u.join(coeffs.select(*GROUP, F.coalesce(live, F.lit(False)).alias("live")), GROUP, "left")
    a = j.groupBy("site_id").agg(F.count(F.lit(1)).alias("in_scope"), F.count("regime").alias("evaluated"), F.count_if(F.col("regime").isNotNull() & F.coalesce("live", F.lit(False))).alias("learned"))
    return a.withColumns({"ready": F.when(F.col("evaluated") > 0, F.col("learned") == F.col("evaluated")),
                          "reason": F.when(F.col("evaluated") == 0, "no_entities_in_active_regime").when(F.col("learned") < F.col("evaluated"), "regimes_not_learned").otherwise("all_active_regimes_learned")})


def irradiance_outage(hourly: DataFrame, sites: DataFrame) -> DataFrame:
    """Raise, hold or clear by the real-source share of each site's last 24 daylight hours."""
    d = hourly.filter((nz("solar_factor") > 0) & F.col("dni_dhi_source").isNotNull())
    w = Window.partitionBy("site_id").orderBy(F.col("ts").desc())
    d = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= K.OUTAGE_WINDOW)
    a = d.groupBy("site_id").agg(F.count(F.lit(1)).alias("examined"), F.count_if(F.col("dni_dhi_source").isin("native", "erbs_from_ghi")).alias("real_hours"))
    j = sites.select("site_id", "use_4d").join(a, "site_id", "left")
    share = F.col("real_hours") / F.col("examined")
    return j.withColumns({"share": F.when(nz("examined", 0) >= K.OUTAGE_WINDOW, share), "verdict": F.when(~F.col("use_4d"), "not_applicable").when(
        nz("examined", 0) < K.OUTAGE_WINDOW, "insufficient_data").when(share < K.OUTAGE_RAISE_BELOW, "raise").when(share >= K.OUTAGE_CLEAR_AT, "clear").otherwise("hold")})
