"""Sun, irradiance, screen and COP enrichment of hour tables.

Each enrichment is staged over named helper columns rather than one nested
expression: every intermediate is computed once and generated code stays small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions import solar as S
from warmgrid.functions import weather as W
from warmgrid.functions.numeric import c, nz, rnd


def enrich_solar_geometry(hours: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Sun elevation and azimuth at the hour midpoint (public Spencer series)."""
    df = hours if sites is None else hours.join(sites.select("site_id", "lat", "lon"), "site_id")
    g = F.col("_g")
    df = df.withColumn("_g", (2 * math.pi / 365.0) * (F.dayofyear("ts") - 1 + (F.hour("ts") + 0.5 - 12) / 24.0))
    eq_minutes = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g)
                           - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    df = df.withColumns({
        "_decl": 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g)
        + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g),
        "_ha": F.radians((F.hour("ts") * 60 + 30 + eq_minutes + 4 * F.col("lon")) / 4.0 - 180.0),
        "_la": F.radians("lat"),
    })
    d, h, la = F.col("_decl"), F.col("_ha"), F.col("_la")
    sine = F.sin(la) * F.sin(d) + F.cos(la) * F.cos(d) * F.cos(h)
    return df.withColumns({
        "sun_elev": rnd(F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), sine)))), 4),
        "sun_azim": rnd(F.degrees(F.atan2(F.sin(h), F.cos(h) * F.sin(la) - F.tan(d) * F.cos(la))) + 180.0, 4),
    }).drop("_g", "_decl", "_ha", "_la")


def enrich_solar_factor(hours: DataFrame, cloud="cloud_coverage", azimuth=K.SOLAR_AZIMUTH) -> DataFrame:
    """Scalar solar factor and the south/east/west vector."""
    delta = F.abs(F.col("sun_azim") - c(azimuth))
    df = hours.withColumns({
        "_sky": S.clear_sky("sun_elev") * W.cloud_attenuation(cloud),
        "_delta": F.when(delta > 180, 360 - delta).otherwise(delta),
    })
    taper = (F.when(F.col("_delta") <= 75.0, F.cos(F.col("_delta") / 75.0 * (math.pi / 2)) * 0.9 + 0.1)
             .when(F.col("_delta") <= 90.0, F.lit(0.1)).otherwise(F.lit(0.05)))
    cols = {"solar_factor": rnd(F.col("_sky") * taper, 5)}
    for f, w in S.facade_weights("sun_azim").items():
        cols[f"solar_vector_{f}"] = rnd(F.col("_sky") * w, 5)
    return df.withColumns(cols).drop("_sky", "_delta")


def enrich_irradiance(hours: DataFrame, ghi="ghi_in", dni="dni_in", dhi="dhi_in", cloud="cloud_coverage") -> DataFrame:
    """DNI, DHI and source label: GHI split, else native pair, else cloud synthetic, else none."""
    doy = F.dayofyear("ts")
    df = hours.withColumns({
        "dni_dhi_source": F.when(F.col("sun_elev") <= 0, F.lit("no_sun")).otherwise(S.irradiance_source(ghi, dni, dhi, cloud)),
        "_sin": F.sin(F.radians("sun_elev")),
    })
    df = df.withColumn("_ext", 1367.0 * (1.0 + 0.033 * F.cos(2 * math.pi * doy / 365.0)) * F.col("_sin"))
    src = F.col("dni_dhi_source")
    synth = F.greatest(F.lit(0.0), F.col("_ext") * F.pow(F.lit(0.7), 1.0 / F.col("_sin")) * W.cloud_attenuation(cloud))
    df = df.withColumn("_ghi", F.when(src == "erbs_from_ghi", c(ghi)).when(src == "kasten_synthetic", synth))
    df = df.withColumn("_kt", F.when((F.col("_ghi") > 0) & (F.col("_ext") >= 1.0), F.least(F.col("_ghi") / F.col("_ext"), F.lit(1.0))))
    k = F.col("_kt")
    poly = 0.9511 + k * (-0.1604 + k * (4.388 + k * (-16.638 + k * 12.336)))
    df = df.withColumn("_kd", F.when(k <= 0.22, 1.0 - 0.09 * k).when(k <= 0.80, poly).otherwise(F.lit(0.165)))
    zero, native = F.lit(0.0), src == "native"
    df = df.withColumns({
        "dni": rnd(F.when(native, F.greatest(zero, c(dni))).when(k.isNull(), zero)
                   .otherwise(F.greatest(zero, (1.0 - F.col("_kd")) * F.col("_ghi") / F.col("_sin"))), 3),
        "dhi": rnd(F.when(native, F.greatest(zero, c(dhi))).when(nz("_ghi") <= 0, zero).when(k.isNull(), F.col("_ghi"))
                   .otherwise(F.col("_kd") * F.col("_ghi")), 3),
    })
    return df.drop("_sin", "_ext", "_ghi", "_kt", "_kd")


def enrich_forecast_irradiance(forecast: DataFrame) -> DataFrame:
    """Forecast variant: native pair if published, else cloud (or condition text) synthetic."""
    df = forecast.withColumns({
        "cloud_used": F.coalesce("cloud_coverage", W.cloud_from_condition("condition")),
        "_none": F.lit(None).cast("double")})
    return enrich_irradiance(df, ghi="_none", dni="direct_normal_irradiance", dhi="diffuse_radiation",
                             cloud="cloud_used").drop("_none")


def facade_transmittance(hours: DataFrame, sites: DataFrame, floor=K.SCREEN_FLOOR) -> DataFrame:
    """Adds ``t_s, t_e, t_w`` from the screen position and the site's screened facades."""
    df = hours.join(sites.select("site_id", "screen_s", "screen_e", "screen_w"), "site_id")
    return df.withColumns({f"t_{f}": S.transmittance("correction_percent", f"screen_{f}", floor) for f in "sew"})


def screen_potential(hours: DataFrame, sites: DataFrame) -> DataFrame:
    """Pre-screen potential vector rebuilt from the logged (post-screen) vector."""
    df = facade_transmittance(hours, sites)
    return df.withColumns({f"pot_{f}": S.unscreen(f"solar_vector_{f}", f"t_{f}") for f in "sew"})


def enrich_potential_4d(unit_hours: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Beam per facade and diffuse potential, after screens and obstruction gates.

    ``unit_hours`` carries sun position, irradiance and transmittance; ``gates`` has
    one row per (site, unit, facade), joined by key after pivoting to columns.
    """
    df = unit_hours
    if gates is not None:
        wide = gates.groupBy("site_id", "unit_id").agg(*[
            F.max(F.when(F.col("facade") == f, F.col(b))).alias(f"{b}_{f}") for f in "sew" for b in ("low", "high")])
        df = df.join(wide, ["site_id", "unit_id"], "left")
    up = F.col("sun_elev") > 0
    flat = F.greatest(F.lit(0.0), F.col("dni")) * F.cos(F.radians("sun_elev"))
    df = df.withColumn("_beam", F.when(up, flat).otherwise(F.lit(0.0)))
    cols = {}
    for f, w in S.facade_weights("sun_azim").items():
        beam = F.col("_beam") * w * F.col(f"t_{f}")
        if gates is not None:
            shut = (F.col("sun_elev") < F.col(f"low_{f}")) | (F.col("sun_elev") > F.col(f"high_{f}"))
            beam = F.when(F.coalesce(shut, F.lit(False)), F.lit(0.0)).otherwise(beam)
        cols[f"p4_{f}"] = beam
    diffuse = F.greatest(F.lit(0.0), F.col("dhi")) * 0.5 * (F.col("t_s") + F.col("t_e") + F.col("t_w")) / 3.0
    cols["p4_d"] = F.when(up, diffuse).otherwise(F.lit(0.0))
    return df.withColumns(cols).drop("_beam")


def saturate_units(unit_hours: DataFrame, demand="demand", solar="solar") -> DataFrame:
    """Applied, wasted and net columns for every unit-hour."""
    s = S.saturate(demand, solar, "mode")
    return unit_hours.withColumns({"applied": rnd(s["applied"], 3), "wasted": rnd(s["wasted"], 3), "net": rnd(s["net"], 3)})


def cop_hours(hours: DataFrame, cop_params: DataFrame) -> DataFrame:
    p = cop_params.select("site_id", "eta_carnot", "lwt", "f_defrost", "defrost_temp_threshold", "defrost_rh_threshold")
    return hours.join(p, "site_id").withColumn("cop", W.carnot_cop(
        "temp", "humidity", "eta_carnot", "lwt", "f_defrost", "defrost_temp_threshold", "defrost_rh_threshold"))


def fill_cloud(forecast: DataFrame) -> DataFrame:
    """Cloud cover from the number, else the condition text, else 50 %."""
    return forecast.withColumn("cloud_used", F.coalesce(
        "cloud_coverage", W.cloud_from_condition("condition"), F.lit(K.DEFAULT_CLOUD)))


def snr_weights(hourly: DataFrame, flagged: DataFrame) -> DataFrame:
    """Learning weight per hour from the sun and the share of units not shut down."""
    n = flagged.groupBy("site_id", "ts").agg(
        F.count_if("is_shutdown").alias("n_shutdown"),
        F.count_if((F.col("mode") == "heating") & (F.col("actual_kwh") > 0)).alias("n_active"),
        F.count(F.lit(1)).alias("n_all"))
    j = hourly.join(n, ["site_id", "ts"], "left").withColumn(
        "n_units", F.when(F.col("n_active") > 0, F.col("n_active")).otherwise(F.col("n_all")))
    return j.withColumn("snr_weight", S.snr_weight("solar_factor", "n_shutdown", "n_units"))


def screen_recommendation(hours: DataFrame, bp=K.BALANCE_POINT) -> DataFrame:
    sunny = F.col("solar_factor") > 0.1
    state = (F.when((F.col("temp") < bp) & sunny, "maximize_solar").when(F.col("temp") < bp, "insulate")
             .when(sunny, "mitigate_solar").otherwise("none"))
    return hours.withColumn("state", state)


def average_day_solar(days: DataFrame, cloud: float = K.DEFAULT_CLOUD) -> DataFrame:
    """Mean solar factor and vector over the 24 hour midpoints of each day."""
    h = days.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    h = h.withColumn("ts", (F.col("local_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))))
    h = enrich_solar_factor(enrich_solar_geometry(h).withColumn("_c", F.lit(cloud)), "_c")
    return h.groupBy("site_id", "local_date").agg(
        F.avg("solar_factor").alias("solar_factor"), *[F.avg(f"solar_vector_{f}").alias(f"solar_{f}") for f in "sew"])


def calendar_parts(hours: DataFrame, zone: Column | str) -> DataFrame:
    """ISO week parts, local day and hour, and the UTC instant of a local timestamp."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    return hours.withColumns({
        "iso_year": F.extract(F.lit("YEAROFWEEK"), "ts"), "iso_week": F.weekofyear("ts"),
        "iso_weekday": F.weekday("ts") + 1, "day_key": F.date_format("ts", "yyyy-MM-dd"),
        "local_ts": local, "utc_back": F.to_utc_timestamp(local, zone)})
