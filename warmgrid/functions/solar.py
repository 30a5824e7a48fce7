"""Solar column expressions used by the staged enrichers.

Sources are public: Spencer (1971) for the sun position, Erbs, Klein & Duffie
(1982) for the irradiance split, Kasten & Czeplak (1980) for clouds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions.numeric import c, clamp


def clear_sky(elev) -> Column:
    e = F.radians(F.greatest(F.lit(1.0), c(elev)))
    return F.when(c(elev) <= 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.cos(e)) * F.pow(F.lit(0.7), 1.0 / F.sin(e))
    )


def facade_weights(az) -> dict[str, Column]:
    a = F.radians(c(az))
    zero = F.lit(0.0)
    return {
        "s": F.greatest(zero, -F.cos(a)),
        "e": F.greatest(zero, F.sin(a)),
        "w": F.greatest(zero, -F.sin(a)),
    }


def irradiance_source(ghi, dni, dhi, cloud) -> Column:
    """Which branch of the ladder an hour resolves through, ignoring the sun."""
    return (
        F.when(c(ghi) > 0, F.lit("erbs_from_ghi"))
        .when(c(dni).isNotNull() & c(dhi).isNotNull(), F.lit("native"))
        .when(c(cloud).isNotNull(), F.lit("kasten_synthetic"))
        .otherwise(F.lit("none"))
    )


def transmittance(pct, screened, floor=K.SCREEN_FLOOR) -> Column:
    """Open-percentage to transmittance; a facade without screens passes all."""
    t = c(floor) + (1.0 - c(floor)) * clamp(F.coalesce(c(pct), F.lit(100.0)), 0.0, 100.0) / 100.0
    return F.when(c(screened), t).otherwise(F.lit(1.0))


def unscreen(effective, t) -> Column:
    return F.when(c(t) > 0.01, c(effective) / c(t)).otherwise(c(effective))


def saturate(demand, solar, mode) -> dict[str, Column]:
    """Applied solar, wasted solar and net demand for one unit-hour."""
    d, s, m = c(demand), c(solar), c(mode)
    heat, cool = m.isin(*K.HEATING_MODES), m.isin(*K.COOLING_MODES)
    zero = F.lit(0.0)
    applied_h = F.least(s, F.greatest(zero, d))
    return {
        "applied": F.when(heat, applied_h).when(cool, s).otherwise(zero),
        "wasted": F.when(heat, s - applied_h).otherwise(zero),
        "net": F.when(heat, F.greatest(zero, d - applied_h)).when(cool, d + s)
        .when(m == "off", zero).otherwise(d),
    }


def snr_weight(factor, n_shutdown=None, n_units=None, floor=K.SNR_FLOOR, k=K.SNR_K) -> Column:
    """Learning weight: falls with sun, scaled by the share of unaffected units."""
    w = F.greatest(c(floor), 1.0 - c(k) * F.greatest(F.lit(0.0), F.coalesce(c(factor), F.lit(0.0))))
    if n_units is None:
        return w
    clean = F.greatest(F.lit(0), c(n_units) - c(n_shutdown))
    return F.when((c(n_units) > 0) & (c(n_shutdown) > 0), w * clean / c(n_units)).otherwise(w)
