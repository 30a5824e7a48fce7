"""Wind, temperature and cloud column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions.numeric import c, clamp


def speed_to_ms(value, unit) -> Column:
    """Speed in m/s; an unknown or missing unit passes through unchanged."""
    v, u = c(value), c(unit)
    out = v
    for name, (op, factor) in K.SPEED_UNITS.items():
        out = F.when(u == name, v / factor if op == "/" else v * factor).otherwise(out)
    return out


def effective_wind(speed, gust, gust_factor=K.WIND_GUST_FACTOR) -> Column:
    extra = F.greatest(F.lit(0.0), F.coalesce(c(gust) - c(speed), F.lit(0.0)))
    return c(speed) + extra * c(gust_factor)


def wind_bucket(wind, high=K.HIGH_WIND, extreme=K.EXTREME_WIND) -> Column:
    return (
        F.when(c(wind) >= c(extreme), F.lit("extreme_wind"))
        .when(c(wind) >= c(high), F.lit("high_wind"))
        .otherwise(F.lit("normal"))
    )


def tdd_hour(temp, bp=K.BALANCE_POINT) -> Column:
    """Degree-day share of one hour, for either side of the balance point."""
    return F.abs(c(bp) - c(temp)) / 24.0


def side(temp, bp=K.BALANCE_POINT) -> Column:
    return F.when(c(temp) >= c(bp), F.lit("cooling")).otherwise(F.lit("heating"))


def cloud_from_condition(condition) -> Column:
    pairs = [x for k, v in K.CLOUD_BY_CONDITION.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.element_at(F.create_map(*pairs), c(condition))


def cloud_attenuation(cloud_pct) -> Column:
    frac = clamp(c(cloud_pct) / 100.0, 0.0, 1.0)
    return 1.0 - 0.75 * F.pow(frac, F.lit(3.4))


def carnot_cop(t_out, humidity, eta, lwt, f_defrost=K.DEFROST_FACTOR,
               defrost_t=K.DEFROST_TEMP, defrost_rh=K.DEFROST_RH) -> Column:
    """Heat-pump COP at outdoor conditions, limited to [1, 10]."""
    hot, cold = c(lwt) + K.KELVIN, c(t_out) + K.KELVIN
    icing = (c(t_out) < c(defrost_t)) & (c(humidity) > c(defrost_rh))
    penalty = F.when(icing, c(f_defrost)).otherwise(F.lit(1.0))
    lift = F.when(hot > cold, hot / (hot - cold))
    return F.when(lift.isNull(), F.lit(1.0)).otherwise(clamp(c(eta) * lift * penalty, 1.0, 10.0))
