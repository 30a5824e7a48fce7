"""Order-dependent and iterative learners (checked by tests on small fixtures)."""

from pyspark.sql import functions as F

from warmgrid.operators import calibrate as C
from warmgrid.operators import enrich as E
from warmgrid.operators import learn as L
from warmgrid.operators import retrain as R
from warmgrid.operators import sequential as S
from warmgrid.operators import timeseries as W
from warmgrid.operators.scan import affine_scan
from warmgrid.plans.q_calibrate import fit_hours, prior_coeffs
from warmgrid.plans.q_learn import synthetic
from warmgrid.plans.q_timeseries import snr_hours
from warmgrid.plans.registry import query


def solar_rows(t):
    hours = E.screen_potential(t.hourly_log, t.sites).select("site_id", "ts", "pot_s", "pot_e", "pot_w")
    b = W.potential_battery(hours).select("site_id", "ts", "battery_s", "battery_e", "battery_w")
    return S.solar_learning_rows(fit_hours(t)).join(b, ["site_id", "ts"])


@query("train_solar_nlms", "L10 L11", "site_id:i unit_id:s regime:s s:f e:f w:f learned:b n:i")
def _(t):
    return S.train_solar_nlms(solar_rows(t))


@query("train_solar_nlms_4d", "L10 L11", "site_id:i unit_id:s regime:s s:f e:f w:f d:f learned:b n:i")
def _(t):
    d = E.enrich_potential_4d(fit_hours(t)).withColumns({f"p4_{f}": F.col(f"p4_{f}") / 1000 for f in "sewd"})
    hourly = d.groupBy("site_id", "ts").agg(*[F.max(f"p4_{f}").alias(f"x_{f}") for f in "sewd"])
    b = affine_scan(hourly, ["site_id"], "ts", F.lit(0.5), {f"battery_{f}": F.col(f"x_{f}") * 0.5 for f in "sewd"})
    return S.train_solar_nlms(S.solar_learning_rows(d).join(b.drop(*[f"x_{f}" for f in "sewd"]), ["site_id", "ts"]), four_d=True)


def tobit_samples(t):
    return C.solar_samples(fit_hours(t), "tobit", coeffs=prior_coeffs(t)).filter("drop_reason is null")


@query("fit_solar_tobit", "C6", "site_id:i unit_id:s regime:s s:f e:f w:f sigma:f n_eff:f n_uncensored:i n_censored:i skip_reason:s")
def _(t):
    return S.fit_solar_tobit(tobit_samples(t))


@query("fit_solar_tobit_4d", "C6 P7", "site_id:i unit_id:s regime:s s:f e:f w:f d:f sigma:f n_uncensored:i skip_reason:s")
def _(t):
    d = E.enrich_potential_4d(fit_hours(t)).withColumns({f"p4_{f}": F.col(f"p4_{f}") / 1000 for f in "sewd"})
    return S.fit_solar_tobit(C.solar_samples(d, "tobit", coeffs=prior_coeffs(t)).filter("drop_reason is null"), four_d=True)


@query("write_tobit", "C6 U6", "site_id:i unit_id:s regime:s s:f e:f w:f had_prior:b")
def _(t):
    return S.write_tobit(prior_coeffs(t), S.fit_solar_tobit(tobit_samples(t)))


@query("train_tobit_window", "L12", "site_id:i unit_id:s regime:s s:f e:f w:f updates:i last_reason:s")
def _(t):
    return S.train_tobit_window(tobit_samples(t))


@query("outlier_screen", "L15", "site_id:i unit_id:s regime:s is_shutdown:b ts:t residual:f outlier:b")
def _(t):
    d = S.solar_learning_rows(fit_hours(t)).withColumn("residual", F.col("raw_impact") - (0.5 * F.col("ps") + 0.3 * F.col("pe") + 0.2 * F.col("pw")))
    return S.outlier_screen(d)


def live_hours(t):
    d = L.base_inputs(snr_hours(t))
    return d.select("site_id", "ts", "temp_key", "wind_bucket", "temp", "energy", "delta", F.col("snr_weight").alias("weight"), "auxiliary_active",
                    (F.col("guest_impact_kwh") > 0).alias("guest"))


@query("train_base_live", "L2 L4", "site_id:i kind:s temp_key:i wind_bucket:s kwh:f")
def _(t):
    return S.train_base_live(live_hours(t), lr=0.1)


@query("shadow_replay", "D13", "site_id:i unit_id:s regime:s replay_s:f replay_e:f replay_w:f n:i distance:f")
def _(t):
    return S.shadow_replay(solar_rows(t), prior_coeffs(t))


@query("retrain", "L14", "site_id:i track:s cells:i updates:i mean_kwh:f")
def _(t):
    sites = t.sites.withColumn("track", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("site_id") % 3 + 1).cast("int")))
    daily = t.daily.withColumnRenamed("aux_impact_kwh", "excluded_kwh").withColumn("solar_normalization_delta", F.col("solar_factor"))
    contrib = L.strategy_contributions(t.hourly_unit, t.hourly_log, t.units, synthetic(t))
    return R.retrain_report(R.retrain(sites, snr_hours(t), daily, contrib))
