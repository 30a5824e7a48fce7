"""Operators on tiny frames: edge rows, brute force and recovery of known parameters."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.operators import calibrate as C
from warmgrid.operators import enrich as E
from warmgrid.operators import filters as P
from warmgrid.operators import joins as J
from warmgrid.operators import learn as L
from warmgrid.operators import reports as D
from warmgrid.operators import rollup as A
from warmgrid.operators import sequential as S
from warmgrid.operators import timeseries as W
from warmgrid.operators.scan import affine_scan, previous_row

T0 = dt.datetime(2024, 1, 1)


def hours(n, start=T0):
    return [start + dt.timedelta(hours=i) for i in range(n)]


# --- scans ----------------------------------------------------------------------


def test_affine_scan_crosses_days_and_months(spark):
    rng = random.Random(3)
    rows = [(s, ts, rng.uniform(0.2, 0.99), rng.uniform(-1, 1)) for s in (1, 2) for ts in hours(24 * 70, dt.datetime(2024, 1, 20)) if rng.random() > 0.3]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp, a double, b double")
    got = {(r.site_id, r.ts): r.x for r in affine_scan(df, ["site_id"], "ts", "a", {"x": F.col("b")}).collect()}
    state = {1: 0.0, 2: 0.0}
    for s, ts, a, b in sorted(rows):
        state[s] = a * state[s] + b
        assert got[s, ts] == pytest.approx(state[s], abs=1e-9)


def test_previous_row_carries_over_empty_hours(spark):
    rng = random.Random(5)
    rows = [(u, T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * 5)), i, float(i)) for i in range(300) for u in ("a", "b")]
    df = spark.createDataFrame(rows, "unit string, ts timestamp, n long, v double")
    got, fine = ({(r.unit, r.ts, r.n): r.p.v if r.p else None for r in previous_row(df, ["unit"], "ts", ["ts", "n"], ["v"], "p", b).collect()}
                 for b in ("hour", "minute"))
    assert got == fine
    for u in ("a", "b"):
        last = None
        for _, ts, n, v in sorted(r for r in rows if r[0] == u):
            assert got[u, ts, n] == last
            last = v


def test_meter_reset_and_spike_rebaseline(spark):
    vals = [10.0, 11.0, 0.5, 1.0, 9.0, 9.5]
    rows = [(1, "u", ts, i, v, "heating") for i, (ts, v) in enumerate(zip(hours(6), vals))]
    df = spark.createDataFrame(rows, "site_id long, unit_id string, ts timestamp, event_id long, reading_kwh double, mode string")
    got = [(r.status, r.delta_kwh) for r in W.meter_delta(df).orderBy("ts").collect()]
    assert got == [("first", 0.0), ("ok", 1.0), ("reset", 0.0), ("ok", 0.5), ("spike", 0.0), ("ok", 0.5)]


# --- edges of the daily rollup -----------------------------------------------------


def test_vectors_merge_doubled_hour_and_keep_missing_null(spark):
    rows = [(1, T0, T0.date(), 2, 1.0, 1.0, None), (1, T0, T0.date(), 2, 3.0, 2.0, 5.0), (1, T0, T0.date(), 4, 7.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp, local_date date, hour int, temp double, actual_kwh double, dni double")
    df = df.withColumns({x: F.lit(None).cast("double") for x in ("effective_wind", "tdd", "solar_factor", "solar_normalization_delta", "solar_normalization_delta_4d", "dhi")})
    v = A.hourly_vectors(df).first().hourly_vectors
    assert v.temp[2] == 2.0 and v.actual_kwh[2] == 3.0 and v.dni[2] == 5.0
    assert v.temp[3] is None and v.dni[4] == 0.0 and len(v.temp) == 24


def test_regime_edges(spark):
    rows = [(8.0, 2.0), (7.9, 2.1), (2.0, 8.0), (0.004, 0.005)]
    df = spark.createDataFrame(rows, "h double, c double").select("h", A.regime_label("h", "c").alias("r"))
    assert [r.r for r in df.collect()] == ["heating", "mixed", "cooling", "idle"]


def test_half_even_key_and_balance_point(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (17.0,)], "temp double")
    out = P.enrich_tdd(df.withColumn("k", F.rint("temp").cast("int"))).collect()
    assert [r.k for r in out] == [0, 2, 0, 17] and out[3].side == "cooling" and out[3].tdd == 0.0


def test_p90_is_nearest_rank(spark):
    for n in (1, 9, 10, 11, 60):
        rows = [(1, T0 + dt.timedelta(seconds=i), float(i)) for i in range(n)]
        df = spark.createDataFrame(rows, "site_id long, ts timestamp, effective_wind double")
        extra = ("temp", "solar_factor", "solar_vector_s", "solar_vector_e", "solar_vector_w", "correction_percent", "humidity", "dni", "dhi", "ghi", "cloud_coverage")
        df = df.withColumns({**{x: F.lit(1.0) for x in extra}, "wind_bucket": F.lit("normal"), "aux_active": F.lit(False), "solar_data_time": F.lit("x")})
        assert A.hourly_rollup(df).first().effective_wind == math.ceil(0.9 * n) - 1


def test_last_year_week_53_falls_back(spark):
    days = [dt.date(2020, 12, 31), dt.date(2021, 1, 4), dt.date(2024, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(A.last_year_iso(F.col("d")).alias("x"))
    want = []
    for d in days:
        y, w, wd = d.isocalendar()
        try:
            want.append(dt.date.fromisocalendar(y - 1, w, wd))
        except ValueError:
            want.append(dt.date.fromisocalendar(y - 1, 52, wd))
    assert [r.x for r in df.collect()] == want


# --- fallback ladder ------------------------------------------------------------------


def test_fallback_join_agrees_with_sequential_lookup(spark):
    rng = random.Random(11)
    cells, order = {}, []
    for k in range(-10, 26):
        for b in K.WIND_BUCKETS:
            if rng.random() < 0.25:
                cells[k, b] = round(rng.uniform(0, 4), 3)
                order.append((k, b))
    rng.shuffle(order)
    m = S.SiteModel()
    first = {}
    for k, b in order:
        m.base.setdefault(str(k), {})[b] = cells[k, b]
        first.setdefault(k, T0 + dt.timedelta(hours=len(first)))
    model = spark.createDataFrame([(1, k, b, v, first[k]) for (k, b), v in cells.items()], "site_id long, temp_key int, wind_bucket string, kwh double, first_ts timestamp")
    ask = [(1, i, k + off, k, b) for i, (k, off, b) in enumerate((k, off, b) for k in range(-14, 30) for off in (-0.4, 0.3) for b in K.WIND_BUCKETS)]
    q = spark.createDataFrame(ask, "site_id long, i long, temp double, temp_key int, wind_bucket string")
    got = {r.i: r.predicted for r in J.attach_model_with_fallback(q, model).collect()}
    for _, i, temp, k, b in ask:
        assert got[i] == pytest.approx(m.lookup(k, b, temp), abs=1.1e-3), (k, b, temp)


def test_empty_model_predicts_zero(spark):
    model = spark.createDataFrame([], "site_id long, temp_key int, wind_bucket string, kwh double, first_ts timestamp")
    q = spark.createDataFrame([(1, 5.0, 5, "normal")], "site_id long, temp double, temp_key int, wind_bucket string")
    assert J.attach_model_with_fallback(q, model).first().predicted == 0.0


# --- fits recover known parameters ------------------------------------------------------

TRUE = np.array([1.2, 0.5, 0.8])


def synthetic(n=400, sigma=0.05, base=0.9, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, (n, 3)) * rng.choice([0.05, 1.0], (n, 3))
    y = x @ TRUE + rng.normal(0, sigma, n)
    return x, y, base


def frame(spark, x, y, cens):
    rows = [(1, "u", "heating", ts, *map(float, v), float(t), bool(c)) for ts, v, t, c in zip(hours(len(y)), x, y, cens)]
    return spark.createDataFrame(rows, "site_id long, unit_id string, regime string, ts timestamp, ps double, pe double, pw double, impact double, censored boolean")


def test_least_squares_recovery_and_collinear_fallback(spark):
    x, y, _ = synthetic()
    r = C.fit_solar_ls(frame(spark, x, y, np.zeros(len(y)))).first()
    assert np.allclose([r.s, r.e, r.w], TRUE, atol=0.05) and r.method == "joint"
    line = np.outer(np.linspace(0.1, 1, 50), [1.0, 0.0, 0.0])
    r = C.fit_solar_ls(frame(spark, line, line @ TRUE, np.zeros(50))).first()
    assert r.method == "collinear" and r.s == pytest.approx(1.2) and r.e == pytest.approx(0.0)


def test_censored_fit_beats_least_squares_on_clipped_data(spark):
    x, y, cap = synthetic(600)
    cens = y >= cap
    r = S.fit_solar_tobit(frame(spark, x, np.where(cens, cap, y), cens)).first()
    assert r.skip_reason is None and cens.mean() > 0.1
    assert np.allclose([r.s, r.e, r.w], TRUE, atol=0.08) and r.sigma == pytest.approx(0.05, abs=0.02)


def test_censored_fit_gates(spark):
    x, y, _ = synthetic(25)
    assert S.fit_solar_tobit(frame(spark, x[:10], y[:10], np.zeros(10))).first().skip_reason == "insufficient_uncensored"
    assert S.fit_solar_tobit(frame(spark, x, y, np.zeros(25))).first().skip_reason == "insufficient_effective_samples"


def test_lms_converges_and_shutdown_only_raises(spark):
    x, y, _ = synthetic(1500, 0.02)
    rows = [(1, "u", "heating", ts, float(t), 5.0, False, *map(float, v), *map(float, v)) for ts, v, t in zip(hours(len(y)), x, y)]
    cols = "site_id long, unit_id string, regime string, ts timestamp, raw_impact double, expected_base_kwh double, is_shutdown boolean, ps double, pe double, pw double, battery_s double, battery_e double, battery_w double"
    r = S.train_solar_nlms(spark.createDataFrame(rows, cols)).first()
    assert r.learned and np.allclose([r.s, r.e, r.w], TRUE, atol=0.15)
    st = S.SolarState(3, {"coeff": [0.1, 0.1, 0.1]})
    before = st.coeff.copy()
    st.shutdown(2.0, np.array([0.5, 0.2, 0.1]))
    assert (st.coeff >= before).all() and st.coeff[0] > before[0]


def test_dead_zone_resets_after_fifteen_hours():
    st = S.SolarState(3, {"coeff": [0.5, 0.5, 0.5]})
    for i in range(15):
        assert st.coeff.any(), i
        st.modulating(-0.2, np.array([0.5, 0.1, 0.1]))
    assert not st.coeff.any()


def test_outlier_screen_flags_and_promotes():
    rng = random.Random(1)
    scr = S.ResidualScreen()
    assert not any(scr.outlier(rng.gauss(0, 0.05), 1.0, 1.0, 0.15) for _ in range(40))
    assert scr.outlier(3.0, 1.0, 1.0, 0.15)
    flags = [scr.outlier(2.0 + rng.gauss(0, 0.02), 1.0, 1.0, 0.15) for _ in range(12)]
    assert flags[0] and not flags[-1]


def test_obstruction_cut_is_found(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i, e in enumerate(np.linspace(2, 40, 400)):
        pred = 0.6
        seen = pred if e > 12 else 0.0
        rows.append((1, "u", "s", float(e), pred, float(seen + rng.normal(0, 0.03)), T0 + dt.timedelta(hours=i)))
    df = spark.createDataFrame(rows, "site_id long, unit_id string, facade string, elev double, pred double, residual double, ts timestamp")
    low = C.fit_obstruction(df).filter("side = 'low'").first()
    assert low.learned and abs(low.crit - 12) <= 1.0 and low.gain > 0.9
    sky = spark.createDataFrame([(1, "u", "s", e) for e in (6.0, 7.0, 8.0)], "site_id long, unit_id string, facade string, elev double")
    bounded = C.fit_obstruction(df, sky).filter("side = 'low'").first()
    assert bounded is None or bounded.crit <= 8.0


def test_transmittance_sweep_finds_the_floor(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        pot, pct = rng.uniform(0.1, 1, 3), float(rng.choice([0, 20, 50, 100]))
        t = 0.15 + 0.85 * pct / 100
        rows.append((1, "u", *map(float, pot * t), pct, True, True, True, float(pot @ TRUE)))
    df = spark.createDataFrame(rows, "site_id long, unit_id string, solar_vector_s double, solar_vector_e double, solar_vector_w double, correction_percent double, screen_s boolean, screen_e boolean, screen_w boolean, impact double")
    assert C.transmittance_sweep(df).filter("rank = 1").first().floor == 0.15


def test_gram_solver_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 4))
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame([(1, *map(float, r), float(v)) for r, v in zip(x, y)], "k long, a double, b double, c double, d double, y double")
    r = D.solve_gram(D.gram(df, ["k"], ["a", "b", "c", "d"], "y"), ["k"], ["a", "b", "c", "d"]).first()
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert np.allclose([r.a, r.b, r.c, r.d], want, atol=1e-8)


def test_apply_suggestion_only_writes_stable(spark):
    model = spark.createDataFrame([(1, "u", "heating", 0.5, 0.3, 0.2)], "site_id long, unit_id string, regime string, s double, e double, w double")
    sug = spark.createDataFrame([(1, "u", "heating", "s", 0.9, "stable"), (1, "u", "heating", "e", 9.0, "sign_flip")], "site_id long, unit_id string, regime string, direction string, implied double, verdict string")
    r = C.apply_suggestion(model, sug).first()
    assert (r.new_s, r.new_e, r.new_w, r.changed) == (0.9, 0.3, 0.2, True)
    assert C.apply_suggestion(model, sug, force=True).first().new_e == K.SOLAR_COEFF_CAP


# --- live learner, kernels, COP ------------------------------------------------------------


def test_live_learner_buffers_then_averages(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 10.0]
    rows = [(1, ts, 5, "normal", 5.0, v, 0.0, 1.0, False, False) for ts, v in zip(hours(5), vals)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp, temp_key int, wind_bucket string, temp double, energy double, delta double, weight double, auxiliary_active boolean, guest boolean")
    r = S.train_base_live(df, lr=0.1).first()
    assert r.kwh == pytest.approx(2.5 + 0.1 * 7.5)


def test_kernel_sweep_ranks_the_true_time_constant_first(spark):
    rng = np.random.default_rng(6)
    temps = np.cumsum(rng.normal(0, 1.5, 600)) * 0.3
    tau, win = 6, 30
    w = np.exp(-np.arange(win) / tau)
    w /= w.sum()
    rows = []
    for i, ts in enumerate(hours(600)):
        eff = float((temps[max(0, i - win + 1): i + 1][::-1] * w[: min(win, i + 1)]).sum())
        rows.append((1, ts, float(temps[i]), max(0.0, 17 - eff) / 24 * 3 + 0.2, "normal", None))
    df = spark.createDataFrame(rows, "site_id long, ts timestamp, temp double, actual_kwh double, wind_bucket string, reason string")
    model = spark.createDataFrame([], "site_id long, temp_key int, wind_bucket string, kwh double")
    best = C.best_kernel(C.kernel_sweep(df, model, C.exponential_kernels(range(1, 13)))).filter("rank = 1").first()
    assert best.param == tau and best.r2 > 0.999


def test_cop_limits(spark):
    from warmgrid.functions.weather import carnot_cop
    df = spark.createDataFrame([(-20.0, 50.0), (5.0, 90.0), (5.0, 50.0), (40.0, 50.0)], "t double, h double")
    v = [r.c for r in df.select(carnot_cop("t", "h", F.lit(0.42), F.lit(35.0)).alias("c")).collect()]
    assert v[1] == pytest.approx(v[2] * 0.85) and v[3] == 1.0 and all(1 <= x <= 10 for x in v)


def test_sun_is_high_at_noon_and_down_at_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 6, 21, h),) for h in (0, 12)], "ts timestamp").withColumns({"lat": F.lit(45.0), "lon": F.lit(0.0)})
    night, noon = E.enrich_solar_geometry(df).orderBy("ts").collect()
    assert night.sun_elev < 0 and noon.sun_elev == pytest.approx(67.7, abs=0.3) and 170 < noon.sun_azim < 210


def test_synthetic_day_conserves_metered_energy(spark):
    rng = np.random.default_rng(8)
    mpc = spark.createDataFrame([(1, T0.date(), h, float(rng.uniform(1, 3)), float(rng.uniform(0.3, 1)), "sh") for h in range(24)],
                                "site_id long, local_date date, hour int, kwh_th_sh double, kwh_el_sh double, mode string")
    hrs = spark.createDataFrame([(1, T0.date(), h, float(h % 9 - 5), None, 4.0, 0.0, 60.0) for h in range(24)],
                                "site_id long, local_date date, hour int, temp double, inertia_temp double, effective_wind double, solar_factor double, humidity double")
    cop = spark.createDataFrame([(1, 0.42, 35.0, 0.85, 7.0, 70.0)], "site_id long, eta_carnot double, lwt double, f_defrost double, defrost_temp_threshold double, defrost_rh_threshold double")
    total = mpc.agg(F.sum("kwh_el_sh")).first()[0]
    for params in (None, cop):
        got = L.synthetic_baseline(mpc, hrs, params).agg(F.sum("synthetic_kwh_el")).first()[0]
        assert got == pytest.approx(total, abs=0.02)


def test_packed_model_spans_its_temperatures_and_serves_beyond(spark):
    model = spark.createDataFrame([
        (1, 0, "normal", 4.0, "2024-01-02"), (1, 6, "normal", 2.0, "2024-01-01"), (1, 6, "high_wind", 3.0, "2024-01-05"), (2, -30, "cooling", 9.0, "2024-01-01")],
        "site_id long, temp_key int, wind_bucket string, kwh double, first_ts string")
    packed = {r["site_id"]: r for r in J.pack_model(model, ["site_id"]).collect()}
    assert packed[1]["low"] == -2 and len(packed[1]["slots"]) == 4 * 11 and len(packed[2]["slots"]) == 4 * 5
    slot = lambda t, b: packed[1]["slots"][(t + 2) * 4 + b]
    assert slot(0, 0)["exact"] == 4.0 and slot(0, 1)["mid"] == 4.0 and slot(1, 0)["mid"] == 4.0 and slot(-1, 0)["mid"] == 4.0
    # as far from both: the cell learned first
    assert slot(3, 0)["far_key"] == 6 and slot(3, 1)["far"] == 3.0 and slot(2, 0)["far_key"] == 0 and slot(-2, 0)["far_key"] == 0
    hours = spark.createDataFrame([(1, -40.0, -40, "normal"), (1, 40.0, 40, "high_wind"), (2, 0.0, 0, "cooling"), (3, 5.0, 5, "normal"), (1, None, None, "normal"), (1, 5.0, 5, None)],
                                  "site_id long, temp double, temp_key int, wind_bucket string")
    got = {(r["site_id"], r["temp"], r["wind_bucket"]): r["predicted"] for r in J.attach_model_with_fallback(hours, model).collect()}
    assert got[1, -40.0, "normal"] == round(4.0 * 57 / 17, 3) and got[1, 40.0, "high_wind"] == round(3.0 * 23 / 11, 3)
    assert got[2, 0.0, "cooling"] == round(9.0 * 17 / 47, 3) and got[3, 5.0, "normal"] == 0.0 and got[1, None, "normal"] == 0.0 and got[1, 5.0, None] == 0.0
