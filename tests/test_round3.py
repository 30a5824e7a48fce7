"""Horizon cuts by marker rows against plain sorting; the residual screen's single rules."""

import datetime as dt
import math
import random

from warmgrid import constants as K
from warmgrid.operators import calibrate as C
from warmgrid.operators import joins as J
from warmgrid.operators import sequential as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "site_id long, unit_id string, facade string, elev double, pred double, residual double, ts timestamp"


def brute_cuts(rows):
    """{side: (crit, n_above, n_below, gain)} of one group by sorting anew for each cut."""
    best = {}
    for side, (low, high) in (("low", K.OBSTRUCTION_LOW_GRID), ("high", K.OBSTRUCTION_HIGH_GRID)):
        for crit in range(int(low), int(high) + 1):
            near = lambda some: sorted(some, key=lambda r: (abs(r[3] - crit), r[6]))[: K.OBSTRUCTION_K_SIDE]  # noqa: B023, E731
            up, down = near([r for r in rows if r[3] > crit]), near([r for r in rows if r[3] <= crit])
            if min(len(up), len(down)) < K.OBSTRUCTION_MIN_SIDE or max(r[3] for r in up) - min(r[3] for r in down) > K.OBSTRUCTION_MAX_ANGLE:
                continue
            null = sum((r[5] - r[4]) ** 2 for r in up + down)
            gated, kept = (down, up) if side == "low" else (up, down)
            gain = 1 - (sum(r[5] ** 2 for r in gated) + sum((r[5] - r[4]) ** 2 for r in kept)) / null
            if side not in best or gain > best[side][3] + 1e-6:
                best[side] = (float(crit), len(up), len(down), gain)
    return best


def test_cuts_equal_plain_sorting_with_ties(spark):
    rng = random.Random(3)
    rows = []
    for site, n in ((1, 300), (2, 45), (3, 12)):
        for i in range(n):
            e = float(rng.randrange(2, 60)) if i % 3 else rng.uniform(2, 60)  # many samples exactly on a cut
            pred = rng.uniform(0.2, 1.0)
            rows.append((site, "u", "s", e, pred, (pred if 11 < e < 47 else 0.0) + rng.gauss(0, 0.05), T0 + dt.timedelta(hours=i)))
    odd = [(4, "u", "s", None, 0.5, 0.5, T0), (1, "u", "s", None, 9.0, 9.0, T0)]
    got = {}
    for r in C.fit_obstruction(spark.createDataFrame(rows + odd, SCHEMA)).collect():
        got.setdefault(r.site_id, {})[r.side] = (r.crit, r.n_above, r.n_below, r.gain)
    for site in (1, 2, 3):
        want = brute_cuts([r for r in rows if r[0] == site])
        mine = got.get(site, {})
        assert mine.keys() == want.keys()
        for side, (crit, up, down, gain) in want.items():
            assert mine[side][:3] == (crit, up, down) and math.isclose(mine[side][3], gain, abs_tol=2e-6)
    assert got[1]["low"][0] in (10.0, 11.0, 12.0) and 4 not in got


def test_cut_sweep_is_one_exchange_and_linear(spark):
    rows = [(1, "u", "s", float(i % 50), 0.5, 0.5, T0 + dt.timedelta(hours=i)) for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    plan = C.fit_obstruction(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert C.fit_obstruction(df.limit(0)).count() == 0


def test_screen_rules():
    assert S.spread([]) == 0.0 and S.spread([1, 2, 9]) == 1.0
    assert S.tolerated([0.0] * 5, 1.0) == (0.0, K.OUTLIER_CAP_FACTOR)
    centre, reach = S.tolerated([1.0] * 30, 0.0)
    assert centre == 1.0 and math.isclose(reach, K.OUTLIER_SIGMA * 0.02)
    assert S.new_level([0.0] * 30, [5.0] * K.OUTLIER_PROMOTION) and not S.new_level([0.0] * 30, [5.0] * (K.OUTLIER_PROMOTION - 1))
    scr = S.ResidualScreen({"base": [0.0] * 30})
    before = scr.dump()
    assert scr.outlier(float("nan"), 1.0, 1.0, 0.1) and scr.outlier(0.0, 50.0, 1.0, 0.1) and scr.dump() == before
    assert scr.outlier(4.0, 1.0, 1.0, 0.1) and scr.dump()["rejected"] == [4.0]
    assert not scr.outlier(0.0, 1.0, 1.0, 0.1) and scr.dump()["rejected"] == [] and len(scr.dump()["base"]) == 31


def test_ladder_in_a_plan_equals_the_ladder_beside_it(spark):
    rng = random.Random(4)
    model, cells = [], {}
    for site in (1, 2, 3):
        order = [(t, b) for t in range(-6, 24) for b in K.WIND_BUCKETS if rng.random() < 0.25]
        rng.shuffle(order)
        for i, (t, b) in enumerate(order):
            v = round(rng.choice([0.0, rng.uniform(0.2, 3)]), 5)
            model.append((site, t, b, v, T0 + dt.timedelta(hours=i)))
            cells.setdefault(site, {}).setdefault(str(t), {})[b] = v
    hours = [(site, i, t, b, t + rng.uniform(-0.5, 0.5)) for site in (1, 2, 3, 4) for i, (t, b) in enumerate((t, b) for t in range(-12, 30) for b in K.WIND_BUCKETS)]
    h = spark.createDataFrame(hours, "site_id long, i int, temp_key int, wind_bucket string, temp double")
    m = spark.createDataFrame(model, "site_id long, temp_key int, wind_bucket string, kwh double, first_ts timestamp")
    got = {(r.site_id, r.i): r.predicted for r in J.attach_model_with_fallback(h, m).collect()}
    for site, i, t, b, temp in hours:
        assert math.isclose(got[site, i], J.laddered_value(J.slot_in(cells.get(site, {}), t, b), temp), abs_tol=1.1e-3), (site, t, b)


def test_gaps_are_filled_from_the_import_and_from_the_log(spark):
    hour = lambda i: T0 + dt.timedelta(hours=i)
    log = spark.createDataFrame([(1, hour(i), 5.0, 2.0) for i in range(6) if i % 3], "site_id long, ts timestamp, temp double, actual_kwh double")
    new = spark.createDataFrame([(s, hour(i), 9.0) for s in (1, 2) for i in range(6)], "site_id long, ts timestamp, temp double")
    got = {(r.site_id, r.ts): (r.temp, r.actual_kwh) for r in J.insert_missing(log, new).collect()}
    assert got == {**{(s, hour(i)): (9.0, None) for s in (1, 2) for i in range(6)}, **{(1, hour(i)): (5.0, 2.0) for i in range(6) if i % 3}}
