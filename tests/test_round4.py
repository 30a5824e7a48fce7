"""Joins over generated rows, whole training sets and shared reads, on rows of their own."""

import dataclasses
import datetime as dt

import numpy as np

from warmgrid.llm import linededup, recurrent
from warmgrid.operators import joins as J

T0 = dt.datetime(2024, 1, 1)


def ran(df):
    """The rows, and the plan as it was run (a join may become a broadcast on the way)."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_recent_temps_broadcasts_neither_keys_nor_lists(spark):
    log = [(1, T0 + dt.timedelta(hours=i), float(i)) for i in range(12) if i != 4] + [(2, T0, 7.0), (None, T0, 1.0)]
    hourly = spark.createDataFrame(log, "site_id long, ts timestamp, temp double")
    at = spark.createDataFrame([(1, T0 + dt.timedelta(hours=i)) for i in (0, 1, 5, 12, 30)] + [(2, T0), (None, T0)], "site_id long, at timestamp")
    got, plan = ran(J.recent_temps(hourly, at, 4, 6))
    assert "BroadcastHashJoin" not in plan.split("Initial Plan")[0]
    assert {(r.site_id, r.at.hour + 24 * (r.at.day - 1)): r.temps for r in got} == {
        (1, 0): None, (1, 1): [0.0], (1, 5): [0.0, 1.0, 2.0, 3.0], (1, 12): [8.0, 9.0, 10.0, 11.0], (1, 30): None, (2, 0): None, (None, 0): None}


def test_walks_from_each_originator_broadcast_no_expanded_keys(spark):
    rows = [(1, "u", "heating", T0 + dt.timedelta(hours=i), False, 0.5 if i == 0 else 0.0, 2.0, float(i)) for i in range(9)]
    cells = spark.createDataFrame(rows, "site_id long, unit_id string, mode string, ts timestamp, auxiliary_active boolean, solar_factor double, expected_kwh double, actual_kwh double")
    first = cells.where("solar_factor > 0.05")
    lags, plan = ran(J.lag_walk(first, cells))
    assert "BroadcastHashJoin" not in plan.split("Initial Plan")[0]
    assert sorted((r.lag, r.residual) for r in lags) == [(i, 2.0 - i) for i in range(7)]
    tail = J.evening_tail(first, cells, cells)
    assert sorted((r.k, r.residual) for r in tail.collect()) == [(i, 1.0 - i) for i in range(6)]


def test_the_language_model_learns_from_every_training_document(spark, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 17}" for j in range(12)) for i in range(96)]
    docs = spark.createDataFrame([(i if i % 8 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    # a corpus of this size has many shards
    lex = dataclasses.replace(recurrent.lexicon(recurrent.token_counts(docs)), total=24_000_000)
    kept = []

    class Spy(recurrent.Stored):
        def __init__(self, df, name, *rest, **more):
            super().__init__(df, name, *rest, **more)
            kept.extend(len(r.sym) // 2 for r in self.df.collect())

    monkeypatch.setattr(recurrent, "Stored", Spy)
    net = recurrent.fit(docs, lex)
    assert len(kept) == 96 and sum(kept) == 96 * 13
    assert not np.array_equal(net.p["cls_b"], recurrent.Gru.fresh(lex).p["cls_b"])


def test_pieces_of_long_documents_hold_every_token_once(monkeypatch):
    monkeypatch.setattr(recurrent, "PIECE", 8)
    sym = np.arange(100, 160)
    bounds = np.array([0, 5, 5, 45, 60])
    inp, target, begin, live = recurrent.training_lanes(sym, bounds)
    assert sorted(target[live].tolist()) == sym.tolist()
    before = dict(zip(target[live].tolist(), inp[live].tolist()))
    assert [t for t in sym if before[t] == recurrent.START] == [100, 105, 145] and before[113] == 112 and begin.sum() == 8


def test_lines_that_share_one_frequent_key_alone_meet(spark, monkeypatch):
    lines = [("x" * n, n) for n in (60, 61, 66, 67, 100, 111, 300, 330, 333, 334)]
    hot = spark.createDataFrame([(5, i, n) for i, (_, n) in enumerate(lines)], "key long, id long, len int")
    met = linededup.narrower(hot)
    pairs = {(r.a, r.b) for r in met.selectExpr("key", "id AS a").join(met.selectExpr("key", "id AS b"), "key").where("a < b").collect()}
    assert {(i, j) for i, (_, n) in enumerate(lines) for j, (_, m) in enumerate(lines) if i < j and m - n <= m // 10} <= pairs
    assert (0, 9) not in pairs

    # the key's first line is unlike the others, and these share no second frequent key
    one = "quartz alone kept zebra until gate under kite quiet xylo"
    texts = {1: f"{one} mnbvc lkjhg fdsap oiuyt rewqa", 2: f"{one} mnbvc lkjhg fdsap oiuyt rewqb", 3: "nothing of this kind is in the other two lines, which are long as well"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(linededup, "HOT", 1)
    got = {r.doc_id: r.n_dropped for r in linededup.line_counts(docs).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
