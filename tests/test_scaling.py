"""Keyed folds that hold a site's units in one state."""

import json

import numpy as np
from pyspark.sql import functions as F

from warmgrid.operators import sequential as S
from warmgrid.streaming import jobs as J
from warmgrid.streaming.ordered import fold_states, ordered_stream
from warmgrid.streaming.run import drain

KEYS = ["site_id", "unit_id", "regime"]
SUN = KEYS + ["ts", "ps", "pe", "pw", "expected_base_kwh", "actual_kwh", "raw_impact", "min_base", "is_shutdown", "battery_s", "battery_e", "battery_w"]


def sun_rows(spark):
    d = spark.range(2 * 3 * 2 * 60).selectExpr("id % 2 AS site_id", "nullif(concat('u', id div 2 % 3), 'u2') AS unit_id", "IF(id div 6 % 2 = 0, 'heating', 'cooling') AS regime", "id div 12 AS i")
    return d.selectExpr(*KEYS, "timestamp_seconds(1704067200 + 3600 * i) AS ts", "i % 5 / 10 AS ps", "i % 3 / 10 AS pe", "i % 4 / 10 AS pw", "0.5D AS expected_base_kwh", "0.5D AS actual_kwh",
                        "IF(i % 13 = 0, 3, i % 7 / 10) + site_id / 10 AS raw_impact", "0.15D AS min_base", "i % 9 = 0 AS is_shutdown", "0.1D AS battery_s", "0.2D AS battery_e", "0.1D AS battery_w").select(*SUN)


def test_units_of_a_site_are_one_state(spark, tmp_path):
    rows = sun_rows(spark)
    rows.where("ts < timestamp'2024-01-02 12:00:00'").coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    rows.where("ts >= timestamp'2024-01-02 12:00:00'").coalesce(1).write.parquet(f"{tmp_path}/in/part=1")
    coeff = {"coeff": [0.3, 0.2, 0.1]}
    start = spark.createDataFrame([(0, "u0", "heating", json.dumps({"solar": coeff})), (0, "u1", "cooling", "{}")], "site_id long, unit_id string, regime string, doc string")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    out = drain(spark, ordered_stream(stream, KEYS, J.UnitSolarLearner(), "2 hours", start), "x", folder=f"{tmp_path}/run").toPandas()
    # one state a site, which holds the units' documents, not one a unit and regime
    states = {r["site_id"]: json.loads(r["doc"]) for r in fold_states(spark, f"{tmp_path}/run", ["site_id"]).collect()}
    names = sorted(json.dumps([u, r]) for u in ("u0", "u1", None) for r in ("heating", "cooling"))
    assert {k: sorted(doc) for k, doc in states.items()} == {0: names, 1: names}
    # and each unit's rows are those of its own fold
    edge = rows.agg(F.max("ts") - F.expr("INTERVAL 2 HOURS")).first()[0]
    pdf, seen = rows.where(F.col("ts") < F.lit(edge)).toPandas(), 0
    for key, part in pdf.groupby(KEYS, dropna=False):
        unit = key[1] if key[1] == key[1] else None
        doc = {"solar": coeff} if key == (0, "u0", "heating") else {}
        want = J.UnitSolarLearner().fold((key[0], unit, key[2]), doc, part.sort_values("ts").reset_index(drop=True))
        got = out[(out.site_id == key[0]) & (out.unit_id.isna() if unit is None else out.unit_id == unit) & (out.regime == key[2])].sort_values("ts")
        assert got[["ts", "outlier", "s", "e", "w"]].values.tolist() == want[["ts", "outlier", "s", "e", "w"]].values.tolist()
        assert states[key[0]][json.dumps([unit, key[2]])] == doc
        seen += len(got)
    assert seen == len(out) == len(pdf)


def test_spread_is_the_median_distance():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 49, 50):
        v = rng.normal(size=n).tolist()
        assert S.spread(v) == float(np.median(np.abs(np.asarray(v) - np.median(v))))
