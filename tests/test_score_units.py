"""Modes of units, and generated code between a site's packed models and its units' rows."""

import contextlib
import io

from pyspark.sql import functions as F

from warmgrid.operators import score as M


def score_tables(spark):
    hours = spark.createDataFrame([(1, "2024-01-01 10:00:00", 5.0), (1, "2024-01-01 11:00:00", 6.0), (2, "2024-01-01 10:00:00", 5.0)], "site_id long, ts string, temp double").withColumns({
        "ts": F.col("ts").cast("timestamp_ntz"), "effective_wind": F.lit(1.0), "auxiliary_active": F.lit(False), **{f"pot_{f}": F.lit(0.2) for f in "sew"}})
    modes = spark.createDataFrame([
        (1, "a", "2024-01-01 10:00:00", "off"), (1, "a", "2024-01-01 10:00:00", "cooling"), (1, None, "2024-01-01 10:00:00", "off"), (1, "b", "2024-01-01 10:00:00", None),
        (1, "b", "2024-01-01 10:00:00", "off"), (1, "b", "2024-01-01 11:00:00", "off"), (2, "z", "2024-01-01 10:00:00", "off")], "site_id long, unit_id string, ts string, mode string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    cell = "1L AS site_id, 5 AS temp_key, 'normal' AS wind_bucket, {} AS kwh, timestamp_ntz'2024-01-01 00:00:00' AS first_ts"
    site = lambda kwh: spark.range(1).selectExpr(*cell.format(kwh).split(", "))
    unit = lambda kwh: site(kwh).withColumn("unit_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    solar = spark.createDataFrame([(1, "a", "cooling", 0.1, 0.1, 0.1, 0.1, True), (1, "b", "heating", 0.2, 0.1, 0.1, 0.1, True)], "site_id long, unit_id string, regime string, s double, e double, w double, d double, learned boolean")
    units = spark.createDataFrame([(1, "a", True, True), (1, "b", True, True), (1, None, True, True)], "site_id long, unit_id string, aux_affected boolean, solar_affected boolean")
    return M.with_cell(hours).withColumn("carry_state", F.lit(0.0)), modes, M.Models(site("2.0D"), site("0.5D"), unit("1.0D"), unit("0.2D"), solar, units)


def test_modes_of_units(spark):
    u = M.score_units(*score_tables(spark), ["site_id", "ts"]).collect()
    # the least mode of a repeated unit; none, a null one or an unknown unit's heats
    assert sorted((r["site_id"], r["ts"].hour, r["unit_id"] or "", r["mode"]) for r in u) == [
        (1, 10, "", "heating"), (1, 10, "a", "cooling"), (1, 10, "b", "heating"), (1, 11, "", "heating"), (1, 11, "a", "heating"), (1, 11, "b", "off"), (2, 10, "", "heating")]
    assert {(r["site_id"], r["g_base"], r["g_aux"]) for r in u if r["ts"].hour == 10} == {(1, 2.0, 0.0), (2, 0.0, 0.0)}


def test_site_rows_are_not_copied_for_units(spark):
    """From the join with a site's packed models to the exchange, all is generated code: it hands on pointers to the arrays, not copies."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            M.score_units(*score_tables(spark), ["site_id", "ts"]).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = text.getvalue().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    top = max(i for i in range(at) if "Exchange" in lines[i])
    assert at > top + 1 and all("*(" in line for line in lines[top + 1 : at + 2])
