"""Ordered scans that split long keys into calendar blocks.

A recurrence ``state = a * state + b`` composes associatively, so it is scanned
hour-in-day, day-in-month and month-in-key. No task ever holds more than one
day of rows, one month of day summaries, or one key's month summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid.functions.numeric import c


def _fold(arr: Column, width: int) -> Column:
    """Compose a list of affine steps (shared ``a``, vector ``b``), oldest first."""
    one = F.struct(F.lit(1.0).alias("a"), F.array(*[F.lit(0.0)] * width).alias("b"))
    return F.aggregate(arr, one, lambda s, x: F.struct(
        (x["a"] * s["a"]).alias("a"), F.zip_with(s["b"], x["b"], lambda p, q: x["a"] * p + q).alias("b")))


def _after(step: Column, state: Column) -> Column:
    """State vector after one composed step."""
    return F.zip_with(state, step["b"], lambda p, q: step["a"] * p + q)


def affine_scan(df: DataFrame, keys: list[str], ts: str, a, outs: dict[str, Column]) -> DataFrame:
    """Add each ``out`` = state after every row of ``state = a * state + b`` from zero, by ``ts``.

    ``outs`` maps an output name to its ``b``; all of them share ``a`` and one scan.
    """
    k = len(outs)
    first = Window.unboundedPreceding
    step = F.struct(c(a).cast("double").alias("a"), F.array(*[c(b).cast("double") for b in outs.values()]).alias("b"))
    d = df.withColumns({"_day": F.col(ts).cast("date"), "_step": step})
    by_day = Window.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(first, 0)
    d = d.withColumn("_in", _fold(F.collect_list("_step").over(by_day), k))
    days = d.groupBy(*keys, "_day").agg(F.max_by("_in", ts).alias("_d")).withColumn("_month", F.trunc("_day", "month"))
    prior_days = Window.partitionBy(*keys, "_month").orderBy("_day").rowsBetween(first, -1)
    days = days.withColumn("_dp", _fold(F.collect_list("_d").over(prior_days), k))
    whole = F.struct((F.col("_d.a") * F.col("_dp.a")).alias("a"), _after(F.col("_d"), F.col("_dp.b")).alias("b"))
    months = days.groupBy(*keys, "_month").agg(F.max_by(whole, "_day").alias("_m"))
    prior_months = Window.partitionBy(*keys).orderBy("_month").rowsBetween(first, -1)
    months = months.select(*keys, "_month", _fold(F.collect_list("_m").over(prior_months), k)["b"].alias("_s"))
    days = days.join(months, [*keys, "_month"]).select(*keys, "_day", _after(F.col("_dp"), F.col("_s")).alias("_s"))
    d = d.join(days, [*keys, "_day"]).withColumn("_out", _after(F.col("_in"), F.col("_s")))
    return d.withColumns({n: F.col("_out")[i] for i, n in enumerate(outs)}).drop("_day", "_step", "_in", "_s", "_out")


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], fields: list[str], init: Column, step) -> DataFrame:
    """Fold each key's rows in order; ``step(state, row)`` is a column expression.

    For recurrences that round or branch at every step and so cannot be split.
    Use it only where a key holds one row per calendar hour or day.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, *fields)))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, F.aggregate("_rows", init, step).alias("state"))


def previous_row(df: DataFrame, keys: list[str], ts: str, order: list[str], cols: list[str], out: str, block: str = "hour") -> DataFrame:
    """Add ``out`` = struct of ``cols`` of the preceding row, scanning time blocks of a key.

    Rows are ordered inside one block; the last row of each block is carried forward
    over blocks, whose number is bounded by the calendar, not by the number of
    readings. A finer ``block`` splits a hotter key.
    """
    picked = F.struct(*cols)
    d = df.withColumn("_hr", F.date_trunc(block, ts))
    d = d.withColumn("_prev", F.lag(picked).over(Window.partitionBy(*keys, "_hr").orderBy(*order)))
    heads = d.groupBy(*keys, "_hr").agg(F.max_by(picked, F.struct(*order)).alias("_last"))
    heads = heads.select(*keys, "_hr", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_hr")).alias("_carry"))
    d = d.join(heads, [*keys, "_hr"])
    return d.withColumn(out, F.coalesce("_prev", "_carry")).drop("_hr", "_prev", "_carry")
