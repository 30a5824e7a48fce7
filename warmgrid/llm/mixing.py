"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Document rates minimise the relative entropy to one copy each, subject to every source's token
target and to ``cap`` copies at most. The dual has one multiplier for each source; the rates are
``min(cap, exp(multiplier * size / mean size))``, so few documents change much. Newton
steps on the logarithm of a source's tokens, kept inside a bracket, run for all sources at
once over counts of documents by (source, size): gradient and curvature are one aggregation a step.

Rates become copies in two ways. A document of more than a thousandth of its source is one of
at most a thousand such; they are taken from the largest down, each with the number of copies that
leaves the smallest remainder. All others are dealt by a hash into windows of about
``WINDOW`` rows, sorted by size, where the running sum of rates is cut at whole numbers.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; rows
that repeat id, source and size get equal copies; a document of size 0 gets one copy and takes
nothing; an empty table gives an empty result; extra columns pass through ``apply``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from warmgrid.llm.common import WORD, Stored, aside, stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
WINDOW = 4096
LARGE = 1000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (number of words) of every row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """skey, source, source_size, n and target of every source.

    All targets together are all tokens; a target above ``cap`` times its source stops there and
    the excess is shared again by weight, until no target is above. One row a source is all
    that meets in the ordering.
    """
    per = _key(sizes).groupBy("skey", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = stored(per.withColumn("weight", weight), "mix-sources")
    bound = F.col("source_size") * float(cap)
    total, share = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / share if share else 0.0
    while True:
        full = F.col("weight") * level >= bound
        filled, free = rows.agg(F.sum(F.when(full, bound).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not free or (higher := (total - filled) / free) <= level * (1 + 1e-15):
            break
        level = higher
    return rows.select("skey", "source", "source_size", "n", F.least(F.col("weight") * level, bound).alias("target"))


def balance(sizes: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-7, steps: int = 60) -> DataFrame:
    """skey and multiplier of every source, by safeguarded Newton steps for all sources at once."""
    cells = stored(_key(sizes).where(F.col("size") > 0).groupBy("skey", "size").agg(F.count(F.lit(1)).cast("double").alias("k")), "mix-cells")
    top = math.log(cap)
    # means over documents that have tokens, so that the highest multiplier fills even a one-word document
    mean = cells.groupBy("skey").agg((F.sum(F.col("k") * F.col("size")) / F.sum("k")).alias("mean"))
    start = goals.where((F.col("source_size") > 0) & (F.col("target") > 0)).join(mean, "skey").select(
        "skey", "mean", "target", F.least(F.log(F.col("target") / F.col("source_size")), F.lit(top)).alias("lam"),
        (-60.0 * F.col("mean")).alias("low"), (top * F.col("mean")).alias("high"), F.lit(1.0).alias("gap"))
    state = Stored(start, "mix-dual")
    x = F.col("lam") * F.col("size") / F.col("mean")
    rate, open_ = F.exp(F.least(x, F.lit(top))), x < top
    for _ in range(steps):
        sums = cells.join(state.df, "skey").groupBy("skey", "mean", "target", "lam", "low", "high").agg(
            F.sum(F.col("k") * F.col("size") * rate).alias("got"),
            F.sum(F.when(open_, F.col("k") * F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)).alias("slope"))
        over = F.col("got") > F.col("target")
        bracket = sums.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("lam")), "high": F.when(over, F.col("lam")).otherwise(F.col("high"))})
        newton = F.col("lam") - (F.log("got") - F.log("target")) * F.col("got") / F.nullif(F.col("slope"), F.lit(0.0))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        gap = F.abs(F.col("got") / F.col("target") - 1)
        moved = F.when(gap <= tolerance, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        after = Stored(bracket.select("skey", "mean", "target", moved.alias("lam"), "low", "high", gap.alias("gap")), "mix-dual")
        state.drop()
        state = after
        worst = state.df.agg(F.max("gap")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state.df.select("skey", "mean", "lam")


def copies(sizes: DataFrame, goals: DataFrame, dual: DataFrame, cap: int = CAP) -> DataFrame:
    """doc_id, source, size and copies, one row for each distinct (doc_id, source, size)."""
    items = _key(sizes).groupBy("doc_id", "source", "skey", "size").agg(F.count(F.lit(1)).alias("rows"))
    known = items.join(goals.select("skey", "source_size", "n", "target"), "skey").join(dual, "skey", "left")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(F.exp(F.least(F.coalesce("lam", F.lit(0.0)) * F.col("size") / F.col("mean"), F.lit(math.log(cap)))))
    rated = known.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("weight", F.col("size") * F.col("rows"))
    large = F.col("weight") * LARGE > F.col("source_size")
    # at most LARGE documents of a source hold more than a thousandth of it each
    heads = rated.where(large & (F.col("size") > 0)).groupBy("skey").agg(F.sort_array(F.collect_list(F.struct("weight", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("order"), "rate", "doc_id", "source", "size")), asc=False).alias("docs"))
    best = lambda acc, d: F.greatest(F.lit(0), F.least(F.lit(cap), F.floor(d["rate"] + acc["rest"] / d["weight"] + 0.5))).cast("int")
    taken = F.aggregate("docs", F.struct(F.lit(0.0).alias("rest"), F.array().cast("array<int>").alias("got")), lambda acc, d: F.struct(
        (acc["rest"] + (d["rate"] - best(acc, d)) * d["weight"]).alias("rest"), F.concat(acc["got"], F.array(best(acc, d))).alias("got")), lambda acc: acc["got"])
    pairs = heads.select(F.inline(F.zip_with("docs", taken, lambda d, c: F.struct(d["doc_id"].alias("doc_id"), d["source"].alias("source"), d["size"].alias("size"), c.alias("copies")))))
    # the rest, in windows of bounded size
    part = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.ceil(F.col("n") / WINDOW))
    order = Window.partitionBy("skey", "part").orderBy(F.desc("size"), F.xxhash64("doc_id", F.lit(9)), F.asc_nulls_last("doc_id"))
    before = Window.partitionBy("skey", "part").orderBy(F.desc("size"), F.xxhash64("doc_id", F.lit(9)), F.asc_nulls_last("doc_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = F.pmod(F.col("part") * 0.6180339887498949 + 0.5, F.lit(1.0))
    rest = rated.where(~large | (F.col("size") == 0)).withColumn("part", part)
    run = rest.withColumn("upto", F.sum("rate").over(before) + shift).withColumn("from", F.coalesce(F.lag("upto").over(order), shift))
    small = run.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.least(F.lit(cap), F.floor(F.col("upto") + 1e-9) - F.floor(F.col("from") + 1e-9))).cast("int"))
    return pairs.unionByName(small.select("doc_id", "source", "size", "copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes of all rows, targets of the sources, copies of the documents), each a stored table."""
    sizes = stored(sized(docs), "mix-sizes")
    goals = stored(targets(sizes, weights, cap), "mix-targets")
    return sizes, goals, stored(copies(sizes, goals, balance(sizes, goals, cap), cap), "mix-copies")


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])


def shares(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    sizes, goals, chosen = mix(docs, weights, cap)
    rows = sizes.join(chosen, _same(sizes, chosen)).select(sizes["doc_id"], sizes["source"], sizes["size"], "copies")
    out = _key(rows).join(goals.select("skey", "source_size", "target"), "skey")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixed documents: every row as often as it has copies."""
    _, _, chosen = mix(docs, weights, cap)
    plain, back = aside(docs, "doc_id", "text", "source")
    counted = plain.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    some = chosen.where(F.col("copies") > 0)
    pick = counted["doc_id"].eqNullSafe(some["doc_id"]) & counted["source"].eqNullSafe(some["source"]) & (counted["_size"] == some["size"])
    joined = counted.join(some, pick).select(*[counted[c] for c in plain.columns], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return joined.select(*back)
