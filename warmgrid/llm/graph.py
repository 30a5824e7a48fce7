"""Connected components and candidate pairs of groups, without expanding groups into all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmgrid.llm.common import Stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp) of every id in ``links`` (a, b): comp is the smallest id reachable.

    Alternates the large-star and small-star steps, which keep connectivity and end in one
    star for each component; a round is stored in the shared folder, nothing is collected.
    """
    canon = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    state = Stored(canon(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "graph")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    before = mark(state.df)
    for _ in range(rounds):
        if not before[0]:
            break
        e = state.df
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = Stored(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "graph")
        large = Stored(canon(both.where("y > x").join(least.df, "x").select(F.col("y").alias("u"), F.col("m").alias("v"))), "graph")
        low = Stored(large.df.groupBy("u").agg(F.min("v").alias("m")), "graph")
        joined = large.df.join(low.df, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.df.select("u", F.col("m").alias("v")))
        after = Stored(canon(small), "graph")
        for old in (state, least, large, low):
            old.drop()
        state, now = after, mark(after.df)
        if now == before:
            break
        before = now
    e = state.df
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct()


FILTER_BITS = 22


def sift(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be in ``wanted`` (one column of that name); none that is gets lost.

    A filter of 2^FILTER_BITS hashed bits is all that is broadcast (at most 2^16 words of 64 bits),
    so a join with few wanted keys need not shuffle all rows of ``df``. A key has two bits of one word.
    """
    mixed = F.xxhash64(column, F.lit(77))
    bit = lambda at: f"shiftleft(1L, CAST(shiftrightunsigned(_x, {at}) & 63 AS int))"
    word, bits = F.pmod(F.col("_x"), F.lit(1 << FILTER_BITS - 6)), F.expr(f"{bit(40)} | {bit(50)}")
    own = wanted.select(mixed.alias("_x")).select(word.alias("_word"), bits.alias("_b"))
    words = Stored(own.groupBy("_word").agg(F.bit_or("_b").alias("_mask")), "filter")
    met = df.withColumn("_x", mixed).withColumns({"_word": word, "_b": bits}).join(F.broadcast(words.df), "_word")
    return met.where(F.col("_mask").bitwiseAND(F.col("_b")) == F.col("_b")).select(*df.columns)


def cross_pairs(rows: DataFrame, keep) -> DataFrame:
    """Distinct pairs (a < b) of the ids that share a ``key`` but not a component (see ``crossings``)."""
    return crossings(rows, keep).select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b")).distinct()


def crossings(rows: DataFrame, keep) -> DataFrame:
    """The pairs of rows, as l_ and r_ columns, that share a ``key`` but not a component; each pair once for a key.

    ``rows`` is (key, id, comp, ...). A key's most frequent component is never paired
    with itself: each pair has a member outside it, so a group that is all but one component
    costs its strays times its size. ``keep`` is a condition on the two sides' columns,
    given functions that name them.
    """
    per = Stored(rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")), "pairs")
    main = Stored(per.df.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", F.col("top.comp").alias("main")), "pairs")
    mixed = Stored(rows.join(main.df, "key"), "pairs")
    names = [c for c in rows.columns if c != "key"]
    left = mixed.df.where("comp != main").select("key", *[F.col(c).alias(f"l_{c}") for c in names])
    right = mixed.df.select("key", F.col("main"), *[F.col(c).alias(f"r_{c}") for c in names])
    # two strays meet once, a stray and a member of the main component once
    once = (F.col("r_comp") == F.col("main")) | (F.col("l_id") < F.col("r_id"))
    return left.join(right, "key").where((F.col("l_comp") != F.col("r_comp")) & once & keep(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}")))
