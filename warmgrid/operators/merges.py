"""Set operations and table merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid import constants as K
from warmgrid.functions.numeric import clamp, nz, rnd


def dedupe_hours(hours: DataFrame, seq: str) -> DataFrame:
    """Keep the first-written row of each site-hour (partial aggregation, no sort)."""
    cols = [x for x in hours.columns if x not in ("site_id", "ts")]
    return hours.groupBy("site_id", "ts").agg(F.min_by(F.struct(*cols), seq).alias("x")).select("site_id", "ts", "x.*")


def rename_unit(table: DataFrame, site: int, old: str, new: str) -> DataFrame:
    """Re-key a unit in a long table and in any unit-keyed map column.

    Where a map holds both names, numbers add up and of other values the renamed unit's stays.
    A long table may hold both names' rows afterwards; ``merge_renamed`` adds them up.
    """
    here = F.col("site_id") == site
    out = {}
    for f in table.schema.fields:
        if f.name == "unit_id":
            out[f.name] = F.when(here & (F.col("unit_id") == old), F.lit(new)).otherwise(F.col("unit_id"))
        elif f.dataType.typeName() == "map":
            number = f.dataType.valueType.typeName() in ("double", "float", "long", "integer", "decimal")
            value = nz(F.element_at(f.name, old)) + nz(F.element_at(f.name, new)) if number else F.element_at(f.name, old)
            others = F.map_filter(f.name, lambda k, v: (k != old) & (k != new))
            swapped = F.map_concat(others, F.create_map(F.lit(new), value.cast(f.dataType.valueType)))
            out[f.name] = F.when(here & F.map_contains_key(f.name, old), swapped).otherwise(F.col(f.name))
    return table.withColumns(out)


def merge_renamed(table: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows of equal keys as one: ``sums`` add up, of other columns one value stays."""
    rest = [x for x in table.columns if x not in (*keys, *sums)]
    return table.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in sums], *[F.first(x, ignorenulls=True).alias(x) for x in rest]).select(*table.columns)


def redistribute_aux(unit_aux: DataFrame, unit_base: DataFrame, removed: DataFrame, usage: DataFrame) -> DataFrame:
    """Share removed units' aux coefficients among the remaining ones of the site.

    Shares follow the remaining units' own coefficients at that cell; where none
    has one, all goes to the unit with the largest usage. Results stay below the
    unit's base cell.
    """
    cell = ["site_id", "temp_key", "wind_bucket"]
    gone = unit_aux.join(removed, ["site_id", "unit_id"], "left_semi").filter(F.col("kw") > 0)
    stay = unit_aux.join(removed, ["site_id", "unit_id"], "left_anti")
    pool = gone.groupBy(*cell).agg(F.sum("kw").alias("pool"))
    w = Window.partitionBy(*cell)
    weighted = stay.filter(F.col("kw") > 0).withColumn("_w", F.sum("kw").over(w))
    shared = weighted.join(pool, cell).select("site_id", "unit_id", "temp_key", "wind_bucket", (F.col("pool") * F.col("kw") / F.col("_w")).alias("kw"))
    rest = usage.join(removed, ["site_id", "unit_id"], "left_anti")
    primary = rest.groupBy("site_id").agg(F.max_by("unit_id", F.struct("kwh", "unit_id")).alias("unit_id"))
    orphan = pool.join(weighted.select(*cell).distinct(), cell, "left_anti").join(primary, "site_id").select(
        "site_id", "unit_id", "temp_key", "wind_bucket", F.col("pool").alias("kw"))
    add = shared.unionByName(orphan).groupBy("unit_id", *cell).agg(F.sum("kw").alias("add_kw"))
    key = ["unit_id", *cell]
    base = unit_base.select(*key, F.col("kwh").alias("cap"))
    j = stay.select(*key, "kw").join(add, key, "full").join(base, key, "left")
    total = nz("kw") + nz("add_kw")
    capped = F.when(F.col("add_kw").isNotNull(), F.least(total, F.coalesce("cap", total))).otherwise(total)
    return j.select(*key, rnd(capped, 3).alias("kw"))


def drop_units(model: DataFrame, victims: DataFrame) -> DataFrame:
    return model.join(victims, ["site_id", "unit_id"], "left_anti")


def reset_model(model: DataFrame, site: int | None = None, unit: str | None = None, regime: str | None = None) -> DataFrame:
    """Forget a scope of learned rows; an omitted filter widens the scope."""
    hit = F.lit(True)
    for name, value in (("site_id", site), ("unit_id", unit), ("regime", regime)):
        if value is not None:
            hit = hit & (F.col(name) == value)
    return model.filter(~hit)


def normalize_legacy(raw: DataFrame) -> DataFrame:
    """Older daily rows to the canonical shape: renamed fields and string numbers.

    Reads whichever of the known names exist, so files of mixed age can be read
    together with schema merging.
    """
    have = set(raw.columns)

    def pick(*names: str) -> Column:
        found = [F.expr(f"try_cast({n} AS DOUBLE)") for n in names if n in have]
        return F.coalesce(*found) if found else F.lit(None).cast("double")

    return raw.select(
        "site_id", "local_date",
        pick("kwh", "load", "energy").alias("kwh"), pick("tdd", "hdd").alias("tdd"),
        pick("temp", "temperature").alias("temp"), pick("wind", "wind_speed").alias("wind"),
        pick("solar_factor", "solar").alias("solar_factor"), F.coalesce(pick("aux_impact_kwh", "aux_kwh"), F.lit(0.0)).alias("aux_impact_kwh"))


def stratify_coefficients(raw: DataFrame) -> DataFrame:
    """Scalar or flat coefficients to one row per regime.

    A lone scalar is a south coefficient; flat vectors seed the heating regime and
    the cooling regime starts at its default, unlearned.
    """
    s = F.coalesce("s", "scalar")
    flat = raw.select("site_id", "unit_id", nz(s).alias("s"), nz("e").alias("e"), nz("w").alias("w"))
    rows = F.array(
        F.struct(F.lit("heating").alias("regime"), F.col("s").alias("s"), F.col("e").alias("e"), F.col("w").alias("w"),
                 ((F.col("s") + F.col("e") + F.col("w")) > 0).alias("learned")),
        F.struct(F.lit("cooling").alias("regime"), F.lit(K.SOLAR_COEFF_COOLING).alias("s"), F.lit(0.0).alias("e"),
                 F.lit(0.0).alias("w"), F.lit(False).alias("learned")))
    return flat.select("site_id", "unit_id", F.explode(rows).alias("r")).select("site_id", "unit_id", "r.*")


def merge_model(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], alpha: float = K.BATCH_FIT_DAMPING,
                cap: float = K.SOLAR_COEFF_CAP) -> DataFrame:
    """Damped blend of fitted into stored coefficients; written directly where no prior exists."""
    j = old.select(*keys, *[F.col(x).alias(f"_o_{x}") for x in cols]).join(
        new.select(*keys, F.lit(True).alias("_n"), *[F.col(x).alias(f"_n_{x}") for x in cols]), keys, "full")
    prior = F.lit(False)
    for x in cols:
        prior = prior | (nz(f"_o_{x}") > 1e-6)
    out = []
    for x in cols:
        fit = clamp(nz(f"_n_{x}"), 0.0, cap)
        blend = F.when(prior, alpha * fit + (1 - alpha) * nz(f"_o_{x}")).otherwise(fit)
        out.append(rnd(F.when(F.col("_n"), blend).otherwise(F.col(f"_o_{x}")), 5).alias(x))
    return j.select(*keys, *out, prior.alias("had_prior"))
