"""Source divergence audit by one-hot level products.

For every language and source (a group) the terms that at least ``DOCS`` documents of the language hold are priced:
a term that the group holds c times, of N occurrences of V terms, has p = 1 + floor(SCALE (c + 1) / (N + V)), and two prices p, q
are floor((p - q)^2 / q) apart. All arithmetic is exact.

A price depends on the term by its count (its level in the group) alone. So the distance of two groups, summed over
all terms, needs only how many terms have level a in one and level b in the other. With a row for each term and an
indicator column for each (group, level), the matrix of columns times its transpose holds all these joint tables.
The product is taken in blocks of terms of like frequency (few levels) and of groups, each in one task; a block's entries are whole numbers
of at most ``TERMS``, which the product in single precision has exactly; each entry times the distance of its
two levels' prices adds up to the groups' distance. Blocks depend on the number of terms and groups only, so no task grows with the data,
and a frequent term or a large source is one row and one column as any other.

Defined results: a null text, language or source reads as ''; a group without terms has count 0 for each; a language without kept
terms has distances of 0 and no terms; extra columns are ignored; repeated rows count as often as they occur;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warmgrid.llm.common import LOWER, Stored, bounded, mix64, stored, utf8, word_hashes

DOCS, SCALE, RANKS = 3, 1_000_000_000, 200
TERMS, GROUPS, COLUMNS = 4096, 64, 1024  # of a block: terms, groups a side, indicator columns a side
READ = 1 << 23  # bytes of text that a task counts at a time

_GROUP = np.uint64(0x9FB21C651E98DF25)
_LETTER = np.ones(256, bool)
_LETTER[:128] = False
_LETTER[65:91] = _LETTER[97:123] = True


def term_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms (runs of ASCII letters and other than ASCII) of all texts, and each one's text."""
    on = np.concatenate([[False], _LETTER[data], [False]])
    # a run begins behind a byte that is none of its kind, or where a text begins
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(on[1:-1] & (~on[:-2] | cut[:-1]))
    ends = np.flatnonzero(on[1:-1] & (~on[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of ``data`` as strings."""
    size = ends - starts
    off = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.repeat(starts - off[:-1], size) + np.arange(off[-1])]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it), summed over the texts a task reads at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, limit=READ):
            data, off = utf8(b.column("text"))
            data = LOWER[data]
            starts, ends, doc = term_spans(data, off)
            names = list(zip(b.column("lang").to_pylist(), b.column("source").to_pylist()))
            kind = {name: k for k, name in enumerate(dict.fromkeys(names))}
            group = np.fromiter((kind[name] for name in names), np.int64, len(names))[doc]
            key = mix64(word_hashes(data, starts, ends) + group.astype(np.uint64) * _GROUP)
            order = np.argsort(key, kind="stable")  # texts stay in order within a key
            key, doc = key[order], doc[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            first = np.flatnonzero(new)
            fresh = new.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            n = np.diff(np.append(first, len(key)))
            in_docs = np.diff(np.append(0, np.cumsum(fresh))[np.append(first, len(key))])
            own = order[first]
            columns = [pa.array([name[i] for name in kind], pa.string()).take(pa.array(group[own])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, gathered(data, starts[own], ends[own]), pa.array(n), pa.array(in_docs)], ["lang", "source", "term", "n", "docs"])

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return named.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def price(count: Column, total: Column, kinds: Column) -> Column:
    whole = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", whole, (total + kinds).cast("decimal(20,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def joint_distances(counts: np.ndarray, prices: list) -> np.ndarray:
    """Summed distances (from, to) of all groups over the terms of ``counts`` (terms x groups).

    ``prices[g]`` gives the prices of an array of levels of group g.
    """
    groups = counts.shape[1]
    total = np.zeros((groups, groups), np.int64)
    if not groups:
        return total
    at = 0
    while at < len(counts):
        # as many rows as keep the columns of each block of groups within bounds; the fewer levels, the more rows
        rows = min(len(counts) - at, TERMS)
        while True:
            part = counts[at : at + rows]
            levels = [np.unique(part[:, g], return_inverse=True) for g in range(groups)]
            widest = max(sum(len(v) for v, _ in levels[k : k + GROUPS]) for k in range(0, groups, GROUPS))
            if widest <= max(COLUMNS, GROUPS) or rows == 1:
                break
            rows = max(1, rows // 2)
        blocks = []
        for k in range(0, groups, GROUPS):
            own = levels[k : k + GROUPS]
            edge = np.concatenate([[0], np.cumsum([len(v) for v, _ in own])])
            hot = np.zeros((rows, edge[-1]), np.float32)
            for (_, place), base in zip(own, edge):
                hot[np.arange(rows), base + place] = 1
            worth = np.concatenate([prices[k + i](v) for i, (v, _) in enumerate(own)])
            blocks.append((hot, edge[:-1], worth))
        for i, (hot, edge, p) in enumerate(blocks):
            for j, (other, cut, q) in enumerate(blocks):
                joint = (hot.T @ other).astype(np.int64)
                diff = p[:, None] - q[None, :]
                joint *= diff * diff // q[None, :]
                total[i * GROUPS : i * GROUPS + len(edge), j * GROUPS : j * GROUPS + len(cut)] += np.add.reduceat(np.add.reduceat(joint, edge, axis=0), cut, axis=1)
        at += rows
    return total


def level_prices(total: int, kinds: int):
    def of(levels: np.ndarray) -> np.ndarray:
        # whole numbers of any size; the price itself is at most SCALE + 1
        return np.array([1 + SCALE * (c + 1) // (total + kinds) for c in levels.tolist()], np.int64)

    return of


def pair_distances(terms: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, source, item and value: every two groups of a language, summed over its terms.

    ``terms``: lang, term, per (source and count where there are any); ``langs``: lang, kinds (V) and all (source and N of every group).
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).select(["lang", "kinds", "all"]).to_pylist()[0]
                place = {g["source"]: k for k, g in enumerate(row["all"])}
                per = b.column("terms").slice(k, 1).flatten().field("per")
                size = per.value_lengths().to_numpy()
                entries = per.flatten()
                coded = entries.field("source").dictionary_encode()
                known = np.array([place[name] for name in coded.dictionary.to_pylist()], np.int64)
                counts = np.zeros((len(size), len(place)), np.int64)
                counts[np.repeat(np.arange(len(size)), size), known[coded.indices.to_numpy()]] = entries.field("n").to_numpy()
                value = joint_distances(counts, [level_prices(g["total"], row["kinds"]) for g in row["all"]])
                names = list(place)
                for i, name in enumerate(names):
                    others = [j for j in range(len(names)) if j != i]
                    if others:
                        yield pa.RecordBatch.from_arrays([
                            pa.array([row["lang"]] * len(others), pa.string()), pa.array([name] * len(others), pa.string()), pa.array([names[j] for j in others], pa.string()), pa.array(value[i, others]),
                        ], ["lang", "source", "item", "value"])

    # like frequencies together; a block has at most about TERMS terms
    sized = terms.withColumn("size", F.floor(F.log2(F.aggregate("per", F.lit(0).cast("long"), lambda a, x: a + x["n"]))))
    many = sized.groupBy("lang", "size").agg(F.count(F.lit(1)).alias("terms")).select("lang", "size", F.ceil(F.col("terms") / TERMS).alias("blocks"))
    cut = sized.join(many, ["lang", "size"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    blocks = cut.groupBy("lang", "size", "block").agg(F.collect_list(F.struct("per")).alias("terms"))
    # a language without terms has a block without rows, so that its groups have their pairs
    dealt = langs.join(blocks, "lang", "left").select("lang", "kinds", "all", "terms").repartition(F.xxhash64("lang", "terms"))
    return dealt.mapInArrow(apply, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank: each group's distances to the others of its language, and its ``RANKS`` most overweight terms."""
    counted = Stored(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    per = F.collect_list(F.struct("source", "n")).alias("per")
    terms = stored(counted.df.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), per).where(F.col("docs") >= DOCS).drop("docs"), "divergence-terms")
    counted.drop()
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    each = terms.select("lang", "term", F.col("all").alias("of_lang"), F.inline("per"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    owned = stored(groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0).cast("long")).alias("total")), "divergence-groups")
    kinds = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"))
    whole = owned.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sort_array(F.collect_list(F.struct("source", "total"))).alias("all"))
    langs = stored(whole.join(kinds, "lang", "left").withColumn("kinds", F.coalesce("kinds", F.lit(0).cast("long"))), "divergence-langs")

    pairs = pair_distances(terms.select("lang", "term", "per"), langs.select("lang", "kinds", "all"))
    facts = owned.join(langs.select("lang", "kinds", "lang_total"), "lang")
    priced = each.join(facts, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), price(F.col("n"), F.col("total"), F.col("kinds")).alias("p"), price(F.col("of_lang"), F.col("lang_total"), F.col("kinds")).alias("q"))
    heavy = priced.where("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionAll(ranked(heavy, "term").where(F.col("rank") <= RANKS))
