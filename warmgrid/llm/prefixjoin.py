"""N-gram Jaccard join by rare-first prefix filtering.

A document's set holds its distinct three-word shingles; equal sets are one class and only classes are joined.
All sets are put in one order, rare shingles first. Which shingles are common is counted over all
documents with a mergeable summary (Misra-Gries) of bounded size: whatever makes up more than a
``1 / EMITTED`` part of all shingles is sure to be known with its count; the rest counts as rare and follows its hash.
Any order gives the same result, a better one only fewer candidates.

Two sets that reach the similarity share one of their first shingles: the larger one's first
``n - ceil(s n) + 1`` and the smaller one's first ``n - ceil(2 s n / (1 + s)) + 1``. Documents are joined on these
shingles, and a pair goes on only if

* length: the smaller set is at least ``s`` of the larger;
* position: what follows the shared shingle in both sets suffices for the overlap that the similarity asks for
  (true for the first shared one of every pair that reaches it, under which the pair is found);
* suffix: the sets' counts in fixed ranges of hashes (``BINS``, and more for larger sets, about ``PER_BIN`` shingles each) differ by no more
  than the symmetric difference the similarity allows.

Each pair left is verified once, on the full sets. A shingle's list is cut into classes of size (``by_size``), whatever its length,
which loses no pair; a class of up to ``FEW`` documents meets as pairs. More are never paired
with each other while they may yet be found connected: they are held first against the one with the fewest rarer
shingles (the text the others were made from, if there is one), then against one chosen by hash, and only documents
of different components of the links so found meet as pairs. So a group of copies costs its size, and no
link between components is lost.

Defined results: a document without words has an empty set and links with nothing; a null id can't be linked (its
component is null); rows that repeat an id are one document, linked to whatever either text
is linked to; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmgrid.llm.chosenpath import shingles
from warmgrid.llm.common import Stored, bounded, mix64, stored, utf8
from warmgrid.llm.graph import components, cross_pairs, sift

WORDS, PERCENT = 3, 90
HELD, EMITTED = 1 << 18, 1 << 16  # counters of the summary: while a task counts, and what it returns
READ = 1 << 20  # bytes of text that a task holds sets of at a time
COMMON = 1 << 18  # the commonest shingles, broadcast: 12 bytes each
BINS, PER_BIN = 64, 8
FEW = 16  # documents of a shingle that meet as pairs at once
_OTHER = np.uint64(0xA24BAED4963EE407)


def distinct_sets(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, ascending, and the number of the text that each belongs to."""
    s, bounds = shingles(*utf8(text), WORDS)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[new], doc[new]


# -- the order ------------------------------------------------------------------------


def summarise(items: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Equal items summed; beyond ``size`` of them, all counts lose the count of the first one too many."""
    order = np.argsort(items)
    items = items[order]
    first = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])[: len(items)])
    kinds, total = items[first], np.add.reduceat(counts[order], first) if len(first) else counts
    if len(kinds) > size:
        total = total - np.partition(total, len(total) - size - 1)[len(total) - size - 1]
        kinds, total = kinds[total > 0], total[total > 0]
    return kinds, total


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``COMMON`` shingle hashes, ascending, and the counts known of them (of documents that hold them)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        for b in bounded(batches, limit=READ):
            held.append(distinct_sets(b.column("text"))[0])
            if sum(map(len, held)) > HELD:
                kinds, total = summarise(np.concatenate([kinds, *held]), np.concatenate([total, np.ones(sum(map(len, held)), np.int64)]), HELD)
                held = []
        kinds, total = summarise(np.concatenate([kinds, *held]), np.concatenate([total, np.ones(sum(map(len, held)), np.int64)]), EMITTED)
        yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(total)], ["item", "n"])

    counted = docs.select("text").mapInArrow(count, "item long, n long").groupBy("item").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "item").limit(COMMON).toArrow()
    items, n = top.column("item").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(items)
    return items[order], n[order]


def profiles(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], percent: int) -> DataFrame:
    """doc_id, n, k1 and k2 (a 128-bit key of the set), first (the set's prefix, rare first), bins and coarse (``BINS`` of them) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((common[0], common[1].astype(np.uint32)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, counts = sent.value
        for b in bounded(batches, limit=READ):
            s, doc = distinct_sets(b.column("text"))
            n = np.bincount(doc, minlength=b.num_rows)
            ends = np.cumsum(n)
            k1, k2 = (np.concatenate([[np.uint64(0)], np.cumsum(mix64(x))]) for x in (s, s * _OTHER))
            width = np.maximum(np.ceil(np.log2(np.maximum(n, 1) / PER_BIN)), np.log2(BINS)).astype(np.int64)
            edge = np.concatenate([[0], np.cumsum(1 << width)])
            bins = np.bincount(edge[doc] + (s >> (64 - width[doc]).astype(np.uint64)).astype(np.int64), minlength=edge[-1]).astype(np.uint8)
            coarse = np.bincount(doc * BINS + (s >> np.uint64(64 - int(np.log2(BINS)))).astype(np.int64), minlength=b.num_rows * BINS)
            seen = np.zeros(len(s), np.uint32)
            if len(items):
                at = np.minimum(np.searchsorted(items, s), len(items) - 1)
                seen = np.where(items[at] == s, counts[at], 0)
            ranked = s[np.lexsort((s, seen, doc))]
            length = np.where(n > 0, n + -percent * n // 100 + 1, 0)
            at = np.repeat(ends - n, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ranked[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array((k1[ends] - k1[ends - n]).view(np.int64)), pa.array((k2[ends] - k2[ends - n]).view(np.int64)),
                first, pa.array([bins[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BINS), pa.array(coarse.astype(np.int32))),
            ], ["doc_id", "n", "k1", "k2", "first", "bins", "coarse"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n long, k1 long, k2 long, first array<long>, bins binary, coarse array<int>")


# -- candidates and links -------------------------------------------------------------


def needed(percent: int, n: Column, m: Column) -> Column:
    """The overlap that sets of n and m items need."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def leads(percent: int, n: Column, pos: Column) -> Column:
    """Whether a shingle at ``pos`` is among the first that the smaller set of a pair, of n items, needs."""
    return pos <= n - F.ceil(2 * percent * n / F.lit(100 + percent))


def may_link(percent: int):
    """The length and position filters on the two sides of a shared shingle; sides name (id, n, pos)."""

    def keep(left, right) -> Column:
        small = (left("n") < right("n")) | ((left("n") == right("n")) & (left("id") < right("id")))
        n, m = F.least(left("n"), right("n")), F.greatest(left("n"), right("n"))
        spot = F.when(small, left("pos")).otherwise(right("pos"))
        rest = F.least(left("n") - left("pos"), right("n") - right("pos"))
        return (100 * n >= percent * m) & leads(percent, n, spot) & (rest >= needed(percent, n, m))

    return keep


def by_size(rows: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, pos, leads, own) under keys that hold a class of sizes, too: each pair that ``may_link`` keeps shares one.

    A row is in its own size's class; one that may be the smaller of a pair is in the next class, too, since sizes
    that link are in the same class or in adjoining ones (a class is a little wider than the length filter).
    """
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(-1.001 * math.log(percent / 100), 1e-9)))
    placed = rows.withColumns({"leads": leads(percent, F.col("n"), F.col("pos")), "class": own})
    dealt = placed.select("*", F.explode(F.when(F.col("leads"), F.array(F.col("class"), F.col("class") + 1)).otherwise(F.array("class"))).alias("at"))
    return dealt.select(F.xxhash64("key", "at").alias("key"), "id", "n", "pos", "leads", (F.col("at") == F.col("class")).alias("own"))


def coarse_may_link(percent: int):
    """``may_link`` and the suffix filter on the coarse bins of the two sides, for many documents of one shingle."""
    keep = may_link(percent)

    def both(left, right) -> Column:
        apart = F.aggregate(F.zip_with(left("coarse"), right("coarse"), lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda total, d: total + d)
        return keep(left, right) & (apart <= left("n") + right("n") - 2 * needed(percent, left("n"), right("n")))

    return both


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the symmetric difference of two sets from their bins, counts modulo 256."""
    bins = min(len(x), len(y))
    x, y = (z.reshape(bins, -1).sum(axis=1, dtype=np.uint8) for z in (x, y))
    return int(np.minimum(x - y, y - x).sum(dtype=np.int64))


def suffix_filter(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bins differ by no more than the similarity allows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(z.as_buffer(), np.uint8) for z in b.column(c)] for c in ("x", "y"))
            apart = np.array([least_difference(*z) for z in zip(x, y)], np.int64)
            both = b.column("n").to_numpy() + b.column("m").to_numpy()
            keep = pa.array(apart <= both - 2 * -(-percent * both // (100 + percent)))
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    ids = stored(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "prefix-ids")
    some = Stored(sift(reps, "id", ids), "prefix-bins")
    side = lambda id_, n, bins: some.df.select(F.col("id").alias(id_), F.col("n").alias(n), F.col("bins").alias(bins))
    joined = pairs.join(side("b", "m", "y"), "b").join(side("a", "n", "x"), "a")
    # ids with several texts have several sets: a pair stays if any two of them may link
    near = stored(joined.select("a", "b", "n", "m", "x", "y").mapInArrow(apply, "a long, b long").distinct(), "prefix-near")
    some.drop()
    return near


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity (a stored table)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, limit=READ):
            s, doc = distinct_sets(b.column("text"))
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary())], ["id", "items"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), max(len(q) - 1, 0))
                inter = int((q[at] == p).sum()) if len(q) else 0
                ok.append(inter > 0 and 100 * inter >= percent * (len(p) + len(q) - inter))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    ids = stored(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "prefix-ids")
    texts = sift(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), "id", ids).join(ids, "id", "left_semi")
    own = Stored(texts.mapInArrow(sets, "id long, items binary").where(F.octet_length("items") > 0), "prefix-sets")
    side = lambda id_, name: own.df.select(F.col("id").alias(id_), F.col("items").alias(name))
    met = pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "x", "y")
    links = stored(met.mapInArrow(compare, "a long, b long").distinct(), "prefix-links")
    own.drop()
    return links


def jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links of that similarity) of every row."""
    docs = docs.select("doc_id", "text")
    own = Stored(profiles(docs, common_shingles(docs), percent), "prefix-profiles")
    some = own.df.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    keys = ["n", "k1", "k2"]
    # prefix and bins follow from the set, so any member's serve its class
    classes = stored(some.groupBy(*keys).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("first").alias("first"), F.first("bins").alias("bins")), "prefix-classes")
    members = some.select("doc_id", *keys).join(classes.where("size > 1").select(*keys, "id"), keys)
    links = stored(members.where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "prefix-copies")

    reps, keep = classes.select("id", "n", "bins"), may_link(percent)
    posted = Stored(classes.select("id", "n", F.posexplode("first").alias("pos", "key")), "prefix-posted")
    # every list is cut, so that rows grow with the postings and not with the lists that pass a bound; what is left of
    # it is a list only with a document that may be the smaller of a pair and one that may be the larger
    dealt = by_size(posted.df, percent)
    sized = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("leads").alias("leads"), F.max("own").alias("own")).where("size > 1 AND leads AND own")
    parts = stored(sized.select("key", "size"), "prefix-parts")
    split = Stored(sift(dealt, "key", parts.select("key")).join(parts, "key").select("key", "id", "n", "pos", "own", "size"), "prefix-split")
    few = split.df.where(F.col("size") <= FEW)
    listed = few.groupBy("key").agg(F.collect_list(F.struct("id", "n", "pos", "own")).alias("all"))
    # documents of one class meet in their own, not again in the next one
    met = listed.select("all", F.explode(F.filter("all", lambda x: x["own"])).alias("l")).select("l", F.explode("all").alias("r")).where("IF(r.own, l.id < r.id, l.id != r.id)")
    near = met.where(keep(lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"))).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    check = lambda pairs: verified(suffix_filter(stored(pairs, "prefix-pairs"), reps, percent), docs, percent)

    links = stored(links.unionAll(check(near)), "prefix-links")
    rows = stored(split.df.where(F.col("size") > FEW).select("key", "id", "n", "pos"), "prefix-rows")
    for old in (posted, split):
        old.drop()
    open_ = rows
    for chosen in (F.col("pos"), F.lit(0)):
        pick = F.min(F.struct(chosen.alias("p"), F.xxhash64("key", "id", F.lit(5)).alias("o"), "id", "n", "pos")).alias("pivot")
        pivots = stored(open_.groupBy("key").agg(pick).select("key", *[F.col(f"pivot.{c}").alias(f"p_{c}") for c in ("id", "n", "pos")]), "prefix-pivots")
        held = open_.join(pivots, "key").where((F.col("id") != F.col("p_id")) & keep(F.col, lambda c: F.col(f"p_{c}")))
        links = stored(links.unionAll(check(held.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct())), "prefix-links")
        comp = stored(components(links), "prefix-comps")
        named = stored(open_.select("key", "id", "n", "pos").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), "n", "pos"), "prefix-named")
        left = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        open_ = named.join(stored(left, "prefix-open"), "key")
    # what is left of a shingle is paired under all filters at once, so that a large group returns few pairs
    ids = stored(open_.select("id").distinct(), "prefix-ids")
    coarse = stored(sift(some.select(F.col("doc_id").alias("id"), "coarse"), "id", ids).join(ids, "id").distinct(), "prefix-coarse")
    links = stored(links.unionAll(check(cross_pairs(open_.join(coarse, "id"), coarse_may_link(percent)))), "prefix-links")
    final = stored(components(links), "prefix-final").withColumnRenamed("id", "doc_id")
    answer = own.df.select("doc_id", "n").join(final, "doc_id", "left")
    return answer.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))
