"""Near-duplicates by a chosen-path similarity join on word shingles.

A document's set holds its distinct five-word shingles; its signature holds, for each of
64 hash functions, the least hash (a minwise token). Equal sets are one class, and only class
representatives go on. In each of several independent trees a node selects two of
the 64 positions by a hash of its path and branches its documents by their tokens there. Two sets of
similarity s stay together along at least one branch with the survival probability of a branching
process with mean 2 s, so one tree loses ((1 - s) / s)^2 of the pairs however deep it is (3 in 100 at
0.85, 6 in 100 at 0.8), and as many trees are taken as lose one in a million; higher similarities are safer.

A node of at most ``SMALL`` documents and ``WEIGHT`` shingles is compared exhaustively inside one task, first on signatures
(pairs more than five deviations below the threshold are passed over), then, for the clusters that
remain, on the full sets; a cluster returns the links of a spanning forest, so its output is
linear in its size. A larger node first holds its documents against one of them, chosen by
hash; if the confirmed links make it one component it is done, else it branches. At the last
level a node that is still large is compared in blocks, each pair of blocks being a node.

Defined results: a document without words has an empty set and links with nothing; a null id
cannot be linked (its component is null and it is kept); rows that repeat an id are one document,
linked to whatever either text is linked to; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmgrid.llm.common import LOWER, Stored, bounded, mix64, stored, utf8, word_hashes, words_of
from warmgrid.llm.graph import components

WORDS = 5
POSITIONS, BRANCHES = 64, 2
SMALL, WEIGHT, DEPTH = 4096, 3_000_000, 5  # documents and shingles of a node that one task compares

_RNG = np.random.default_rng(11)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_MUL = _RNG.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0xD6E8FEB86659FD93)


def trees_for(percent: int) -> int:
    """Trees that together lose at most one in a million pairs of that similarity."""
    lost = ((100 - percent) / percent) ** 2
    trees = 1 if not lost else max(1, math.ceil(math.log(1e-6) / math.log(lost))) if lost < 1 else POSITIONS
    if trees * BRANCHES > POSITIONS:
        raise ValueError(f"a similarity of {percent} percent is too low for {POSITIONS} positions")
    return trees


def agree_for(percent: int) -> int:
    """Equal tokens of ``POSITIONS`` that pairs of that similarity have, less five deviations (40 at 85, 35 at 80)."""
    s = percent / 100
    return math.floor(POSITIONS * s - 5 * math.sqrt(POSITIONS * s * (1 - s)))


def shingles(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts in order, and n + 1 offsets."""
    data = LOWER[data]
    starts, ends, first = words_of(data, off)
    h = word_hashes(data, starts, ends)
    count = np.diff(first)
    per = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(bounds[-1], np.uint64)
    full = np.flatnonzero(count >= words)
    if len(full):
        n = per[full]
        at = np.repeat(first[full], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        total = np.zeros(len(at), np.uint64)
        for j in range(words):
            total += h[at + j] * _PLACE[j]
        out[np.repeat(bounds[full], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = mix64(total)
    for d in np.flatnonzero((count > 0) & (count < words)):
        own = h[first[d] : first[d + 1]]
        out[bounds[d]] = mix64((own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.array([len(own)], np.uint64) * _SHORT)[0]
    return out, bounds


def minwise(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least hash of each non-empty set for each position: (sets, POSITIONS) of 32 bits."""
    some = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, POSITIONS), np.uint32)
    if len(some):
        for p in range(POSITIONS):
            out[some, p] = np.minimum.reduceat((((s ^ _XOR[p]) * _MUL[p]) >> np.uint64(32)).astype(np.uint32), bounds[some])
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), k1 and k2 (a 128-bit key of the set) and sig of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            s, bounds = shingles(*utf8(b.column("text")))
            sig = minwise(s, bounds)
            n, k1, k2 = (np.zeros(b.num_rows, t) for t in (np.int64, np.uint64, np.uint64))
            for d in range(b.num_rows):
                own = np.unique(s[bounds[d] : bounds[d + 1]])
                n[d] = len(own)
                if len(own):
                    k1[d], k2[d] = mix64(own).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(own * _SHORT))
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array([r.tobytes() for r in sig.astype(">u4")], pa.binary()),
            ], ["doc_id", "n", "k1", "k2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id long, n long, k1 long, k2 long, sig binary")


def _token(position: Column) -> Column:
    return F.substring(F.col("sig"), position * 4 + 1, F.lit(4))


def first_nodes(reps: DataFrame, trees: int) -> DataFrame:
    """(key, id, n): the roots' branches, trees x BRANCHES different positions."""
    keys = F.array(*[F.xxhash64(F.lit(p), _token(F.lit(p))) for p in range(trees * BRANCHES)])
    return reps.select(F.explode(keys).alias("key"), "id", "n")


def next_nodes(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Each node's documents branched at the positions a hash of its path selects."""
    one = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(POSITIONS)).cast("int")
    two = F.pmod(one + 1 + F.pmod(F.xxhash64("key", F.lit(2)), F.lit(POSITIONS - 1)).cast("int"), F.lit(POSITIONS))
    keys = F.array(*[F.xxhash64("key", p, _token(p)) for p in (one, two)])
    return rows.join(reps.select("id", "n", "sig"), "id").select(F.explode(keys).alias("key"), "id", "n")


def in_blocks(rows: DataFrame, small: int) -> DataFrame:
    """(key, id): large nodes (key, id, size, weight) cut into blocks of about half what a task compares, a node for each pair of blocks."""
    blocks = F.ceil(F.greatest(F.col("size") / small, F.col("weight") / WEIGHT) * 2)
    own = F.pmod(F.xxhash64("id", F.lit(4)), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    met = rows.select("key", "id", own.alias("own"), other.alias("other"))
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id")


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows of equal keys, one table each, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), b.num_rows]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if held and held[-1].column(key)[0] != b.column(key)[i]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def clusters(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(cluster, id): the documents of each small node (key, id) that signatures can't keep apart.

    The cluster's name is a hash of its members, so the same cluster found in several nodes is one.
    """
    agree = agree_for(percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids = [], []
        for t in grouped(batches, "key"):
            own = t.column("id").to_numpy()
            if len(own) < 2:
                continue
            size = t.column("n").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(own), POSITIONS)
            forest = Forest(len(own))
            for i in range(len(own) - 1):
                near = (sig[i + 1 :] == sig[i]).sum(axis=1) >= agree
                near &= 100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i])
                for j in np.flatnonzero(near).tolist():
                    forest.join(i, i + 1 + j)
            root = np.array([forest.find(i) for i in range(len(own))])
            for r in np.flatnonzero(np.bincount(root) > 1).tolist():
                members = np.unique(own[root == r])
                if len(members) > 1:
                    name = mix64(members.view(np.uint64) * _SHORT).sum(dtype=np.uint64, keepdims=True) ^ np.bitwise_xor.reduce(mix64(members.view(np.uint64)))
                    names.append(np.repeat(name.view(np.int64), len(members)))
                    ids.append(members)
            if sum(map(len, ids)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(ids))], ["cluster", "id"])
                names, ids = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(ids))], ["cluster", "id"])

    dealt = rows.join(reps, "id").select("key", "id", "n", "sig").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(compare, "cluster long, id long").distinct()


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items): the full sets of the documents in ``ids``; a repeated id has one for each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            s, bounds = shingles(*utf8(b.column("text")))
            own = [np.unique(s[i:j]).tobytes() for i, j in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(own, pa.binary())], ["id", "items"])

    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    return found.mapInArrow(sets, "id long, items binary").where(F.octet_length("items") > 0)


def spanning_links(ids: np.ndarray, own: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the members whose sets reach ``percent``, found over posting lists."""
    size = np.array([len(x) for x in own])
    code = np.unique(np.concatenate(own), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(own)), size)
    # a set can't be more similar to any other than its share of shingles that another holds as well
    live = np.ones(len(own), bool)
    while True:
        held = np.bincount(code[live[owner]], minlength=code.max() + 1)
        shared = np.bincount(owner, (held[code] > 1) & live[owner], len(own))
        left = live & (100 * shared >= percent * size)
        if left.sum() == live.sum():
            break
        live = left
    on = live[owner]
    code, owner = code[on], owner[on]
    starts = np.searchsorted(owner, np.arange(len(own) + 1))
    order = np.argsort(code, kind="stable")
    post, edge = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))]) if len(code) else np.zeros(1, np.int64)
    forest, links, apart = Forest(len(own)), [], int(live.sum())
    for i in np.flatnonzero(live).tolist():
        if apart < 2:
            break
        mine = code[starts[i] : starts[i + 1]]
        n = edge[mine + 1] - edge[mine]
        at = np.repeat(edge[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(post[at], minlength=len(own))
        both[: i + 1] = 0
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (size[i] + size - both))).tolist():
            if forest.join(i, j):
                apart -= 1
                if ids[i] != ids[j]:
                    links.append((int(ids[i]), int(ids[j])))
    return links


def forest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of a spanning forest of each cluster (cluster, id), confirmed on the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "cluster"):
            links = spanning_links(t.column("id").to_numpy(), [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()], percent)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = members.join(sets, "id").select("cluster", "id", "items").repartition("cluster").sortWithinPartitions("cluster", "id")
    return dealt.mapInArrow(compare, "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach ``percent`` of similarity (a stored table)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("x"), b.column("y")):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(p) + len(q) - inter))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    ids = stored(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct(), "near-ids")
    own = Stored(sets_of(docs, ids), "near-sets")
    joined = pairs.join(own.df.select(F.col("id").alias("b"), F.col("items").alias("y")), "b").join(own.df.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
    links = stored(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long").distinct(), "near-links")
    own.drop()
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = Stored(signatures(docs), "near-signed")
    some = signed.df.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    keys = ["n", "k1", "k2"]
    # the signature follows from the set, so any member's serves its class
    classes = stored(some.groupBy(*keys).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("size"), F.first("sig").alias("sig")), "near-classes")
    reps = classes.select("id", "n", "sig")
    # only a set that several rows hold has members besides its representative
    members = some.select("doc_id", *keys).join(classes.where("size > 1").select(*keys, "id"), keys)
    links = stored(members.where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "near-copies")

    level, parts = first_nodes(reps, trees_for(percent)), []
    for depth in range(1, DEPTH + 1):
        sizes = stored(level.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight"), F.min(F.xxhash64("key", "id")).alias("first")).where("size > 1"), "near-sizes")
        rows = stored(level.drop("n").join(sizes, "key"), "near-rows")
        fits = (F.col("size") <= small) & (F.col("weight") <= WEIGHT)
        parts.append(stored(clusters(rows.where(fits).select("key", "id"), reps, percent), "near-clusters"))
        large = rows.where(~fits)
        if not large.limit(1).count():
            break
        # large nodes: everyone against the member whose hash is least
        pivot = stored(large.where(F.xxhash64("key", "id") == F.col("first")).select("key", F.col("id").alias("p")), "near-pivots")
        held = large.join(pivot, "key").where("id != p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
        links = stored(links.unionAll(confirm(stored(held, "near-pairs"), docs, percent)), "near-copies")
        comp = stored(components(links), "near-comps")
        named = stored(large.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")), "near-named")
        open_ = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        left = stored(named.join(stored(open_, "near-open"), "key").select("key", "id", "size", "weight"), "near-large")
        if depth == DEPTH:
            parts.append(stored(clusters(in_blocks(left, small), reps, percent), "near-clusters"))
        else:
            level = next_nodes(left, reps)
    members = stored(reduce(DataFrame.unionAll, parts).distinct(), "near-members")
    sets = Stored(sets_of(docs, stored(members.select("id").distinct(), "near-ids")), "near-sets")
    links = stored(links.unionAll(forest_links(members, sets.df, percent)), "near-links")
    sets.drop()
    final = stored(components(links), "near-final")
    answer = signed.df.select("doc_id", "n").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("comp", "doc_id")
    return answer.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each group of near-duplicates (the smallest id); the columns stay.

    An id names one document: of rows that repeat it one stays, the same in every run (a row with a text
    before one without, then by a hash of all its columns).
    """
    found = near_duplicates(docs, percent)
    gone = stored(found.where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    named = docs.where(F.col("doc_id").isNotNull()).join(gone, "doc_id", "left_anti")
    # a row is carried whole, so that no name of the table can clash; equal ranks are equal rows
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = named.groupBy("doc_id").agg(F.min_by(row, F.struct(F.col("text").isNull(), F.xxhash64(row))).alias("kept_row"))
    return least.select("kept_row.*").unionAll(docs.where(F.col("doc_id").isNull()))
