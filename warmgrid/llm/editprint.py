"""Document fingerprints by randomised edit embedding.

All texts share one random walk rule: at output step j a text emits its current character
and moves to the next one if a random bit of (j, character) says so. Two texts a few edits
apart fall back into step, so their emitted strings differ in few places (edit distance
becomes Hamming distance). A fingerprint samples the emitted string at 128 shared
positions. The positions of one length scale (a power of two) contain those of the next
larger scale that fit, so texts of different length still compare. Likeness is the share of
equal samples; bands of sampled symbols make candidate keys for a search.

Defined results: null counts as empty; two empty texts have likeness 1, an empty and another
one 0; equal texts have equal fingerprints; rows with equal ids are ordered by text; extra
columns are ignored; of a single row the next document is the row itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmgrid.llm.common import bounded, mix64

CLASSES, PERIOD = 64, 1 << 16
SAMPLES, SCALES = 128, 40
BAND = 4
LANES = 24  # with fewer unfinished texts than this, each is walked on its own


def _walk_table(seed: int = 5) -> np.ndarray:
    """Steps a character of each class stays at each output position, from random bits with a long period."""
    bits = np.random.default_rng(seed).random((CLASSES, PERIOD)) < 0.5
    bits[:, -1] = True
    stop = np.where(bits, np.arange(PERIOD), PERIOD)
    nearest = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    return np.minimum(nearest - np.arange(PERIOD) + 1, 255).astype(np.uint8)


def _positions(seed: int = 6) -> list[np.ndarray]:
    """Sampled positions for each scale; those of scale s hold all of scale s + 1 below 2^(s+1)."""
    rng = np.random.default_rng(seed)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * SCALES
    kept = np.zeros(0, np.int64)
    for s in range(SCALES - 1, -1, -1):
        top = 1 << (s + 1)
        kept = kept[kept < top]
        if top <= SAMPLES:
            kept = np.arange(top)
        while len(kept) < min(SAMPLES, top):
            kept = np.unique(np.append(kept, rng.integers(0, top, SAMPLES - len(kept))))
        out[s] = kept
    return out


class EditEmbedding:
    """Walk tables and sample positions; the same for every task."""

    def __init__(self) -> None:
        self.table = _walk_table()
        self.rows = [r.tobytes() for r in self.table]
        self.flat = self.table.reshape(-1)
        self.positions = _positions()

    def walk(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """For each text the output position at which each character is first emitted, and the total."""
        classes = [(mix64(c) % np.uint64(CLASSES)).astype(np.int32) for c in codes]
        order = sorted(range(len(codes)), key=lambda i: -len(codes[i]))
        length = np.array([len(codes[i]) for i in order], np.int64)
        steps = int(length[LANES - 1]) if len(order) >= LANES else 0
        out: list[np.ndarray] = [np.zeros(len(c) + 1, np.int64) for c in codes]
        at = np.zeros(len(order), np.int64)
        if steps:
            grid = np.zeros((steps, len(order)), np.int32)
            for lane, i in enumerate(order):
                n = min(steps, len(classes[i]))
                grid[:n, lane] = classes[i][:n]
            grid <<= 16
            trail = np.zeros((steps + 1, len(order)), np.int32)
            active = np.searchsorted(-length, -np.arange(steps), "left")
            j = np.zeros(len(order), np.int32)
            for i in range(steps):
                a = active[i]
                part = j[:a]
                part += self.flat.take(grid[i, :a] | (part & (PERIOD - 1)))
                trail[i + 1, :a] = part
            for lane, i in enumerate(order):
                n = min(steps, len(classes[i]))
                out[i][: n + 1] = trail[: n + 1, lane]
                at[lane] = trail[n, lane]
        rows, mask = self.rows, PERIOD - 1
        for lane, i in enumerate(order):
            if length[lane] <= steps:
                break
            j, rest = int(at[lane]), []
            for c in classes[i][steps:].tolist():
                j += rows[c][j & mask]
                rest.append(j)
            out[i][steps + 1 :] = rest
        return out

    def prints(self, texts: list[str]) -> list[tuple[int, bytes]]:
        """(emitted length, sampled symbols) of each text."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        out = []
        for code, trail in zip(codes, self.walk(codes)):
            total = int(trail[-1])
            if not total:
                out.append((0, b""))
                continue
            at = self.positions[scale_of(total)]
            char = np.searchsorted(trail, at[at < total], "right") - 1
            # a sampled symbol hashes the emitted character and the two after it
            ends = len(code) - 1
            key = code[char].astype(np.uint64) << np.uint64(42)
            key |= code[np.minimum(char + 1, ends)].astype(np.uint64) << np.uint64(21)
            key |= code[np.minimum(char + 2, ends)].astype(np.uint64)
            out.append((total, (mix64(key) & np.uint64(255)).astype(np.uint8).tobytes()))
        return out

    def likeness(self, a: tuple[int, bytes], b: tuple[int, bytes]) -> float:
        """Share of equal samples at the positions both scales know, of those that either text reaches."""
        if not a[0] or not b[0]:
            return float(a[0] == b[0])
        scale = scale_of(max(a[0], b[0]))
        common = self.positions[scale]
        common = common[common < max(a[0], b[0])]
        x, y = (self._at(p, common) for p in (a, b))
        return float(((x == y) & (x >= 0)).mean())

    def _at(self, p: tuple[int, bytes], common: np.ndarray) -> np.ndarray:
        own = self.positions[scale_of(p[0])]
        own = own[own < p[0]]
        where = np.minimum(np.searchsorted(own, common), len(own) - 1)
        return np.where(own[where] == common, np.frombuffer(p[1], np.uint8)[where].astype(np.int16), -1)

    def bands(self, p: tuple[int, bytes]) -> list[int]:
        """Candidate keys: a hash of each run of BAND sampled symbols with its place and scale."""
        sym = np.frombuffer(p[1], np.uint8)[: len(p[1]) // BAND * BAND].reshape(-1, BAND).astype(np.uint64)
        if not p[0] or not len(sym):
            return []
        key = (sym[:, 0] << np.uint64(24)) | (sym[:, 1] << np.uint64(16)) | (sym[:, 2] << np.uint64(8)) | sym[:, 3]
        place = np.uint64(scale_of(p[0]) << 8) + np.arange(len(sym), dtype=np.uint64)
        return (mix64(key | (place << np.uint64(32))) >> np.uint64(1)).astype(np.int64).tolist()


def scale_of(total: int) -> int:
    return min(max(total - 1, 1).bit_length() - 1, SCALES - 1)


def as_text(p: tuple[int, bytes]) -> str:
    return f"{p[0]:x}-{p[1].hex()}"


def from_text(s: str) -> tuple[int, bytes]:
    total, _, sym = s.partition("-")
    return int(total, 16), bytes.fromhex(sym)


_SHARED: list[EditEmbedding] = []


def embedding() -> EditEmbedding:
    if not _SHARED:
        _SHARED.append(EditEmbedding())
    return _SHARED[0]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and its band keys of every text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = embedding()
        for b in bounded(batches):
            found = e.prints([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([as_text(p) for p in found]), pa.array([e.bands(p) for p in found], pa.list_(pa.int64()))], ["doc_id", "fingerprint", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, fingerprint string, bands array<long>")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprint columns."""

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        e = embedding()
        return pd.Series([None if p is None or q is None else e.likeness(from_text(p), from_text(q)) for p, q in zip(x, y)], dtype="float64")

    return apply(a, b)


def search(queries: DataFrame, prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Query fingerprints against all: equal band key, then likeness of ``least`` or more.

    Returns query_id, rep_id and likeness, one row for each distinct fingerprint; documents
    with equal fingerprints share ``rep_id``, their smallest id, so a hot copy group is one row.
    """
    reps = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep_id"))
    keyed = reps.join(prints.select(F.col("doc_id").alias("rep_id"), "bands"), "rep_id").select("rep_id", F.explode(F.array_distinct("bands")).alias("band"))
    asked = queries.select(F.col("doc_id").alias("query_id"), F.explode(F.array_distinct("bands")).alias("band"))
    pairs = asked.join(keyed, "band").select("query_id", "rep_id").distinct()
    mine = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("_q"))
    both = pairs.join(mine, "query_id").join(reps, "rep_id")
    return both.withColumn("likeness", likeness(F.col("_q"), F.col("fingerprint"))).where(F.col("likeness") >= least).select("query_id", "rep_id", "likeness")


LOWEST = -(1 << 63)


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Rows (block, extra, key, doc_id, text) such that, sorted so, each document is followed by the next smaller id.

    Ids are cut into blocks at approximate quantiles; each block also gets a copy of the
    following block's first document (marked ``extra``), so no window spans the table.
    """
    blocks = blocks or max(2, 2 * docs.rdd.getNumPartitions())
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(LOWEST)).cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = base.agg(F.percentile_approx("key", [i / blocks for i in range(1, blocks)], 20 * blocks).alias("c")).first()["c"] or []
    edges = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(cuts, np.int64)))

    @F.pandas_udf("int")
    def block_of(key: pd.Series) -> pd.Series:
        return pd.Series(-np.searchsorted(edges.value, key.to_numpy(), "left").astype(np.int32))

    # ascending block is descending id
    first = base.select(block_of("key").alias("block"), "key").groupBy("block").agg(F.max("key").alias("key")).orderBy("block").collect()
    names = ["block", "extra", "key", "doc_id", "text"]
    rows = base.withColumns({"block": block_of("key"), "extra": F.lit(False)}).select(*names)
    if not first:
        return rows
    # block -> the key of the block that follows (after the last: the first)
    follow = {first[i - 1]["block"]: first[i]["key"] for i in range(len(first))}
    heads = base.where(F.col("key").isin([r["key"] for r in first])).groupBy("key").agg(F.min("text").alias("text"))
    before = F.create_map(*[F.lit(v) for b, k in follow.items() for v in (k, b)])
    copies = heads.select(before[F.col("key")].alias("block"), F.lit(True).alias("extra"), "key", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text")
    return rows.unionByName(copies).repartition(len(first), "block").sortWithinPartitions("block", "extra", F.desc("key"), "text")


def edited(text: str, after: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def compare_with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that of the next document."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "banded_edited", "banded_next"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, banded_edited boolean, banded_next boolean"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = embedding()
        held: list = []  # the last row, waiting for its follower: (doc_id, extra, text, print)
        for b in bounded(batches):
            texts = b.column("text").to_pylist()
            rows = held + [[i, x, t, p] for i, x, t, p in zip(b.column("doc_id").to_pylist(), b.column("extra").to_pylist(), texts, e.prints(texts))]
            held = rows[-1:]
            pairs = [(r, s) for r, s in zip(rows, rows[1:]) if not r[1]]
            changed = [edited(r[2], s[2]) for r, s in pairs]
            prints = e.prints(changed)
            out: list[list] = [[] for _ in names]
            for (r, s), text, p in zip(pairs, changed, prints):
                own = set(e.bands(r[3]))
                for column, value in zip(out, (
                    r[0], len(r[2]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), as_text(r[3]), as_text(p),
                    e.likeness(r[3], p), e.likeness(r[3], s[3]), not own.isdisjoint(e.bands(p)), not own.isdisjoint(e.bands(s[3])),
                )):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.column("doc_id").type), pa.array(out[1], pa.int64())] + [pa.array(c, t) for c, t in zip(out[2:], [pa.string()] * 3 + [pa.float64()] * 2 + [pa.bool_()] * 2)], names)

    return with_next(docs, blocks).mapInArrow(apply, schema)
