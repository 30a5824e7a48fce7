"""Benchmark decontamination: test items found in whole texts within an edit budget.

Texts and items are normalised (lower case, every run of other than letters and digits one
blank). An item of m characters has a budget of ``floor(rate * m)`` edits and is split into one
piece more than that: by the pigeonhole principle any passage within the budget holds at
least one piece unchanged. All pieces are sought at once with an automaton, hits are gathered into
windows of the text, windows that lack too many of the item's trigrams are passed over (the q-gram
lemma, also exact), and Myers' bit-parallel recurrence gives the least distance of the item to any
passage of the window.

Items are taken in blocks of at most ``block_chars`` characters (one item at least); a block is
what a task holds and what is broadcast, and every block meets all rows.

Defined results: a null text or item counts as empty, and an empty item matches nothing; an item with fewer
than ``least`` normalised characters has no edits to spare and is found only whole, between blanks
or the ends of the text; equal item texts are all reported; repeated rows get equal results; an empty
item table marks nothing; extra columns keep their names and values (``hits`` is replaced by ``contaminated`` alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warmgrid.llm.common import bounded

RATE = 0.08
LEAST = 24
GRAM = 3


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


@dataclass(frozen=True)
class Item:
    item_id: int
    text: str
    budget: int
    whole: bool = False  # found only between blanks or the ends of a text

    def pieces(self) -> list[tuple[int, str]]:
        """budget + 1 pieces of nearly equal length: (offset, piece)."""
        n = self.budget + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Least edit distance of a pattern to any stretch of a text, one machine word operation a bit column."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.mask = (1 << self.m) - 1
        self.high = 1 << (self.m - 1)
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | (1 << i)

    def distance(self, text: str) -> int:
        mask, high, get = self.mask, self.high, self.peq.get
        plus, minus, score = mask, 0, self.m
        best = score
        for c in text:
            eq = get(c, 0)
            zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & mask
            up = minus | (mask & ~(zero | plus))
            down = plus & zero
            if up & high:
                score += 1
            elif down & high:
                score -= 1
                if score < best:
                    best = score
            up = (up << 1) & mask
            down = (down << 1) & mask
            plus = down | (mask & ~(zero | up))
            minus = up & zero
        return best


def grams(text: str) -> set[str]:
    return {a + b + c for a, b, c in zip(text, text[1:], text[2:])}


class Finder:
    """Automaton over the pieces of a block of items, and the verification of its hits."""

    def __init__(self, items: list[Item]):
        import ahocorasick

        self.items = items
        self.automaton = ahocorasick.Automaton()
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(items):
            for offset, piece in item.pieces():
                owners.setdefault(piece, []).append((k, offset))
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        self.some = bool(owners)
        self.myers: dict[int, Myers] = {}
        self.grams = [grams(item.text) for item in items]

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of every item within its budget somewhere in ``text``."""
        if not self.some or not text:
            return []
        begins: dict[int, list[int]] = {}
        for end, (size, own) in self.automaton.iter(text):
            for k, offset in own:
                begins.setdefault(k, []).append(end - size + 1 - offset)
        found = []
        for k, starts in begins.items():
            item = self.items[k]
            if item.whole:
                ends = (s + len(item.text) for s in starts if not s or text[s - 1] == " ")
                if any(e == len(text) or text[e] == " " for e in ends):
                    found.append((item.item_id, 0))
                continue
            m, budget = len(item.text), item.budget
            best, upto = m, None
            for s in sorted(starts):
                if upto is None or s - budget > upto:
                    if upto is not None:
                        best = min(best, self._distance(k, text[max(low, 0) : upto]))
                    low = s - budget
                upto = s + m + budget
            best = min(best, self._distance(k, text[max(low, 0) : upto]))
            if best <= budget:
                found.append((item.item_id, best))
        return sorted(found)

    def _distance(self, k: int, window: str) -> int:
        pattern = self.items[k].text
        if pattern in window:
            return 0
        # an edit removes at most GRAM of the item's distinct q-grams
        if len(self.grams[k] - grams(window)) > GRAM * self.items[k].budget:
            return len(pattern)
        if k not in self.myers:
            self.myers[k] = Myers(pattern)
        return self.myers[k].distance(window)


def item_blocks(benchmark: DataFrame, rate: float = RATE, least: int = LEAST, block_chars: int = 4_000_000) -> Iterator[list[Item]]:
    """The items in blocks of at most ``block_chars`` characters (or one item), in the order of a hash."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normalised(F.col("text")).alias("text")).where("text != ''")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // (block_chars // 2)) or 1
    for part in range(parts):
        block, size = [], 0
        for r in rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == part).toLocalIterator():
            if block and size + len(r["text"]) > block_chars:
                yield block
                block, size = [], 0
            block.append(Item(-1 if r["item_id"] is None else r["item_id"], r["text"], int(rate * len(r["text"])) if len(r["text"]) >= least else 0, len(r["text"]) < least))
            size += len(r["text"])
        if block:
            yield block


def free_name(docs: DataFrame, stem: str) -> str:
    """A column name like ``stem`` that ``docs`` does not have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (f"_{stem}_{i}" for i in range(len(taken) + 1)) if n not in taken)


def hits(docs: DataFrame, items: list[Item], name: str = "hits") -> DataFrame:
    """``docs`` with ``name``: the items of one block found in each text, with their distance."""
    block = docs.sparkSession.sparkContext.broadcast(items)
    norm = free_name(docs, "norm")
    plain = docs.withColumn(norm, normalised(F.col("text")))
    schema = StructType(docs.schema.fields + StructType.fromDDL(f"`{name}` array<struct<item_id:bigint,distance:int>>").fields)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(block.value)
        for b in bounded(batches, norm):
            found = [[{"item_id": i, "distance": d} for i, d in finder.find(t)] for t in b.column(norm).to_pylist()]
            keep = [i for i, f in enumerate(b.schema.names) if f != norm]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(found, kind)], [b.schema.names[i] for i in keep] + [name])

    return plain.mapInArrow(apply, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with the items found: ``hits``, an array of (item_id, distance) over all blocks, ordered by item."""
    return _marked(docs.drop("hits"), benchmark, "hits", rate, least, block_chars)


def _marked(docs: DataFrame, benchmark: DataFrame, name: str, rate: float = RATE, least: int = LEAST, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with the hits of all blocks in a new column ``name``."""
    out, parts = docs, []
    for items in item_blocks(benchmark, rate, least, block_chars):
        parts.append(free_name(out, "hits"))
        out = hits(out, items, parts[-1])
    every = reduce(F.concat, [F.col(c) for c in parts]) if parts else F.array().cast("array<struct<item_id:bigint,distance:int>>")
    return out.withColumn(free_name(out, "all"), F.array_sort(every)).drop(*parts).withColumnRenamed(free_name(out, "all"), name)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST) -> DataFrame:
    """The documents that hold no test item; the columns stay."""
    name = free_name(docs, "found")
    return _marked(docs, benchmark, name, rate, least).where(F.size(name) == 0).drop(name)
