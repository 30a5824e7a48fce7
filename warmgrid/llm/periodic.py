"""Periodic runs of words, by descending-LCP Kruskal over suffix classes.

A run is a longest stretch of words with a smallest period q (words q apart are equal) that
repeats it at least ``TIMES`` times and has at least ``LEAST`` words. Inside a document every word is a number. The
suffixes are sorted by prefix doubling, and neighbours in that order are united by
decreasing length of their common prefix (LCP): at length l the classes are the sets of positions that agree for l words.
Each class keeps its positions in order. Where two classes unite, two positions i < j that become neighbours in the
united set agree for exactly l words; if j - i <= l, the words from i to j + l have period j - i, which is their
smallest, for a smaller one would have put a third position between them. The end j + l can't grow, and
the pair whose words before i and j differ stands at the start, so each run comes out once.

A run of q times 4 and 6 words at least needs l >= max(3 q, 6 - q), so l >= 5: Kruskal ends at five, and only
suffixes whose first five words occur elsewhere in the document take part. Time is about n log n, memory about
4 bytes a word for each doubling of the longest repeat; a document is one task's work.

Defined results: a null or blank text has no runs and an empty collapsed text; extra columns pass
through, but the two new ones take the place of columns of their names (the caller may name them otherwise); repeated
rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from warmgrid.llm.common import bounded

TIMES, LEAST = 4, 6
# the shortest common prefix that any run's first two periods can have
SEED = min(max((TIMES - 1) * q, LEAST - q) for q in range(1, LEAST + 1))
RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Ranks of all stretches of ``n`` numbers, in their order."""
    count = len(ids) - n + 1
    kinds = int(ids.max()) + 1
    key, bound = ids[:count].astype(np.int64), kinds
    for k in range(1, n):
        if bound * kinds >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = int(key.max()) + 1
        key, bound = key * kinds + ids[k : k + count], bound * kinds
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def suffix_neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose first ``SEED`` words recur, in suffix order, and each one's LCP with the one before (0: below ``SEED``)."""
    n = len(ids)
    if n <= SEED:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # numbers that occur once behind the end: suffixes that end there have places in the order and ranks of their own
    rank = grams(np.concatenate([ids, int(ids.max()) + 1 + np.arange(SEED, dtype=np.int32)]), SEED)
    live = np.flatnonzero(np.bincount(rank)[rank] > 1)
    if not len(live):
        return live, live
    some, levels, width = live, [], SEED
    while len(live):
        levels.append((width, rank))
        # live suffixes agree with another for `width` words, so these lie inside the text
        after = np.zeros(n + 1, np.int64)
        after[live] = rank[live + width].astype(np.int64) + 1
        rank = np.unique(rank * np.int64(n + 2) + after, return_inverse=True)[1].astype(np.int32)
        live, width = live[np.bincount(rank)[rank[live]] > 1], width * 2
    some = some[np.argsort(rank[some])]
    i, j = some[:-1], some[1:]
    lcp = np.zeros(len(some), np.int64)
    deep = lcp[1:]
    for width, rank in reversed(levels):
        deep[rank[i + deep] == rank[j + deep]] += width
    on = np.flatnonzero(deep)
    for _ in range(SEED - 1):
        on = on[np.maximum(i[on], j[on]) + deep[on] < n]
        on = on[ids[i[on] + deep[on]] == ids[j[on] + deep[on]]]
        deep[on] += 1
    return some, lcp


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the sequence, by start, then period."""
    place, lcp = suffix_neighbours(ids)
    if not len(place):
        return []
    order = np.argsort(-lcp, kind="stable")
    order = order[lcp[order] >= SEED].tolist()
    spots, depth, word = place.tolist(), lcp.tolist(), ids.tolist()
    # classes are stretches of the suffix order: each end of one knows the other and the ordered positions
    sets: list[list[int]] = [[p] for p in spots]
    up = list(range(len(spots)))
    found = []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in order:
        a, b, deep = root(k - 1), root(k), depth[k]
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        into, new = sets[a], sets[b]
        fresh = set(new)
        for p in new:
            at = bisect_left(into, p)
            into.insert(at, p)
        for p in new:
            at = bisect_left(into, p)
            for i, j in ((into[at - 1], p) if at else (p, p), (p, into[at + 1]) if at + 1 < len(into) else (p, p)):
                q = j - i
                # a pair inside the smaller set was met before
                if 0 < q <= deep and not (i in fresh and j in fresh) and (i == 0 or word[i - 1] != word[j - 1]) and q + deep >= max(LEAST, TIMES * q):
                    found.append((i, q + deep, q))
        up[b], sets[b] = a, []
    return sorted(found)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside all runs or in a run's first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", short: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of its texts (``runs``) and the texts without the repeats of those runs (``short``)."""
    docs = docs.drop(runs, short)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, text):
            all_runs, texts = [], []
            for value in b.column(text):
                words = (value.as_py() or "").encode().split()
                seen: dict[bytes, int] = {}
                ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
                found = runs_of(ids) if len(seen) < len(words) else []
                all_runs.append(found)
                texts.append(collapsed(words, found))
            size = np.concatenate([[0], np.cumsum([len(r) for r in all_runs])]).astype(np.int32)
            flat = np.array([r for own in all_runs for r in own], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(size), items), pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, runs, short])

    return docs.mapInArrow(apply, StructType([*docs.schema.fields, StructField(runs, ArrayType(RUN)), StructField(short, StringType())]))


def strongest(runs):
    """The run of greatest exact length / period (ties: the first by start, then period); null without runs."""
    ahead = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(ahead(best, r), r).otherwise(best))
