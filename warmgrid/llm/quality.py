"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed in the tasks with numpy over the bytes of many texts at once and
stored as one narrow table, so the corpus is read once. Trees are grown on the driver from
a bounded labelled sample (``sample`` rows at most on average, chosen by a hash of the id) and
flattened into arrays of features, thresholds and leaves; scoring walks all rows and trees
level by level as array lookups.

Defined results: a null text counts as empty and is scored; a null or missing label is not learnt
from; without labels of both kinds every score is the share of label 1 (0.5 with no label);
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warmgrid.llm.common import bounded, utf8, word_hashes, words_of

# classes of bytes whose shares are features
KINDS = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t\x0b\x0c", "line": b"\n\r",
    "stop": b".,;:", "shout": b"!?", "symbol": b"#$%&*@^~+=<>\\`_", "bar": b"|/", "quote": b"'\"()[]{}-",
}
FEATURES = [f"share_{k}" for k in KINDS] + ["share_wide", "share_control", "log_bytes", "log_words", "word_mean", "word_deviation", "word_longest", "distinct_words", "top_word", "distinct_pairs", "capital_words", "plain_ends", "log_lines", "line_mean", "distinct_lines", "byte_entropy"]
_KIND = np.full(256, len(KINDS), np.int64)
_KIND[:32] = _KIND[127] = len(KINDS) + 1
for _i, _bytes in enumerate(KINDS.values()):
    _KIND[list(_bytes)] = _i
_ALNUM = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def _runs(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group the number of distinct values and the count of its commonest one."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(group):
        key = np.sort((group.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        owner = (key[first] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(owner, minlength=n).astype(float)
        np.maximum.at(most, owner, np.diff(np.append(first, len(key))).astype(float))
    return distinct, most


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(off) - 1
    size = np.diff(off)
    some = np.maximum(size, 1)
    doc = np.repeat(np.arange(n), size)
    by_byte = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    kinds = np.zeros((n, len(KINDS) + 2))
    for k in range(kinds.shape[1]):
        kinds[:, k] = by_byte[:, _KIND == k].sum(axis=1) / some
    p = by_byte / some[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    starts, ends, first = words_of(data, off)
    words = np.diff(first)
    owner = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    many = np.maximum(words, 1)
    mean = np.bincount(owner, length, n) / many
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / many - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    hashed = word_hashes(data, starts, ends)
    distinct, top = _runs(owner, hashed, n)
    pair = hashed[:-1] * np.uint64(31) + hashed[1:] if len(hashed) else hashed
    inner = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pairs, _ = _runs(owner[:-1][inner], pair[inner], n) if len(owner) else (np.zeros(n), None)
    capital = np.bincount(owner, _KIND[data[starts]] == 1, n) / many if len(starts) else np.zeros(n)
    plain = np.bincount(owner, _ALNUM[data[ends - 1]], n) / many if len(starts) else np.zeros(n)
    # lines: the stretches between line feeds, hashed like words
    brk = np.flatnonzero(data == 10)
    line_start = np.union1d(off[:-1][size > 0], brk + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_owner = np.searchsorted(off, line_start, "right") - 1
    lines = np.bincount(line_owner, minlength=n)
    kinds_of_line, _ = _runs(line_owner, word_hashes(data, line_start, line_end), n)
    return np.column_stack([
        kinds, np.log1p(size), np.log1p(words), mean, spread, np.log1p(longest), distinct / many, top / many, (pairs + 1) / many, capital, plain,
        np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), kinds_of_line / np.maximum(lines, 1), entropy,
    ]).astype(np.float32)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` (array of FEATURES) of every text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            x = statistics(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))], ["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<float>")


@dataclass
class Trees:
    """Complete binary trees in arrays: node k of a level has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        total = np.full(len(x), self.base)
        tree = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            row = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.threshold[tree, node])
            if depth:
                total[at : at + 4096] += self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; splits are sought over quantile bins, all nodes of a level at once."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), float(np.log(share / (1 - share))))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    code = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    flat = code + np.arange(width) * bins
    base = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            nodes = 2**d
            key = (node[:, None] * width * bins + flat).reshape(-1)
            gain_g = np.bincount(key, np.repeat(g, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2)
            gain_h = np.bincount(key, np.repeat(h, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2)
            all_g, all_h = gain_g[:, :, -1:], gain_h[:, :, -1:]
            gain = gain_g**2 / (gain_h + ridge) + (all_g - gain_g) ** 2 / (all_h - gain_h + ridge) - all_g**2 / (all_h + ridge)
            gain[(gain_h < 1) | (all_h - gain_h < 1)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            value = gain.reshape(nodes, -1)[np.arange(nodes), best]
            f, b = best // bins, best % bins
            bound = np.array([cuts[i][k] if v > 1e-6 and k < len(cuts[i]) else np.inf for i, k, v in zip(f, b, value)])
            at = nodes - 1 + np.arange(nodes)
            feature[t, at], threshold[t, at] = f, bound
            node = 2 * node + (x[np.arange(n), f[node]] > bound[node])
        sum_g, sum_h = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -rate * sum_g / (sum_h + ridge)
        total += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


def fit(stats: DataFrame, labels: DataFrame, sample: int = 20_000, label: str = "quality") -> Trees:
    """Trees learnt from the labels' rows joined to the statistics; about ``sample`` labelled rows at most."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("double").alias("_y"))
    n = known.count()
    if n > sample:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = stats.join(known, "doc_id").select("doc_id", "_y", "stats").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["_y"], r["stats"]))
    x = np.array([r["stats"] for r in rows], np.float32).reshape(-1, len(FEATURES))
    return grow(x, np.array([r["_y"] for r in rows], float))


def score(stats: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every row of statistics."""
    model = stats.sparkSession.sparkContext.broadcast(trees)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.value.score(x))], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(apply, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
