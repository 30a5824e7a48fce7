"""Language identification: a convolutional network over bytes, trained in numpy.

Byte embeddings, filters of several widths, a maximum over a fixed-length window, and
a softmax. Whole texts are read as consecutive windows; the windows' log-probabilities
are averaged by their length. Because a filter's response is a sum over its bytes,
a trained filter is stored as tables over byte pairs, so a task scores a window by
looking rows up and taking their maximum.

Defined results: a null or letterless text gives ``und`` with score 0; equal texts give
equal rows; repeated rows are each scored; extra columns are ignored; with no labelled
row every text is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from warmgrid.llm.common import aside, bounded, utf8

WINDOW = 512
PAD = 32
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    """Parameters: embedding (256, e); for each width, filters (width, e, f); dense layer."""

    labels: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, its response as a sum of lookups: byte pairs, then a last single byte if the width is odd."""
        result = {}
        for w, filt in self.filters.items():
            per_byte = np.einsum("be,wef->wbf", self.embed, filt).astype(np.float32)
            parts = []
            for o in range(0, w - 1, 2):
                parts.append((per_byte[o][:, None, :] + per_byte[o + 1][None, :, :]).reshape(65536, -1))
            if w % 2:
                parts.append(per_byte[w - 1])
            parts[0] = parts[0] + self.bias[w]
            result[w] = [np.ascontiguousarray(p, dtype=np.float32) for p in parts]
        return result


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window matrix padded with spaces, document of each window, bytes in each window)."""
    length = np.diff(off)
    per = -(-length // size)
    doc = np.repeat(np.arange(len(length)), per)
    first = np.cumsum(per) - per
    start = off[doc] + (np.arange(len(doc)) - first[doc]) * size
    n = np.minimum(off[doc + 1] - start, size)
    at = start[:, None] + np.arange(size)
    grid = np.append(data, np.uint8(PAD))[np.minimum(at, len(data))]
    grid[np.arange(size)[None, :] >= n[:, None]] = PAD
    return grid, doc, n


def pooled(grid: np.ndarray, tables: dict[int, list[np.ndarray]], block: int = 64) -> np.ndarray:
    """Largest response of every filter in every window, rectified."""
    out = []
    for at in range(0, len(grid), block):
        x = grid[at : at + block].astype(np.intp)
        pair = (x[:, :-1] << 8) | x[:, 1:]
        row = []
        for w, parts in tables.items():
            n = x.shape[1] - w + 1
            total = None
            for k, part in enumerate(parts):
                codes = pair[:, 2 * k : 2 * k + n] if len(part) == 65536 else x[:, w - 1 : w - 1 + n]
                got = part.take(codes, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            row.append(total.max(axis=1))
        out.append(np.concatenate(row, axis=1))
    return np.maximum(np.concatenate(out), 0) if out else np.zeros((0, sum(p[0].shape[1] for p in tables.values())), np.float32)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, labels: list[str], embed: int = 8, filters: int = 16, steps: int = 240, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteConvNet:
    """Adam on cross-entropy; classes weigh alike. The gradient of the maximum goes to the window position that reached it."""
    rng = np.random.default_rng(seed)
    net = {"embed": rng.normal(0, 0.3, (256, embed)), "dense": rng.normal(0, 0.1, (filters * len(WIDTHS), len(labels))), "out": np.zeros(len(labels))}
    for w in WIDTHS:
        net[f"f{w}"] = rng.normal(0, 0.4, (w, embed, filters))
        net[f"b{w}"] = np.zeros(filters)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    members = [np.flatnonzero(y == c) for c in range(len(labels))]
    for step in range(1, steps + 1):
        cls = rng.integers(0, len(labels), batch)
        pick = np.array([members[c][rng.integers(0, len(members[c]))] for c in cls])
        grid = x[pick].astype(np.intp)
        grad = {k: np.zeros_like(v) for k, v in net.items()}
        hidden, where = [], {}
        for w in WIDTHS:
            per_byte = np.einsum("be,wef->wbf", net["embed"], net[f"f{w}"]).astype(np.float32)
            n = grid.shape[1] - w + 1
            resp = per_byte[0][grid[:, :n]]
            for o in range(1, w):
                resp += per_byte[o][grid[:, o : o + n]]
            where[w] = resp.argmax(axis=1)
            hidden.append(np.take_along_axis(resp, where[w][:, None, :], axis=1)[:, 0, :] + net[f"b{w}"])
        raw = np.concatenate(hidden, axis=1)
        act = np.maximum(raw, 0)
        err = np.exp(log_softmax(act @ net["dense"] + net["out"]))
        err[np.arange(batch), cls] -= 1
        err /= batch
        grad["dense"], grad["out"] = act.T @ err, err.sum(axis=0)
        back = (err @ net["dense"].T) * (raw > 0)
        for i, w in enumerate(WIDTHS):
            g = back[:, i * filters : (i + 1) * filters]
            grad[f"b{w}"] = g.sum(axis=0)
            for o in range(w):
                by_byte = np.zeros((256, filters))
                hit = np.take_along_axis(grid, where[w] + o, axis=1)
                np.add.at(by_byte, (hit, np.arange(filters)[None, :]), g)
                grad["embed"] += by_byte @ net[f"f{w}"][o].T
                grad[f"f{w}"][o] = net["embed"].T @ by_byte
        for k, v in net.items():
            m, s = moments[k]
            m += 0.1 * (grad[k] - m)
            s += 0.01 * (grad[k] ** 2 - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return ByteConvNet(labels, net["embed"], {w: net[f"f{w}"] for w in WIDTHS}, {w: net[f"b{w}"] for w in WIDTHS}, net["dense"], net["out"])


def training_sample(docs: DataFrame, per_label: int, per_doc: int = 2) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of about ``per_label`` documents of each label, chosen by a hash of the id and cut inside the tasks.

    The sample is bounded by ``per_label`` x labels x ``per_doc`` windows, whatever the corpus holds.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, int), []
    labels = sorted(counts)
    # hashed uniformly to 0 .. 2^30: keep those under the label's share
    cut = F.create_map(*[F.lit(v) for c in labels for v in (c, int(min(1.0, per_label / counts[c]) * (1 << 30)))])
    key = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(11)), F.lit(1 << 30))
    chosen = known.where(key < cut[F.col("lang")]).select("doc_id", "lang", "text")

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            data, off = utf8(b.column("text"))
            grid, doc, n = windows(data, off)
            if not len(grid):
                continue
            last = np.flatnonzero(np.append(np.diff(doc) > 0, True))
            keep = np.unique(np.concatenate([(last - k)[doc[np.maximum(last - k, 0)] == doc[last]] for k in range(per_doc)]))
            keep = keep[keep >= 0]
            langs = b.column("lang").to_pylist()
            ids = b.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[d] for d in doc[keep]], pa.int64()), pa.array([langs[d] for d in doc[keep]], pa.string()), pa.array([g.tobytes() for g in grid[keep]], pa.binary()),
            ], ["doc_id", "lang", "window"])

    rows = chosen.mapInArrow(cut_windows, "doc_id long, lang string, window binary").collect()
    rows.sort(key=lambda r: (r["lang"], -1 if r["doc_id"] is None else r["doc_id"], bytes(r["window"])))
    labels = sorted({r["lang"] for r in rows})
    x = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return x, np.array([labels.index(r["lang"]) for r in rows], int), labels


def fit(docs: DataFrame, per_label: int = 1500) -> ByteConvNet | None:
    """A network learnt from the ``lang`` of ``docs``, by a sample of at most about ``per_label`` documents a label."""
    x, y, labels = training_sample(docs, per_label)
    return train(x, y, labels) if labels else None


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended; reads the text only."""
    spark = docs.sparkSession
    clash = [c for c in ("lang_pred", "score", "_letters") if c in docs.columns]
    base = docs.drop(*clash).withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    if net is None:
        return base.drop("_letters").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    model = spark.sparkContext.broadcast((net.tables(), net.dense, net.out_bias, net.labels))
    schema = StructType(base.drop("_letters").schema.fields + StructType.fromDDL("lang_pred string, score double").fields)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, dense, out, labels = model.value
        for b in bounded(batches):
            data, off = utf8(b.column("text"))
            grid, doc, n = windows(data, off)
            total = np.zeros((b.num_rows, len(labels)))
            if len(grid):
                np.add.at(total, doc, log_softmax(pooled(grid, tables) @ dense + out) * n[:, None])
            prob = np.exp(log_softmax(total / np.maximum(np.diff(off), 1)[:, None]))
            best = prob.argmax(axis=1)
            letters = b.column("_letters").to_numpy(zero_copy_only=False).astype(bool)
            names = [labels[c] if ok else UNKNOWN for c, ok in zip(best, letters)]
            score = np.where(letters, prob[np.arange(len(best)), best], 0.0)
            keep = [i for i, f in enumerate(b.schema.names) if f != "_letters"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(names, pa.string()), pa.array(score)], [b.schema.names[i] for i in keep] + ["lang_pred", "score"])

    return base.mapInArrow(apply, schema)


def keep_identified(docs: DataFrame, net: ByteConvNet | None, least: float = 0.3) -> DataFrame:
    """The documents whose language is identified with a score of ``least`` or more; the columns stay."""
    plain, back = aside(docs, "text")
    return predict(plain, net).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*back)
