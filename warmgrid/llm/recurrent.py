"""Gated recurrent language model: training by truncated backpropagation, scoring of whole documents.

Words are counted over all training documents. The ``HEAD`` commonest tokens are symbols of
their own; every other word is a symbol of one of ``TAIL`` classes by its ending. The output is
factored: a softmax over classes, then one over the words of a head class, or
the class's counts (plus one) for a tail word. Replicas of the network train on shards, which hold
all training documents between them; after each round Spark sums their parameters chunk by chunk and
the driver holds their mean only. Documents are scored from end to end: many run side by side
in lanes, window after window, with the state carried from a window to the next.

Counts of the ``KNOWN`` commonest tokens travel with the model (a bounded table); for other words
(document, word) rows are joined to the counts, so no key is frequent.

Defined results: a null text is empty and has the end token alone; rows are scored one by one, equal
texts alike; a word never seen in training has count 0 and is its class's unknown; without
training documents all counts are 0; a null id counts as training; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heapreplace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmgrid.llm.common import LOWER, Stored, bounded, mix64, stored, utf8, word_hashes, words_of

WIDTH, GROUP, HEAD, TAIL = 32, 64, 2048, 96
KNOWN = 1 << 18
CLASSES = HEAD // GROUP + TAIL
START = HEAD + TAIL  # the symbol before a document
END = np.uint64(0xE2D)  # the hash of the end token
SHARD_TOKENS, ROUNDS = 2_000_000, 2
PASS_TOKENS, MOST_PASSES = 1_000_000, 8  # a replica reads a smaller shard several times
LANES, STEPS = 256, 64
TRAIN_LANES, PIECE = 128, 2048

_LETTER = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending class, document bounds) of all tokens of the texts; each document ends with END."""
    data = LOWER[data]
    starts, ends, first = words_of(data, off)
    h = word_hashes(data, starts, ends)
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(_LETTER[data], at, -1))[ends - 1] if len(starts) else starts
    some = last >= starts
    spot = np.where(some, last, ends - 1)
    one = data[spot].astype(np.uint64)
    two = np.where(spot > starts, data[np.maximum(spot - 1, 0)], 0).astype(np.uint64)
    mark = np.where(spot + 1 < ends, data[np.minimum(spot + 1, max(len(data) - 1, 0))], 0).astype(np.uint64)
    ending = (mix64(one | (two << np.uint64(8)) | (mark << np.uint64(16)) | (some.astype(np.uint64) << np.uint64(24))) % np.uint64(TAIL)).astype(np.int16)
    where = first[1:]
    bounds = first + np.arange(len(first))
    return np.insert(h, where, END), np.insert(ending, where, 0), bounds


def _batches_of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in bounded(batches):
        yield b, *tokens(*utf8(b.column("text")))


def token_counts(docs: DataFrame) -> DataFrame:
    """h, ending and c of every distinct token of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            h, e = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, e = h[order], e[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(e[first]), pa.array(np.diff(np.append(first, len(h))))], ["h", "ending", "c"])

        for _, h, e, _ in _batches_of_tokens(batches):
            held.append((h, e))
            size += len(h)
            if size > 4_000_000:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    rows = docs.select("text").mapInArrow(count, "h long, ending short, c long")
    return rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The commonest tokens with their counts, and the totals of the tail classes."""

    known: np.ndarray  # sorted hashes
    count: np.ndarray  # their counts
    symbol: np.ndarray  # rank where it is a head symbol, else -1
    tail_total: np.ndarray  # tokens of each tail class in training, and
    tail_kinds: np.ndarray  # distinct words
    total: int
    kinds: int
    head_counts: np.ndarray

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, -1 where the token is not known; head symbol or -1) of each token."""
        if not len(self.known):
            return np.full(len(h), -1), np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        ok = self.known[at] == h
        return np.where(ok, self.count[at], -1), np.where(ok, self.symbol[at], -1)

    def symbols(self, h: np.ndarray, ending: np.ndarray) -> np.ndarray:
        sym = self.look_up(h)[1]
        return np.where(sym >= 0, sym, HEAD + ending)


def lexicon(counts: DataFrame) -> Lexicon:
    total, kinds = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "h").limit(KNOWN).toArrow()
    h = top.column("h").to_numpy().astype(np.int64).view(np.uint64)
    c = top.column("c").to_numpy().astype(np.int64)
    e = top.column("ending").to_numpy()
    best = np.lexsort((h.view(np.int64), -c))
    h, c, e = h[best], c[best], e[best]
    per = {r["ending"]: (r["t"], r["k"]) for r in counts.groupBy("ending").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("k")).collect()}
    t, k = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for ending, (a, b) in per.items():
        t[ending], k[ending] = a, b
    np.subtract.at(t, e[:HEAD], c[:HEAD])
    np.subtract.at(k, e[:HEAD], 1)
    order = np.argsort(h)
    symbol = np.where(np.arange(len(h)) < HEAD, np.arange(len(h)), -1)
    head = np.zeros(HEAD, np.int64)
    head[: min(HEAD, len(c))] = c[:HEAD]
    return Lexicon(h[order], c[order], symbol[order], t, k, total or 0, kinds, head)


@dataclass
class Gru:
    """Parameters and the passes through them; gates are ordered update, reset, candidate."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(lex: Lexicon, seed: int = 3) -> Gru:
        rng = np.random.default_rng(seed)
        w = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(WIDTH)).astype(np.float32)
        mass = np.concatenate([lex.head_counts.reshape(-1, GROUP).sum(axis=1), lex.tail_total + 1]) + 0.5
        inside = np.log(lex.head_counts + 0.5)
        return Gru({
            "embed": w(START + 1, 3 * WIDTH) * 0.5, "gate": w(WIDTH, 3 * WIDTH), "bias": np.zeros(3 * WIDTH, np.float32),
            "cls": w(WIDTH, CLASSES) * 0.1, "cls_b": np.log(mass / mass.sum()).astype(np.float32),
            "word": w(HEAD // GROUP, WIDTH, GROUP) * 0.1, "word_b": inside.reshape(-1, GROUP).astype(np.float32),
        })

    def run(self, inp: np.ndarray, begin: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each of the steps (T, B, WIDTH) from state ``h``; ``begin`` marks where a document starts."""
        p, steps = self.p, len(inp)
        x = p["embed"][inp] + p["bias"]
        out = np.empty((steps, *h.shape), np.float32)
        trace = []
        for t in range(steps):
            if begin[t].any():
                h = h * ~begin[t][:, None]
            u = h @ p["gate"]
            g = x[t, :, : 2 * WIDTH] + u[:, : 2 * WIDTH]
            np.negative(g, out=g)
            np.exp(np.minimum(g, 40, out=g), out=g)
            g += 1
            np.reciprocal(g, out=g)
            z, r = g[:, :WIDTH], g[:, WIDTH:]
            n = np.tanh(x[t, :, 2 * WIDTH :] + r * u[:, 2 * WIDTH :])
            if keep:
                trace.append((h, u, z, r, n))
            h = n + z * (h - n)
            out[t] = h
        return (out, h, trace) if keep else (out, h)

    def log_probs(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each target symbol's probability, given states (n, WIDTH); a tail symbol's is its class's.

        With ``grad`` also fills the output layers' gradients of the summed loss and returns that by the states.
        """
        p = self.p
        head = target < HEAD
        c = np.where(head, target // GROUP, HEAD // GROUP + target - HEAD)
        logit = h @ p["cls"] + p["cls_b"]
        logit -= logit.max(axis=1, keepdims=True)
        row = np.arange(len(h))
        picked = logit[row, c]
        np.exp(logit, out=logit)
        norm = logit.sum(axis=1)
        out = picked - np.log(norm)
        back = None
        if grad is not None:
            logit /= norm[:, None]
            logit[row, c] -= 1
            grad["cls"] += h.T @ logit
            grad["cls_b"] += logit.sum(axis=0)
            back = logit @ p["cls"].T
        order = np.argsort(c, kind="stable")
        edges = np.searchsorted(c[order], np.arange(HEAD // GROUP + 1))
        for k in range(HEAD // GROUP):
            pick = order[edges[k] : edges[k + 1]]
            if not len(pick):
                continue
            own, t = h[pick], target[pick] - k * GROUP
            z = own @ p["word"][k] + p["word_b"][k]
            z -= z.max(axis=1, keepdims=True)
            at = np.arange(len(pick))
            got = z[at, t]
            np.exp(z, out=z)
            norm = z.sum(axis=1)
            out[pick] += got - np.log(norm)
            if grad is not None:
                z /= norm[:, None]
                z[at, t] -= 1
                grad["word"][k] += own.T @ z
                grad["word_b"][k] += z.sum(axis=0)
                back[pick] += z @ p["word"][k].T
        return out, back

    def gradients(self, inp: np.ndarray, target: np.ndarray, begin: np.ndarray, live: np.ndarray, h0: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean loss over one window; the state's gradient stops at its left edge."""
        p = self.p
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        out, h, trace = self.run(inp, begin, h0, keep=True)
        flat, on = out.reshape(-1, WIDTH), live.reshape(-1)
        logs, back = self.log_probs(flat[on], target.reshape(-1)[on], grad)
        d_out = np.zeros_like(flat)
        d_out[on] = back
        d_out = d_out.reshape(out.shape)
        d_x = np.empty((*inp.shape, 3 * WIDTH), np.float32)
        d_h = np.zeros_like(h0)
        for t in range(len(inp) - 1, -1, -1):
            prev, u, z, r, n = trace[t]
            d_h += d_out[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_z = d_h * (prev - n) * z * (1 - z)
            d_r = d_n * u[:, 2 * WIDTH :] * r * (1 - r)
            d_x[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
            grad["gate"] += prev.T @ d_u
            d_h = (d_h * z + d_u @ p["gate"].T) * ~begin[t][:, None]
        np.add.at(grad["embed"], inp.reshape(-1), d_x.reshape(-1, 3 * WIDTH))
        grad["bias"] += d_x.sum(axis=(0, 1))
        n_on = max(int(on.sum()), 1)
        for g in grad.values():
            g /= n_on
        return grad, h, float(-logs.sum() / n_on)

    def train(self, lanes: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], steps: int = 24, rate: float = 0.008) -> None:
        """One pass of Adam over the lanes, window after window, the state carried along."""
        inp, target, begin, live = lanes
        h = np.zeros((inp.shape[1], WIDTH), np.float32)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i, at in enumerate(range(0, len(inp), steps), 1):
            w = slice(at, at + steps)
            grad, h, _ = self.gradients(inp[w], target[w], begin[w], live[w], h)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 1.0 / max(size, 1e-9))
            step = rate * min(1.0, i / 20) * np.sqrt(1 - 0.99**i) / (1 - 0.9**i)
            for k, v in self.p.items():
                g = grad[k] * scale
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.01 * (g * g - s[k])
                v -= step * m[k] / (np.sqrt(s[k]) + 1e-5)


def training_lanes(sym: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input, target, begin, live) of all tokens, long documents in pieces so that lanes are of about equal length.

    A later piece begins without a state, but with the token before it as input.
    """
    cuts = np.unique(np.concatenate([bounds, *[np.arange(a, b, PIECE) for a, b in zip(bounds, bounds[1:]) if b - a > PIECE]]))
    inp, target, begin, live, place = into_lanes(sym, cuts, int(np.clip(len(sym) // (4 * PIECE), 1, TRAIN_LANES)))
    inside = begin & ~np.isin(place, bounds)
    inp[inside] = sym[place[inside] - 1]
    return inp, target, begin, live


def into_lanes(sym: np.ndarray, bounds: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(input, target, begin, live, place): documents laid into lanes of about equal length, longest first.

    ``place`` is each cell's token, so that results can be gathered again.
    """
    length = np.diff(bounds)
    lanes = max(1, min(lanes, len(length)))
    load = [(0, i) for i in range(lanes)]
    heapify(load)
    lane, spot = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for d in np.argsort(-length, kind="stable").tolist():
        used, i = load[0]
        lane[d], spot[d] = i, used
        heapreplace(load, (used + int(length[d]), i))
    height = max(used for used, _ in load)
    owner = np.repeat(np.arange(len(length)), length)
    row = spot[owner] + np.arange(len(sym)) - bounds[owner]
    col = lane[owner]
    before = np.empty(len(sym), np.int64)
    before[1:] = sym[:-1]
    first = np.zeros(len(sym), bool)
    first[bounds[:-1][length > 0]] = True
    before[first] = START
    inp = np.full((height, lanes), START, np.int32)
    target = np.zeros((height, lanes), np.int32)
    begin = np.zeros((height, lanes), bool)
    live = np.zeros((height, lanes), bool)
    place = np.full((height, lanes), -1, np.int64)
    inp[row, col], target[row, col], begin[row, col], live[row, col], place[row, col] = before, sym, first, True, np.arange(len(sym))
    return inp, target, begin, live, place


def token_log_probs(net: Gru, sym: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log of each token's symbol probability, documents read from end to end."""
    out = np.zeros(len(sym))
    inp, target, begin, live, place = into_lanes(sym, bounds, LANES)
    h = np.zeros((inp.shape[1], WIDTH), np.float32)
    at = 0
    while at < len(inp):
        # lanes that have ended fall away
        w = slice(at, at + STEPS)
        on = live[w].any(axis=0)
        if not on.all():
            inp, target, begin, live, place, h = inp[:, on], target[:, on], begin[:, on], live[:, on], place[:, on], h[on]
        states, h = net.run(inp[w], begin[w], h)
        cell = live[w].reshape(-1)
        out[place[w].reshape(-1)[cell]] = net.log_probs(states.reshape(-1, WIDTH)[cell], target[w].reshape(-1)[cell])[0]
        at += STEPS
    return out


def _learner(net_value, first: bool):
    """A replica's pass over the rows of one shard: its parameters in chunks, times its tokens."""

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(s, np.int16) for s in sorted(rows["sym"])]
        order = np.random.default_rng(len(parts)).permutation(len(parts))
        held = max(1, len(parts) // 10)
        check, sym = (np.concatenate([parts[i] for i in part]).astype(np.int64) for part in (order[:held], order[held:] if len(order) > 1 else order))
        check_bounds, bounds = (np.concatenate([[0], np.cumsum([len(parts[i]) for i in part])]) for part in (order[:held], order[held:] if len(order) > 1 else order))
        local = Gru({k: v.copy() for k, v in net_value.value.p.items()})
        lanes = training_lanes(sym, bounds)
        # after each pass the held-back tenth of the shard is scored, and the best parameters stay
        best, kept = float(token_log_probs(local, check, check_bounds).sum()), local.p
        for _ in range(max(1, min(MOST_PASSES, round(PASS_TOKENS / max(len(sym), 1))))):
            local.p = {k: v.copy() for k, v in local.p.items()}
            local.train(lanes, rate=0.008 if first else 0.004)
            now = float(token_log_probs(local, check, check_bounds).sum())
            if now > best:
                best, kept = now, local.p
        local.p = kept
        chunks = [(f"{k}:{i}", part) for k, v in local.p.items() for i, part in enumerate(np.array_split(v.reshape(-1), max(1, v.size // 16384)))]
        return pd.DataFrame([(name, (part.astype(np.float64) * len(sym)).tobytes(), len(sym)) for name, part in chunks], columns=["chunk", "total", "weight"])

    return learn


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(t) for t in rows["total"])
    return pd.DataFrame([(rows["chunk"].iloc[0], total.tobytes(), int(rows["weight"].sum()))], columns=["chunk", "total", "weight"])


def fit(docs: DataFrame, lex: Lexicon) -> Gru:
    """Rounds of local training on shards of ``docs``, averaged after each; every row is in one shard of one round.

    A shard holds about ``SHARD_TOKENS``, so their number grows with the corpus, and is read up to ``MOST_PASSES`` times,
    until a replica has seen about ``PASS_TOKENS``; what does best on a tenth of the shard that the pass leaves out stays.
    """
    net = Gru.fresh(lex)
    if not lex.total:
        return net
    shards = max(1, round(lex.total / ROUNDS / SHARD_TOKENS))
    # by id and text, so that rows without an id are spread, too
    deal = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(22)), F.lit(shards * ROUNDS)).cast("int")
    lex_value = docs.sparkSession.sparkContext.broadcast(lex)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, e, bounds in _batches_of_tokens(batches):
            sym = lex_value.value.symbols(h, e).astype(np.int16)
            rows = pa.array([sym[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("shard"), rows], ["shard", "sym"])

    dealt = Stored(docs.select(deal.alias("shard"), "text").mapInArrow(symbols, "shard int, sym binary"), "lm-shards")
    for number in range(ROUNDS):
        net_value = docs.sparkSession.sparkContext.broadcast(net)

        schema = "chunk string, total binary, weight long"
        learnt = dealt.df.where(F.col("shard") % ROUNDS == number).groupBy("shard").applyInPandas(_learner(net_value, number == 0), schema)
        # summed in two steps, so that no task adds up all replicas
        part = learnt.withColumn("part", F.pmod(F.xxhash64("total"), F.lit(max(1, int(shards**0.5)))))
        sums = part.groupBy("chunk", "part").applyInPandas(_add, schema).groupBy("chunk").applyInPandas(_add, schema).collect()
        mean: dict[str, dict[int, np.ndarray]] = {}
        for r in sums:
            name, i = r["chunk"].split(":")
            mean.setdefault(name, {})[int(i)] = np.frombuffer(r["total"]) / r["weight"]
        if mean:
            net = Gru({k: np.concatenate([mean[k][i] for i in sorted(mean[k])]).reshape(v.shape).astype(np.float32) for k, v in net.p.items()})
    dealt.drop()
    return net


def score(docs: DataFrame, counts: DataFrame, lex: Lexicon, net: Gru, extra: dict[str, Column]) -> DataFrame:
    """doc_id, the ``extra`` columns, n_tokens, n_known, train_tokens, base_score and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast((lex, net))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, net = model.value
        serial = TaskContext.get().partitionId() << 40
        log_class = np.log10(lex.tail_total + lex.tail_kinds + 1)
        for whole in bounded(batches, limit=1 << 24):
            parts = [(h, e, b) for _, h, e, b in _batches_of_tokens(iter([whole]))]
            h, e = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            n = np.concatenate([np.diff(p[2]) for p in parts])
            bounds = np.concatenate([[0], np.cumsum(n)])
            count, sym = lex.look_up(h)
            tail = sym < 0
            sym = np.where(tail, HEAD + e, sym)
            model_log = token_log_probs(net, sym, bounds) / np.log(10)
            seen = np.log10(np.maximum(count, 0) + 1.0)
            model_log += np.where(tail, seen - log_class[e], 0)
            rest = count < 0
            docs_of = np.repeat(np.arange(len(n)), n)
            key = np.lexsort((h[rest], docs_of[rest]))
            rd, rh = docs_of[rest][key], h[rest][key]
            first = np.flatnonzero(np.concatenate([[True], (rd[1:] != rd[:-1]) | (rh[1:] != rh[:-1])])) if len(rd) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(rd)))
            lists = np.searchsorted(rd[first], np.arange(len(n) + 1)).astype(np.int32)
            add = lambda v: np.add.reduceat(v, bounds[:-1]) if len(n) else v
            words = pa.StructArray.from_arrays([pa.array(rh[first].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "times"])
            keep = [c for c in whole.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [whole.column(c) for c in keep] + [pa.array(serial + np.arange(len(n))), pa.array(n), pa.array(add((count > 0).astype(np.int64))), pa.array(add(seen)), pa.array(add(model_log)), pa.ListArray.from_arrays(pa.array(lists), words)],
                [*keep, "rid", "n_tokens", "known", "seen", "model", "rest"])
            serial += len(n)

    named = docs.select("doc_id", "text", *[c.alias(k) for k, c in extra.items()])
    outer = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema if f.name != "text")
    done = stored(named.mapInArrow(apply, f"{outer}, rid long, n_tokens long, known long, seen double, model double, rest array<struct<h:bigint,times:int>>"), "lm-scored")
    words = done.select("rid", F.inline("rest"))
    met = words.join(counts.select("h", "c"), "h").groupBy("rid").agg(F.sum("times").alias("r_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("r_seen"))
    all_ = done.join(met, "rid", "left")
    more, known = F.coalesce("r_seen", F.lit(0.0)), F.coalesce("r_known", F.lit(0)).cast("long")
    floor = float(np.log10(lex.total + lex.kinds + 1))
    return all_.select("doc_id", *extra, "n_tokens", (F.col("known") + known).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"),
                       (F.col("seen") + more - F.col("n_tokens") * floor).alias("base_score"), (F.col("model") + more).alias("score"))


def score_documents(docs: DataFrame, training: Column, extra: dict[str, Column]) -> DataFrame:
    """Count, fit and score: learns from the rows where ``training`` holds, scores all."""
    learnt = docs.where(training)
    counts = stored(token_counts(learnt), "lm-counts")
    lex = lexicon(counts)
    return score(docs, counts, lex, fit(learnt, lex), extra)
