"""Folds over keyed streams in event-time order.

Rows of a key wait in state until the watermark has passed them and are then folded in order of
time, whatever micro-batch or file brought them. A row older than the watermark is late: the engine
drops and counts it (``late_rows``), so it never reaches a fold that has gone past it. What
comes out is therefore the batch fold over the same rows up to the watermark; the hours
after it stay in state and come out when later rows, or a restarted query, move it on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DELAY = "2 hours"


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") // 1000


class OrderedFold(StatefulProcessor):
    """Fold of a key's rows by event time with a small JSON document as state.

    State: the document (``fold``); the rows that wait, a list of chunks with the time of their
    first row (``waiting``); the time of the one timer that is set (``due``), just after the
    first row that waits. Memory for a key is what it received within the watermark's delay and one micro-batch.

    A state costs calls and small tables whatever it holds. With ``together``, for keys of few rows, those that
    share the first key column are one state, whose document holds theirs by the other columns (``inner``).
    """

    order: list[str] = ["ts"]
    output: str
    together = False
    inner: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "doc string")
        self.waiting = handle.getListState("waiting", "first long, chunk binary")
        self.due = handle.getValueState("due", "at long")

    def start(self) -> dict:
        return {}

    def fold(self, key: tuple, doc: dict, rows: pd.DataFrame) -> pd.DataFrame:
        """Output of ``rows``, which are in order and follow all earlier ones; changes ``doc``."""
        raise NotImplementedError

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Go on from a stored document (column ``doc``)."""
        docs = initialState["doc"].tolist()
        if self.inner:
            docs = [json.dumps({json.dumps(k): json.loads(doc) for k, doc in zip(initialState[self.inner].values.tolist(), docs)})]
        self.state.update((docs[0],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        firsts = []
        for part in rows:
            first = int(_millis(part["ts"]).min())
            self.waiting.appendValue((first, _packed(part)))
            firsts.append(first)
        now = self.due.get()
        self._wake(min(firsts), now[0] if now else None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs()
        ready, later = [], []
        for first, chunk in self.waiting.get():
            if first >= edge:
                later.append((first, chunk))
                continue
            rows = _unpacked(chunk)
            at = _millis(rows["ts"])
            ready.append(rows[at < edge])
            if (at >= edge).any():
                rest = rows[at >= edge]
                later.append((int(at[at >= edge].min()), _packed(rest)))
        if later:
            self.waiting.put(later)
            self._wake(min(first for first, _ in later))
        else:
            self.waiting.clear()
            self.due.clear()
        kept = self.state.get()
        doc = json.loads(kept[0]) if kept else self.start()
        outs = self._folded(key, doc, pd.concat(ready).sort_values(self.order, kind="stable").reset_index(drop=True)) if ready else []
        self.state.update((json.dumps(doc),))
        outs = [out for out in outs if len(out)]
        if outs:
            yield pd.concat(outs) if len(outs) > 1 else outs[0]

    def _folded(self, key: tuple, doc: dict, rows: pd.DataFrame) -> list[pd.DataFrame]:
        if not self.inner:
            return [self.fold(key, doc, rows)]
        outs = []
        for other, part in rows.groupby(self.inner, dropna=False):
            other = [x if x == x else None for x in other]
            outs.append(self.fold((*key, *other), doc.setdefault(json.dumps(other), self.start()), part.reset_index(drop=True)))
        return outs

    def _wake(self, first: int, now: int | None = None) -> None:
        """Have the key called once the watermark is past ``first``; ``now`` is the timer that is set already, if one is."""
        at = first + 1
        if now is not None:
            if now <= at:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        self.due.update((at,))

    def close(self) -> None:
        pass


def ordered_stream(stream: DataFrame, keys: list[str], processor: OrderedFold, delay: str = DELAY, start: DataFrame | None = None) -> DataFrame:
    """Fold a stream by ``keys`` in order of ``ts`` (RocksDB state store required).

    ``delay`` is how far rows may lag behind the newest one. ``start`` (the keys and ``doc``)
    holds the state that the keys begin with at the first start of the query.
    """
    held = keys[:1] if processor.together else keys
    processor.inner = keys[len(held):]
    begun = {} if start is None else {"initialState": start.select(*keys, "doc").groupBy(*held)}
    return stream.withWatermark("ts", delay).groupBy(*held).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="append", timeMode="eventTime", **begun)


def fold_states(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The keys and ``doc`` of every state of a stopped query that ran in ``folder`` (as ``drain`` lays it out); ``keys`` as the states have them."""
    read = spark.read.format("statestore").option("stateVarName", "fold").load(f"{folder}/checkpoint")
    return read.select(*[F.col(f"key.{k}").alias(k) for k in keys], F.col("value.doc").alias("doc"))


def late_rows(reports: list) -> int:
    """Rows that came behind the watermark and were left out, from a query's progress reports."""
    return sum(op.numRowsDroppedByWatermark for report in reports for op in report.stateOperators)
