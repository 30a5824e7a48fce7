"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A run of bytes that are not ASCII white space: the word of every text operator here.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: Column | str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; a null id counts as empty text."""
    text = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(None)).cast("string")
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % divisor


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with only the ``used`` columns under their own names, and the columns that give all of them back."""
    names = [c if c in used else f"_kept_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


# -- shared folder -----------------------------------------------------------------

_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; under the warehouse where that is unset."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not named:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
            atexit.register(_clear, f"{named}/llm-{app}")
        _SCRATCH[app] = f"{named.rstrip('/')}/llm-{app}"
    return _SCRATCH[app]


def _clear(folder: str) -> None:
    jvm = SparkContext._jvm
    if jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stored:
    """A table written once to the shared folder; ``drop`` frees its space when no reader is left."""

    def __init__(self, df: DataFrame, name: str, compression: str = "snappy"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        # what was shuffled on the way goes with the write, not when the driver happens to collect its garbage
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", compression).parquet(self.path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` with a written table."""
    return Stored(df, name).df


def range_block(key: Column, edges: np.ndarray) -> Column:
    """Number of ``edges`` at or below ``key``: the range that holds it."""
    edges = np.asarray(edges, np.int64)

    @F.pandas_udf("int")
    def block(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(), "right").astype(np.int32))

    return block(key) if len(edges) else F.lit(0)


# -- texts inside tasks -------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column laid end to end, and n + 1 offsets; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def bounded(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about ``limit`` bytes of text each (a longer text stands alone)."""
    for batch in batches:
        size = np.frombuffer(pc.fill_null(pc.binary_length(batch.column(text)), 0).cast(pa.int64()).buffers()[1], np.int64)[: batch.num_rows] if batch.num_rows else np.zeros(0, np.int64)
        start, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply) on unsigned arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_ROOT = np.uint64(0x5851F42D4C957F2D)
# inverse of the odd root modulo 2^64, by Newton's iteration
_BACK = np.uint64(pow(int(_ROOT), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers modulo 2^64; kept for the texts to come up to a few megabytes."""
    out = _POWERS.get(int(base))
    if out is None or len(out) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n <= 1 << 22:
            _POWERS[int(base)] = out
    return out[:n]


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the first word of each text (n + 1 entries)."""
    solid = np.ones(len(data) + 1, dtype=bool)
    solid[:-1] = ~SPACE[data]
    solid[-1] = False
    begins = np.empty(len(data), dtype=bool)
    if len(data):
        begins[0] = solid[0]
        np.greater(solid[1:-1], solid[:-2], out=begins[1:])
        cut = off[:-1][off[:-1] < len(data)]
        begins[cut] = solid[cut]
    starts = np.flatnonzero(begins)
    stops = np.zeros(len(data) + 1, dtype=bool)
    stops[1:] = solid[:-1] & ~solid[1:]
    cut = off[1:]
    inner = cut[cut > 0]
    stops[inner] |= solid[inner - 1]
    ends = np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial of random byte values, mixed."""
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_ROOT, len(data)), out=acc[1:])
    back = powers(_BACK, len(data) + 1)
    return mix64((acc[ends] - acc[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _MULT)
