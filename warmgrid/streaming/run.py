"""Drive a stream over whatever its source holds now, into a Parquet table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from warmgrid.session import checkpoint_root
from warmgrid.streaming.jobs import ROCKS


def drain(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", folder: str | None = None, state_partitions: int | None = None, reports: list | None = None) -> DataFrame:
    """Process everything available, commit, and read the sink back.

    Sink and offsets live under ``folder``; a restarted driver that names the same
    folder resumes where it stopped. Without one a new folder is taken under the
    shared checkpoint folder. ``state_partitions`` fixes the state's partitions at
    the first start; otherwise the session's shuffle partitions hold. ``reports``
    takes the query's progress reports.
    """
    base = folder or f"{checkpoint_root(spark)}/warmgrid/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if state_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(state_partitions))
    try:
        done = _finish(stream, base, mode)
        if reports is not None:
            reports += done
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _finish(stream: DataFrame, base: str, mode: str) -> list:
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return q.recentProgress
