"""Session settings."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "warmgrid", cores: int = 8, shuffle: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_ROOTS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; under the warehouse where it names none."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not named:
            named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
            atexit.register(_clear, f"{named}/warmgrid/{app}")
        _ROOTS[app] = named
    return _ROOTS[app]


def _clear(folder: str) -> None:
    """Remove what this application stored under the warehouse; works after the session has stopped, too."""
    jvm = SparkContext._jvm
    if jvm is not None:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def inputs_of(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files in ``folder``: a stored table made from other files is another one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return "|".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))


_STORED: dict[tuple[str, str, str], str] = {}


def stored_table(spark: SparkSession, scope: str, name: str, build) -> DataFrame:
    """Write ``build()`` once per application and read it back as a columnar table.

    Cuts lineage where one table feeds many branches of a plan: the branches then
    scan only their columns, and a lost executor re-reads instead of recomputing.
    """
    key = (spark.sparkContext.applicationId, f"{scope}#{inputs_of(spark, scope)}", name)
    if key not in _STORED:
        path = f"{checkpoint_root(spark)}/warmgrid/{key[0]}/{uuid.uuid4().hex}/{name}"
        build().write.mode("overwrite").parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
