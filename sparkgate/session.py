"""Session helpers: configuration, shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that make results reproducible; a cluster's own sizing settings are left alone.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    conf = BASE_CONF | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.driver.host": "127.0.0.1"} | extra
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-sparkgate-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkgate-{name}-{uuid.uuid4().hex}"


#: Folders written within settled(), a list per call that is not done.
_written: list[list[str]] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df to the shared folder and read it back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if _written:
        _written[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What make() gives, written; every table that make() wrote on its way is deleted, whether it succeeds or not."""
    _written.append([])
    try:
        out = make()
        steps = _written.pop()
        try:
            return materialize(out, name)
        finally:
            _written.append(steps)
    finally:
        for path in _written.pop():
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sparkgate-" in path:
            remove_path(df.sparkSession, path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Within it, batches that Spark sends to Python take about `size` bytes: rows of some hundred KB would fill up to 64 MB, held on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@contextmanager
def unbroadcast(spark: SparkSession) -> Iterator[None]:
    """Within it, no table is sent to the driver to be joined, however small it seems: each takes pages of some MB of the driver's heap, and keeps them for as long as its plan is known."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
