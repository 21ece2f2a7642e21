"""Tables kept in the folder that all executors share, so that jobs restart from there when executors are lost."""

from __future__ import annotations

import contextlib
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a local session gets a folder of its own; a cluster must
    name one, as a driver's folder is not its executors'."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="corpusatlas-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df written as parquet and read again. The folder stays unless inside `scratch`: a result may still be read from it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes on leaving what `keep` has written inside. For work whose result is stored by then."""
    mark = len(_KEPT)
    try:
        yield
    finally:
        while len(_KEPT) > mark:
            delete(spark, _KEPT.pop())


def release(*tables: DataFrame) -> None:
    """Deletes tables of `keep` that nothing reads any more."""
    for df in tables:
        for name in {f.split("/")[-2] for f in df.inputFiles()}:
            path = next(p for p in _KEPT if p.endswith(f"/{name}"))
            delete(df.sparkSession, path)
            _KEPT.remove(path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished work go from the executors' disks once the driver collects what refers to them."""
    gc.collect()
    spark._jvm.System.gc()
