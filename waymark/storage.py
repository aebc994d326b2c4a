"""Writing intermediate tables to the folder that the driver and the executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local sessions use the warehouse; a cluster has to name its folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def written(df: DataFrame, what: str, kept: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: this cuts its lineage and outlives executors.

    A kept table outlives the `passing` block that it is written in, and belongs to the block around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    blocks = _PASSING.get()[: -1 if kept else None]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of the tables that open blocks write for a time only, the innermost last; each thread has its own blocks.
_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete the tables written inside once the block ends; what is needed later has to be written with `kept`."""
    token = _PASSING.set((*_PASSING.get(), []))
    try:
        yield
    finally:
        paths = _PASSING.get()[-1]
        _PASSING.reset(token)
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
