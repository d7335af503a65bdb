"""What the operators share: the shared folder and cutting a plan's lineage there."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, the context's checkpoint folder; where there is none either, a local master (whose
    driver and executors are one process) gets a folder of its own, and any other an error: executors elsewhere
    would not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        if base.isDefined():
            base = base.get()
        elif spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-kb-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return f"{base.rstrip('/')}/kbspark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and read again if an executor is lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it, that no column of df has: what an operator adds for itself must not meet the caller's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(*cols: str):
    """A column in [0, 1) that depends on the values alone: the same rows are sampled on every run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def _give_back() -> None:
    """Freed memory goes back to the system: Python's, Arrow's, and what the C library would keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_held: dict = {}


def held(name: str, make):
    """What a Python worker keeps between tasks: the state of the operator that ran last, and of no other.

    Workers are used again by later jobs, so without this the caches of several operators would add up."""
    if name not in _held:
        _held.clear()
        _give_back()
        _held[name] = make()
    return _held[name]
