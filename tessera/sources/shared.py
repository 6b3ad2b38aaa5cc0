"""A place that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from typing import BinaryIO

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may lack it (tests), and then gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}/{name}"


def spool(spark: SparkSession, source: BinaryIO, name: str) -> str:
    """What source has, as a file in the shared folder."""
    path = new_path(spark, name)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        while chunk := source.read(1 << 20):
            out.write(bytearray(chunk))
    finally:
        out.close()
    return path
