"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K

BATCH_ROWS = 1000
#: Bits of the filter that spares rows an exchange; when full it spares none.
FILTER_BITS = 1 << 24
#: The white space of every contract here: ASCII only.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session may lack the setting (tests); it then gets a folder of
    its own. On a cluster a missing setting is an error, as a machine-local
    folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for a result that stays."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def passing_path(spark: SparkSession, name: str) -> str:
    """A new path below a folder of this application in the shared folder, which goes when the driver ends."""
    sc = spark.sparkContext
    own = getattr(sc, "_tessera_folder", None)
    if own is None:
        own = sc._tessera_folder = shared_path(spark, "app")
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = passing_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers wherever the session runs.

    Arrow batches are held to BATCH_ROWS rows, as rows of whole texts are wide and both
    the JVM and the worker hold a batch in full.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-zip-"), "tessera_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hash_limit(share: float) -> int:
    """So many of all signed 64-bit hashes are at most this."""
    return min(2**63 - 1, int(share * 2**64) - 2**63)


def n_words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, native; 0 for null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE + "+"))).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def maybe_in(ids: DataFrame, column: str = "doc") -> Column:
    """A condition on a column that holds for every id in ids (doc), and for few others while the filter isn't full; neither holds nulls."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 64, K.U)
        for x in batches:
            h = K.mix(x.column("doc").to_numpy().view(K.U))
            np.bitwise_or.at(bits, ((h >> K.U(6)) % K.U(len(bits))).astype(np.int64), K.U(1) << (h & K.U(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits[at].view(np.int64))], ["at", "bits"])

    # FILTER_BITS / 64 rows at most
    rows = ids.select("doc").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, K.U)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(K.U)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def member(doc: pd.Series) -> pd.Series:
        own = shared.value
        h = K.mix(doc.to_numpy().view(K.U))
        return pd.Series(((own[((h >> K.U(6)) % K.U(len(own))).astype(np.int64)] >> (h & K.U(63))) & K.U(1)).astype(bool))

    return member(column)
