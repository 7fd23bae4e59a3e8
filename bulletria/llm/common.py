"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is named and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="bulletria-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written in the shared folder.

    Later stages read the files, so a lost executor costs them nothing.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a materialize() that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_struct(df: DataFrame) -> Column:
    """The whole row in one column, so that names can't clash with ours."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def slices(n: int, bounds: np.ndarray):
    """Index pairs of consecutive bounds."""
    return zip(bounds[:n], bounds[1 : n + 1])


def scatter(schema: pa.Schema, place: np.ndarray, record: np.ndarray) -> pa.RecordBatch:
    """One row a destination: its number and the records that go there.

    Thousands of fixed-width records travel as one binary value, which spares
    the shuffle its cost by row.
    """
    order = np.argsort(place, kind="stable")
    place, record = place[order], np.ascontiguousarray(record[order])
    cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(place)] if len(cuts) else cuts
    parts = [record[a:b].tobytes() for a, b in zip(cuts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(place[cuts]).cast(schema.field(0).type), pa.array(parts, pa.binary())], schema=schema)


SCATTER = pa.schema([("place", pa.int32()), ("records", pa.binary())])
SCATTER_DDL = "place int, records binary"


def gathered(records: pa.ChunkedArray, dtype: np.dtype) -> np.ndarray:
    """The records that scatter() sent to one place."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for chunk in records.chunks for x in chunk]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def give_back() -> None:
    """What a pass has freed goes back to the system; allocators would keep it while the worker waits beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ascii_words(text: Column) -> Column:
    """Words of lower-case ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), F.lit(1))
