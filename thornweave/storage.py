"""Tables in the folder that all machines share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is named, a temporary one, but only if all runs in one process (local[...])."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="thornweave-"))
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Narrow rows that are worth a file.
ROWS_A_FILE = 10_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many narrow rows, in as many partitions as they are worth: a small table isn't written as a file for each shuffle partition."""
    return df.repartition(max(1, -(-rows // ROWS_A_FILE)))


#: Narrow rows up to which a table is broadcast.
FEW_ROWS = 200_000


def small(df: DataFrame, rows: int, limit: int = FEW_ROWS) -> DataFrame:
    """df with a hint to broadcast it if it has few rows; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of fresh_path() that nothing will read again."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it. A cluster without that path gets it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    own = spark.sparkContext.environment
    if root not in own.get("PYTHONPATH", "").split(os.pathsep):
        own["PYTHONPATH"] = os.pathsep.join(filter(None, [root, own.get("PYTHONPATH", "")]))


def in_arrow(f: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """For DataFrame.transform: mapInArrow() with this package at hand."""

    def run(df: DataFrame) -> DataFrame:
        on_workers(df.sparkSession)
        return df.mapInArrow(f, schema)

    return run
