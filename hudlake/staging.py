"""Tables in a folder that every executor sees, written once and read again: they cut lineage and make costly passes run once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def own_folder() -> str:
    path = tempfile.mkdtemp(prefix="hudlake-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees.

    Where that is unset, a local master, all of whose threads see one disk, gets a temporary folder that ends
    with the process; a cluster gets a folder in the warehouse. The session's settings are left alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        base = own_folder() if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/hudlake-stages"
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder, by default with the session's compression, and read it back.

    This cuts the lineage at a place that survives lost executors, and makes sure that costly
    Python passes below it run once.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    return staged


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_stage(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        drop_path(df.sparkSession, df._staged_path)
