"""Tables that cut lineage, in the folder that the driver and all executors share.

The folder is the one named by ``spark.checkpoint.dir``. Only where a session has none and its master is local (tests) is a
temporary folder made and set as the session's own; on a cluster a machine's own folder would scatter the tables.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; sets a local one where the session names none."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there.

    With ``by``, its last column, each of that column's values gets a folder, so that a filter on it reads its own rows alone.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more. What isn't one of ``stored`` is passed over."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            drop(t.sparkSession, path)
