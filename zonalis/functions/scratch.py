"""Cut the lineage of iterative jobs with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the session's checkpoint folder.

    Only a local master without either gets a temporary folder, removed when Python ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="zonalis-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    The table survives the loss of executors, its readers still prune columns and row groups, and
    its size is known to the optimizer when it picks the next join. :func:`discard` removes it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/zonalis-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later action reads."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
