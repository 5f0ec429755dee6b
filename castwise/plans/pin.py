"""Cuts a plan's lineage with a reliable checkpoint, so that what follows is planned from rows, not from all that led there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder that goes when the driver
    ends; on a cluster that is an error, since executors can't see each other's disks.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(sc, "_castwise_shared", None)
        if base is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="castwise-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = sc._castwise_shared = "file://" + own
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


def pinned(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder: they survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a table written to the shared folder and read again.

    For rounds of joins: the new plan knows the table's real size, whereas a checkpoint keeps the
    estimate, which multiplies with every join.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
