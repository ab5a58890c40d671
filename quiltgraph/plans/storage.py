"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


_written: dict[str, list[str]] = {}


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    spark.checkpoint.dir names that folder on a cluster, where its lack is an error; on one machine (a local master) a
    folder in /tmp is set as the checkpoint folder first.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(f"file:///tmp/checkpoints/{sc.applicationId}")
            held = sc._jsc.sc().getCheckpointDir()
        root = held.get()
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _written.setdefault(sc.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> None:
    """Deletes all that this session's operators have written to the shared folder. Tables that they returned can't be
    read any longer, so save those first."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost
    executor costs nothing that is already written. Options are the writer's."""
    path = work_dir(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
