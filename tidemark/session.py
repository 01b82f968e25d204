"""Session defaults and the shared folder used to pin intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # One hash exchange on `code` then serves joins on (code, d) and windows on code.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(master: str | None = None, name: str = "tidemark", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A folder of this machine stands in only where all executors run in this process."""
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        context.setCheckpointDir(folder)
    return folder


class Pins:
    """Owner of the tables pinned while it is entered: ``with owner: ...``. ``clear`` deletes these and no others.

    For callers whose results are stored elsewhere by now. What is pinned outside of any owner stays until the folder is cleaned.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Pins:
        _OWNERS.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNERS.remove(self)

    def clear(self, spark: SparkSession) -> None:
        while self.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_OWNERS: list[Pins] = []  # those entered, the innermost last


def pin(df: DataFrame, label: str = "t", keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; it belongs to the innermost owner entered unless it is to be kept.

    Cuts lineage, survives lost executors, and gives Catalyst the real table size, so a later
    join broadcasts it only when that size is below the session's threshold.
    """
    path = f"{shared_folder(df.sparkSession)}/pinned/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _OWNERS and not keep:
        _OWNERS[-1].paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
