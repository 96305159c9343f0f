"""Session helpers: settings the operators rely on, and where durable files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # No call-site lookup for every column that is built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(cpus: int | str = "*", app: str = "netwatch", shuffle_partitions: int = 8,
                  **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folder of each local application that names none; a running session can't be given the setting.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A temporary one stands in only on a local master (tests), where all
    tasks share one disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        name = spark.sparkContext.applicationId
        if name not in _LOCAL:
            _LOCAL[name] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _LOCAL[name]
    return folder


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The frame as a parquet table in the shared folder: computed once, and safe when executors are
    lost. For results much smaller than what they are computed from and read several times."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
