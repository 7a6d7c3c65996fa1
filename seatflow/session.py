"""Session settings and the shared working folder.

Operators never depend on these settings for correct results; they only make
the plans better (adaptive execution, skew splitting, state on disk).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Call sites for error messages cost a stack walk per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Shuffles start wide and are merged to the advisory size once their real size is
# known; large scan splits keep the number of map tasks of a 100 TB read in bounds.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app: str = "seatflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package settings; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            cores = master[6:-1] if "[" in master else "1"
            cores = str(os.cpu_count()) if cores == "*" else cores
            builder = (
                builder.config("spark.sql.shuffle.partitions", cores)
                .config("spark.ui.enabled", "false")
                .config("spark.driver.memory", "8g")
                # Little data on few cores: keep all cores busy all the same.
                .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            )
    if not (master or "").startswith("local"):
        conf = {**CLUSTER_SETTINGS, **conf}
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master, where driver and
    executors are the same machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="seatflow-", dir="/tmp")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/seatflow/{name}-{uuid.uuid4().hex}"


def use_checkpoints(spark: SparkSession) -> None:
    """Point Spark's own checkpoints (used by iterative training) at the shared folder."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")
