"""SparkSession construction.

Cluster settings (master, executor sizing, ``spark.checkpoint.dir``) come from
``spark-submit``; this module only fills in what a local test run lacks.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library relies on.  They are defaults: a value
# already present in the cluster configuration wins.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Windowed top-k (row_number <= k) runs a partial limit before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def build_session(app: str = "tidewatch", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g") -> SparkSession:
    """Session for tests and the local benchmark."""
    return build_session(master=f"local[{cpus}]", shuffle_partitions=shuffle_partitions,
                         extra={"spark.driver.memory": driver_memory})


_CHECKPOINTS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session (driver and executors are one process) may go without the setting: it
    gets a fresh scratch folder.  Elsewhere a machine-local folder would lose data, so the
    setting is required.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidewatch-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if _CHECKPOINTS.get(sc.applicationId) != path:
        sc.setCheckpointDir(path)
        _CHECKPOINTS[sc.applicationId] = path
    return path


def materialized(df):
    """Compute ``df`` once and keep it in the shared checkpoint folder: later reads neither
    recompute it nor depend on one executor's disk."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidewatch`` importable in the Python workers of this application.

    Pandas UDFs and ``mapInPandas`` functions refer to package functions, so
    executors must import the package.  The source is zipped once per
    application on the driver and distributed with ``addPyFile`` (the same as
    ``spark-submit --py-files``): only the driver reads the zip and serves it
    to the executors.  Set ``spark.tidewatch.shipPackage=false`` where the
    package is installed on the executors.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if spark.conf.get("spark.tidewatch.shipPackage", "true").lower() == "false":
        _SHIPPED.add(sc.applicationId)
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="tidewatch-pyfiles-"), "tidewatch.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
