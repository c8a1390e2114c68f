"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "staygrid", master: str | None = None, **conf) -> SparkSession:
    """A session with AQE (incl. skew-join splitting) and UTC.

    Shuffle partitions are left to AQE on a cluster: start high and let
    coalescing shrink them.  Local runs pass ``master`` and get a small number.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        # Small shuffles stay on all local cores instead of being merged into one task.
        b = (b.master(master).config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k"))
    for key, value in conf.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    Python workers import the modules whose functions they run; this makes that
    work from any folder and on any node.  Where the package is installed on the
    nodes, the copy is the same.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # addPyFile serves the file to the executors; only the driver reads it from here.
    target = os.path.join(tempfile.mkdtemp(prefix="staygrid-"), "staygrid.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.join("staygrid", os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall
    back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="staygrid-")
    return _LOCAL_SCRATCH[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused between runs."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Write ``df`` once to the shared folder and read it back.

    Unlike caching, the result survives the loss of executors, and every
    consumer sees the same rows even if the plan is not deterministic.
    """
    spark = df.sparkSession
    path = work_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df, *keys: str, bytes_per_task: int = 512 * 1024):
    """Use all cores for work that is heavy per row, when the reader would not.

    A file with few row groups is read by few tasks.  If the estimated size
    gives the reader fewer tasks than there are cores, rows are hashed by
    ``keys`` (unique ids, so evenly).  Large inputs already have enough splits
    and are returned as they are, without a shuffle.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    tasks = min(cores, size // bytes_per_task)
    if size // split >= cores or tasks <= 1:
        return df
    return df.repartition(int(tasks), *keys)
