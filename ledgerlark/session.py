"""Session helpers: local sessions for tests and the bench, shared scratch space, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK_CONF = "spark.ledgerlark.rowsPerTask"
ROWS_PER_TASK_DEFAULT = 4_000_000


def local_session(cores: int | str = 8, app: str = "ledgerlark", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this library to the executors' Python workers.

    Not needed where it is installed on every machine; harmless there, and done once per application.
    """
    name = f"ledgerlark-{spark.sparkContext.applicationId}.zip"
    if any(os.path.basename(f) == name for f in spark.sparkContext.listFiles):
        return
    root = Path(__file__).resolve().parent
    # The driver serves the archive to executors as long as the application runs.
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlark-"), name)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)


def rows_per_task(spark: SparkSession) -> int:
    """How many history rows of one key a single task may scan before the key is split by time."""
    return int(spark.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK_DEFAULT)))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    A machine-local folder is used only where the session names none, as in local tests.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = tempfile.mkdtemp(prefix="spark-")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        spark.conf.set("spark.checkpoint.dir", shared)
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the reliable checkpoint folder and continue from the written copy."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_dir(spark, "checkpoints"))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write the frame as a table of the shared folder and continue from it.

    For loops: unlike a checkpoint, the table carries no constraints of the plan behind it into the next round, and
    its size is known to the planner.
    """
    path = scratch_dir(df.sparkSession, "table")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stashed = path
    return table


def discard(*frames: DataFrame | None) -> None:
    """Delete the files of written frames that nothing will read again; other frames are left alone."""
    for df in frames:
        if path := getattr(df, "stashed", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
