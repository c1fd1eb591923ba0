"""Session for tests, the bench and interactive work; on a cluster the given session is used as it is."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, name: str = "skein") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by spark.checkpoint.dir; only in local mode, as in tests, a temporary
    one where the session names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context = spark.sparkContext
    if not hasattr(context, "_skein_folder"):
        context._skein_folder = tempfile.mkdtemp(prefix="skein-checkpoint-")
    return context._skein_folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, unless the context already has one of its own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))


def let_go(spark: SparkSession) -> None:
    """Has both garbage collectors run, so that the files of shuffles that nothing refers to any more (a checkpoint has
    taken their place) leave the disks now and not when the driver's memory happens to fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def work_folder(spark: SparkSession) -> str:
    """A new folder where all executors can read and write."""
    return f"{shared_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context: their Python workers import it, and executors that join
    later get it too. The archive is read from the driver only."""
    context = spark.sparkContext
    if getattr(context, "_skein_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="skein-")) / "skein.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._skein_shipped = True
