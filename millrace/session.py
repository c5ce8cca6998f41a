"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def build_session(cpus: int = 8, app: str = "millrace", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects of any cluster: UTC, ANSI SQL, AQE, Arrow."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MILLRACE_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and the master is local (tests, a laptop) a temporary folder is
    made, which goes when the process ends; a cluster without the setting is refused, for its machines
    share no temporary folder.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="millrace-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
