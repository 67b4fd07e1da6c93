"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ARCHIVE = "logwarden-package.zip"


def build_session(master: str | None = None, app: str = "logwarden", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    On a cluster the master, shuffle partitions and checkpoint folder come from spark-submit; only
    settings that change results (UTC) or plans (AQE) are pinned here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they run (once per Spark application)."""
    sc = spark.sparkContext
    if ARCHIVE not in sc._python_includes:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="spark-")) / ARCHIVE
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        sc.addPyFile(str(target))
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and sc.master.startswith("local"):
        shared = os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoint")
    if shared is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared checkpoint folder."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so a lost executor costs no recomputation."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read back: Spark then knows its size, as it does not of a checkpoint."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
