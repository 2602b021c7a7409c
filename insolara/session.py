"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "insolara", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution switched on.

    On a cluster leave ``master`` and the resource settings to spark-submit.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where the package is not installed on the executors.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    stem = os.path.join(tempfile.mkdtemp(prefix="insolara-code-"), "insolara")
    context.addPyFile(shutil.make_archive(stem, "zip", os.path.dirname(here), os.path.basename(here)))
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, since
    executors on other machines could not read it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        own = tempfile.mkdtemp(prefix="insolara-")
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir()
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below :func:`scratch_dir`."""
    return os.path.join(scratch_dir(spark), f"{label}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives lost executors)."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
