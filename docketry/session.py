"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(master: str | None = None, **settings) -> SparkSession:
    """A session with the settings this package is tuned for; ``settings`` win."""
    builder = SparkSession.builder.appName("docketry")
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder the cluster names.

    Only where no such folder is set and all tasks run on this machine (tests)
    a temporary one is made and set; a cluster has to name its own.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_SETTING
    )
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="docketry-")
        spark.conf.set(CHECKPOINT_SETTING, base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")
