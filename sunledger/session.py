"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Only at start-up: no call-site capture on every DataFrame call.
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set what the semantics depend on (UTC instants, ANSI errors) on any session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "sunledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STARTUP, **conf}.items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder:
    on a cluster a machine-local path would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):     # local-cluster is a cluster
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
