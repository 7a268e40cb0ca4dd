"""The Spark session, and the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "parquarry", **conf: str) -> SparkSession:
    """The running session, or a new one with the settings this library expects.

    UTC keeps epoch and zone-less casts the same everywhere; ANSI stays on, so a bad cast fails
    instead of giving null. Sizes of shuffles are the cluster's business.
    """
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in the checkpoint directory that was set; without either in
    a temporary folder on one machine, and an error on a cluster, whose executors share no such folder."""
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if base is None:
        if re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parquarry-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
