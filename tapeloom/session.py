"""Sessions and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(name: str = "tapeloom", **conf) -> SparkSession:
    """A session with the settings the operators want: adaptive plans, skew joins, UTC."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir; below a temporary one of our own only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tapeloom-")
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
