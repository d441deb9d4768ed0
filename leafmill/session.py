"""Session settings that the library's plans are made for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Rows and bytes of a batch.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def get_session(name: str = "leafmill", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew handling; partition counts are left to it."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    own = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.session.timeZone": "UTC"} | BATCHES
    for k, v in (own | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def bounded_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches that are small in rows and bytes, so that what a worker holds doesn't grow with its task's rows."""
    for name, most in BATCHES.items():
        spark.conf.set(name, most)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; where that is unset on a local master, below a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="leafmill-")
    return f"{shared.rstrip('/')}/leafmill/{name}-{uuid.uuid4().hex}"
