"""Tables that an operator writes between two of its jobs.

They go to the folder that the session names in ``spark.checkpoint.dir``, which driver and
executors share, so a lost executor costs a task and not the job. Only where that setting is
absent on a local master (tests on one machine) is a folder of our own used, which goes when the process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.leafmill.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    own = spark.conf.get(_OWN, None)
    if not own:
        own = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set(_OWN, own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete a table that materialize wrote and no later step reads."""
    spark, paths = table.sparkSession, {x.rsplit("/", 1)[0] for x in table.inputFiles()}
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions_for(df: DataFrame, bytes_each: int = 64 << 20, factor: float = 1.0) -> int:
    """Partitions for an exchange of df: the session's number, or more so that none gets over about bytes_each,
    where the exchanged rows take `factor` times what the tables that df reads do."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    known = sum(x for x in sizes if x < 1 << 60)  # others say that they don't know
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1 << 17, int(known * factor) // bytes_each))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, so a run of very long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
