"""Tables, lineage cuts and session settings shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table; naming the columns keeps the scan narrow whatever follows (e.g. a Python stage)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on this machine alone (tests, a laptop) may leave it unset: then it is a temporary folder here.  On a
    cluster that would be a folder which other machines do not see, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.environ.get("EVIDENCIA_SHARED_DIR")
    if not own:
        own = tempfile.mkdtemp(prefix="evidencia-")
        os.environ["EVIDENCIA_SHARED_DIR"] = own
    return own


def stored(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again.

    The lineage ends there: what follows re-reads files that outlive any executor, and a plan that uses the
    result twice computes it once.  The files are deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evidencia-{uuid.uuid4().hex}"
    (df.select(*columns) if columns else df).write.mode("error").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.select(*columns).schema if columns else df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """Shuffle partitions in force, the unit in which bounded fan-outs are sized."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` over at least as many partitions as the session shuffles into.

    A Python stage over a small file would otherwise run in as many tasks as the file has splits.
    Large inputs, which have more splits than that, are left as they are.  For scans without a shuffle: counting the
    partitions of a shuffled frame would run the shuffle, see ``dealt``.
    """
    want = max(slots(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism)
    if df.rdd.getNumPartitions() >= want // 2:
        return df
    return df.repartition(want, *columns) if columns else df.repartition(want)


def dealt(df: DataFrame) -> DataFrame:
    """The rows of an aggregate over as many partitions as the session shuffles into, for a Python stage behind it.

    Adaptive execution would join the small partitions of an aggregate, and a costly stage would run in one task.
    """
    return df.repartition(max(slots(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism))
