"""Session settings and checkpoints shared by every operator."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that matter for correctness or for plans at scale; sizes stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Bytes of rows, and one row more, that go to a Python worker at once in the pipeline.
BATCH = 2 << 20


def get_session(master: str = "local[*]", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session for tests and for the bench; on a cluster pass the session you have."""
    builder = SparkSession.builder.master(master).config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session, as in tests, gets a temporary folder where that is unset; on a cluster it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not re.match(r"local($|\[)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of about BATCH bytes, not ten thousand whole texts, from here on in this session.

    The JVM, outside its heap, and the worker both hold whole batches. The setting is read when a plan
    runs, so it stays; it never changes results, and a session's own lower limit stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    spark.conf.set(key, str(min(own, BATCH)))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, wherever it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, which outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
