"""Session builder with the settings the operators are tuned for."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sievelight", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on. ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; one is set only where none is configured.

    Clusters name the folder in ``spark.checkpoint.dir``. Only a local session, as in tests, gets a
    machine-local folder.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """``frame`` written to the shared checkpoint folder, so lost executors never repeat its past."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


#: Whether Spark removes the shuffle files of a query when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` as compressed files in the shared checkpoint folder; what was shuffled to make it is removed at once."""
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def unstored(frame: DataFrame) -> None:
    """Removes the files of a :func:`stored` frame that nothing reads any more."""
    spark = frame.sparkSession
    for folder in {file.rpartition("/")[0] for file in frame.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unsent(frame: DataFrame) -> DataFrame:
    """``frame`` for the side of a join that grows with the data: it is sorted, and never sent whole to the driver and all tasks.

    Spark takes the size of files, which may be a tenth of the rows in them, for the size of the side.
    """
    return frame.hint("merge")
