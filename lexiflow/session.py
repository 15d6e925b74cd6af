"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lexiflow") -> SparkSession:
    """Build (or reuse) a session with the settings every job here relies on.

    AQE is on so that small lookup sides (vocabularies, class tables, bucket
    counts) are broadcast from *runtime* sizes and skewed shuffle partitions
    are split; no join in the library forces a broadcast of a side whose size
    grows with the data.
    """
    master = master or os.environ.get("LEXIFLOW_MASTER")
    if master is None and "PYSPARK_GATEWAY_PORT" not in os.environ:  # spark-submit names its own master
        master = "local[8]"
    builder = SparkSession.builder if master is None else SparkSession.builder.master(master)
    builder = (
        builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEXIFLOW_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_CONFIGURED: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a shared, fault-tolerant folder and is used
    as is.  Only when it is unset (local tests) a private scratch folder is
    created and registered, so reliable ``checkpoint()`` works everywhere.
    """
    sc = spark.sparkContext
    if sc.applicationId in _CONFIGURED:
        return _CONFIGURED[sc.applicationId]
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        sc.setCheckpointDir(path)
    else:
        existing = sc.getCheckpointDir()  # set programmatically by the caller
        if existing:
            path = existing
        elif re.match(r"local(\[|$)", sc.master):
            path = tempfile.mkdtemp(prefix="lexiflow-ckpt-")
            sc.setCheckpointDir(path)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a shared, fault-tolerant folder on a cluster")
    _CONFIGURED[sc.applicationId] = path
    return path


def materialize(df):
    """Eagerly write ``df`` to the reliable checkpoint folder and continue
    from the written copy.

    Used for *fitted* artefacts (vocabularies, model tables, context
    examples) and for session-shared narrow tables: later plans read a small
    scan instead of re-deriving the lineage in every branch that uses it, and
    a lost executor costs a re-read, not a recomputation.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: for tables
    that are scanned many times, by some of their columns or by ranges of their order."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
