"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "casewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow; ``conf`` overrides anything, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    held = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in held.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def _shared(spark) -> str:
    """The checkpoint folder; a temporary one only where ``spark.checkpoint.dir`` is absent and the master local."""
    import tempfile

    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="casewright-"))
    return context.getCheckpointDir()


def cut_lineage(df):
    """A reliable checkpoint in ``spark.checkpoint.dir``."""
    _shared(df.sparkSession)
    return df.checkpoint()


def written(df):
    """A table written beside the checkpoints and read again.

    For loops: a checkpointed plan hands its constraints on, and constraints about columns that are renamed in every round
    multiply until the optimizer takes longer than the work.
    """
    import uuid

    path = f"{_shared(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df, column: str):
    """A table written beside the checkpoints in buckets of ``column``: joins on it in a loop do not shuffle it again."""
    import uuid

    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).option("path", f"{_shared(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
