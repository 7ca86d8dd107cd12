"""Session helpers common to the operators: shared folder, partition counts, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that setting is absent and the master is local a temporary folder is made and set.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="casewright-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path for a table or archive set in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def partitions(df: DataFrame) -> int:
    """How many tasks share what ``df`` sends: the session's shuffle partitions, and two for each partition that is read.

    The second grows with the input, so that a task's share does not, whatever the session is set to.
    """
    spark = df.sparkSession
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def broadcast_checked(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast ``df`` only after counting that it has at most ``most_rows`` rows; else leave the join to AQE."""
    if df.count() <= most_rows:
        return F.broadcast(df)
    return df


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
