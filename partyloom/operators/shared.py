"""Tables in the folder that the cluster shares, to cut the lineage of loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """The folder that the cluster shares.  Where it is unset a local session gets one of its own; a cluster is refused."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="partyloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


#: Rows that a task takes of a table whose rows cost much.
DEALT_ROWS = 20_000


def dealt(df: DataFrame, rows: int = DEALT_ROWS) -> DataFrame:
    """df over tasks of about `rows` rows each: a file may hold all of its rows in one group, which one task reads."""
    return df.repartition(max(1, -(-df.count() // rows)))


def pinned(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/partyloom/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
