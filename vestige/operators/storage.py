"""The folder that a cluster shares, for tables between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder of ``spark.checkpoint.dir``, so that lost executors lose nothing."""
    ensure_folder(df.sparkSession)
    return df.checkpoint()


def ensure_folder(spark: SparkSession) -> str:
    """The shared folder. Only a session on one machine may do without one: it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="vestige-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{ensure_folder(spark)}/vestige/{name}-{uuid.uuid4().hex}"
