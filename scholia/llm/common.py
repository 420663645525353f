"""What the corpus operators share: tables, the shared folder, session settings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch handed to Python; small, since one text can be very long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's spark.checkpoint.dir; where that is unset, a temporary folder on one machine only."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scholia-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends here and survives a lost executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and no other column than those named."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it clash with no column of df (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
