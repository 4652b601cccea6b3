"""Tables that many later steps read."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cellweave-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, without its lineage: a checkpoint in the folder that spark.checkpoint.dir names. A local session
    without one gets a temporary folder; a cluster without one recomputes what it loses."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            return df.persist()
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellweave-"))
    return df.checkpoint()
