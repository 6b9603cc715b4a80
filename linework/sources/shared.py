"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The frame written below spark.checkpoint.dir and read back: its lineage ends there, and a lost executor costs no more than the
    tasks it was running. Without that setting only a local session has a folder of its own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.linework.localKept", None) or tempfile.mkdtemp(prefix="linework-")
        spark.conf.set("spark.sql.linework.localKept", folder)
    path = f"{folder.rstrip('/')}/linework/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
