"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read back: computed once, and safe when executors are lost.

    Only where the setting is absent and the master is local, as in tests, is a folder of this machine used.
    """
    spark, schema = df.sparkSession, df.schema
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.gettempdir(), f"stemma-{os.getuid()}").as_uri()
    to = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(to)
    return spark.read.schema(schema).parquet(to)
