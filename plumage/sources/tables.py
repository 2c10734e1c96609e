"""Tables written and read again, in storage that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame

_local: list[str] = []


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read again.

    In one process (tests) a temporary folder serves where the setting is missing.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _local:
            _local.append(os.path.join(tempfile.gettempdir(), "checkpoints", f"plumage-{uuid.uuid4().hex}"))
            atexit.register(shutil.rmtree, _local[0], True)
        root = _local[0]
    path = f"{root.rstrip('/')}/plumage/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
