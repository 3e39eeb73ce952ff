"""Cutting the lineage of what is computed in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own_folder: list[str] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that the cluster names in spark.checkpoint.dir and read back; where that is unset and all runs on one machine, to an own one.

    A table that is read has a known size; a checkpoint would keep the estimates of the plans before it, which multiply from round to round.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own_folder:
            _own_folder.append("file://" + tempfile.mkdtemp(prefix="foliant-rounds-"))
        folder = _own_folder[0]
    path = f"{folder.rstrip('/')}/rounds-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
