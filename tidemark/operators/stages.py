"""Intermediate tables: long compositions are cut where several branches read one result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

from ..errors import PipelineError


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names (a temporary one where it is unset and all runs on this machine) and read back.

    The rows are made once for all branches, and a lost executor costs a read, not the lineage.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise PipelineError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LOCAL: dict[str, str] = {}
