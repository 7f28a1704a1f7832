"""Cutting lineage in the folder that all hosts share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a session of one process may do without that setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all hosts share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(frame: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    _folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """The name of a folder beside the checkpoints that no one else uses."""
    return f"{_folder(spark)}/{uuid.uuid4()}"
