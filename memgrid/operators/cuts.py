"""Cutting lineage between the rounds of a loop."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpointed(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """checkpoint() in the folder that driver and executors share; see shared_folder()."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(spark))
    return lambda df: df.checkpoint()


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and Spark runs in one process a temporary one."""
    shared, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not shared:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="memgrid-")
            atexit.register(shutil.rmtree, _own[context.applicationId], ignore_errors=True)
        shared = _own[context.applicationId]
    return shared.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one."""
    return f"{shared_folder(spark)}/memgrid-{name}-{uuid.uuid4().hex}"
