"""Shared working folders for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by the session.

    Only a local master may go without the setting; it gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder shared by the cluster")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="trackwake-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder, one per query."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
