"""Scratch folders that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


@functools.cache
def _own_root() -> str:
    root = tempfile.mkdtemp(prefix="weftline-")
    atexit.register(shutil.rmtree, root, True)
    return root


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share; it goes when the driver ends.

    Only where the setting is absent in a local session, whose driver and executors are one process, a
    temporary folder is made. On a cluster without the setting this raises: executors would each write to
    a disk of their own, and what is read back would lack rows without a word.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or _own_root()
    path = f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's interpreter ends, if the session still lives then."""
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
