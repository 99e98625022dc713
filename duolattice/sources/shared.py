"""The folder that driver and executors share."""

from __future__ import annotations

import posixpath
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of spark.checkpoint.dir. Where it is unset a session of one machine gets a folder of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # The setting itself can't be changed in a running session.
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="duolattice-"))
        found = context._jsc.sc().getCheckpointDir().get()
    # A path without a scheme belongs to the cluster's default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return posixpath.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
