"""Shipping this package to the executors of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package's source to the session's Python files, once for each application.

    Executors then import it wherever their working folder is.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_path(spark: SparkSession, name: str) -> str | None:
    """A fresh path in the folder that spark.checkpoint.dir names, which all executors share.

    Without the setting it is a temporary folder where the master is this machine, and None on
    a cluster, whose executors have no folder in common.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            return None
        named = "file://" + tempfile.mkdtemp(prefix="plyforge-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
