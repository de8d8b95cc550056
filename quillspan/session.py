"""Where derived tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for derived tables, visible to every executor.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without that
    setting gets a temporary folder of its own.
    """
    app = spark.sparkContext.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/quillspan/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="quillspan-")
    return _LOCAL_FOLDERS[app]



def new_path(spark: SparkSession, kind: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
