"""What a Spark session needs for this library's jobs."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see (spark.checkpoint.dir). Only a local session may go without one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.gettempdir()}"
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, for what several branches of a plan start from."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the session's executors, once for each Spark application.

    Python functions in jobs import it there; executors need no copy of their own.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        with tempfile.TemporaryDirectory() as d:
            tree = shutil.copytree(here, f"{d}/src/{os.path.basename(here)}", ignore=shutil.ignore_patterns("__pycache__"))
            archive = shutil.make_archive(f"{d}/{os.path.basename(here)}-{abs(hash(app))}", "zip", os.path.dirname(tree))
            kept = shutil.copy(archive, tempfile.gettempdir())
        spark.sparkContext.addPyFile(kept)
        _shipped.add(app)
    return spark
