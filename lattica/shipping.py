"""Sends the package to Python workers that would not find it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Once for each context: Spark carries a zip of the package (some 100 KB) from the driver to its executors, whatever
    paths the driver itself has.  On one machine (``local[...]``) workers share the driver's paths, and need it only where those
    do not lead here."""
    sc = spark.sparkContext
    here = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
    if getattr(sc, "_lattica", False) or alone and (ROOT in here or os.path.abspath(os.getcwd()) == ROOT):
        return
    at = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lattica-"), "lattica"), "zip", ROOT, "lattica")
    sc.addPyFile(at)
    sc._lattica = True
