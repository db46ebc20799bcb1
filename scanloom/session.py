"""Sessions with sensible settings, and sending this package to executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def session(name: str = "scanloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by name with ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def send_package(spark: SparkSession) -> None:
    """Gives executors this package, once for each application; for tasks that run its Python code."""
    application = spark.sparkContext.applicationId
    if application in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="scanloom"), "scanloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("scanloom", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)
    _sent.add(application)
