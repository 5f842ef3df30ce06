"""Sessions, and the package itself on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def session(app: str = "tangency", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; an existing session is used as it is."""
    builder = SparkSession.builder.appName(app)
    own = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for key, value in (own | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tangency-code-"), "tangency_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tangency", os.path.relpath(full, here)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
