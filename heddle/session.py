"""Small helpers shared by the query modules."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalog:
    """Queries by name, with their SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, once for each application, unless they can import it as the driver does: from
    PYTHONPATH or from the folder that the driver was started in."""
    root = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and Path(p).resolve() == root for p in known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="heddle-"), "heddle.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.glob("heddle/**/*.py")):
            z.write(f, str(f.relative_to(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
