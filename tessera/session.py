"""Session settings, and the package itself for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_shipped: dict[str, str] = {}


def session(master: str = "local[*]", name: str = "tessera", **more: str) -> SparkSession:
    return SparkSession.builder.master(master).appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Executors import this package from a zip that the driver serves, so nothing has to be installed on them."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tessera-zip-")) / "tessera_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"tessera/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))
    _shipped[app] = str(path)
