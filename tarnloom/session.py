"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that Python functions find it there."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="tarnloom-"), "tarnloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, f"{root.name}/{path.relative_to(root)}")
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    return spark


def config_path(value: str, root: str | Path) -> str:
    """A configured path made absolute: as given, else a file below the working folder, else one below ``root``; empty stays empty."""
    if not value:
        return value
    path = Path(value).expanduser()
    if path.is_absolute():
        return str(path)
    tried = [(base / path).resolve() for base in (Path.cwd(), Path(root))]
    return str(next((p for p in tried if p.is_file()), tried[0]))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine: UTC, adaptive execution, few shuffle partitions."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tarnloom")
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    } | conf
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)
