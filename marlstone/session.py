"""One place for the session settings that the library relies on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "marlstone", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with UTC, AQE and skew handling on; master and partitions only where given, so a cluster's own win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where it is unset and Spark runs in this process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a session, so that they need no path to it."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_shipped_package", None) == root or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="marlstone-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._shipped_package = root
