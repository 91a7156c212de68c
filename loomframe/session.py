"""Session settings that hold on a laptop and on a cluster alike."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # cost-based join order where tables have statistics
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
}


def session(name: str = "loomframe", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; `more` adds settings, with _ for the dots of their names after spark."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {f"spark.{k.replace('_', '.')}": v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@functools.cache
def _own_folder() -> str:
    path = f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of this process only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless their path has it; once a context."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if getattr(context, "_loomframe_shipped", False):
        return
    there = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    if root not in there:
        # On the driver alone: executors fetch it from there.
        folder = tempfile.mkdtemp(prefix="loomframe-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        file = Path(folder) / "loomframe.zip"
        with zipfile.ZipFile(file, "w") as out:
            for source in sorted((root / "loomframe").rglob("*.py")):
                out.write(source, source.relative_to(root))
        context.addPyFile(str(file))
    context._loomframe_shipped = True
