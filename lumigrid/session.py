"""Help with sessions: a local one, and the package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local(cpus: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, with the settings that the tests and the benchmark use."""
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return SparkSession.builder.master(f"local[{cpus}]").config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if getattr(context, "_lumigrid_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # it runs from an archive that was sent before
        return
    archive = Path(tempfile.mkdtemp(prefix="lumigrid-")) / "lumigrid.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._lumigrid_shipped = True


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which driver and executors share; on a local master without it, a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lumigrid-")
    return f"{found.rstrip('/')}/lumigrid-{name}-{uuid.uuid4().hex}"
