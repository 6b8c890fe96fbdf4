"""What jobs with Python functions need of a session."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application: they need no installation of it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="trackloom-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, f"{package.name}/{source.relative_to(package)}")
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path inside ``spark.checkpoint.dir``, which driver and executors share; in local mode without that setting, in a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.gettempdir()
    return f"{top.rstrip('/')}/trackloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def dealt(rows: DataFrame, key: str, least: int = 64) -> DataFrame:
    """The rows in several partitions for each core, by a key: a small file is one task's however long its rows take."""
    return rows.repartition(max(least, 4 * rows.sparkSession.sparkContext.defaultParallelism), key)
