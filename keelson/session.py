"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for k, v in (SETTINGS | {"spark.sql.shuffle.partitions": "8"} | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_sent: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Give the session's workers this package, unless they find it by PYTHONPATH or by the folder they were started in."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _sent or not root.is_dir() or Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = Path(tempfile.mkdtemp(prefix="keelson-")) / "keelson.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "keelson").rglob("*.py")):
            z.write(f, f.relative_to(root).as_posix())
    sc.addPyFile(str(path))  # Spark serves it to the executors
    _sent.add(sc.applicationId)


def materialised(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the session's reliable checkpoint folder.

    The folder is the cluster's (spark.checkpoint.dir); one of our own is set only where a session on one machine names none.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="keelson-"))
    return df.checkpoint(eager=True)
