"""Sessions: the package for Python workers, and settings for local runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .errors import require

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="helixframe-")  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Where it is unset a local run gets a temporary one; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        require(sc.master.startswith("local"), "set spark.checkpoint.dir to a folder that the driver and all executors share", "invalid_argument")
        if sc.applicationId not in _own_folders:
            folder = tempfile.mkdtemp(prefix="helixframe-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own_folders[sc.applicationId] = "file://" + folder
        root = _own_folders[sc.applicationId]
    return root.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_session(cpus: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("helixframe")
    for k, v in ({"spark.sql.shuffle.partitions": str(partitions or cpus), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
