"""Session helpers: building a session, loading tables, cutting lineage through shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "verdigris", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` overrides them (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_verdigris_shipped", False):
        return
    home = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="verdigris-")) / "verdigris.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, str(f.relative_to(home.parent)))
    sc.addPyFile(str(to))
    sc._verdigris_shipped = True


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the session (spark.checkpoint.dir). Where none is set, one machine alone may use a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table written by :func:`materialize` once nothing reads it any more."""
    spark = df.sparkSession
    root = scratch(spark).rstrip("/")
    for parent in {os.path.dirname(f) for f in df.inputFiles()}:
        if root.removeprefix("file://").strip("/") in parent:
            jvm = spark._jvm
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local_arrow_rows(spark: SparkSession, most: int = 1000) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts fit a small Python worker."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))
