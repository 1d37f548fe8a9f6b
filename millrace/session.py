"""Session defaults and the one way lineage is cut: a parquet table in the shared folder."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings a locally built session gets; on a cluster the session arrives configured.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the benchmark."""
    settings = LOCAL_CONF | {"spark.driver.memory": "8g"} | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("millrace")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    ``spark.checkpoint.dir`` of the session wins, then a directory set on the context. Only a
    local master, where driver and executors share one disk, gets a folder made here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_WRITTEN: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` wrote in this application; frames that read them end."""
    sc = spark.sparkContext
    paths = _WRITTEN.pop(sc.applicationId, [])
    for path in paths:
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)


def durable(df: DataFrame, label: str = "t", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage like ``checkpoint()`` and survives the loss of executors, but is columnar (later
    reads are pruned) and has known sizes (the planner and AQE can rely on them).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors, once an application.

    Python functions of a plan are found by the workers by name; whoever starts the driver from
    another folder need not have the package on the workers' path.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root)}")
    jvm = sc._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(held.getvalue())
    out.close()
    sc.addPyFile(target.toString())
    _SHIPPED.add(sc.applicationId)
