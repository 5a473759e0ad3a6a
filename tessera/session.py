"""Session construction, code shipping and shared scratch space."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC timestamps."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors once per SparkContext.

    Python workers then import it from the files Spark distributes, whatever folder the driver was started from.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("tessera", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset and all run on
    one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark.sparkContext, "_tessera_scratch", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="tessera-scratch-")
            spark.sparkContext._tessera_scratch = at
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the session ends."""
    path = f"{shared_root(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    held = getattr(spark.sparkContext, "_tessera_held", None)
    if held is None:
        held = spark.sparkContext._tessera_held = []
        atexit.register(held.clear)
    held.append(path)
    for made in _SCOPES:
        made.append(path)
    return path


#: The open ``scratch_scope`` blocks of this thread of control, outermost first.
_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """The paths of the scratch tables that are made inside the block; they belong to whoever opened it."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    held = getattr(spark.sparkContext, "_tessera_held", [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = paths.pop()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in held:
            held.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of the session; for callers that need no result of it any more, such as a benchmark's."""
    remove_paths(spark, list(getattr(spark.sparkContext, "_tessera_held", [])))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; for a file scan the size of its files."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(n, 1), 1 << 50)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a folder; the workers get the package with the first one that is opened."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
