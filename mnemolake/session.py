"""Session settings and the shared scratch area in which lineage is cut.

Intermediate results are written as Parquet tables below ``spark.checkpoint.dir``, the folder all
executors share, so a lost executor costs a re-read and never a result. Only a local master may run
without that setting; it then gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "mnemolake", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators assume: UTC, Arrow and adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or a private one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="mnemolake-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_ROOTS[app] = path
    return "file://" + _LOCAL_ROOTS[app]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that workers can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="mnemolake-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/mnemolake.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(archive)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
    except Exception:  # a Spark without this setting
        yield
        return
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 100_000
"""Rows that one bucket of an intermediate table holds, and Spark's own bound on the number of buckets."""
_WRITTEN: set[str] = set()


def release() -> None:
    """Delete the intermediate tables of all operator calls so far; results that still read them end here.

    Runs by itself when the driver's Python ends.
    """
    from pyspark import SparkContext

    jvm = getattr(SparkContext._gateway, "jvm", None)
    for at in list(_WRITTEN):
        with contextlib.suppress(Exception):  # the JVM may be gone; then the folder's owner cleans up
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        _WRITTEN.discard(at)


atexit.register(release)


class Scratch:
    """Tables one operator call writes and reads again."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        ship_package(spark)
        self.spark = spark
        self.path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        _WRITTEN.add(self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, mode: str = "errorifexists") -> DataFrame:
        """Write ``df`` and return the table read back. Shuffle files of the write are freed with it."""
        with setting(self.spark, CLEANUP, "true"):
            df.write.mode(mode).parquet(self.at(name))
        return self.read(name, df)

    def write_bucketed(self, df: DataFrame, name: str, key: str, rows: int = 0) -> DataFrame:
        """Write ``df``, which ends in an aggregation by ``key``, as a table whose joins on ``key`` need no shuffle.

        Its buckets are those of that aggregation's shuffle: as many as ``rows`` need, and at least one a
        shuffle partition.
        """
        buckets = min(MOST_BUCKETS, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS)))
        self.tables[name] = known = f"{name}_{uuid.uuid4().hex}"
        with setting(self.spark, CLEANUP, "true"), setting(self.spark, "spark.sql.shuffle.partitions", str(buckets)):
            df.write.bucketBy(buckets, key).sortBy(key).option("path", self.at(name)).saveAsTable(known)
        return self.spark.table(known)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Delete tables nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
