"""Session helpers: tables, shipping the package to executors, shared scratch tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKAGE = Path(__file__).resolve().parent
_SHIPPED: dict[str, str] = {}
_SENT: dict[str, set[str]] = {}
_SCOPES: list[list[str]] = []


def get_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the library expects; every setting can be overridden."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
    } | conf
    builder = SparkSession.builder.master(master).appName("tessera")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application (Spark's own file server carries it)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-ship-"), "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, Path("tessera") / path.relative_to(PACKAGE))
    spark.sparkContext.addPyFile(target)
    _SHIPPED[app] = target


def send_file(spark: SparkSession, path: str) -> None:
    """Let Spark carry a file of the driver to the executors, once per application; ``received`` finds it there."""
    app = spark.sparkContext.applicationId
    if os.path.isfile(path) and path not in _SENT.setdefault(app, set()):
        spark.sparkContext.addFile(path)
        _SENT[app].add(path)


def received(path: str) -> str:
    """Where a task finds a file that was sent: Spark's copy, or else the path itself."""
    copy = SparkFiles.get(os.path.basename(path))
    return copy if os.path.isfile(copy) else path


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="tessera-shared-")  # no cluster set a folder: a local run
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str = "step", tidy: bool = False) -> DataFrame:
    """The rows of df as a written table in the shared folder: cuts lineage and survives lost executors.

    ``tidy``: the shuffle files of the write go with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    for made in _SCOPES:
        made.append(path)
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, str(tidy or before == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes inside are deleted on the way out: results must have been read or saved by then."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables that written() left in the shared folder; no result that reads them may be used afterwards."""
    _delete(spark, f"{shared_dir(spark).rstrip('/')}/tessera")


def forget(df: DataFrame | None) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)
