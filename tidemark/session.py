"""Session set-up and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime settings that the operators count on; a session's own lower value stays.
MAX_ARROW_ROWS = 2000


def build_session(app: str = "tidemark", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution; cluster settings come from spark-submit."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return tune(b.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that long texts don't fill a Python worker; this package's source for the workers."""
    _ship(spark)
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if rows <= 0 or rows > MAX_ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(MAX_ARROW_ROWS))
    return spark


def _ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="tidemark-src-")) / "tidemark.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._tidemark_shipped = True
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset (tests, local mode), a new temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.tidemark.dir", at)
        atexit.register(_remove_local, at)
    return at.rstrip("/")


def _remove_local(uri: str) -> None:
    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path for one run's tables in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The rows, written as Parquet and read again: lineage ends here, and lost executors cost nothing."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def row_of(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names; select("<alias>.*") gives them back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
