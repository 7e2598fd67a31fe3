"""Written intermediate tables: short lineage that survives lost executors, in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: While this is set, the shuffle files of a write go as soon as it is done, not when the driver happens to collect its garbage.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset (tests, one machine)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/skein-shared"
    return where.rstrip("/")


def erase(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _erase_all() -> None:
    for spark, path in _made:
        try:
            erase(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit; leftover files are harmless
            return


def own_folder(spark: SparkSession) -> str:
    """A new place in the shared folder, which goes when the process ends."""
    path = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again; what it wrote goes when the process ends, or by drop()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skein-{uuid.uuid4().hex}"
    held = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SWEEP, held) if held is not None else spark.conf.unset(SWEEP)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.skein_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    erase(df.sparkSession, df.skein_path)
    _made.remove((df.sparkSession, df.skein_path))
