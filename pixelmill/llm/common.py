"""What the operators share: the folder all executors see, tables written there to cut lineage, fresh names."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_runs: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A new folder is set only in local mode, as in tests.

    On a cluster every executor would write to a machine's own folder, and reading back would miss rows.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The shared folder's part for this application; it goes with the driver's process, or by ``clear_run``."""
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}"
    if path not in _runs:
        _runs[path] = spark
        atexit.register(_leave, path)
    return path


def _leave(path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already; the folder is then the cluster's to clean
        remove(_runs[path], path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of whatever file system it is on."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_run(spark: SparkSession) -> None:
    """Deletes all tables that this application stored; no result that still reads them may be open."""
    remove(spark, run_dir(spark))


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the run's folder that nothing else uses."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "zstd", path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    It cuts lineage so that a lost executor costs the tasks it ran, not the whole plan, and makes
    nondeterministic columns (row keys) fixed.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``stored`` whose tables are deleted at the end of the block: what outlives it must be stored elsewhere."""
    folder = new_path(spark, label)
    try:
        yield lambda df, name: stored(df, name, path=f"{folder}/{name}-{uuid.uuid4().hex}")
    finally:
        remove(spark, folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def content_key(column: str) -> Column:
    """What names a text (null as the empty one): its SHA-256, so that different texts never meet."""
    return F.unhex(F.sha2(text_of(column).cast("string").cast("binary"), 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
