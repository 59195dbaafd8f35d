"""Tables and the shared scratch folder of a session."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that this driver has made, which go when it ends.
_made: set[tuple[str, SparkSession]] = set()


def short_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of a few MB, whatever their lengths; by default they go by thousands of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a local master, whose executors share the driver's disk, may leave it unset and gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="kindred-")
    return shared_dir.own


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for path, spark in _made:
        with contextlib.suppress(Exception):  # the session may have ended already
            _deleted(spark, path)


atexit.register(_clean)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder below the shared one; the folder goes when the driver ends."""
    home = f"{shared_dir(spark)}/kindred-{spark.sparkContext.applicationId}"
    _made.add((home, spark))
    return f"{home}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: the lineage ends here and lost executors lose nothing.

    The written table also carries sizes, so the planner picks joins from facts.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._path = path
    return found


def forget(*tables: DataFrame) -> None:
    """Deletes stored tables. Everything that was made of them must be stored itself by now."""
    for df in tables:
        _deleted(df.sparkSession, df._path)


def fan_out(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """docs with columns c0, c1, ..., which clash with no other, and these by their names."""
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return rows, {name: F.col(f"c{i}") for i, name in enumerate(docs.columns)}
