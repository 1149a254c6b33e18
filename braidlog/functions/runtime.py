"""Session helpers shared by all operators: shared folder, written tables, partition counts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Files of a written table for each core, and shuffle partitions in one file beyond that.
FILES_PER_CORE, MERGED = 4, 4
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="braidlog-")
    return _OWN[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a path when the driver ends."""
    atexit.register(_forget, spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            delete_path(spark, path)
    except Exception:  # the session is already gone: nothing left to ask
        return


def written(df: DataFrame, label: str = "table", merge: bool = True) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    The table survives lost executors, and is deleted when the driver ends. Small partitions
    are merged into ``FILES_PER_CORE`` files for each core, or more where that would put over
    ``MERGED`` shuffle partitions into one task, unless ``merge`` is false: functions that
    name things by their partition need their own.
    """
    spark = df.sparkSession
    if merge:
        df = df.coalesce(max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, shuffle_partitions(spark) // MERGED))
    path = f"{shared_dir(spark)}/braidlog-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    schema = StructType.fromJson(df.schema.jsonValue())
    return spark.read.schema(schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which follows the size of the input on a cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
