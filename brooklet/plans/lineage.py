"""Cuts of the lineage that survive the loss of an executor: tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a folder of our own, if
    driver and executors are one machine; on a cluster they may not see it, so that raises."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="brooklet-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back. The table goes when the
    application ends; results that were not written elsewhere by then go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brooklet-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    # a schema, so that an empty table can be read
    fields = sorted(df.schema.fields, key=lambda f: f.name in partition_by)
    return spark.read.schema(T.StructType(fields)).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of written() that nothing will read again, and let Spark's cleaner take
    the shuffles that led to it."""
    spark = df.sparkSession
    for path in {re.match(r".*/brooklet-[^/]+-[0-9a-f]{32}(?=/)", f)[0] for f in df.inputFiles()}:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    released(spark)


def released(spark: SparkSession) -> None:
    """Let Spark's cleaner take the shuffles that nothing refers to any more. Its listeners hold on to
    the last query that ended until they hear of another, so there is one."""
    spark.range(1).count()
    try:
        spark._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    except Py4JError:
        pass  # busy listeners: the next call frees it
    gc.collect()
    spark._jvm.System.gc()
