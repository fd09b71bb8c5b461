"""Tables that several queries of a session start from, written once in the shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: By application, function and folder: path, schema, and the folder's state when it was written.
_WRITTEN: dict[tuple[str, str, str], tuple[str, str, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: plans start anew from there and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str, rows: int, most: int = 1 << 18) -> DataFrame:
    """``df`` dealt by a key to so many tasks that each has about ``most`` of ``rows`` rows: its memory stays the same on any table.

    What groups, joins small tables or has windows by that key, alone or with further ones, then needs no shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), key)


def state(spark: SparkSession, folder: str) -> str:
    """What a folder of tables holds just now: each table's bytes and files and when it was changed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for x in store.listStatus(place):
        total = store.getContentSummary(x.getPath())
        seen.append((x.getPath().getName(), x.getModificationTime(), total.getLength(), total.getFileCount()))
    return json.dumps(sorted(seen))


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(spark: SparkSession) -> None:
    """Delete the tables that ``once`` has written; they are made again when they are next wanted."""
    for path, _, _ in _WRITTEN.values():
        _remove(spark, path)
    _WRITTEN.clear()


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Write the table that f(spark, sf_dir) gives at its first use in an application; later uses read it.

    When the tables of the folder have changed since, it is made anew and the old one deleted.
    """

    @wraps(f)
    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, f.__module__ + "." + f.__qualname__, sf_dir)
        now = state(spark, sf_dir)
        if key in _WRITTEN and _WRITTEN[key][2] != now:
            _remove(spark, _WRITTEN.pop(key)[0])
        if key not in _WRITTEN:
            df = f(spark, sf_dir)
            path = f"{shared_dir(spark)}/{f.__name__.strip('_')}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            _WRITTEN[key] = path, df.schema.json(), now
        path, schema, _ = _WRITTEN[key]
        return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(path)

    return get
