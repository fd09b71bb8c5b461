"""Tables written in the folder that the cluster shares, in place of long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if its counted rows times its row width stay below this many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        place = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back.

    The files survive the loss of any executor, and later plans start from them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` (a written table), marked for broadcast if its measured size is small enough.

    Beyond the bound it is returned as it is and the join is a shuffled one.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def attach(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Left join of documents with ``found`` (a written table with one row a doc_id).

    If the ids of ``found`` are few by count, only the documents that have a partner are shuffled
    with it and the others stay where they are read; else it is one shuffled join of all.
    """
    extra = [c for c in found.columns if c != "doc_id"]
    if found.count() * 16 > BROADCAST_BYTES:
        return docs.join(found.hint("shuffle_hash"), "doc_id", "left")
    ids = F.broadcast(found.select("doc_id"))
    hit = docs.join(ids, "doc_id", "left_semi").join(found.hint("shuffle_hash"), "doc_id")
    rest = docs.join(ids, "doc_id", "left_anti").withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in extra})
    return hit.unionByName(rest)


def text_size(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
