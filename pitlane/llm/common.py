"""Helpers that the corpus operators share: reading, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its rows times their width stay below this.
BROADCAST_BYTES = 32 << 20
#: What a row takes in the hash table of a broadcast besides its columns.
ROW_OVERHEAD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named: a temporary one in a local test, an error on a cluster, whose machines share no such folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return (named or tempfile.mkdtemp(prefix="pitlane-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint.

    It goes to shared_folder(), unless the session has set a checkpoint folder itself.
    """
    spark = df.sparkSession
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its counted rows of ``row_bytes`` each (and ROW_OVERHEAD) fit ``limit``, else as it is.

    Beyond the limit the join that follows is a shuffle join, whose skewed partitions AQE splits.
    ``df`` should be checkpointed or cheap, for it is counted.
    """
    return F.broadcast(df) if df.count() * (row_bytes + ROW_OVERHEAD) <= limit else df


#: A key of more than one HOT-th of all rows is joined by broadcast in join_counted(); there are at most HOT such keys.
HOT = 512


def join_counted(rows: DataFrame, by_key: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``by_key``, which has one row a key and in _n how many rows that key has.

    The few keys that are hot are sent to where their rows lie, so no task gets all rows of one.
    """
    is_hot = F.col("_n") * HOT > total
    hot, rest = by_key.where(is_hot).drop("_n"), by_key.where(~is_hot).drop("_n")
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    added = [c for c in hot.columns if c != key]
    one = marked.where("_hot").drop("_hot")
    return one.unionByName(marked.where("_hot is null").drop("_hot", *added).join(rest, key))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in a folder of its own within shared_folder() and read again, and that folder.

    What is read more than once, and must be the same each time, is stored even if a plan could be
    run again: its rows might come in another order.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder that stored() wrote and nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
