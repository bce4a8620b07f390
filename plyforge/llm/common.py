"""What the training-data operators share: places for written tables, and ids."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.session import ship


#: Rows of an Arrow batch: texts of any length go to Python and back, and both sides hold whole batches.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows; a smaller setting stays."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    Only where the setting is absent and the master is local, as in tests, a temporary folder
    is made and used for the rest of the session: on a cluster executors would write to their
    own disks, so that there the absence is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="plyforge-")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again.

    Cuts the lineage: what follows does not depend on the executors that computed df.
    """
    bound_batches(df.sparkSession)
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by staged() that nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_of_id(col: str | Column) -> Column:
    """crc32 of an identifier written as decimal text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(col.cast("string").cast("binary"))


#: Above this estimated size a side is shuffled instead of broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df marked for broadcasting if its counted rows fit BROADCAST_BYTES, else df as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def merged_if_large(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df as it is if its counted rows fit BROADCAST_BYTES, else marked so that its join broadcasts neither side.

    Spark estimates a table by the compressed size of its files and an exploded row as one, and
    would gather many times spark.sql.autoBroadcastJoinThreshold in the driver.
    """
    return df if rows * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def running_offsets(counts: DataFrame, group: str, part: str, rows: str, block: int = 4096) -> DataFrame:
    """For counts with one row (group, part, rows): group, part, offset, the rows of the parts before it.

    part is a whole number from 0. Counts are summed within blocks of parts first, so that no
    task reads more than a block of them, or one row a block.
    """
    blocked = counts.select(group, part, rows, F.floor(F.col(part) / block).alias("_block"))
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(group, "_block").orderBy(part).rowsBetween(*before)
    outer = Window.partitionBy(group).orderBy("_block").rowsBetween(*before)
    bases = (
        blocked.groupBy(group, "_block")
        .agg(F.sum(rows).alias("_total"))
        .select(group, "_block", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_base"))
    )
    return (
        blocked.withColumn("_within", F.coalesce(F.sum(rows).over(inner), F.lit(0)))
        .join(bases, [group, "_block"])
        .select(group, part, (F.col("_base") + F.col("_within")).alias("offset"))
    )
