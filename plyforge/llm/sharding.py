"""Two-pass external shuffle into shards.

Pass 1 scatters the records uniformly by seeded hashes: a record's shard depends on its
doc_id and the number of shards alone, and within the shard a second hash scatters it over
buckets of a size that one task's memory holds with room to spare. Pass 2 runs a seeded
Fisher-Yates shuffle over each bucket and lays the buckets of a shard end to end, which
gives every record its slot.

Law ``key``. The shard is consistent: step j (1, 2, ...) moves a record into shard j with
probability 1 / (j + 1), decided by a uniform number that depends on doc_id and j only, so
that with one more shard a record stays or goes to the new shard. Shards hold no more or
less than what independent uniform choices give them, whatever keys or sources are hot.

Records are shuffled as identifiers; texts are moved once, by write_shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import running_offsets, staged, table

SHARDS = 40
SEED = 20
#: Records in a bucket, on average. A bucket holds identifiers only, and a swap copies them.
BUCKET_ROWS = 128
OVERHEAD_BYTES = 16
_SLICES = 4  # uniform 32-bit numbers in one md5


def _uniforms(key: Column, n: int, seed: int) -> Column:
    """n uniform whole numbers below 2**32 that depend on key and their place only."""
    hexes = [F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(k).cast("string"), key)) for k in range(-(-n // _SLICES))]
    return F.array(*[F.conv(F.substring(hexes[j // _SLICES], 1 + 8 * (j % _SLICES), 8), 16, 10).cast("long") for j in range(n)])


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of a record among so many shards; a null doc_id is a key like others."""
    return F.element_at(_shards(doc_id, shards, shards, seed), 1)


def _shards(doc_id: Column, fewest: int, most: int, seed: int) -> Column:
    """The record's shard for every number of shards from fewest to most."""
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    moves = F.transform(
        _uniforms(key, most, seed), lambda u, j: F.when((j == 0) | (u * (j + 1) < F.lit(1 << 32)), j).otherwise(-1)
    )
    return F.array(*[F.array_max(F.slice(moves, 1, n)) for n in range(fewest, most + 1)])


def _fisher_yates(items: Column, bucket: Column, seed: int) -> Column:
    """items in the order of a Fisher-Yates shuffle whose draws depend on seed, bucket and step."""

    def swap(acc: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        return F.transform(acc, lambda x, k: F.when(k == i, F.get(acc, j)).when(k == j, F.get(acc, i)).otherwise(x))

    steps = F.when(F.size(items) > 1, F.sequence(F.size(items) - 1, F.lit(1), F.lit(-1))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(steps, items, swap)


def shuffle_into_shards(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For each row: doc_id, size, text_crc32, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 that of its bytes (null:
    as empty). slot counts from 0 in each shard without gaps; grown_shard is the shard with
    one more shard. Rows with one doc_id share a shard; repeated rows each get a slot. Within
    a bucket the shuffle starts from the order of (doc_id, size, crc), so the result does not
    depend on partitions.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    records = documents.select(
        "doc_id",
        (F.octet_length(body).cast("long") + OVERHEAD_BYTES).alias("size"),
        F.crc32(body).alias("text_crc32"),
        _shards(F.col("doc_id"), shards, shards + 1, seed).alias("_at"),
    ).select(
        "doc_id", "size", "text_crc32", F.get("_at", F.lit(0)).alias("shard"), F.get("_at", F.lit(1)).alias("grown_shard")
    )
    records = staged(records, "records")
    counts = records.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("buckets"))
    # A row for each shard: as many rows as shards, whatever the input.
    scattered = records.join(F.broadcast(counts), "shard").withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"), F.col("buckets")).cast("int")
    )
    # Copies of one row would share a bucket: the plain count of equal rows stands for them.
    buckets = (
        scattered.groupBy("shard", "bucket", "doc_id", "size", "text_crc32", "grown_shard")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("shard", "bucket")
        .agg(
            F.sort_array(F.collect_list(F.struct("doc_id", "size", "text_crc32", "grown_shard", "n"))).alias("items"),
            F.sum("n").alias("rows"),
        )
    )
    shuffled = staged(
        buckets.select(
            "shard",
            "bucket",
            "rows",
            _fisher_yates(F.col("items"), F.concat_ws("/", "shard", "bucket"), seed).alias("items"),
        ),
        "buckets",
    )
    offsets = running_offsets(shuffled.select("shard", "bucket", "rows"), "shard", "bucket", "rows")
    placed = shuffled.join(offsets, ["shard", "bucket"]).select(
        "shard",
        "offset",
        F.posexplode("items").alias("pos", "item"),
        F.transform("items", lambda x: x["n"]).alias("ns"),
    )
    before = F.aggregate(F.slice("ns", F.lit(1), F.col("pos")), F.lit(0).cast("long"), lambda a, n: a + n)
    first = placed.select(
        "item.doc_id",
        "item.size",
        "item.text_crc32",
        "shard",
        (F.col("offset") + before).alias("first"),
        "item.n",
        "item.grown_shard",
    )
    return first.select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"),
        "grown_shard",
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, max_records: int = 100_000) -> None:
    """Write the documents, all their columns, below path/shard=K in the order of their slots.

    doc_id must be unique. A shard's files follow one another in slot order and hold at most
    max_records rows each; the writer's tasks are ranges of (shard, slot), so a shard of any
    size spreads over tasks.
    """
    placed = shuffle_into_shards(documents, shards, seed).select(
        F.col("doc_id").alias("_doc"), F.col("shard").alias("shard"), F.col("slot").alias("slot")
    )
    own = [c for c in documents.columns if c not in ("shard", "slot")]
    (
        documents.select(*own)
        .join(placed, F.col("doc_id").eqNullSafe(F.col("_doc")))
        .drop("_doc")
        .repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.option("maxRecordsPerFile", max_records)
        .partitionBy("shard")
        .parquet(path)
    )


NAME = "op5_sharding"
ORACLE_SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle_into_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
