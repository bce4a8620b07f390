"""Exact deduplication with a log-structured merge index of text digests.

* Memtable: the rows of one batch aggregate to one entry a digest (map side first).
* Flush: each batch becomes a run, a folder of Parquet files range-partitioned and sorted by
  digest, so that footers carry disjoint digest ranges, and a Bloom filter, a table of words.
* Compaction: entries that other runs' filters may hold merge; the preferred identifier stays,
  counts add up; the others are copied. Filters too large to send are passed over, and all merges.
* Later batches are looked up against all runs through the filters.
* Lookup of the table itself: rows join the compacted run by digest; every hit is then verified byte by byte
  against the text of the row that it would defer to.

Everything is DataFrame operations. Entries leave each task pre-aggregated, joins are plain
equi-joins that adaptive execution may split, and the verification salts large groups, so
that a text that a third of all rows share is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm.common import BROADCAST_BYTES, broadcast_if_small, fresh_path, staged, table

MEMTABLES = 4
#: Rows of one group that one task verifies against one copy of the text.
GROUP_SLICE = 500


def _bytes_of(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


#: An entry sets PROBES bits in one 64-bit word of its run's filter; a word serves FILTER_ENTRIES on average.
PROBES = 4
FILTER_ENTRIES = 4
_ENTRY = "digest binary, keep_id long, n long"


def _mask(digest: Column) -> Column:
    """The bits that a digest sets in its word."""
    h = F.xxhash64(F.lit(0xF117E5), digest)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(PROBES)))


def _word(digest: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(words))


@dataclass(frozen=True)
class Run:
    """Sorted entries (memtable, digest, keep_id, n) and the Bloom filters (memtable, word, bits) of its memtables."""

    path: str
    filter: str
    words: int


class DigestIndex:
    """A log-structured index digest -> (preferred identifier, count).

    keep names the identifier that stays: "min" or "max". Runs and their filters are written
    below the shared folder of the session; the index itself holds only their paths.
    """

    def __init__(self, spark: SparkSession, keep: str = "min"):
        if keep not in ("min", "max"):
            raise ValueError(f"keep must be min or max, not {keep!r}")
        self.spark, self.runs = spark, []
        self._best = F.min if keep == "min" else F.max

    def _written(self, entries: DataFrame) -> Run:
        """entries (memtable, digest, keep_id, n) as a sorted run with its filters."""
        path = fresh_path(self.spark, "run")
        entries.sortWithinPartitions("memtable", "digest").write.partitionBy("memtable").parquet(path)
        kept = self.spark.read.schema(_ENTRY + ", memtable int").parquet(path)
        words = max(1, kept.count() // FILTER_ENTRIES)
        bits = kept.groupBy("memtable", _word(F.col("digest"), words).alias("word")).agg(F.bit_or(_mask(F.col("digest"))).alias("bits"))
        bits.write.parquet(f"{path}-filter")
        return Run(path, f"{path}-filter", words)

    def flush(self, entries: DataFrame, memtables: int = MEMTABLES) -> None:
        """Flush rows (digest, id) as one sorted run for each of the memtables, in one job.

        Rows go to memtables by a hash of the identifier, so copies of one text that arrive
        together meet in different runs and merge at compaction, as they would over time.
        """
        rows = (
            entries.withColumn("memtable", F.pmod(F.xxhash64("id"), F.lit(memtables)).cast("int"))
            .groupBy("memtable", "digest")
            .agg(self._best("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
            .repartitionByRange("memtable", "digest")
        )
        self.runs.append(self._written(rows))

    def _with_hits(self, rows: DataFrame) -> DataFrame | None:
        """rows (digest, ...) with _hits, the (run, memtable) whose filters may hold the digest; None if the filters are too large to send.

        A filter's words are counted before they are broadcast.
        """
        out = rows.withColumn("_hits", F.array().cast("array<struct<run:int,memtable:int>>"))
        for k, run in enumerate(self.runs):
            words = self.spark.read.schema("memtable int, word long, bits long").parquet(run.filter)
            n = words.count()
            if n * 40 > BROADCAST_BYTES:
                return None
            words = words.groupBy(F.col("word").alias("_word")).agg(F.collect_list(F.struct("memtable", "bits")).alias("_bits"))
            out = out.join(F.broadcast(words), _word(F.col("digest"), run.words) == F.col("_word"), "left")
            out = out.withColumn("_hits", F.concat("_hits", self._holders(k))).drop("_word", "_bits")
        return out

    @staticmethod
    def _holders(run: int) -> Column:
        """(run, memtable) of each filter word in _bits that has all bits of the digest."""
        mask = _mask(F.col("digest"))
        none = F.array().cast("array<struct<memtable:int,bits:long>>")
        may = F.filter(F.coalesce("_bits", none), lambda x: x["bits"].bitwiseAND(mask) == mask)
        return F.transform(may, lambda x: F.struct(F.lit(run).alias("run"), x["memtable"].alias("memtable")))

    def _merged(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("digest").agg(self._best("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Of a batch (digest, ...) the rows whose digest some run has, with keep_id and n over all runs.

        The filters drop most of the others before any row is shuffled; runs need not be merged.
        """
        probed = self._with_hits(digests)
        if probed is not None:
            digests = probed.where(F.size("_hits") > 0).drop("_hits")
        return digests.join(self._merged(self.entries()), "digest")

    def compact(self) -> DataFrame:
        """Merge all runs into one and return it: digest, keep_id, n.

        Entries that no other run's filter may hold are copied; only the rest is shuffled and
        merged, entry by entry: the preferred identifier stays, counts add up.
        """
        entries = self._entries()
        probed = self._with_hits(entries)
        if probed is None:
            merged = self._merged(entries)
        else:
            others = F.exists("_hits", lambda x: (x["run"] != F.col("run")) | (x["memtable"] != F.col("memtable")))
            merged = self._merged(probed.where(others)).unionByName(probed.where(~others).select("digest", "keep_id", "n"))
        self.runs = [self._written(merged.withColumn("memtable", F.lit(0)))]
        return self.entries()

    def _entries(self) -> DataFrame:
        """All runs' entries with their memtable and run."""
        own = [self.spark.read.schema(_ENTRY + ", memtable int").parquet(run.path).withColumn("run", F.lit(k)) for k, run in enumerate(self.runs)]
        return reduce(DataFrame.unionByName, own)

    def entries(self) -> DataFrame:
        return self._entries().select("digest", "keep_id", "n")


def exact_groups(documents: DataFrame, keep: str = "min", memtables: int = MEMTABLES) -> DataFrame:
    """For each row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of repeated rows with one
    doc_id the group counts each. Rows whose bytes differ from those of the row they would
    defer to, though the digests agree, form groups of their own by their bytes. An empty
    table gives no rows.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", _bytes_of(F.col("text")).alias("body"))
    digests = staged(rows.select("doc_id", F.unhex(F.sha2("body", 256)).alias("digest")), "digests")
    index = DigestIndex(spark, keep)
    index.flush(digests.select("digest", F.col("doc_id").alias("id")), memtables)
    entries = index.compact()

    shared = entries.where("n > 1")
    shared = broadcast_if_small(shared, shared.count(), 200)
    found = digests.join(entries, "digest")

    # Hits: rows with a text that others have. Keepers go out once for each slice of their group.
    slices = F.ceil(F.col("n") / GROUP_SLICE).cast("int")
    marked = rows.withColumn("digest", F.unhex(F.sha2("body", 256))).join(shared, "digest")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    hits = marked.where(~stays).select(
        "doc_id", "digest", "body", F.pmod(F.xxhash64("doc_id"), slices).cast("int").alias("slice")
    )
    keepers = (
        marked.where(stays)
        .dropDuplicates(["digest"])
        .select("digest", F.col("body").alias("kept_body"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    )
    clashing = staged(
        hits.join(keepers, ["digest", "slice"]).where("body != kept_body").select("doc_id", "digest", "body"), "clashes"
    )
    if not clashing.isEmpty():
        found = _apart(found, clashing, keep)
    return found.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _apart(found: DataFrame, clashing: DataFrame, keep: str) -> DataFrame:
    """Rows of found whose digest agrees with their keeper's but whose bytes don't, grouped by their bytes."""
    best = F.min if keep == "min" else F.max
    own = clashing.groupBy("digest", "body").agg(best("doc_id").alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
    own = clashing.join(own, ["digest", "body"]).select("doc_id", "digest", "own_keep", "own_n").distinct()
    lost = clashing.groupBy("digest").agg(F.count(F.lit(1)).alias("lost_n"))
    return (
        found.join(own, ["doc_id", "digest"], "left")
        .join(lost, "digest", "left")
        .select(
            "doc_id",
            "digest",
            F.coalesce("own_keep", "keep_id").alias("keep_id"),
            F.coalesce("own_n", F.col("n") - F.coalesce("lost_n", F.lit(0))).alias("n"),
        )
    )


def without_copies(documents: DataFrame, keep: str = "min") -> DataFrame:
    """The documents, all their columns, one row for each distinct text.

    Rows that repeat both the identifier and the text of the row that stays are reduced to one.
    """
    groups = staged(exact_groups(documents, keep), "groups")
    out = groups.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    sha = F.sha2(_bytes_of(F.col("text")), 256)
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha"))
    stays = documents.join(broadcast_if_small(out, out.count(), 200), match, "left_anti")
    repeats = groups.where("kept").groupBy("text_sha256", "keep_id").count().where("count > 1")
    if repeats.isEmpty():
        return stays
    return stays.withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha")


NAME = "op9_exact_dedup"
ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )
