"""Sinks: state lists, rejected records with their reasons, one folder a source, splits with a manifest, tables as CSV, small JSON files."""

from __future__ import annotations

import json
import os
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.positions import QualityConfig
from plyforge.functions.hashing import RECORD
from plyforge.operators.positions import with_quality
from plyforge.operators.sampling import split
from plyforge.session import ship

SPLITS = ("train", "valid", "test")


def put_json(spark: SparkSession, path: str, value: dict) -> None:
    """value as indented JSON in one file, on any file system that Spark writes to; None values are left out."""
    kept = {k: v for k, v in value.items() if v is not None}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(json.dumps(kept, indent=2, ensure_ascii=False).encode()))
    finally:
        out.close()


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def write_states(records: DataFrame, path: str) -> None:
    """One state a line."""
    records.select("sfen").write.text(path)


def write_rejected(records: DataFrame, config: QualityConfig, path: str) -> None:
    """{"record", "quality"} of each record that a gate drops, as JSON lines in gzip.

    Kept records are left out by explode, since a filter would be pushed below the gates and make
    them, with all that they share, again.
    """
    own = F.struct(*[F.col(c) for c in records.columns])
    names = ("keep", "score", "reasons", "score_swing_cp", "bestmove_agreement", "cp_count", "mate_count")
    judged = with_quality(records.withColumn("_record", own), config)
    line = F.to_json(F.struct(F.col("_record").alias("record"), F.struct(*names).alias("quality")))
    lines = judged.select(F.explode(F.when(~F.col("keep"), F.array(line))).alias("value"))
    lines.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def safe_name(path: Column) -> Column:
    """A source's path as a file name: letters, digits, dots and hyphens stay, all else is an underscore."""
    return F.regexp_replace(path, r"[^\p{IsAlphabetic}\p{N}.-]", "_")


#: Folders among which the folders of sources are dealt by name, so that each stays small and is listed by a task of its own.
FOLDERS = 256
_NO_SOURCE = "__HIVE_DEFAULT_PARTITION__"


def _shared_folder(spark: SparkSession, path: str) -> str | None:
    """The folder that path names where it is on a file system that executors open themselves, else None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def _write_files(folder: str, batches):
    """Lines (folder, file, value), sorted by file, into one file each of this task; a file gets its name when it is whole."""
    task = TaskContext.get()
    name, hidden = f"part-{task.partitionId():05d}.jsonl", f".{task.taskAttemptId()}.tmp"
    n, out, now, at = 0, None, None, b""

    def end() -> None:
        if out:
            out.close()
            os.replace(at + hidden.encode(), at + name.encode())

    for batch in batches:
        for k, file, value in zip(*(batch.column(c).to_pylist() for c in ("folder", "file", "value")), strict=True):
            if out is None or file != now:
                end()
                now, at = file, f"{folder}/folder={k}/file={_NO_SOURCE if file is None else file}/".encode()
                os.makedirs(at, exist_ok=True)
                out = open(at + hidden.encode(), "wb")
            out.write(value.encode() + b"\n")
            n += 1
    end()
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def write_by_source(records: DataFrame, path: str, source: str = "path") -> None:
    """The records as JSON lines, a folder folder=K/file=NAME for each source.

    Rows are dealt by ranges of source and value, so that a source is in one file, in two where
    ranges meet, and one that a third of all records share is written by several tasks. A task
    holds one file open. Where executors open files themselves, they write them without the
    processes, renames by the driver and lists of files that Spark's writer needs for each.
    """
    spark = records.sparkSession
    folder = _shared_folder(spark, path)
    named = records.withColumn("file", safe_name(F.col(source)))
    value = F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("value")
    at = F.pmod(F.crc32(F.coalesce("file", F.lit(_NO_SOURCE)).cast("binary")), F.lit(FOLDERS)).cast("int").alias("folder")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = named.select(at, "file", value).repartitionByRange(tasks, "file", F.xxhash64("value")).sortWithinPartitions("file")
    if folder is None:
        dealt.write.partitionBy("folder", "file").text(path)
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileExistsError(path)
    ship(spark)
    n = dealt.mapInArrow(partial(_write_files, folder), "n long").agg(F.sum("n")).first()[0] or 0
    put_json(spark, f"{path}/_SUCCESS", {"records": n})


def _listed(folder: str, batches):
    """file and place of each file below the given folders."""
    for batch in batches:
        for k in batch.column("id").to_pylist():
            names, places = [], []
            top = f"{folder}/folder={k}".encode()
            for source in os.scandir(top) if os.path.isdir(top) else ():
                name = source.name.decode().removeprefix("file=")
                for x in os.listdir(source.path):
                    if not x.startswith(b"."):
                        names.append(None if name == _NO_SOURCE else name)
                        places.append((source.path + b"/" + x).decode())
            yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string()), "place": pa.array(places, pa.string())})


def _lines(batches):
    for batch in batches:
        values, files, size = [], [], 0
        for file, place in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist(), strict=True):
            with open(place.encode(), "rb") as read:
                for line in read:
                    values.append(line.removesuffix(b"\n").decode())
                    files.append(file)
                    size += len(line)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string()), "file": pa.array(files, pa.string())})
                        values, files, size = [], [], 0
        yield pa.RecordBatch.from_pydict({"value": pa.array(values, pa.string()), "file": pa.array(files, pa.string())})


def read_by_source(spark: SparkSession, path: str) -> DataFrame:
    """value and file of every line that write_by_source has written; the driver holds no list of the files."""
    folder = _shared_folder(spark, path)
    if folder is None:
        return spark.read.schema("value string, folder int, file string").text(path).select("value", "file")
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = spark.range(0, FOLDERS, 1, min(FOLDERS, 4 * tasks)).mapInArrow(partial(_listed, folder), "file string, place string")
    return places.repartition(tasks).mapInArrow(_lines, "value string, file string")


def write_split(records: DataFrame, path: str, seed: int, valid: float, test: float, source: str = "path", profile: str = RECORD) -> dict:
    """The records as JSON lines below path/split=train, valid and test, and path/manifest.json, which is returned.

    A game and its variations stay together. The manifest has each split's positions and
    distinct sources; a split without records has zeros.
    """
    spark = records.sparkSession
    marked = split(records, seed, valid, test, profile)
    value = F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("value")
    marked.select("split", value).write.partitionBy("split").text(path)
    counts = marked.groupBy("split").agg(F.count(F.lit(1)).alias("positions"), F.countDistinct(source).alias("sources"))
    found = {r.split: {"positions": r.positions, "sources": r.sources} for r in counts.collect()}
    manifest = {
        "seed": seed,
        "requested": {"valid_frac": valid, "test_frac": test},
        "total_positions": sum(r["positions"] for r in found.values()),
        "splits": {name: {"path": f"{path}/split={name}"} | found.get(name, {"positions": 0, "sources": 0}) for name in SPLITS},
    }
    put_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    """A small table of sweeps or grids as one CSV file with a header; a null is an empty cell."""
    rows.orderBy(*order).drop(*order).coalesce(1).write.option("header", True).option("emptyValue", "").csv(path)


def quota_template(counts: DataFrame, dimensions: tuple[str, ...], source: str) -> dict:
    """bucket_key and n as a template of quotas; buckets are the values of few dimensions."""
    return {"stratify_format_version": 1, "input": source, "by": list(dimensions), "quotas": {r.bucket_key: r.n for r in counts.orderBy("bucket_key").collect()}}


def int_list(text: str) -> list[int]:
    """Whole numbers of a flag, separated by commas; blanks around them don't count."""
    return [int(part.strip()) for part in text.split(",")]
