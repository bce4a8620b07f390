"""Sinks: what is written per source, and that all of it is read again."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_positions import frame, record, seen

from plyforge.functions.positions import QualityConfig
from plyforge.sources import sinks


def lines_of(frame):
    return Counter((r.file, json.loads(r.value)["idx"]) for r in frame.collect())


def test_a_source_is_one_file_unless_it_is_crowded(spark, tmp_path):
    rows = spark.range(3000).select(
        F.col("id").alias("idx"), F.when(F.col("id") < 1000, "crowd").otherwise(F.concat(F.lit("g/"), (F.col("id") % 200).cast("string"))).alias("path")
    )
    sinks.write_by_source(rows, f"file://{tmp_path}/out")
    files = Counter(p.parent.name for p in (tmp_path / "out").rglob("file=*/part-*") if p.suffix != ".crc")
    assert len(files) == 201 and 1 < files["file=crowd"] <= 8
    assert sum(files.values()) <= 201 + 8  # a source more for each meeting of two of the eight ranges
    want = Counter(("crowd" if i < 1000 else f"g_{i % 200}", i) for i in range(3000))
    assert lines_of(sinks.read_by_source(spark, f"file://{tmp_path}/out")) == want
    with pytest.raises(Exception, match="out"):
        sinks.write_by_source(rows, f"file://{tmp_path}/out")


def test_odd_names_of_sources_are_read_again(spark, tmp_path):
    names = [None, "", "_hidden", ".dots", "1.10", "対局", "a=b"]
    rows = spark.createDataFrame(list(enumerate(names)), "idx long, path string")
    sinks.write_by_source(rows, str(tmp_path / "out"))
    want = Counter({(None if n is None else n.replace("=", "_"), i): 1 for i, n in enumerate(names)})
    assert lines_of(sinks.read_by_source(spark, str(tmp_path / "out"))) == want


def test_stores_that_only_spark_opens_have_the_same_folders(spark, tmp_path, monkeypatch):
    rows = spark.range(100).select(F.col("id").alias("idx"), F.concat(F.lit("g"), (F.col("id") % 7).cast("string")).alias("path"))
    sinks.write_by_source(rows, str(tmp_path / "a"))
    monkeypatch.setattr(sinks, "_shared_folder", lambda spark, path: None)
    sinks.write_by_source(rows, str(tmp_path / "b"))
    found = [{str(p.parent.relative_to(tmp_path / x)) for p in (tmp_path / x).rglob("file=*/part-*")} for x in "ab"]
    assert found[0] == found[1] and len(found[0]) == 7
    assert lines_of(sinks.read_by_source(spark, str(tmp_path / "a"))) == lines_of(sinks.read_by_source(spark, str(tmp_path / "b")))


def test_no_records_are_no_files(spark, tmp_path):
    rows = spark.range(0).select(F.col("id").alias("idx"), F.lit("g").alias("path"))
    sinks.write_by_source(rows, str(tmp_path / "out"))
    assert sinks.read_by_source(spark, str(tmp_path / "out")).count() == 0


def test_rejected_records_are_compressed_and_all_there(spark, tmp_path):
    rows = [record(i, [seen(i, margin=1)] * (i % 3)) for i in range(30)]
    config = QualityConfig(min_observations=1, eval_max=20)
    plans = []
    whole = sinks.with_quality

    def judged(*args):
        plans.append(whole(*args))
        return plans[-1]

    sinks.with_quality = judged
    try:
        sinks.write_rejected(frame(spark, rows), config, str(tmp_path / "out"))
    finally:
        sinks.with_quality = whole
    files = [p for p in (tmp_path / "out").glob("part-*")]
    assert files and all(p.suffix == ".gz" for p in files)
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    want = {r.idx: list(r.reasons) for r in plans[0].where("not keep").collect()}
    assert {g["record"]["idx"]: g["quality"]["reasons"] for g in got} == want and len(got) == len(want) == 16
    assert not any(g["quality"]["keep"] for g in got)
