"""Hashes, sampling, splitting and merging on hand-made records."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_positions import frame, record, seen

from plyforge.functions import hashing
from plyforge.operators import merging, sampling


@pytest.mark.parametrize(
    ("length", "digest"),
    [
        (0, "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"),
        (1, "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"),
        (1024, "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7"),
        (1025, "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"),
        (3072, "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2"),
    ],
)
def test_published_digests(length, digest):
    assert hashing.blake3([bytes(i % 251 for i in range(length))])[0].hex() == digest


def test_hash_is_the_number_of_the_first_bytes(spark):
    got = spark.createDataFrame([("a",), (None,)], "k string").select(hashing.seeded_hash(3, F.col("k")).alias("h")).collect()
    message = hashing.framed((3).to_bytes(8, "little"), b"a")
    assert got[0].h == f"{int.from_bytes(hashing.blake3([message])[0][:8], 'little'):016x}" and got[1].h is None


def games(spark, n):
    rows = [record(i, [], path=f"g{i % 7}", ply=i, sfen=f"s{i % 90}") for i in range(n)]
    return frame(spark, rows).withColumn("group_key", F.col("path"))


@pytest.mark.parametrize("profile", [hashing.RECORD, hashing.TEXT])
def test_orders_follow_the_hash(spark, profile):
    rows = games(spark, 200)
    hashed = rows.select("idx", hashing.seeded_hash(5, F.col("sfen"), profile).alias("h")).collect()
    want = {r.idx for r in sorted(hashed, key=lambda r: (r.h, r.idx))[:31]}
    assert {r.idx for r in sampling.reservoir(rows, 31, 5, profile).collect()} == want
    order = sampling.shuffled(rows, 5, 16, profile).orderBy("training_position").collect()
    assert [r.training_position for r in order] == list(range(1, 201))
    assert all(r.block_id == (r.training_position - 1) // 16 for r in order)
    assert sorted(r.idx for r in order) == list(range(200))
    again = sampling.shuffled(rows.repartition(5), 5, 16, profile).orderBy("training_position").collect()
    assert [r.idx for r in again] == [r.idx for r in order]


def test_split_keeps_groups_together(spark):
    parts = sampling.split(games(spark, 300), 1, 0.3, 0.3).select("group_key", "split").distinct().collect()
    assert max(Counter(r.group_key for r in parts).values()) == 1
    with pytest.raises(ValueError, match="below 1"):
        sampling.split(games(spark, 1), 1, 0.5, 0.5)


def test_fill_goes_round_by_round(spark):
    rows = games(spark, 70).withColumn("bucket_key", F.lit("x"))
    kept = sampling.group_fill(rows, {"x": 10, "unseen": 5}, 3).collect()
    assert len(kept) == 10 and sorted(Counter(r.group_key for r in kept).values()) == [1, 1, 1, 1, 2, 2, 2]
    assert sampling.group_fill(rows.where("false"), {"x": 10}, 3).count() == 0
    assert sampling.largest_group_share(rows.limit(0)).first().max_share is None


def test_openings_give_one_reason_each(spark):
    states = ["a b - 1", "a  b - 9", "c b - 1", "d b - 1", "bad"]
    rows = frame(spark, [record(i, [], ply=i, sfen=s) for i, s in enumerate(states)]).withColumn("group_key", F.col("path"))
    got = sampling.gate_openings(rows, 1, 0, 0, 2, F.col("sfen") != "bad").orderBy("idx").collect()
    assert [r.drop_reason for r in got] == [None, "duplicate_sfen", "over_count", "above_max_ply", "invalid_sfen"]


def merged(spark, policy, base, incoming):
    out = merging.merge(frame(spark, base), frame(spark, incoming), policy)
    return {(r.side_ord, r.idx): ([o.cp for o in r.observations], r.matched, r.collisions) for r in out.collect()}


def test_merge_takes_the_last_of_repeated_keys(spark):
    base = [record(0, [seen(1)], sfen="s"), record(1, [seen(2)], sfen="s"), record(2, [], sfen="t")]
    incoming = [record(0, [seen(8)], sfen="s"), record(5, [seen(9)], sfen="s"), record(6, [seen(7)], sfen="u")]
    got = merged(spark, merging.KEEP_BOTH, base, incoming)
    assert got == {
        (0, 0): ([1, 9], True, 0),
        (0, 1): ([2, 9], True, 0),
        (0, 2): ([], False, 0),
        (1, 0): ([8], False, 0),
        (1, 6): ([7], False, 0),
    }


def test_collisions_are_judged_against_what_is_kept_so_far(spark):
    base = [record(0, [seen(1, depth=4), seen(2, depth=6)])]
    incoming = [record(0, [seen(7, depth=4), seen(8, depth=8), seen(9, depth=8)])]
    assert merged(spark, merging.PREFER_PRIMARY, base, incoming)[0, 0] == ([1, 2, 8], True, 2)
    assert merged(spark, merging.PREFER_SECONDARY, base, incoming)[0, 0] == ([2, 7, 9], True, 2)
    with pytest.raises(ValueError, match="policy"):
        merged(spark, "other", base, incoming)
