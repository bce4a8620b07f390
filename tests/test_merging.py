"""Merging moves each side once."""

import pytest
from pyspark.sql import functions as F
from test_positions import frame, record, seen

from plyforge.operators import merging


@pytest.mark.parametrize("policy", [merging.KEEP_BOTH, merging.PREFER_PRIMARY, merging.PREFER_SECONDARY])
def test_each_side_is_shuffled_once(spark, policy):
    rows = frame(spark, [record(0, [seen(1)]), record(1, [])])
    plan = merging.merge(rows, rows, policy)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan


def test_rows_without_a_whole_key_and_repeated_ones_stay(spark):
    base = [record(0, [seen(1)], sfen=None), record(1, [seen(2)], sfen="s"), record(2, [seen(3)], sfen="s", path=None)]
    incoming = [record(0, [seen(7)], sfen=None), record(3, [seen(8)], sfen="s"), record(4, [seen(9)], sfen="s"), record(5, [seen(6)], sfen="s", path=None), record(6, [], sfen="t")]
    wrapped = [frame(spark, x).withColumn("idx", F.struct(F.lit("f").alias("file"), F.col("idx").alias("row"))) for x in (base, incoming)]
    got = {(r.side_ord, r.idx.row): ([o.cp for o in r.observations], r.matched) for r in merging.merge(*wrapped).collect()}
    assert got == {
        (0, 0): ([1], False),
        (0, 1): ([2, 9], True),
        (0, 2): ([3], False),
        (1, 0): ([7], False),
        (1, 3): ([8], False),
        (1, 5): ([6], False),
        (1, 6): ([], False),
    }
