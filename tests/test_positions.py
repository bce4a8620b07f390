"""Every registered position query against DuckDB, and the gates on hand-made records."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plyforge.functions.positions import QualityConfig
from plyforge.operators import positions as O
from plyforge.plans import formats, registry, selection  # noqa: F401  (all three register queries)

SF = "/root/testdata/sf0.001"
OBSERVATION = "struct<engine:string,depth:int,requested_depth:int,kind:string,cp:int,bestmove:string,margin:int,bound:string,salvaged:boolean>"
RECORD = (
    "idx long, sfen string, path string, ply long, phase string, side string, in_check boolean, has_capture boolean,"
    f" outcome string, observations array<{OBSERVATION}>"
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(key, want)) == sorted(key(tuple(r)) for r in got.select(*columns).collect())


def record(idx, observations, side="black", ply=1, path="g", **more):
    base = dict(sfen=str(idx), phase="opening", in_check=False, has_capture=False, outcome="draw")
    return {"idx": idx, "side": side, "ply": ply, "path": path, "observations": observations} | base | more


def seen(cp=0, depth=4, engine="a", move="m1", kind="cp", asked=None, margin=None, bound="exact", salvaged=False):
    return (engine, depth, asked, kind, cp if kind == "cp" else None, move, margin, bound, salvaged)


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


@pytest.mark.parametrize(
    ("config", "failing", "passing"),
    [
        (dict(min_observations=1), [], [seen()]),
        (dict(exclude_mate=True), [seen(kind="mate")], [seen()]),
        (dict(eval_min=-10), [seen(-11)], [seen(-10)]),
        (dict(eval_max=10), [seen(11)], [seen(10)]),
        (dict(max_score_swing_cp=5), [seen(0), seen(6)], [seen(9)]),
        (dict(min_policy_margin_cp=5), [seen(margin=4)], [seen(margin=None)]),
        (dict(require_policy_margin=True), [], [seen(margin=1)]),
        (dict(require_exact_score=True), [seen(bound="lowerbound")], [seen()]),
        (dict(min_depth_reached=5), [seen(depth=4)], [seen(depth=1, kind="mate")]),
        (dict(require_requested_depth_reached=True), [seen(depth=4, asked=5)], [seen(depth=4, asked=5, kind="mate")]),
        (dict(require_requested_depth_reached=True), [seen(depth=4, asked=5, kind="mate", salvaged=True)], [seen()]),
        (dict(require_bestmove_agreement=True), [seen(move="m1"), seen(move="m2")], [seen(move="m1"), seen(move="resign")]),
        (dict(require_engine_agreement=True), [seen(move="m1"), seen(move="m2", engine="b")], [seen(move="m1"), seen(move="m2")]),
        (dict(max_engine_score_swing_cp=5), [seen(0), seen(9, engine="b")], [seen(0), seen(9)]),
    ],
)
def test_gate(spark, config, failing, passing):
    rows = frame(spark, [record(1, failing), record(2, passing)])
    assert [r.idx for r in O.filter_quality(rows, QualityConfig(**config)).collect()] == [2]


def test_white_values_are_turned(spark):
    rows = frame(spark, [record(1, [seen(-20)], side="white")])
    assert O.filter_quality(rows, QualityConfig(eval_max=10)).count() == 0


def test_mine_takes_neighbours_of_a_jump(spark):
    rows = frame(spark, [record(i, [seen(cp)] if cp is not None else [], ply=i) for i, cp in enumerate([0, 0, 500, 500, None, 0])])
    assert sorted(r.idx for r in O.mine(rows, 400, 1).collect()) == [1, 2, 3]
    near = sorted(r.idx for r in O.mine(rows, 400, 0).collect())
    assert near == [2]


def test_empty_table(spark):
    rows = frame(spark, [])
    assert O.filter_quality(rows, QualityConfig(min_observations=1)).count() == 0
    assert O.with_bucket(rows).select(F.count("bucket_key")).first()[0] == 0
