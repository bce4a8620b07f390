"""What the projection of the order tables moves between tasks."""

import re

from plyforge.plans import projection

SMOKE = "/root/testdata/sf0.001"


def test_lines_are_moved_once_with_their_own_columns_alone(spark):
    """Lines gathered before the shuffle were sorted and spilled there, and carried what follows from their columns."""
    plan = projection.projected(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(l_orderkey") :].split("Exchange hashpartitioning(o_")[0]
    assert "collect_list" not in below and "Exchange" not in below[1:]
    names = set(re.findall(r"(\w+)#\d+", below)) - {"plan_id"}
    assert names == {"l_orderkey", *projection._ORDER}


def test_lines_keep_their_order_and_orders_without_lines_stay(spark, tmp_path):
    line = (
        "{k}L AS l_orderkey, {part}L AS l_partkey, 3L AS l_suppkey, {n} AS l_linenumber, 5D AS l_quantity, 90000D AS l_extendedprice, {off}D AS l_discount,"
        " 0.08D AS l_tax, 'R' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP'2000-01-01' AS l_shipdate"
    )
    lines = [(1, 20, 2, 0.1), (1, 21, 1, 0.0), (1, 7, 2, 0.0)]
    spark.sql(" UNION ALL ".join("SELECT " + line.format(k=k, part=p, n=n, off=off) for k, p, n, off in lines)).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql(
        "SELECT id AS o_orderkey, 9L AS o_custkey, 'F' AS o_orderstatus, '2-HIGH' AS o_orderpriority, TIMESTAMP'2000-01-01' AS o_orderdate FROM range(1, 3)"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    first, second = projection.projected(spark, str(tmp_path)).orderBy("idx").collect()
    assert [tuple(o) for o in first.observations] == [
        ("e1", 2, 4, "cp", 400, "m0", 50, "exact", False),
        ("e1", 4, 6, "cp", 400, "m1", 50, "exact", False),
        ("e1", 4, 6, "mate", None, "resign", 50, "lowerbound", False),
    ]
    assert (second.ply, second.path, second.observations, first.has_capture) == (9, "g9", [], True)
