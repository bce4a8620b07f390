"""Position records made from the order tables: orders are positions, their lines observations, customers games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plyforge.functions.positions import group_of, phase_of
from plyforge.session import shared_path

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


_stored: dict[tuple[str, str], str] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the tables below sf_dir, from a table of records that the first query of an application stores.

    Queries then scan the columns they need instead of gathering every order's lines again.
    Without a folder that executors share the projection is computed each time.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path, made = shared_path(spark, "records"), projected(spark, sf_dir)
        if path is None:
            return made
        made.write.parquet(path)
        _stored[key] = path
    return spark.read.schema(projected(spark, sf_dir).schema).parquet(_stored[key])


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as positions, each with its lines as observations, in the order of l_linenumber.

    Only the lines' own columns are shuffled, and before they are gathered: no order's lines lie
    together in the input, so that gathering them earlier sorts and spills without making less.
    What follows from a row is made after the last shuffle.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *_ORDER).repartition("l_orderkey")
    observed = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_ORDER))).alias("_lines"))
    game = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", (8 * F.row_number().over(game) - 7).cast("long").alias("ply")
    )
    path = F.concat(F.lit("g"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 10 == 0, "#var1@5").otherwise(""))
    observations = F.transform("_lines", _observation)
    return (
        orders.join(observed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("idx"),
            (F.col("o_orderkey") % 4000).cast("string").alias("sfen"),
            path.alias("path"),
            "ply",
            F.when(F.col("o_orderkey") % 2 == 0, "black").otherwise("white").alias("side"),
            (F.col("o_orderpriority") == "1-URGENT").alias("in_check"),
            (F.col("o_orderpriority") == "2-HIGH").alias("has_capture"),
            F.when(F.col("o_orderstatus") == "F", "black_wins").when(F.col("o_orderstatus") == "O", "white_wins").otherwise("draw").alias("outcome"),
            phase_of(F.col("ply")).alias("phase"),
            group_of(path).alias("group_key"),
            F.coalesce(observations, F.array()).alias("observations"),
        )
    )


def _observation(line: Column) -> Column:
    """An order's line, a struct of _ORDER, as an observation."""
    mate = F.round(line["l_discount"] * 100).cast("int") == 10
    depth = line["l_linenumber"] * 2
    return F.struct(
        F.concat(F.lit("e"), (line["l_suppkey"] % 2).cast("string")).alias("engine"),
        depth.cast("int").alias("depth"),
        F.when(F.round(line["l_tax"] * 100).cast("int") > 7, depth + 2).otherwise(depth).cast("int").alias("requested_depth"),
        F.when(mate, "mate").otherwise("cp").alias("kind"),
        F.when(~mate, (F.floor(line["l_extendedprice"] / 100) - 500).cast("int")).alias("cp"),
        F.when((line["l_returnflag"] == "R") & (line["l_partkey"] % 20 == 0), "resign")
        .otherwise(F.concat(F.lit("m"), (line["l_partkey"] % 3).cast("string")))
        .alias("bestmove"),
        F.when(line["l_linestatus"] == "O", line["l_quantity"].cast("int") * 10).alias("margin"),
        F.when(line["l_partkey"] % 10 == 0, "lowerbound").otherwise("exact").alias("bound"),
        (line["l_partkey"] % 25 == 0).alias("salvaged"),
    )


#: The same projection in DuckDB, with one row an observation and what the operators need per record.
SQL = """
WITH rec0 AS (
  SELECT o_orderkey AS idx, CAST(o_orderkey % 4000 AS VARCHAR) AS sfen,
         'g' || o_custkey || CASE WHEN o_orderkey % 10 = 0 THEN '#var1@5' ELSE '' END AS path,
         'g' || o_custkey AS group_key,
         8 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 7 AS ply,
         CASE WHEN o_orderkey % 2 = 0 THEN 'black' ELSE 'white' END AS side,
         o_orderpriority = '1-URGENT' AS in_check, o_orderpriority = '2-HIGH' AS has_capture,
         CASE o_orderstatus WHEN 'F' THEN 'black_wins' WHEN 'O' THEN 'white_wins' ELSE 'draw' END AS outcome
  FROM orders
), rec AS (
  SELECT *, CASE WHEN ply <= 20 THEN 'opening' WHEN ply <= 100 THEN 'middlegame' ELSE 'endgame' END AS phase FROM rec0
), obs AS (
  SELECT l_orderkey AS idx,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                            l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS pos,
         'e' || (l_suppkey % 2) AS engine, l_linenumber * 2 AS depth,
         CASE WHEN CAST(round(l_tax * 100) AS INT) > 7 THEN l_linenumber * 2 + 2 ELSE l_linenumber * 2 END AS requested_depth,
         CASE WHEN CAST(round(l_discount * 100) AS INT) = 10 THEN 'mate' ELSE 'cp' END AS kind,
         CASE WHEN CAST(round(l_discount * 100) AS INT) <> 10 THEN CAST(floor(l_extendedprice / 100) AS INT) - 500 END AS cp,
         CASE WHEN l_returnflag = 'R' AND l_partkey % 20 = 0 THEN 'resign' ELSE 'm' || (l_partkey % 3) END AS bestmove,
         CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS INT) * 10 END AS margin,
         CASE WHEN l_partkey % 10 = 0 THEN 'lowerbound' ELSE 'exact' END AS bound, l_partkey % 25 = 0 AS salvaged
  FROM lineitem
), by_engine AS (
  SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY idx, engine ORDER BY depth DESC, pos) = 1
), top AS (
  SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY idx ORDER BY depth DESC, pos DESC) = 1
), e AS (
  SELECT idx, count(*) AS engines, count(DISTINCT bestmove) FILTER (bestmove <> 'resign') <= 1 AS agree,
         CASE WHEN count(cp) >= 2 THEN max(cp) - min(cp) END AS swing
  FROM by_engine GROUP BY idx
), q AS (
  SELECT rec.*, coalesce(o.n, 0) AS n, coalesce(o.any_mate, false) AS any_mate, coalesce(o.any_salvaged, false) AS any_salvaged,
         CASE WHEN side = 'white' THEN -o.hi ELSE o.lo END AS black_lo, CASE WHEN side = 'white' THEN -o.lo ELSE o.hi END AS black_hi,
         o.swing, o.min_margin, coalesce(o.non_exact, false) AS non_exact, coalesce(o.margins, 0) AS margins, o.min_depth,
         coalesce(o.short, false) AS short, o.agree, e.engines, e.agree AS engine_agree, e.swing AS engine_swing,
         top.kind AS top_kind, CASE WHEN side = 'white' THEN -top.cp ELSE top.cp END AS eval_black
  FROM rec LEFT JOIN (
    SELECT idx, count(*) AS n, bool_or(kind = 'mate') AS any_mate, bool_or(salvaged) AS any_salvaged, min(cp) AS lo, max(cp) AS hi,
           CASE WHEN count(cp) >= 2 THEN max(cp) - min(cp) END AS swing, min(margin) AS min_margin, bool_or(bound <> 'exact') AS non_exact,
           count(margin) AS margins, min(depth) FILTER (kind = 'cp') AS min_depth,
           bool_or(requested_depth > depth AND (kind = 'cp' OR salvaged)) AS short,
           count(DISTINCT bestmove) FILTER (bestmove <> 'resign') <= 1 AS agree
    FROM obs GROUP BY idx) o USING (idx)
  LEFT JOIN e USING (idx) LEFT JOIN top USING (idx)
), b AS (
  SELECT *, CASE WHEN n = 0 THEN '_none_' WHEN top_kind = 'mate' THEN 'mate'
                 ELSE CAST(CAST(floor(eval_black / 200.0) * 200 AS BIGINT) AS VARCHAR) END AS eval_bucket,
         CASE WHEN outcome = 'draw' THEN 'draw' WHEN outcome = side || '_wins' THEN 'success' ELSE 'failure' END AS wdl
  FROM q
)
"""
