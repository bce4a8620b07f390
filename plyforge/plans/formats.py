"""Queries over written and reread forms: JSON lines with planted bad ones, sinks, game records, states and hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import board as B
from plyforge.functions import hashing as H
from plyforge.operators import positions as O
from plyforge.operators.sampling import opening_key
from plyforge.plans.projection import SQL
from plyforge.plans.projection import records as projected_records
from plyforge.plans.registry import _FIRST, _GATES, _SOFT, CONFIG, ORACLES, QUERIES
from plyforge.session import shared_path
from plyforge.sources import games as G
from plyforge.sources import records as R
from plyforge.sources import sinks as S


def _query(name: str, sql: str):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return keep


def _path(spark: SparkSession, name: str) -> str:
    path = shared_path(spark, name)
    if path is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return path


# ---------------------------------------------------------------- JSON lines


def _json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each order: a record, or of every 50 one that is no JSON, one that is no record and one without a state."""
    idx = F.col("o_orderkey")
    black = idx % 2 == 0
    side = F.when(black != (idx % 7 == 0), "black").otherwise("white")
    state = F.concat(F.lit(B.START), F.when(black, " b - ").otherwise(" w - "), (idx % 1000 + 1).cast("string"))
    value = F.struct(F.lit("cp").alias("kind"), (idx % 300 - 150).cast("int").alias("value"))
    seen = F.struct(
        F.lit("e").alias("engine"),
        F.lit(4).alias("depth"),
        F.lit(6).alias("requested_depth"),
        value.alias("score"),
        F.when(idx % 10 == 0, "black").otherwise("side_to_move").alias("score_perspective"),
        F.when(idx % 15 == 0, "resign").otherwise("7g7f").alias("bestmove"),
    )
    record = F.struct(
        F.when(idx % 3 == 0, 7).otherwise(R.SCHEMA_VERSION).alias("schema_version"),
        F.when(idx % 50 == 2, "nonsense").otherwise(state).alias("sfen"),
        F.struct(F.lit("csa").alias("kind"), F.concat(F.lit("p"), idx.cast("string")).alias("path"), (idx % 150 + 1).cast("int").alias("ply")).alias("source"),
        F.struct(F.lit("opening").alias("phase"), side.alias("side_to_move"), F.lit(False).alias("in_check"), F.lit(False).alias("has_capture")).alias("tags"),
        F.when(idx % 5 == 0, F.array(seen)).otherwise(F.array().cast("array<struct<engine:string,depth:int,requested_depth:int,score:struct<kind:string,value:int>,score_perspective:string,bestmove:string>>")).alias("observations"),
        F.when(idx % 4 == 0, F.struct(F.lit("draw").alias("outcome"), F.lit("x").alias("result_source"))).alias("game_result"),
    )
    line = F.when(idx % 50 == 0, "no json {").when(idx % 50 == 1, '{"schema_version": 11}').otherwise(F.to_json(record))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(line.alias("value"))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "lines")
    _json_lines(spark, sf_dir).write.text(path)
    return R.scan(spark, path)


_LINES = """
WITH l AS (
  SELECT o_orderkey AS idx, o_orderkey % 50 AS k, o_orderkey % 2 = 0 AS black, (o_orderkey % 2 = 0) <> (o_orderkey % 7 = 0) AS told,
         CASE WHEN o_orderkey % 50 = 2 THEN 'nonsense' ELSE concat(o_orderkey % 2, ' ', o_orderkey % 1000) END AS state,
         CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE 11 END AS version
  FROM orders
), r AS (SELECT * FROM l WHERE k > 1)
"""


@_query(
    "jsonl_validate",
    _LINES + "SELECT (SELECT count(*) FROM l) AS total_lines, (SELECT count(*) FROM l WHERE k > 0) AS valid_json, count(*) AS valid_records,"
    " (SELECT count(*) FROM l WHERE k = 0) AS broken, count(*) FILTER (k = 2) AS invalid_sfens, count(*) - count(DISTINCT state) AS duplicate_sfens,"
    " count(*) FILTER (k <> 2 AND black <> told) AS tag_mismatches FROM r",
)
def jsonl_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validate(_scanned(spark, sf_dir))


@_query(
    "jsonl_flat",
    _LINES + "SELECT 'p' || idx AS path, idx % 150 + 1 AS ply, CASE WHEN told THEN 'black' ELSE 'white' END AS side,"
    " CASE WHEN idx % 4 = 0 THEN 'draw' ELSE 'unknown' END AS outcome, CASE WHEN idx % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS n,"
    " CASE WHEN idx % 5 = 0 THEN CASE WHEN idx % 10 = 0 AND NOT told THEN 150 - idx % 300 ELSE idx % 300 - 150 END END::INTEGER AS cp,"
    " CASE WHEN idx % 15 = 0 THEN 'resign' WHEN idx % 5 = 0 THEN '7g7f' END AS bestmove FROM r",
)
def jsonl_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get("observations", F.lit(0))
    flat = R.flat(_scanned(spark, sf_dir))
    return flat.select("path", "ply", "side", "outcome", F.size("observations").cast("long").alias("n"), first["cp"].alias("cp"), first["bestmove"].alias("bestmove"))


@_query("jsonl_sink_versions", _LINES + "SELECT version AS schema_version, count(*) AS n FROM r GROUP BY 1")
def jsonl_sink_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "rewritten")
    R.write(_scanned(spark, sf_dir).where("record is not null").select("record.*"), path)
    return R.schema_versions(R.scan(spark, path))


# ---------------------------------------------------------------- sinks


@_query("sfen_sink", SQL + "SELECT sfen AS value, count(*) AS n FROM rec GROUP BY 1")
def sfen_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "states")
    S.write_states(projected_records(spark, sf_dir), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@_query("explain_sink", SQL + f"SELECT {_FIRST} AS reason, count(*) AS n FROM q GROUP BY 1 HAVING reason <> 'keep'")
def explain_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "rejected")
    S.write_rejected(projected_records(spark, sf_dir), CONFIG, path)
    return spark.read.text(path).groupBy(F.get_json_object("value", "$.quality.reasons[0]").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@_query("fan_out_by_source", SQL + "SELECT regexp_replace(path, '[^0-9A-Za-z.-]', '_', 'g') AS file, count(*) AS n, min(ply) AS first_ply FROM rec GROUP BY 1")
def fan_out_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "sources")
    S.write_by_source(projected_records(spark, sf_dir).select("idx", "sfen", "path", "ply"), path)
    return S.read_by_source(spark, path).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min(F.get_json_object("value", "$.ply").cast("long")).alias("first_ply"))


_TALLIES = " UNION ALL ".join(
    f"SELECT '{param}' AS sweep_param, {value} AS sweep_value, {place} AS position, CASE "
    + " ".join(f"WHEN {test} THEN '{reason}'" for reason, test in tests)
    + " END AS reason FROM q"
    for place, (param, value, tests) in enumerate(
        [("policy_margin", m, (("min_observations", "n < 1"), ("mate", "any_mate"), ("score_swing", "swing > 400"), ("policy_margin", f"min_margin < {m}"))) for m in (0, 50, 200)]
        + [("score_swing", s, (("min_observations", "n < 1"), ("mate", "any_mate"), ("score_swing", f"swing > {s}"), ("policy_margin", "min_margin < 100"))) for s in (800, 200)]
    )
)
_SWEEP = (
    f", s AS ({_TALLIES}), c AS (SELECT sweep_param, sweep_value, position, reason, count(*) AS n FROM s GROUP BY ALL)"
    " SELECT position, sweep_param, sweep_value, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (reason IS NULL), 0)::BIGINT AS kept,"
    " coalesce(sum(n) FILTER (reason IS NOT NULL), 0)::BIGINT AS dropped, printf('%.2f', coalesce(sum(n) FILTER (reason IS NULL), 0) / sum(n) * 100) AS coverage_pct,"
    " coalesce(string_agg(reason || '=' || n, ';' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS drop_reasons FROM c GROUP BY ALL"
)


@_query("calibrate_sweep", SQL + _SWEEP)
def calibrate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sweep(projected_records(spark, sf_dir), _SOFT, [0, 50, 200], [800, 200])


@_query("calibrate_csv", f"SELECT sweep_param, sweep_value::VARCHAR AS sweep_value, kept::VARCHAR AS kept, coverage_pct, drop_reasons FROM ({SQL + _SWEEP})")
def calibrate_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "csv")
    S.write_csv(calibrate_sweep(spark, sf_dir), path, "position")
    return spark.read.option("header", True).csv(path).select("sweep_param", "sweep_value", "kept", "coverage_pct", "drop_reasons")


@_query(
    "evaluate_quality",
    SQL + ", k AS (SELECT idx, count(*) FILTER (kind = 'cp') AS cp_count, count(*) FILTER (kind = 'mate') AS mate_count FROM obs GROUP BY 1),"
    " f AS (SELECT *, " + " + ".join(f"coalesce(({test})::INT, 0)" for _, test in _GATES) + " AS failed FROM q)"
    f" SELECT idx, failed = 0 AS keep, (1::FLOAT - (failed / {len(_GATES)}.0::DOUBLE)::FLOAT)::DOUBLE AS score, failed::INT AS n_reasons, swing AS score_swing_cp,"
    " coalesce(k.cp_count, 0)::INT AS cp_count, coalesce(k.mate_count, 0)::INT AS mate_count FROM f LEFT JOIN k USING (idx)",
)
def evaluate_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = O.with_quality(projected_records(spark, sf_dir), CONFIG)
    return judged.select("idx", "keep", F.col("score").cast("double").alias("score"), F.size("reasons").alias("n_reasons"), "score_swing_cp", "cp_count", "mate_count")


_FLAGS = ", ".join(
    f"count(*) FILTER ({side}.bound <> 'exact') AS {whose}_non_exact,"
    f" count(*) FILTER ({side}.requested_depth > {side}.depth AND {side}.kind <> 'mate') AS {whose}_underreach,"
    f" count(*) FILTER ({side}.bestmove = 'resign') AS {whose}_special"
    for whose, side in (("teacher", "t"), ("student", "s"))
)


@_query(
    "audit_stats",
    SQL + ", obs_at AS (SELECT obs.*, d FROM obs JOIN rec USING (idx), (VALUES (12), (4), (6), (8)) v(d) WHERE requested_depth = d OR depth = d"
    " QUALIFY row_number() OVER (PARTITION BY idx, engine, d ORDER BY requested_depth = d DESC, pos) = 1)"
    " SELECT s.d AS student_depth, count(*) AS pairs, count(*) FILTER (t.bestmove <> s.bestmove AND t.bestmove <> 'resign' AND s.bestmove <> 'resign') AS mismatches,"
    f" count(abs(t.cp - s.cp)) AS compared, sum(abs(t.cp - s.cp))::BIGINT AS error_sum, max(abs(t.cp - s.cp)) AS error_max, {_FLAGS}"
    " FROM obs_at t JOIN obs_at s ON t.idx = s.idx AND t.engine = s.engine AND t.d = 12 AND s.d <> 12 GROUP BY ROLLUP (s.d)",
)
def audit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.audit_stats(projected_records(spark, sf_dir), 12, [4, 6, 8])


# ---------------------------------------------------------------- states, hashes, games


@_query(
    "board_states",
    "SELECT o_orderkey AS idx, o_orderkey % 6 <> 5 AS valid, CASE WHEN o_orderkey % 6 <> 5 THEN 122 + CASE WHEN o_orderkey % 3 = 0 THEN 21 ELSE 0 END END::INTEGER AS material,"
    f" '{B.START} ' || CASE WHEN o_orderkey % 6 = 5 THEN 'x' WHEN o_orderkey % 2 = 0 THEN 'b' ELSE 'w' END || CASE WHEN o_orderkey % 3 = 0 THEN ' 2Rp' ELSE ' -' END AS opening FROM orders",
)
def board_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.col("o_orderkey")
    side = F.when(idx % 6 == 5, "x").when(idx % 2 == 0, "b").otherwise("w")
    state = F.concat_ws(" ", F.lit(B.START), side, F.when(idx % 3 == 0, "2Rp").otherwise("-"), (idx % 90 + 1).cast("string"))
    states = spark.read.parquet(f"{sf_dir}/orders.parquet").select(idx.alias("idx"), state.alias("sfen"))
    return states.select("idx", B.state_is_valid(F.col("sfen")).alias("valid"), B.total_material(F.col("sfen")).alias("material"), opening_key(F.col("sfen")).alias("opening"))


@_query(
    "record_hashes",
    "SELECT * FROM (VALUES ('seeded_hash', lower(format('{:016x}', 13402537162744184401::UBIGINT))), ('engine_options_hash', '1923589341701319780'),"
    " ('split', 'train'), ('blake3', 'af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262')) t(what, value)",
)
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that the record format and the published test vectors fix."""
    from plyforge.operators.sampling import split

    one = spark.range(1)
    hashed = one.select(F.lit("seeded_hash").alias("what"), H.seeded_hash(7, F.lit("startpos")).alias("value"))
    shared = split(one.select(F.lit("some-fixed-key").alias("group_key")), 42, 0.1, 0.1).select(F.lit("split").alias("what"), F.col("split").alias("value"))
    known = [("engine_options_hash", str(H.engine_options_hash([("MultiPV", "4")]))), ("blake3", H.blake3([b""])[0].hex())]
    return hashed.unionByName(shared).unionByName(spark.createDataFrame(known, "what string, value string"))


#: One game in the three formats: a bishop exchange with promotion, a drop, and a recapture on the same square.
CSA = (
    "V2.2\nN+first\nN-second\nPI\n+\n+2726FU\n-8384FU\n+2625FU\n-8485FU\n+7776FU\n-4132KI\n+8877KA\n-3334FU\n+7968GI\n-2277UM\n+6877GI\n-3122GI\n"
    "+0055KA\n-2233GI\n%TORYO\n"
)
KIF = (
    "手合割：平手\n手数----指手----消費時間--\n1 ２六歩(27)\n2 ８四歩(83)\n3 ２五歩(26)\n4 ８五歩(84)\n5 ７六歩(77)\n6 ３二金(41)\n7 ７七角(88)\n8 ３四歩(33)\n"
    "9 ６八銀(79)\n10 ７七角成(22)\n11 同　銀(68)\n12 ２二銀(31)\n13 ５五角打\n14 ３三銀(22)\n15 投了\nまで14手で後手の勝ち\n"
)
USI = "2g2f 8c8d 2f2e 8d8e 7g7f 4a3b 8h7g 3c3d 7i6h 2b7g+ 6h7g 3a2b B*5e 2b3c"
MATCH = f"# Engine1: x (Black)\n# Engine2: y (White)\n# Result: Engine2 Win\nposition startpos moves {USI}\n"


@_query(
    "game_positions",
    "SELECT f.format, p.ply, p.usi, p.mover, p.has_capture, 'white_wins' AS outcome FROM (VALUES ('csa'), ('kif'), ('txt')) f(format), (VALUES "
    + ", ".join(f"({i}, '{move}', '{'black' if i % 2 else 'white'}', {'true' if i in (10, 11) else 'false'})" for i, move in enumerate(USI.split(), 1))
    + ") p(ply, usi, mover, has_capture)",
)
def game_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "games")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name, text in (("a.csa", CSA), ("b.kif", KIF), ("c.txt", MATCH)):
        at = hadoop(f"{path}/{name}")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
    read = G.read_games(spark, path).unionByName(G.read_games(spark, path, "match", None))
    return read.select(F.substring_index("file", ".", -1).alias("format"), "ply", "usi", "mover", "has_capture", F.coalesce("outcome", F.lit("white_wins")).alias("outcome"))
