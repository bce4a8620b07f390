"""Queries of sampling, selecting, splitting, merging and tuning; registered with the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions import positions as P
from plyforge.functions.hashing import TEXT
from plyforge.functions.positions import QualityConfig
from plyforge.operators import merging, sampling, tuning
from plyforge.operators import positions as O
from plyforge.plans.registry import _GATES, _JUMPS, CONFIG, _counted, _register

SEED = 7
_H = f"sha256('{SEED}:' || sfen)"
_G = f"sha256('{SEED}:' || group_key)"


@_register("sample_reservoir", f"SELECT idx FROM rec ORDER BY {_H}, idx LIMIT 500")
def sample_reservoir(r: DataFrame) -> DataFrame:
    return sampling.reservoir(r, 500, SEED, TEXT).select("idx")


@_register(
    "select_uncertain",
    f", u AS (SELECT idx, row_number() OVER (ORDER BY (CASE WHEN min_margin < 50 THEN 1 ELSE 0 END + non_exact::INT + (margins = 0)::INT + short::INT"
    f" + coalesce(engines >= 2 AND NOT engine_agree, false)::INT) DESC, {_H}, idx) AS rank FROM q) SELECT idx, rank FROM u WHERE rank <= 500",
)
def select_uncertain(r: DataFrame) -> DataFrame:
    return sampling.select_uncertain(r, 500, SEED, 50, TEXT).select("idx", F.col("rank").cast("long").alias("rank"))


@_register(
    "select_coverage",
    f", c AS (SELECT idx, sfen, count(*) OVER (PARTITION BY phase, side, eval_bucket) AS size FROM b),"
    f" u AS (SELECT idx, row_number() OVER (ORDER BY size, {_H}, idx) AS rank FROM c) SELECT idx, rank FROM u WHERE rank <= 500",
)
def select_coverage(r: DataFrame) -> DataFrame:
    return sampling.select_coverage(r, 500, SEED, TEXT).select("idx", F.col("rank").cast("long").alias("rank"))


@_register(
    "select_hard",
    _JUMPS + f", u AS (SELECT idx, row_number() OVER (ORDER BY near DESC, NOT coalesce(agree, true) DESC, coalesce(swing, 0) DESC, {_H}, idx) AS rank FROM m)"
    " SELECT idx, rank FROM u WHERE rank <= 500",
)
def select_hard(r: DataFrame) -> DataFrame:
    return sampling.select_hard(r, 500, SEED, 400, 1, TEXT).select("idx", F.col("rank").cast("long").alias("rank"))


_QUOTAS = {"opening:black:": 100, "opening:white:": 50, "middlegame:black:": 100, "endgame:white:": 25}
_FILL = (
    ", k AS (SELECT *, phase || ':' || side || ':' AS bucket_key FROM rec), quota AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', {n})" for k, n in _QUOTAS.items())
    + f") t(bucket_key, quota)), f AS (SELECT *, {_G} AS h, row_number() OVER (PARTITION BY bucket_key, group_key ORDER BY idx) AS r FROM k JOIN quota USING (bucket_key)),"
    " filled AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY bucket_key ORDER BY r, h, idx) <= quota)"
)


@_register("stratify_fill", _FILL + " SELECT idx, bucket_key FROM filled")
def stratify_fill(r: DataFrame) -> DataFrame:
    return sampling.stratify(r, ("phase", "side"), _QUOTAS, SEED, TEXT).select("idx", "bucket_key")


@_register(
    "stratify_group_share",
    _FILL + ", g AS (SELECT bucket_key, group_key, count(*) AS n FROM filled GROUP BY ALL),"
    " s AS (SELECT sum(n) AS total, max(n) AS most FROM g GROUP BY bucket_key)"
    " SELECT (SELECT max(round(1000000 * most / total)::BIGINT) FROM s WHERE total >= 2) AS max_share_millionths, count(DISTINCT group_key) AS groups FROM g",
)
def stratify_group_share(r: DataFrame) -> DataFrame:
    kept = sampling.stratify(r, ("phase", "side"), _QUOTAS, SEED, TEXT)
    return sampling.largest_group_share(kept).select(F.round(F.col("max_share") * 1000000).cast("long").alias("max_share_millionths"), "groups")


_ID = "sha256(sfen || chr(10) || path || chr(10) || ply)"
_SHUFFLED = f", s AS (SELECT idx, path, {_ID} AS sample_id FROM rec), o AS (SELECT *, row_number() OVER (ORDER BY sha256('{SEED}:' || sample_id), sample_id, idx) AS training_position FROM s)"


@_register("shuffle_order", _SHUFFLED + " SELECT idx, sample_id, training_position, (training_position - 1) // 256 AS block_id FROM o")
def shuffle_order(r: DataFrame) -> DataFrame:
    return sampling.shuffled(r, SEED, 256, TEXT).select("idx", "sample_id", "training_position", "block_id")


_UNIT = f"((('0x' || substr({_G}, 1, 8))::BIGINT::DOUBLE * 4294967296.0 + ('0x' || substr({_G}, 9, 8))::BIGINT::DOUBLE) / 18446744073709551615.0)"
_SPLIT = f", u AS (SELECT *, {_UNIT} AS unit FROM rec), sp AS (SELECT *, CASE WHEN unit < 0.1 THEN 'test' WHEN unit < 0.1 + 0.2 THEN 'valid' ELSE 'train' END AS split FROM u)"


@_register("split_assignment", _SPLIT + " SELECT idx, split FROM sp")
def split_assignment(r: DataFrame) -> DataFrame:
    return sampling.split(r, SEED, 0.2, 0.1, TEXT).select("idx", "split")


@_register("split_counts", _SPLIT + " SELECT split, count(*) AS n, count(DISTINCT path) AS sources FROM sp GROUP BY 1")
def split_counts(r: DataFrame) -> DataFrame:
    return sampling.split(r, SEED, 0.2, 0.1, TEXT).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("sources"))


_OPENINGS = (
    ", w AS (SELECT *, CASE WHEN ply < 5 THEN 'below_min_ply' WHEN ply > 60 THEN 'above_max_ply' END AS reason FROM rec),"
    f" fresh AS (SELECT *, {_G} AS h FROM w WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY sfen ORDER BY idx) = 1),"
    " rounds AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY idx) AS r FROM fresh),"
    " kept AS (SELECT idx FROM rounds ORDER BY r, h, idx LIMIT 300),"
    " g AS (SELECT idx, CASE WHEN reason IS NOT NULL THEN reason WHEN idx NOT IN (SELECT idx FROM fresh) THEN 'duplicate_sfen'"
    " WHEN idx NOT IN (SELECT idx FROM kept) THEN 'over_count' END AS drop_reason FROM w)"
)


@_register("gate_openings_pick", _OPENINGS + " SELECT idx FROM g WHERE drop_reason IS NULL")
def gate_openings_pick(r: DataFrame) -> DataFrame:
    return sampling.gate_openings(r, 300, SEED, 5, 60, profile=TEXT).where("drop_reason is null").select("idx")


@_register("gate_openings_drop_reasons", _OPENINGS + " SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM g GROUP BY 1")
def gate_openings_drop_reasons(r: DataFrame) -> DataFrame:
    return _counted(sampling.gate_openings(r, 300, SEED, 5, 60, profile=TEXT), F.coalesce("drop_reason", F.lit("kept")).alias("reason"))


def _halves(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records as two labelling runs see them: opening and middlegame to depth 8, all but the opening from depth 6."""
    shallow = r.where("phase <> 'endgame'").withColumn(P.OBS, F.filter(P.OBS, lambda o: o["depth"] <= 8))
    deep = r.where("phase <> 'opening'").withColumn(P.OBS, F.filter(P.OBS, lambda o: o["depth"] >= 6))
    return shallow, deep


#: One row an observation of the merged records. base and inc are the two runs' observations in their order.
_MERGE = (
    ", base AS (SELECT obs.*, 'p' AS run FROM obs JOIN rec USING (idx) WHERE phase <> 'endgame' AND depth <= 8),"
    " inc AS (SELECT obs.*, 's' AS run FROM obs JOIN rec USING (idx) WHERE phase <> 'opening' AND depth >= 6)"
)
_SAME = "x.idx = y.idx AND x.engine = y.engine AND x.depth = y.depth AND x.requested_depth = y.requested_depth"
_MID = "x.idx IN (SELECT idx FROM rec WHERE phase = 'middlegame')"


def _merged_rows(kept: str, collided: str) -> str:
    return (
        _MERGE
        + f", kept AS ({kept}), hit AS ({collided}), n AS (SELECT idx, count(*) AS n, sum(coalesce(cp, 0)) AS cp_sum FROM kept GROUP BY 1), h AS (SELECT idx, count(*) AS c FROM hit GROUP BY 1)"
        " SELECT idx, CASE WHEN phase = 'endgame' THEN 1 ELSE 0 END AS side_ord, phase = 'middlegame' AS matched, coalesce(n.n, 0) AS observations_n,"
        " coalesce(cp_sum, 0)::BIGINT AS cp_sum, coalesce(c, 0)::BIGINT AS collisions FROM rec LEFT JOIN n USING (idx) LEFT JOIN h USING (idx)"
    )


#: Incoming ones that meet an equal key: an earlier one of the same run, or one of the other run.
_HITS = f"SELECT y.* FROM inc y WHERE y.idx IN (SELECT idx FROM rec WHERE phase = 'middlegame') AND (EXISTS (SELECT 1 FROM base x WHERE {_SAME}) OR EXISTS (SELECT 1 FROM inc x WHERE {_SAME} AND x.pos < y.pos))"
_LATER = f"SELECT x.* FROM inc x WHERE NOT ({_MID} AND EXISTS (SELECT 1 FROM inc y WHERE {_SAME} AND y.pos > x.pos))"


def _merge_query(r: DataFrame, policy: str) -> DataFrame:
    merged = merging.merge(*_halves(r), policy)
    total = F.aggregate(P.OBS, F.lit(0).cast("long"), lambda a, o: a + F.coalesce(o["cp"], F.lit(0)))
    return merged.select(
        "idx", "side_ord", "matched", F.size(P.OBS).cast("long").alias("observations_n"), total.alias("cp_sum"), F.col("collisions").cast("long").alias("collisions")
    )


@_register("merge_keep_both", _merged_rows("SELECT * FROM base UNION ALL SELECT * FROM inc", "SELECT * FROM inc WHERE false"))
def merge_keep_both(r: DataFrame) -> DataFrame:
    return _merge_query(r, merging.KEEP_BOTH)


@_register(
    "merge_prefer_primary",
    _merged_rows(f"SELECT * FROM base UNION ALL SELECT * FROM inc ANTI JOIN ({_HITS}) z USING (idx, pos)", _HITS),
)
def merge_prefer_primary(r: DataFrame) -> DataFrame:
    return _merge_query(r, merging.PREFER_PRIMARY)


@_register(
    "merge_prefer_secondary",
    _merged_rows(f"SELECT x.* FROM base x WHERE NOT EXISTS (SELECT 1 FROM inc y WHERE {_SAME}) UNION ALL {_LATER}", _HITS),
)
def merge_prefer_secondary(r: DataFrame) -> DataFrame:
    return _merge_query(r, merging.PREFER_SECONDARY)


@_register(
    "resume_left_merge",
    _MERGE + ", kept AS (SELECT * FROM base UNION ALL SELECT inc.* FROM inc JOIN rec USING (idx) WHERE phase <> 'endgame')"
    " SELECT idx, count(kept.idx) AS observations_n FROM rec LEFT JOIN kept USING (idx) WHERE phase <> 'endgame' GROUP BY 1",
)
def resume_left_merge(r: DataFrame) -> DataFrame:
    return merging.resume(*_halves(r)).select("idx", F.size(P.OBS).cast("long").alias("observations_n"))


_TUNE = QualityConfig(min_observations=1)
_MARGINS, _SWINGS = [None, 50, 100, 200], [None, 200, 400, 800]
_AT = "SELECT obs.*, d FROM obs JOIN rec USING (idx), (VALUES (12), (4), (6), (8)) v(d) WHERE requested_depth = d OR depth = d QUALIFY row_number() OVER (PARTITION BY idx, engine, d ORDER BY requested_depth = d DESC, pos) = 1"
_PAIRS = (
    f", obs_at AS ({_AT}), pair AS (SELECT t.idx, s.d AS student_depth, t.bestmove <> s.bestmove AND t.bestmove <> 'resign' AND s.bestmove <> 'resign' AS mismatch,"
    " abs(t.cp - s.cp) AS error FROM obs_at t JOIN obs_at s ON t.idx = s.idx AND t.engine = s.engine AND t.d = 12 AND s.d <> 12)"
)
_VALUES = lambda xs: ", ".join("(CAST(NULL AS INT))" if x is None else f"({x})" for x in xs)
_GRID = (
    _PAIRS + ", pr AS (SELECT idx, count(*) AS pairs, count(*) FILTER (mismatch) AS mismatches, count(error) AS compared, coalesce(sum(error), 0) AS error_sum,"
    " max(error) AS error_max FROM pair GROUP BY 1),"
    f" c AS (SELECT * FROM (VALUES {_VALUES(_MARGINS)}) a(margin), (VALUES {_VALUES(_SWINGS)}) e(swing)),"
    " j AS (SELECT c.margin, c.swing, q.idx, coalesce(n >= 1 AND coalesce(q.swing <= c.swing, true) AND coalesce(min_margin >= c.margin, true), false) AS keep FROM q, c),"
    " cells AS (SELECT margin, swing, count(*) AS total, count(*) FILTER (keep) AS kept, coalesce(sum(pairs) FILTER (keep), 0)::BIGINT AS pairs,"
    " coalesce(sum(mismatches) FILTER (keep), 0)::BIGINT AS mismatches, coalesce(sum(compared) FILTER (keep), 0)::BIGINT AS compared,"
    " coalesce(sum(error_sum) FILTER (keep), 0)::BIGINT AS error_sum, max(error_max) FILTER (keep) AS error_max FROM j LEFT JOIN pr USING (idx) GROUP BY 1, 2)"
)


def _tune_grid(r: DataFrame) -> DataFrame:
    return tuning.grid(r, _TUNE, _MARGINS, _SWINGS, 12, [4, 6, 8])


@_register("tune_grid", _GRID + " SELECT * FROM cells")
def tune_grid(r: DataFrame) -> DataFrame:
    return _tune_grid(r).drop("cell")


@_register(
    "tune_frontier",
    _GRID + ", k AS (SELECT *, kept / total AS cov, mismatches / pairs AS mis FROM cells WHERE pairs > 0),"
    " f AS (SELECT * FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.cov >= x.cov AND y.mis <= x.mis AND (y.cov > x.cov OR y.mis < x.mis))),"
    " z AS (SELECT *, CASE WHEN max(cov) OVER () > min(cov) OVER () THEN (cov - min(cov) OVER ()) / (max(cov) OVER () - min(cov) OVER ()) ELSE 0 END AS c1,"
    " CASE WHEN max(mis) OVER () > min(mis) OVER () THEN (mis - min(mis) OVER ()) / (max(mis) OVER () - min(mis) OVER ()) ELSE 0 END AS m1 FROM f),"
    " y AS (SELECT *, row_number() OVER (ORDER BY cov DESC, mis, margin NULLS FIRST, swing NULLS FIRST) = 1 AS broad,"
    " row_number() OVER (ORDER BY sqrt(pow(1.0 - c1, 2) + pow(m1, 2)), margin NULLS FIRST, swing NULLS FIRST) = 1 AS balanced,"
    " row_number() OVER (ORDER BY mis, cov DESC, margin NULLS FIRST, swing NULLS FIRST) = 1 AS strict FROM z)"
    " SELECT margin, swing, kept, pairs, mismatches, concat_ws(',', CASE WHEN broad THEN 'broad' END, CASE WHEN balanced THEN 'balanced' END,"
    " CASE WHEN strict THEN 'strict' END) AS roles FROM y",
)
def tune_frontier(r: DataFrame) -> DataFrame:
    return tuning.frontier(_tune_grid(r)).select("margin", "swing", "kept", "pairs", "mismatches", "roles")


@_register("audit_pairs", _PAIRS + " SELECT idx, student_depth, mismatch, error FROM pair")
def audit_pairs(r: DataFrame) -> DataFrame:
    return O.audit_pairs(r, 12, [4, 6, 8]).select("idx", "student_depth", "mismatch", "error")


@_register(
    "distribution_eval_grid",
    ", t AS (SELECT phase, side, eval_bucket, count(*) AS n FROM b GROUP BY ALL),"
    " r AS (SELECT min(CAST(eval_bucket AS BIGINT)) AS lo, max(CAST(eval_bucket AS BIGINT)) AS hi, avg(n) AS mean FROM t WHERE eval_bucket NOT IN ('_none_', 'mate')),"
    " bk AS (SELECT '_none_' AS eval_bucket UNION ALL SELECT 'mate' UNION ALL SELECT CAST(unnest(range(lo, hi + 1, 200)) AS VARCHAR) FROM r),"
    " cells AS (SELECT phase, side, eval_bucket, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES ('opening'), ('middlegame'), ('endgame')) p(phase), (VALUES ('black'), ('white')) s(side), bk)"
    " LEFT JOIN t USING (phase, side, eval_bucket))"
    " SELECT phase, side, eval_bucket, n, CASE WHEN n = 0 THEN 'MISSING' WHEN eval_bucket IN ('_none_', 'mate') THEN '-'"
    " WHEN n < 0.5 * mean THEN 'UNDER' WHEN n > 2.0 * mean THEN 'OVER' ELSE 'OK' END AS status FROM cells, r",
)
def distribution_eval_grid(r: DataFrame) -> DataFrame:
    return O.eval_coverage(r)


_FAILS = " + ".join(f"coalesce({test}, false)::INT" for _, test in _GATES)


@_register("quality_score_counts", f"SELECT {_FAILS} AS fails, count(*) AS n FROM q GROUP BY 1")
def quality_score_counts(r: DataFrame) -> DataFrame:
    return _counted(O.with_reasons(r, CONFIG), F.size("reasons").alias("fails"))


@_register("report_duplicates", "SELECT sfen, count(*) - 1 AS extra FROM rec GROUP BY 1 HAVING count(*) > 1")
def report_duplicates(r: DataFrame) -> DataFrame:
    return _counted(r, "sfen").where("n > 1").select("sfen", (F.col("n") - 1).alias("extra"))


@_register("eval_by_phase", "SELECT phase, eval_bucket, count(*) AS n FROM b GROUP BY 1, 2")
def eval_by_phase(r: DataFrame) -> DataFrame:
    return _counted(O.prepared(r), "phase", P.eval_bucket().alias("eval_bucket"))


@_register("eval_by_side", "SELECT side, eval_bucket, count(*) AS n FROM b GROUP BY 1, 2")
def eval_by_side(r: DataFrame) -> DataFrame:
    return _counted(O.prepared(r), "side", P.eval_bucket().alias("eval_bucket"))


@_register("distribution_roots", "SELECT group_key, count(*) AS n, count(DISTINCT path) AS paths FROM rec GROUP BY 1")
def distribution_roots(r: DataFrame) -> DataFrame:
    return r.groupBy("group_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"))


@_register("split_by_source_counts", "SELECT path, count(*) AS n, min(ply) AS first_ply, max(ply) AS last_ply FROM rec GROUP BY 1")
def split_by_source_counts(r: DataFrame) -> DataFrame:
    return r.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("ply").alias("first_ply"), F.max("ply").alias("last_ply"))


@_register("engine_agreement", "SELECT idx, engine_agree AS agree, engine_swing AS swing FROM q WHERE engines >= 2")
def engine_agreement(r: DataFrame) -> DataFrame:
    s = O.with_stability(r).where("engine_bestmove_agreement is not null")
    return s.select("idx", F.col("engine_bestmove_agreement").alias("agree"), F.col("engine_score_swing_cp").alias("swing"))


@_register(
    "balance_eval_bucket",
    ", t AS (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM b GROUP BY eval_bucket))"
    " SELECT idx, eval_bucket || ':' AS bucket_key FROM b, t QUALIFY row_number() OVER (PARTITION BY eval_bucket ORDER BY sfen, idx) <= target",
)
def balance_eval_bucket(r: DataFrame) -> DataFrame:
    return O.balance(r, ("eval",)).select("idx", "bucket_key")
