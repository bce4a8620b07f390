"""All queries of the position operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions import positions as P
from plyforge.functions.positions import QualityConfig
from plyforge.operators import positions as O
from plyforge.plans.projection import SQL, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "filter_first_reason"

CONFIG = QualityConfig(
    min_observations=2,
    allowed_phases=("opening", "middlegame"),
    exclude_mate=True,
    exclude_in_check=True,
    exclude_capture=True,
    exclude_timeout_salvaged=True,
    eval_min=-450,
    eval_max=450,
    max_score_swing_cp=600,
    min_policy_margin_cp=50,
    require_exact_score=True,
    require_policy_margin=True,
    min_depth_reached=4,
    require_requested_depth_reached=True,
    require_bestmove_agreement=True,
    require_engine_agreement=True,
    max_engine_score_swing_cp=300,
)

#: The gates of CONFIG over the SQL projection, in evaluation order.
_GATES = (
    ("min_observations", "n < 2"),
    ("phase", "phase NOT IN ('opening', 'middlegame')"),
    ("mate", "any_mate"),
    ("in_check", "in_check"),
    ("capture", "has_capture"),
    ("timeout_salvaged", "any_salvaged"),
    ("eval_min", "black_lo < -450"),
    ("eval_max", "black_hi > 450"),
    ("score_swing", "swing > 600"),
    ("policy_margin", "min_margin < 50"),
    ("non_exact_score", "non_exact"),
    ("missing_policy_margin", "margins = 0"),
    ("low_actual_depth", "min_depth < 4"),
    ("requested_depth_not_reached", "short"),
    ("bestmove_disagreement", "n >= 2 AND NOT agree"),
    ("engine_disagreement", "engines >= 2 AND NOT engine_agree"),
    ("engine_score_swing", "engine_swing > 300"),
)
_FIRST = "CASE " + " ".join(f"WHEN {test} THEN '{reason}'" for reason, test in _GATES) + " ELSE 'keep' END"


def _register(name: str, sql: str | None):
    def keep(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(records(spark, sf_dir))
        if sql:
            ORACLES[name] = SQL + sql
        return f

    return keep


def _counted(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@_register("filter_first_reason", f"SELECT {_FIRST} AS reason, count(*) AS n FROM q GROUP BY 1")
def filter_first_reason(r: DataFrame) -> DataFrame:
    first = F.coalesce(F.get("reasons", F.lit(0)), F.lit("keep"))
    return _counted(O.with_reasons(r, CONFIG), first.alias("reason"))


@_register("filter_all_reasons", " UNION ALL ".join(f"SELECT '{reason}' AS reason, count(*) AS n FROM q WHERE {test} HAVING count(*) > 0" for reason, test in _GATES))
def filter_all_reasons(r: DataFrame) -> DataFrame:
    return _counted(O.with_reasons(r, CONFIG).select(F.explode("reasons").alias("reason")), "reason")


_SOFT = QualityConfig(min_observations=1, exclude_mate=True, max_score_swing_cp=400, min_policy_margin_cp=100)


@_register("filter_kept", "SELECT idx FROM q WHERE n >= 1 AND NOT any_mate AND coalesce(swing, 0) <= 400 AND coalesce(min_margin, 100) >= 100")
def filter_kept(r: DataFrame) -> DataFrame:
    return O.filter_quality(r, _SOFT).select("idx")


@_register(
    "stability_fields",
    "SELECT idx, swing AS score_swing_cp, agree AS bestmove_agreement, CASE WHEN engines >= 2 THEN engine_agree END AS engine_bestmove_agreement,"
    " engine_swing AS engine_score_swing_cp FROM q",
)
def stability_fields(r: DataFrame) -> DataFrame:
    return O.with_stability(r).select("idx", *P.stability())


@_register("eval_bucket_hist", "SELECT eval_bucket, count(*) AS n FROM b GROUP BY 1")
def eval_bucket_hist(r: DataFrame) -> DataFrame:
    return _counted(O.prepared(r), P.eval_bucket().alias("eval_bucket"))


@_register("stratify_template", "SELECT phase || ':' || side || ':' || eval_bucket || ':' || wdl || ':' AS bucket_key, count(*) AS n FROM b GROUP BY 1")
def stratify_template(r: DataFrame) -> DataFrame:
    return _counted(O.with_bucket(r), "bucket_key")


@_register(
    "balance_phase_side",
    ", t AS (SELECT min(n) AS target FROM (SELECT count(*) AS n FROM rec GROUP BY phase, side))"
    " SELECT idx, phase || ':' || side || ':' AS bucket_key FROM rec, t"
    " QUALIFY row_number() OVER (PARTITION BY phase, side ORDER BY sfen, idx) <= target",
)
def balance_phase_side(r: DataFrame) -> DataFrame:
    return O.balance(r, ("phase", "side")).select("idx", "bucket_key")


_JUMPS = (
    ", j AS (SELECT *, coalesce(abs(eval_black - lag(eval_black) OVER (PARTITION BY path ORDER BY ply, idx)) >= 400, false) AS jump FROM q),"
    " m AS (SELECT *, bool_or(jump) OVER (PARTITION BY path ORDER BY ply, idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AND n > 0 AS near FROM j)"
)


@_register("mine_blunders", _JUMPS + " SELECT idx FROM m WHERE near")
def mine_blunders(r: DataFrame) -> DataFrame:
    return O.mine(r, 400, 1).select("idx")


@_register("mine_losing", _JUMPS + " SELECT idx FROM m WHERE near OR coalesce(CASE WHEN side = 'white' THEN -eval_black ELSE eval_black END < -300, false)")
def mine_losing(r: DataFrame) -> DataFrame:
    return O.mine(r, 400, 1, losing=300).select("idx")


@_register(
    "calibrate_cells",
    ", c AS (SELECT * FROM (VALUES (0), (50), (100), (200)) a(m), (VALUES (100), (200), (400), (800)) b(s))"
    " SELECT m AS margin, s AS swing, count(*) AS total, count(*) FILTER (n >= 1 AND NOT any_mate AND coalesce(q.swing <= s, true)"
    " AND coalesce(min_margin >= m, true)) AS kept FROM q, c GROUP BY m, s",
)
def calibrate_cells(r: DataFrame) -> DataFrame:
    return O.calibrate(r, _SOFT, [0, 50, 100, 200], [100, 200, 400, 800]).select("margin", "swing", "total", "kept")


@_register(
    "audit_by_depth",
    ", obs_at AS (SELECT obs.*, d FROM obs JOIN rec USING (idx), (VALUES (12), (4), (6), (8)) v(d) WHERE requested_depth = d OR depth = d"
    " QUALIFY row_number() OVER (PARTITION BY idx, engine, d ORDER BY requested_depth = d DESC, pos) = 1)"
    " SELECT s.d AS student_depth, count(*) AS pairs, count(*) FILTER (t.bestmove <> s.bestmove AND t.bestmove <> 'resign' AND s.bestmove <> 'resign') AS mismatches,"
    " count(abs(t.cp - s.cp)) AS compared, sum(abs(t.cp - s.cp))::BIGINT AS error_sum, max(abs(t.cp - s.cp)) AS error_max"
    " FROM obs_at t JOIN obs_at s ON t.idx = s.idx AND t.engine = s.engine AND t.d = 12 AND s.d <> 12 GROUP BY 1",
)
def audit_by_depth(r: DataFrame) -> DataFrame:
    return O.audit(r, 12, [4, 6, 8])


@_register("dedup_first_wins", "SELECT sfen, min(idx) AS idx FROM rec GROUP BY 1")
def dedup_first_wins(r: DataFrame) -> DataFrame:
    return O.first_by_state(r).select("sfen", "idx")


@_register(
    "report_scalars",
    "SELECT count(*) AS records, min(ply) AS ply_min, max(ply) AS ply_max, count(*) - count(DISTINCT sfen) AS duplicates, count(*) FILTER (in_check) AS in_check,"
    " count(*) FILTER (has_capture) AS has_capture, count(*) FILTER (n > 0) AS labeled, count(*) FILTER (engines >= 2) AS multi_engine,"
    " count(*) FILTER (engines >= 2 AND NOT engine_agree) AS engine_disagree FROM q",
)
def report_scalars(r: DataFrame) -> DataFrame:
    return O.with_stability(r).agg(
        F.count(F.lit(1)).alias("records"),
        F.min("ply").alias("ply_min"),
        F.max("ply").alias("ply_max"),
        (F.count(F.lit(1)) - F.countDistinct("sfen")).alias("duplicates"),
        F.count_if("in_check").alias("in_check"),
        F.count_if("has_capture").alias("has_capture"),
        F.count_if(F.size(P.OBS) > 0).alias("labeled"),
        F.count_if(F.size("_by_engine") >= 2).alias("multi_engine"),
        F.count_if(~F.col("engine_bestmove_agreement")).alias("engine_disagree"),
    )


@_register("report_depth_counts", "SELECT depth, count(*) AS n FROM obs JOIN rec USING (idx) GROUP BY 1")
def report_depth_counts(r: DataFrame) -> DataFrame:
    return _counted(r.select(F.inline(P.OBS)), "depth")


@_register("score_bound_counts", "SELECT bound, kind, count(*) AS n FROM obs JOIN rec USING (idx) GROUP BY 1, 2")
def score_bound_counts(r: DataFrame) -> DataFrame:
    return _counted(r.select(F.inline(P.OBS)), "bound", "kind")


@_register("report_swing_hist", "SELECT CAST(floor(swing / 50.0) * 50 AS BIGINT) AS bin, count(*) AS n FROM q WHERE swing IS NOT NULL GROUP BY 1")
def report_swing_hist(r: DataFrame) -> DataFrame:
    s = r.select(P.swing(P.cps(F.col(P.OBS))).alias("swing")).where("swing is not null")
    return _counted(s, (F.floor(F.col("swing") / P.HISTOGRAM_STEP) * P.HISTOGRAM_STEP).alias("bin"))


@_register("report_margin_hist", "SELECT CAST(floor(margin / 50.0) * 50 AS BIGINT) AS bin, count(*) AS n FROM obs JOIN rec USING (idx) WHERE margin IS NOT NULL GROUP BY 1")
def report_margin_hist(r: DataFrame) -> DataFrame:
    m = r.select(F.inline(P.OBS)).where("margin is not null")
    return _counted(m, (F.floor(F.col("margin") / P.HISTOGRAM_STEP) * P.HISTOGRAM_STEP).alias("bin"))


@_register("wdl_distribution", "SELECT phase, side, wdl, count(*) AS n FROM b GROUP BY 1, 2, 3")
def wdl_distribution(r: DataFrame) -> DataFrame:
    return _counted(r, "phase", "side", P.wdl().alias("wdl"))


@_register("report_source_dominance", "SELECT group_key, count(*) AS n FROM rec GROUP BY 1")
def report_source_dominance(r: DataFrame) -> DataFrame:
    return _counted(r, "group_key")


@_register("special_bestmove", "SELECT idx FROM obs JOIN rec USING (idx) WHERE bestmove = 'resign' GROUP BY 1")
def special_bestmove(r: DataFrame) -> DataFrame:
    return r.where(F.exists(P.OBS, lambda o: P.bestmove_kind(o["bestmove"]).isNotNull())).select("idx")


@_register("requested_depth_underreach", "SELECT idx FROM obs JOIN rec USING (idx) WHERE requested_depth > depth AND kind <> 'mate' GROUP BY 1")
def requested_depth_underreach(r: DataFrame) -> DataFrame:
    return r.where(F.exists(P.OBS, P.underreached)).select("idx")


@_register(
    "distribution_ply_hist",
    "SELECT bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range((SELECT min(ply) // 20 * 20 FROM rec), (SELECT max(ply) FROM rec) + 1, 20)) AS bin)"
    " LEFT JOIN (SELECT ply // 20 * 20 AS bin, count(*) AS n FROM rec GROUP BY 1) USING (bin)",
)
def distribution_ply_hist(r: DataFrame) -> DataFrame:
    return O.ply_histogram(r, 20)
