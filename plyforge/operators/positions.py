"""Operators over DataFrames of position records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions import positions as P
from plyforge.functions.positions import QualityConfig


def prepared(records: DataFrame) -> DataFrame:
    """The records with _deepest and _by_engine, which several expressions share."""
    return records.withColumns({"_deepest": P.deepest(F.col(P.OBS)), "_by_engine": P.deepest_by_engine(F.col(P.OBS))})


def with_reasons(records: DataFrame, config: QualityConfig) -> DataFrame:
    return prepared(records).withColumn("reasons", P.failing_reasons(config))


def filter_quality(records: DataFrame, config: QualityConfig) -> DataFrame:
    """The records that pass every configured gate."""
    return with_reasons(records, config).where(F.size("reasons") == 0).drop("reasons", "_deepest", "_by_engine")


def with_quality(records: DataFrame, config: QualityConfig) -> DataFrame:
    """The records with keep, score, reasons, score_swing_cp, bestmove_agreement, cp_count and mate_count.

    score is the share of configured gates that hold, in single precision; 1 without gates.
    """
    gates, o = len(P.quality_gates(config)), F.col(P.OBS)
    failed = (F.size("reasons") / F.lit(max(gates, 1))).cast("float")
    return with_reasons(records, config).withColumns(
        {
            "keep": F.size("reasons") == 0,
            "score": F.lit(1.0).cast("float") - failed,
            "score_swing_cp": P.swing(P.cps(o)),
            "bestmove_agreement": P.moves_agree(o),
            "cp_count": F.size(P.cps(o)),
            "mate_count": F.size(F.filter(o, lambda x: x["kind"] == "mate")),
        }
    )


def with_stability(records: DataFrame) -> DataFrame:
    """The records with the four stability fields; fields that are there stay where there are no observations."""
    fields, labelled = P.stability(), F.size(P.OBS) > 0
    kept = {name: F.when(labelled, made).otherwise(F.col(name)) if name in records.columns else made for name, made in fields.items()}
    return prepared(records).withColumns(kept)


def with_bucket(records: DataFrame, dimensions: tuple[str, ...] = ("phase", "side", "eval", "wdl")) -> DataFrame:
    """bucket_key: the wanted dimensions, each followed by a colon, in fixed order."""
    made = {"phase": F.col("phase"), "side": F.col("side"), "eval": P.eval_bucket(), "wdl": P.wdl()}
    parts = [F.concat(made[d], F.lit(":")) for d in made if d in dimensions]
    return prepared(records).withColumn("bucket_key", F.concat(*parts))


def first_by_state(records: DataFrame) -> DataFrame:
    """Of the records of one state the first in input order."""
    w = Window.partitionBy("sfen").orderBy("idx")
    return records.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def balance(records: DataFrame, dimensions: tuple[str, ...], target: int | None = None) -> DataFrame:
    """Per bucket the target records smallest by (sfen, idx); by default as many as the smallest bucket has."""
    bucketed = with_bucket(records, dimensions)
    if target is None:
        # One number, known before the ranking, so that every task drops what is past it before the shuffle.
        target = bucketed.groupBy("bucket_key").count().agg(F.min("count")).first()[0] or 0
    ranked = bucketed.withColumn("_nth", F.row_number().over(Window.partitionBy("bucket_key").orderBy("sfen", "idx")))
    return ranked.where(F.col("_nth") <= F.lit(target))


def near_jumps(records: DataFrame, threshold: int, window: int) -> DataFrame:
    """The records with _eval, Black's value, and _near: labelled and near a jump of it in their game.

    A jump is a change of at least threshold between neighbours in (ply, idx) order that both
    have a value; records up to window places from it are near.
    """
    game = Window.partitionBy("path").orderBy("ply", "idx")
    # What is read after the shuffle is made before it: the observations themselves stay behind unless asked for.
    e = prepared(records).withColumns({"_eval": P.eval_black(), "_labelled": F.size(P.OBS) > 0})
    e = e.withColumn("_jump", F.coalesce(F.abs(F.col("_eval") - F.lag("_eval").over(game)) >= threshold, F.lit(False)))
    near = F.max("_jump").over(game.rowsBetween(-window, window)) & F.col("_labelled")
    return e.withColumn("_near", near).drop("_labelled")


def mine(records: DataFrame, threshold: int, window: int, losing: int | None = None) -> DataFrame:
    """Labelled records near a jump (near_jumps), or lost by more than losing."""
    e = near_jumps(records, threshold, window)
    if losing is None:
        return e.where("_near")
    own = F.when(F.col("side") == "white", -F.col("_eval")).otherwise(F.col("_eval"))
    return e.where(F.col("_near") | F.coalesce(own < -losing, F.lit(False)))


def calibrate(records: DataFrame, config: QualityConfig, margins: list[int], swings: list[int]) -> DataFrame:
    """Kept records for each pair of margin and swing thresholds, one pass over the records.

    The two gates are neighbours in evaluation order, so that a record's other gates are
    decided once; every cell is then a conditional sum.
    """
    base = QualityConfig(**{**config.__dict__, "max_score_swing_cp": None, "min_policy_margin_cp": None})
    facts = with_reasons(records, base).select(
        (F.size("reasons") == 0).alias("other"),
        P.swing(P.cps(F.col(P.OBS))).alias("swing"),
        F.array_min(F.transform(P.OBS, lambda o: o["margin"])).alias("margin"),
    )
    cells = [(m, s) for m in margins for s in swings]
    kept = [
        F.count_if(F.col("other") & F.coalesce(F.col("swing") <= s, F.lit(True)) & F.coalesce(F.col("margin") >= m, F.lit(True)))
        for m, s in cells
    ]
    row = facts.agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[F.struct(F.lit(m).alias("margin"), F.lit(s).alias("swing"), k.alias("kept")) for (m, s), k in zip(cells, kept, strict=True)]).alias("cells"),
    )
    return row.select("total", F.inline("cells"))


def sweep(records: DataFrame, config: QualityConfig, margins: list[int] = (), swings: list[int] = ()) -> DataFrame:
    """A row for each swept value, margins first: sweep_param, sweep_value, total, kept, dropped, coverage_pct, drop_reasons.

    Each value replaces its gate's alone in config. A record counts for its first failing
    gate; drop_reasons lists "gate=count" by name. position orders the rows. The records are
    read once: the cells' tallies are sums within it.
    """
    if not margins and not swings:
        raise ValueError("nothing to sweep")
    cells = [("policy_margin", "min_policy_margin_cp", v) for v in margins] + [("score_swing", "max_score_swing_cp", v) for v in swings]
    firsts = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(param).alias("sweep_param"),
            F.lit(v).alias("sweep_value"),
            F.get(P.failing_reasons(QualityConfig(**{**config.__dict__, field: v})), F.lit(0)).alias("reason"),
        )
        for i, (param, field, v) in enumerate(cells)
    ]
    counts = prepared(records).select(F.inline(F.array(*firsts))).groupBy("position", "sweep_param", "sweep_value", "reason").agg(F.count(F.lit(1)).alias("n"))
    kept, total = F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)), F.sum("n")
    named = F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.concat("reason", F.lit("="), F.col("n").cast("string")))))
    return counts.groupBy("position", "sweep_param", "sweep_value").agg(
        total.alias("total"), kept.alias("kept"), (total - kept).alias("dropped"),
        F.format_string("%.2f", kept / total * 100).alias("coverage_pct"), F.array_join(named, ";").alias("drop_reasons"),
    )


def _at_depth(engine: Column, depth: int) -> Column:
    """An engine's observation of a requested depth, else of a reached one; the first of several."""
    asked = F.get(F.filter(P.OBS, lambda o: (o["engine"] == engine) & (o["requested_depth"] == depth)), F.lit(0))
    return F.coalesce(asked, F.get(F.filter(P.OBS, lambda o: (o["engine"] == engine) & (o["depth"] == depth)), F.lit(0)))


AUDIT_FLAGS = tuple(f"{whose}_{what}" for whose in ("teacher", "student") for what in ("non_exact", "underreach", "special"))


def audit_pairs_of(teacher: int, students: list[int]) -> Column:
    """A record's array of (student_depth, mismatch, error) and what is special about either side: teacher against student observations of each engine.

    The best moves match unless both are ordinary and differ. error is null unless both values
    are centipawns. The teacher's own depth is never a student's.
    """

    def pair(t: Column, s: Column, depth: int) -> Column:
        ordinary = P.bestmove_kind(t["bestmove"]).isNull() & P.bestmove_kind(s["bestmove"]).isNull()
        both = (t["kind"] == "cp") & (s["kind"] == "cp")
        made = F.struct(
            F.lit(depth).alias("student_depth"),
            (ordinary & (t["bestmove"] != s["bestmove"])).alias("mismatch"),
            F.when(both, F.abs(t["cp"] - s["cp"])).alias("error"),
            *[
                test(side).alias(f"{whose}_{what}")
                for whose, side in (("teacher", t), ("student", s))
                for what, test in (
                    ("non_exact", lambda o: o["bound"] != "exact"),
                    ("underreach", P.underreached),
                    ("special", lambda o: P.bestmove_kind(o["bestmove"]).isNotNull()),
                )
            ],
        )
        return F.when(t.isNotNull() & s.isNotNull(), made)

    depths = [d for d in students if d != teacher]
    if not depths:
        flags = ",".join(f"{name}:boolean" for name in AUDIT_FLAGS)
        return F.array().cast(f"array<struct<student_depth:int,mismatch:boolean,error:int,{flags}>>")
    engines = F.array_distinct(F.transform(P.OBS, lambda o: o["engine"]))
    # A struct of each engine's observations at the wanted depths, so that every lookup is made once.
    found = F.transform(
        engines,
        lambda e: F.struct(_at_depth(e, teacher).alias("t"), *[_at_depth(e, d).alias(f"s{i}") for i, d in enumerate(depths)]),
    )
    pairs = F.transform(found, lambda x: F.array(*[pair(x["t"], x[f"s{i}"], d) for i, d in enumerate(depths)]))
    return F.array_compact(F.flatten(pairs))


def audit_pairs(records: DataFrame, teacher: int, students: list[int]) -> DataFrame:
    """idx, student_depth, mismatch and error of every pair (audit_pairs_of), and the flags of either side."""
    return records.select("idx", F.inline(audit_pairs_of(teacher, students)))


def _audit() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("pairs"),
        F.count_if("mismatch").alias("mismatches"),
        F.count("error").alias("compared"),
        F.sum(F.col("error").cast("long")).alias("error_sum"),
        F.max("error").alias("error_max"),
    ]


def audit_stats(records: DataFrame, teacher: int, students: list[int]) -> DataFrame:
    """audit's tallies per student depth with the sides' flags counted, and a row of null depth over all pairs."""
    return audit_pairs(records, teacher, students).rollup("student_depth").agg(*_audit(), *[F.count_if(flag).alias(flag) for flag in AUDIT_FLAGS])


def audit(records: DataFrame, teacher: int, students: list[int]) -> DataFrame:
    """Pairs, mismatches and errors of audit_pairs per student depth."""
    return audit_pairs(records, teacher, students).groupBy("student_depth").agg(*_audit())


def ply_histogram(records: DataFrame, step: int) -> DataFrame:
    """Counts per step of plies, with zeros for steps without records between the first and the last."""
    counts = records.groupBy((F.floor(F.col("ply") / step) * step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.lit(step).cast("long"))).alias("bin")
    )
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


#: Cells are listed for values nobody has, unless the values span this many steps or more.
MAX_STEPS = 50
PHASES, SIDES = ("opening", "middlegame", "endgame"), ("black", "white")


def coverage_status(n: Column, mean: Column, under: float, over: float) -> Column:
    """How a cell's count stands to the mean of the observed cells."""
    return F.when(n == 0, "MISSING").when(n < mean * under, "UNDER").when(n > mean * over, "OVER").otherwise("OK")


def eval_coverage(records: DataFrame, under: float = 0.5, over: float = 2.0) -> DataFrame:
    """phase, side, eval_bucket, n, status of every cell of phases, sides and value steps, empty ones too.

    Cells without a value or with a mate are listed apart: their status is MISSING or "-". Only
    the counts meet the list of cells, at most six times MAX_STEPS and the two marks.
    """
    step = (F.floor(P.eval_black() / P.EVAL_STEP) * P.EVAL_STEP).cast("long")
    counts = prepared(records).groupBy("phase", "side", P.eval_bucket().alias("eval_bucket"), step.alias("_cp")).agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(
        F.min("_cp").alias("lo"), F.max("_cp").alias("hi"), F.avg(F.when(F.col("_cp").isNotNull(), F.col("n"))).alias("_mean"),
    )
    none = F.array().cast("array<string>")
    narrow = (F.col("hi") - F.col("lo")) / P.EVAL_STEP < MAX_STEPS
    stepped = F.when(F.col("lo").isNull() | ~narrow, none).otherwise(
        F.transform(F.sequence("lo", "hi", F.lit(P.EVAL_STEP).cast("long")), lambda v: v.cast("string"))
    )
    cells = stats.select(
        F.explode(F.array(*map(F.lit, PHASES))).alias("phase"),
        F.concat(F.array(F.lit("_none_"), F.lit("mate")), stepped).alias("_buckets"),
    )
    cells = cells.select("phase", F.explode(F.array(*map(F.lit, SIDES))).alias("side"), "_buckets")
    cells = cells.select("phase", "side", F.explode("_buckets").alias("eval_bucket"))
    mean = stats.select(F.col("_mean").alias("_any_mean"))
    joined = cells.join(counts, ["phase", "side", "eval_bucket"], "full").crossJoin(F.broadcast(mean))  # one row
    n = F.coalesce("n", F.lit(0))
    status = coverage_status(n, F.col("_any_mean"), under, over)
    marks = F.col("eval_bucket").isin("_none_", "mate")
    return joined.select(
        "phase", "side", "eval_bucket", n.alias("n"), F.when(marks & (n > 0), "-").when(n == 0, "MISSING").otherwise(status).alias("status")
    )
