"""Column expressions over position records with nested observations.

A record has the columns idx, sfen, path, ply, phase, side, in_check, has_capture, outcome and
observations, an array of structs (engine, depth, requested_depth, kind, cp, bestmove, margin,
bound, salvaged). Everything is evaluated within the row: no observation is ever exploded to
decide about its record.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

OBS = "observations"
EVAL_STEP = 200
HISTOGRAM_STEP = 50


def phase_of(ply: Column) -> Column:
    return F.when(ply <= 20, "opening").when(ply <= 100, "middlegame").otherwise("endgame")


def group_of(path: Column) -> Column:
    """A game and its variations: the path up to the variation mark."""
    return F.split(path, "#var")[0]


def bestmove_kind(bestmove: Column) -> Column:
    return F.when(bestmove == "resign", "resign").when(bestmove == "win", "win").when(bestmove == "none", "no_move")


def black_cp(cp: Column, side: Column) -> Column:
    """A centipawn value of the side to move, from Black's view."""
    return F.when(side == "white", -cp).otherwise(cp)


def cps(observations: Column) -> Column:
    """The centipawn values among observations."""
    return F.transform(F.filter(observations, lambda o: o["kind"] == "cp"), lambda o: o["cp"])


def swing(values: Column) -> Column:
    """Largest minus smallest of at least two values, else null."""
    return F.when(F.size(values) >= 2, F.array_max(values) - F.array_min(values))


def deepest(observations: Column) -> Column:
    """The deepest observation, the last of equal ones; null without any."""
    most = F.array_max(F.transform(observations, lambda o: o["depth"]))
    tied = F.filter(observations, lambda o: o["depth"] == most)
    return F.get(tied, F.size(tied) - 1)


def deepest_by_engine(observations: Column) -> Column:
    """Each engine's deepest observation, the first of equal ones."""

    def first(engine: Column) -> Column:
        own = F.filter(observations, lambda o: o["engine"] == engine)
        most = F.array_max(F.transform(own, lambda o: o["depth"]))
        return F.get(F.filter(own, lambda o: o["depth"] == most), F.lit(0))

    return F.transform(F.array_distinct(F.transform(observations, lambda o: o["engine"])), first)


def moves_agree(observations: Column) -> Column:
    """Whether all ordinary best moves are one; true of fewer than two."""
    ordinary = F.filter(observations, lambda o: bestmove_kind(o["bestmove"]).isNull())
    return F.size(F.array_distinct(F.transform(ordinary, lambda o: o["bestmove"]))) <= 1


def underreached(o: Column) -> Column:
    """An observation that stopped short of the depth it was asked for, mates aside."""
    return F.coalesce((o["requested_depth"] > o["depth"]) & (o["kind"] != "mate"), F.lit(False))


def stability() -> dict[str, Column]:
    """The four stability fields; null without observations."""
    o, by_engine = F.col(OBS), F.col("_by_engine")
    two = F.size(by_engine) >= 2
    labelled = F.size(o) > 0
    return {
        "score_swing_cp": swing(cps(o)),
        "bestmove_agreement": F.when(labelled, moves_agree(o)),
        "engine_bestmove_agreement": F.when(two, moves_agree(by_engine)),
        "engine_score_swing_cp": swing(cps(by_engine)),
    }


def eval_black() -> Column:
    """The deepest observation's value for Black; null for a mate or none."""
    top = F.col("_deepest")
    return F.when(top["kind"] == "cp", black_cp(top["cp"], F.col("side")))


def eval_bucket() -> Column:
    """_none_, mate, or the lower end of the value's step."""
    step = F.floor(eval_black() / EVAL_STEP) * EVAL_STEP
    return F.when(F.col("_deepest").isNull(), "_none_").when(F.col("_deepest.kind") == "mate", "mate").otherwise(step.cast("string"))


def wdl() -> Column:
    """The result for the side to move."""
    won = F.when(F.col("side") == "black", "black_wins").otherwise("white_wins")
    return (
        F.when(F.col("outcome") == "draw", "draw")
        .when(F.col("outcome").isin("black_wins", "white_wins"), F.when(F.col("outcome") == won, "success").otherwise("failure"))
        .otherwise("unknown")
    )


@dataclass(frozen=True)
class QualityConfig:
    min_observations: int = 0
    allowed_phases: tuple[str, ...] | None = None
    exclude_mate: bool = False
    exclude_in_check: bool = False
    exclude_capture: bool = False
    exclude_timeout_salvaged: bool = False
    eval_min: int | None = None
    eval_max: int | None = None
    max_score_swing_cp: int | None = None
    min_policy_margin_cp: int | None = None
    require_exact_score: bool = False
    require_policy_margin: bool = False
    min_depth_reached: int | None = None
    require_requested_depth_reached: bool = False
    allow_timeout_salvaged_mate: bool = False
    require_bestmove_agreement: bool = False
    require_engine_agreement: bool = False
    max_engine_score_swing_cp: int | None = None

    @classmethod
    def from_dict(cls, values: dict) -> QualityConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in known})


def quality_gates(c: QualityConfig) -> list[tuple[str, Column]]:
    """(reason, whether the record fails) of each configured gate, in evaluation order. Needs _by_engine."""
    o, by_engine, side = F.col(OBS), F.col("_by_engine"), F.col("side")
    some = lambda test: F.exists(o, test)
    black = F.transform(cps(o), lambda v: black_cp(v, side))
    short_mate = lambda x: (x["kind"] == "mate") & x["salvaged"] & F.coalesce(x["depth"] < x["requested_depth"], F.lit(False))
    gates: list[tuple[str, bool, Column]] = [
        ("min_observations", c.min_observations > 0, F.size(o) < c.min_observations),
        ("phase", c.allowed_phases is not None, ~F.col("phase").isin(*(c.allowed_phases or ("",)))),
        ("mate", c.exclude_mate, some(lambda x: x["kind"] == "mate")),
        ("in_check", c.exclude_in_check, F.col("in_check")),
        ("capture", c.exclude_capture, F.col("has_capture")),
        ("timeout_salvaged", c.exclude_timeout_salvaged, some(lambda x: x["salvaged"])),
        ("eval_min", c.eval_min is not None, F.exists(black, lambda v: v < (c.eval_min or 0))),
        ("eval_max", c.eval_max is not None, F.exists(black, lambda v: v > (c.eval_max or 0))),
        ("score_swing", c.max_score_swing_cp is not None, swing(cps(o)) > (c.max_score_swing_cp or 0)),
        ("policy_margin", c.min_policy_margin_cp is not None, some(lambda x: F.coalesce(x["margin"] < (c.min_policy_margin_cp or 0), F.lit(False)))),
        ("non_exact_score", c.require_exact_score, some(lambda x: x["bound"] != "exact")),
        ("missing_policy_margin", c.require_policy_margin, ~some(lambda x: x["margin"].isNotNull())),
        ("low_actual_depth", c.min_depth_reached is not None, some(lambda x: (x["kind"] != "mate") & (x["depth"] < (c.min_depth_reached or 0)))),
        (
            "requested_depth_not_reached",
            c.require_requested_depth_reached,
            some(underreached) if c.allow_timeout_salvaged_mate else some(lambda x: underreached(x) | short_mate(x)),
        ),
        ("bestmove_disagreement", c.require_bestmove_agreement, (F.size(o) >= 2) & ~moves_agree(o)),
        ("engine_disagreement", c.require_engine_agreement, (F.size(by_engine) >= 2) & ~moves_agree(by_engine)),
        ("engine_score_swing", c.max_engine_score_swing_cp is not None, swing(cps(by_engine)) > (c.max_engine_score_swing_cp or 0)),
    ]
    return [(reason, F.coalesce(fails, F.lit(False))) for reason, on, fails in gates if on]


def failing_reasons(c: QualityConfig) -> Column:
    """All reasons that a record fails for, in evaluation order; empty where it is kept."""
    gates = quality_gates(c)
    if not gates:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(fails, reason) for reason, fails in gates]))
