"""The tuning grid: what thresholds keep, how well the kept rows agree with a teacher, and which cells are worth taking."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions import positions as P
from plyforge.functions.positions import QualityConfig
from plyforge.operators.positions import audit_pairs_of, with_reasons

#: An inactive axis sorts before every threshold.
_INACTIVE = -(2**31)


def _below(limits: list[int], value: Column, strict: bool) -> Column:
    """How many of the limits lie below the value (or at it, unless strict)."""
    passed = [F.when((value > x) if strict else (value >= x), 1).otherwise(0) for x in limits]
    return sum(passed[1:], passed[0]) if passed else F.lit(0)


def grid(
    records: DataFrame,
    config: QualityConfig,
    margins: list[int | None],
    swings: list[int | None],
    teacher: int,
    students: list[int],
) -> DataFrame:
    """One row a cell: margin, swing, total, kept and the audit of the kept records' pairs.

    None is an inactive gate. Records are aggregated once, by where their margin and swing fall
    among the thresholds; a cell is then a sum over at most (margins + 1) * (swings + 1) rows,
    so the grid's size never multiplies the records.
    """
    base = replace(config, max_score_swing_cp=None, min_policy_margin_cp=None)
    low, high = sorted({m for m in margins if m is not None}), sorted({s for s in swings if s is not None})
    margin = F.array_min(F.transform(P.OBS, lambda o: o["margin"]))
    facts = with_reasons(records, base).select(
        (F.size("reasons") == 0).alias("other"),
        F.when(margin.isNull(), len(low)).otherwise(_below(low, margin, strict=False)).alias("m"),
        _below(high, P.swing(P.cps(F.col(P.OBS))), strict=True).alias("s"),
        audit_pairs_of(teacher, students).alias("p"),
    )
    facts = facts.select(
        "other",
        "m",
        "s",
        F.size("p").alias("pairs"),
        F.size(F.filter("p", lambda x: x["mismatch"])).alias("mismatches"),
        F.filter(F.transform("p", lambda x: x["error"]), lambda e: e.isNotNull()).alias("errors"),
    )
    places = facts.groupBy("other", "m", "s").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pairs").alias("pairs"),
        F.sum("mismatches").alias("mismatches"),
        F.sum(F.size("errors")).alias("compared"),
        F.sum(F.aggregate("errors", F.lit(0).cast("long"), lambda a, e: a + e)).alias("error_sum"),
        F.max(F.array_max("errors")).alias("error_max"),
    )
    cells = records.sparkSession.createDataFrame(
        [
            (k, m, s, None if m is None else low.index(m), None if s is None else high.index(s))
            for k, (m, s) in enumerate((m, s) for m in margins for s in swings)
        ],
        "cell int, margin int, swing int, at_m int, at_s int",
    )
    kept = F.col("other") & (F.col("at_m").isNull() | (F.col("at_m") < F.col("m"))) & (F.col("at_s").isNull() | (F.col("at_s") >= F.col("s")))
    counted = lambda name: F.coalesce(F.sum(F.when(kept, F.col(name))), F.lit(0)).alias(name)
    # Two tables of the grid's size.
    return (
        places.crossJoin(F.broadcast(cells))
        .groupBy("cell", "margin", "swing")
        .agg(
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept"),
            counted("pairs"),
            counted("mismatches"),
            counted("compared"),
            counted("error_sum"),
            F.max(F.when(kept, F.col("error_max"))).alias("error_max"),
        )
    )


def _fraction(cell: Column) -> Column:
    return F.coalesce(cell["kept"] / cell["total"], F.lit(0.0))


def _rate(cell: Column) -> Column:
    return cell["mismatches"] / cell["pairs"]


def frontier(cells: DataFrame) -> DataFrame:
    """The cells with pairs that no other such cell beats in kept rows and mismatches, with the roles they take.

    broad keeps most, strict mismatches least, balanced lies nearest to the best of both after
    each axis is scaled to the frontier's own range. Ties go to the other axis, then to the
    smaller thresholds. The grid is one row of bounded size here.
    """
    row = cells.agg(F.filter(F.collect_list(F.struct(*cells.columns)), lambda c: c["pairs"] > 0).alias("c"))

    def beaten(c: Column) -> Column:
        return F.exists(
            "c",
            lambda o: (_fraction(o) >= _fraction(c)) & (_rate(o) <= _rate(c)) & ((_fraction(o) > _fraction(c)) | (_rate(o) < _rate(c))),
        )

    row = row.select(F.filter("c", lambda c: ~beaten(c)).alias("f"))
    row = row.select("f", F.transform("f", _fraction).alias("cov"), F.transform("f", _rate).alias("mis"))
    row = row.select(
        "f",
        *[F.array_min(x).alias(f"{x}_lo") for x in ("cov", "mis")],
        *[F.array_max(x).alias(f"{x}_hi") for x in ("cov", "mis")],
    )

    def scaled(value: Column, axis: str) -> Column:
        lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        return F.when(hi > lo, (value - lo) / (hi - lo)).otherwise(0.0)

    def tie(c: Column) -> list[Column]:
        return [
            F.coalesce(c["margin"], F.lit(_INACTIVE)).alias("margin"),
            F.coalesce(c["swing"], F.lit(_INACTIVE)).alias("swing"),
            c["cell"].alias("cell"),
        ]

    def first(*order) -> Column:
        return F.array_min(F.transform("f", lambda c: F.struct(*[o(c) for o in order], *tie(c))))["cell"]

    def distance(c: Column) -> Column:
        return F.sqrt(F.pow(1.0 - scaled(_fraction(c), "cov"), 2) + F.pow(scaled(_rate(c), "mis"), 2))

    row = row.select(
        "f",
        first(lambda c: (-_fraction(c)).alias("x"), lambda c: _rate(c).alias("y")).alias("broad"),
        first(lambda c: distance(c).alias("x")).alias("balanced"),
        first(lambda c: _rate(c).alias("x"), lambda c: (-_fraction(c)).alias("y")).alias("strict"),
    )
    roles = [F.when(F.col(r) == F.col("cell"), r) for r in ("broad", "balanced", "strict")]
    return row.select("broad", "balanced", "strict", F.inline("f")).withColumn("roles", F.concat_ws(",", *roles)).drop("broad", "balanced", "strict")
