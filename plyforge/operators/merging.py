"""Merging two data sets of position records, and carrying observations over from an earlier run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions import positions as P

KEY = ("sfen", "path", "ply")
KEEP_BOTH, PREFER_PRIMARY, PREFER_SECONDARY = "keep-both", "prefer-primary", "prefer-secondary"
#: Fields that tell one observation of a record from another; those that the records have count.
OBSERVATION_KEY = ("engine", "engine_version", "depth", "requested_depth", "search_limit_kind", "requested_nodes")


def _same(fields: list[str], x: Column, y: Column) -> Column:
    return reduce(lambda a, b: a & b, [x[f].eqNullSafe(y[f]) for f in fields])


def _merged(fields: list[str], base: Column, incoming: Column, policy: str) -> Column:
    """Struct (kept, collisions): incoming observations laid one by one upon those kept so far."""
    if policy == KEEP_BOTH:
        return F.struct(F.concat(base, incoming).alias("kept"), F.lit(0).alias("collisions"))

    def step(found: Column, o: Column) -> Column:
        hit = F.exists(found["kept"], lambda x: _same(fields, x, o))
        if policy == PREFER_PRIMARY:
            kept = F.when(hit, found["kept"]).otherwise(F.concat(found["kept"], F.array(o)))
        else:
            kept = F.concat(F.filter(found["kept"], lambda x: ~_same(fields, x, o)), F.array(o))
        return F.struct(kept.alias("kept"), (found["collisions"] + hit.cast("int")).alias("collisions"))

    return F.aggregate(incoming, F.struct(base.alias("kept"), F.lit(0).alias("collisions")), step)


def _last(records: DataFrame) -> DataFrame:
    """Of each key the last record's observations; combined before the shuffle."""
    return records.groupBy(*KEY).agg(F.max("idx").alias("_other"), F.max_by(P.OBS, "idx").alias("_incoming"))


def merge(primary: DataFrame, secondary: DataFrame, policy: str = KEEP_BOTH) -> DataFrame:
    """All primary records with the observations of the secondary record of the same key, then the other secondary ones.

    Of secondary records that share a key the last is merged; earlier ones, and those without a
    primary record, come out as they are. More columns: side (0 primary, 1 secondary; with idx
    the output's order), matched, collisions. Null keys equal nothing. Both sides have the same columns.
    Both sides are shuffled and sorted once, by key; all rows of one key are in one task.
    """
    if policy not in (KEEP_BOTH, PREFER_PRIMARY, PREFER_SECONDARY):
        raise ValueError(f"unknown policy {policy}")
    element = primary.schema[P.OBS].dataType.elementType
    fields = [f for f in OBSERVATION_KEY if f in element.fieldNames()]
    secondary = secondary.select(*primary.columns)
    both = primary.withColumn("side_ord", F.lit(0)).unionByName(secondary.withColumn("side_ord", F.lit(1)))
    # Rows without a whole key pair with nothing, so that they are dealt by idx.
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEY])
    both = both.withColumn("_apart", F.when(~whole, F.xxhash64("idx")))
    # Of a key's rows the last secondary one comes first.
    ordered = Window.partitionBy(*KEY, "_apart").orderBy(F.desc("side_ord"), F.desc("idx"))
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = F.col("_apart").isNull() & (F.col("_lo") == 0) & (F.col("_hi") == 1)
    seen = both.withColumns(
        {
            "_nth": F.row_number().over(ordered),
            "_lo": F.min("side_ord").over(every),
            "_hi": F.max("side_ord").over(every),
            "_incoming": F.first(P.OBS).over(every),
        }
    )
    kept = seen.withColumn("matched", paired & (F.col("side_ord") == 0)).where(~(paired & (F.col("side_ord") == 1) & (F.col("_nth") == 1)))
    none = F.array().cast(primary.schema[P.OBS].dataType)
    incoming = F.when(F.col("matched"), F.col("_incoming")).otherwise(none)
    return kept.withColumn("_m", _merged(fields, F.col(P.OBS), incoming, policy)).select(
        *[F.col("_m.kept").alias(P.OBS) if c == P.OBS else F.col(c) for c in primary.columns],
        "side_ord",
        "matched",
        F.col("_m.collisions").alias("collisions"),
    )


def resume(records: DataFrame, earlier: DataFrame) -> DataFrame:
    """The records with the observations that an earlier output has for them; its other records are left out."""
    joined = records.join(_last(earlier.select("idx", *KEY, P.OBS)), list(KEY), "left")
    none = F.array().cast(records.schema[P.OBS].dataType)
    return joined.withColumn(P.OBS, F.concat(P.OBS, F.coalesce("_incoming", none))).select(*records.columns)
