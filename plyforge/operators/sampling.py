"""Deterministic sampling, ranking, ordering and splitting of position records.

Orders come from keyed hashes with the input index as the last tie-break, never from random numbers, so
that a task run again gives the same rows. Every top-k keeps a constant bound next to its ranking, which
lets Spark cut each map task to k rows a bucket before the shuffle: a hot bucket costs no more than others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plyforge.functions import positions as P
from plyforge.functions.hashing import RECORD, sample_id, seeded_hash
from plyforge.functions.positions import QualityConfig
from plyforge.operators.positions import near_jumps, prepared, with_bucket, with_reasons

#: Leading hex digits of a hash that name its block of a global order, 65,536 of them.
ORDER_DIGITS = 4
UNCERTAIN = QualityConfig(
    require_exact_score=True, require_policy_margin=True, require_requested_depth_reached=True, require_engine_agreement=True
)


#: Buckets whose counts are sent to every task; more are joined by a shuffle.
MAX_BUCKETS = 100_000


def reservoir(records: DataFrame, count: int, seed: int, profile: str = RECORD) -> DataFrame:
    """The count records smallest by (hash of the state, idx)."""
    hashed = records.withColumn("_h", seeded_hash(seed, F.col("sfen"), profile))
    return hashed.orderBy("_h", "idx").limit(count).drop("_h")


def _ranked(records: DataFrame, count: int, seed: int, profile: str, *order: Column) -> DataFrame:
    """The first count records by order, hash and idx, with their place as rank, from 1."""
    hashed = records.withColumn("_h", seeded_hash(seed, F.col("sfen"), profile))
    top = hashed.orderBy(*order, "_h", "idx").limit(count)
    # At most count rows are left, one task's worth.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order, "_h", "idx"))).drop("_h")


def select_uncertain(records: DataFrame, count: int, seed: int, min_margin: int | None = None, profile: str = RECORD) -> DataFrame:
    """The records that fail most of the fixed gates of uncertainty, in rank order."""
    config = QualityConfig(**{**UNCERTAIN.__dict__, "min_policy_margin_cp": min_margin})
    return _ranked(with_reasons(records, config), count, seed, profile, F.size("reasons").desc())


def select_coverage(records: DataFrame, count: int, seed: int, profile: str = RECORD) -> DataFrame:
    """The records of the rarest buckets of phase, side and value, in rank order.

    Bucket counts are aggregated before they are joined, so that no bucket's rows meet in one task.
    """
    bucketed = with_bucket(records, ("phase", "side", "eval"))
    sizes = bucketed.groupBy("bucket_key").agg(F.count(F.lit(1)).alias("bucket_size"))
    few = sizes.limit(MAX_BUCKETS + 1).count() <= MAX_BUCKETS
    return _ranked(bucketed.join(F.broadcast(sizes) if few else sizes, "bucket_key"), count, seed, profile, F.col("bucket_size").asc())


def select_hard(records: DataFrame, count: int, seed: int, threshold: int, window: int, profile: str = RECORD) -> DataFrame:
    """The records near jumps, then with disagreement, then with the widest swing, in rank order."""
    e = near_jumps(records, threshold, window).withColumns(
        {"_apart": ~P.moves_agree(F.col(P.OBS)), "_swing": F.coalesce(P.swing(P.cps(F.col(P.OBS))), F.lit(0))}
    )
    return _ranked(e, count, seed, profile, F.col("_near").desc(), F.col("_apart").desc(), F.col("_swing").desc())


def group_fill(keyed: DataFrame, quotas: dict[str, int], seed: int, profile: str = RECORD) -> DataFrame:
    """Of each bucket with a quota that many records, taken round by round over its groups.

    keyed has bucket_key, group_key and idx. A record's round is its number within its group and
    bucket; within a round groups go by their hash. A round at or past the largest quota cannot be
    chosen, as its group alone has that many earlier ones, so both rankings are bounded.
    """
    if not quotas:
        raise ValueError("no quotas")
    most = max(quotas.values())
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col("bucket_key")]
    wanted = keyed.withColumn("_quota", quota).where("_quota is not null")
    rounds = Window.partitionBy("bucket_key", "group_key").orderBy("idx")
    first = wanted.withColumn("_round", F.row_number().over(rounds)).where(F.col("_round") <= most)
    hashed = first.withColumn("_h", seeded_hash(seed, F.col("group_key"), profile))
    places = Window.partitionBy("bucket_key").orderBy("_round", "_h", "idx")
    chosen = hashed.withColumn("_place", F.row_number().over(places)).where(F.col("_place") <= most)
    return chosen.where(F.col("_place") <= F.col("_quota")).drop("_quota", "_round", "_h", "_place")


def stratify(records: DataFrame, dimensions: tuple[str, ...], quotas: dict[str, int], seed: int, profile: str = RECORD) -> DataFrame:
    return group_fill(with_bucket(records, dimensions), quotas, seed, profile)


def largest_group_share(kept: DataFrame) -> DataFrame:
    """One row: max_share over buckets of at least two records of their largest group, and the distinct groups."""
    by_group = kept.groupBy("bucket_key", "group_key").agg(F.count(F.lit(1)).alias("n"))
    by_bucket = by_group.groupBy("bucket_key").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    share = by_bucket.where("total >= 2").agg(F.max(F.col("most") / F.col("total")).alias("max_share"))
    groups = by_group.agg(F.countDistinct("group_key").alias("groups"))
    return share.crossJoin(groups)  # one row each


def shuffled(records: DataFrame, seed: int, block_size: int, profile: str = RECORD) -> DataFrame:
    """All records with sample_id, training_position (from 1) and block_id in an order by hash.

    The order is (hash of sample_id, sample_id, idx). Positions are numbered within blocks of the
    hash's leading digits, and each block starts after the sum of those before it: the only global
    step is over the blocks' counts, at most 16 ** ORDER_DIGITS rows.
    """
    keyed = records.withColumn("sample_id", sample_id(F.col("sfen"), F.col("path"), F.col("ply"), profile))
    keyed = keyed.withColumn("_h", seeded_hash(seed, F.col("sample_id"), profile))
    keyed = keyed.withColumn("_block", F.substring("_h", 1, ORDER_DIGITS))
    counts = keyed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_h", "sample_id", "idx"))
    numbered = keyed.withColumn("_place", place).join(F.broadcast(starts), "_block")
    position = F.col("_start") + F.col("_place")
    return numbered.withColumns(
        {"training_position": position, "block_id": F.floor((position - 1) / block_size).cast("long")}
    ).drop("_h", "_block", "_place", "_start")


#: Two to the 64th less one, the largest hash of the record profile.
_MOST = float(2**64 - 1)


def _hex_value(digits: Column) -> Column:
    """16 hex digits as a fraction of the largest such number."""
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("double")
    return (high * 4294967296.0 + low) / _MOST


def split(records: DataFrame, seed: int, valid: float, test: float, profile: str = RECORD) -> DataFrame:
    """split: train, valid or test, one for all records of a game and its variations."""
    if valid < 0 or test < 0 or valid + test >= 1:
        raise ValueError("valid and test must be shares whose sum is below 1")
    unit = _hex_value(seeded_hash(seed, F.col("group_key"), profile))
    marked = records.withColumn("_unit", unit)
    where = F.when(F.col("_unit") < test, "test").when(F.col("_unit") < test + valid, "valid").otherwise("train")
    return marked.withColumn("split", where).drop("_unit")


def opening_key(sfen: Column) -> Column:
    """A state without its move count: its first three fields."""
    return F.array_join(F.slice(F.filter(F.split(sfen, r"\s+"), lambda x: x != ""), 1, 3), " ")


def gate_openings(
    records: DataFrame, count: int, seed: int, min_ply: int | None, max_ply: int | None, valid: Column | None = None, profile: str = RECORD,
    playable: Column | None = None,
) -> DataFrame:
    """All records with drop_reason: null where one is an opening for match play.

    Records fall by invalid_sfen, below_min_ply, above_max_ply, unplayable (with playable, where it
    is not true: the side to move has no legal move, or none can be told), duplicate_sfen (the first of a
    state stays) and over_count, in this order. count are kept over all groups, round by round.
    """
    tests = [(~valid, "invalid_sfen")] if valid is not None else []
    if min_ply is not None:
        tests.append((F.col("ply") < min_ply, "below_min_ply"))
    if max_ply is not None:
        tests.append((F.col("ply") > max_ply, "above_max_ply"))
    if playable is not None:
        # Asked only of records that are left: a legal move is by far the dearest test.
        left = reduce(lambda a, b: a & ~F.coalesce(b[0], F.lit(False)), tests, F.lit(True))
        tests.append((left & ~F.coalesce(F.when(left, playable), F.lit(False)), "unplayable"))
    reason = reduce(lambda found, t: F.coalesce(found, F.when(t[0], t[1])), tests, F.lit(None).cast("string"))
    judged = records.withColumn("_reason", reason).withColumn("_state", opening_key(F.col("sfen")))
    eligible = judged.where("_reason is null")
    # min over idx combines before the shuffle, so a state that a third of the records share is no hot task.
    firsts = eligible.groupBy("_state").agg(F.min("idx").alias("idx")).select("idx", F.lit(True).alias("_first"))
    fresh = eligible.join(firsts.select("idx"), "idx", "left_semi").withColumn("bucket_key", F.lit(""))
    kept = group_fill(fresh, {"": count}, seed, profile).select("idx", F.lit(True).alias("_kept"))
    marked = judged.join(firsts, "idx", "left").join(kept, "idx", "left")
    final = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.col("_first").isNull(), "duplicate_sfen")
        .when(F.col("_kept").isNull(), "over_count")
    )
    return marked.withColumn("drop_reason", final).drop("_reason", "_state", "_first", "_kept")
