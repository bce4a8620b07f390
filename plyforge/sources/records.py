"""Position records as JSON lines: lenient and validating scans, the flat form the operators take, and the sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.functions.board import state_is_valid
from plyforge.functions.positions import group_of

_SCORE = "struct<kind:string,value:int,moves:int>"
SCHEMA = (
    "schema_version int, sfen string,"
    " source struct<kind:string,path:string,ply:int,root_id:string,variation_id:string,branch_from_ply:int>,"
    " tags struct<phase:string,side_to_move:string,in_check:boolean,has_capture:boolean>,"
    " observations array<struct<engine:string,engine_version:string,depth:int,requested_depth:int,requested_nodes:bigint,"
    f"search_limit_kind:string,score:{_SCORE},score_perspective:string,score_bound:string,bestmove:string,bestmove_kind:string,"
    "nodes:bigint,time_ms:bigint,seldepth:int,hashfull:int,nps:bigint,pv:array<string>,policy_margin_cp:int,"
    f"candidates:array<struct<multipv:int,bestmove:string,score:{_SCORE},score_bound:string,pv:array<string>>>,"
    "engine_options_hash:string,weight_sha256:string,was_timeout_salvaged:boolean>>,"
    " stability struct<score_swing_cp:int,bestmove_agreement:boolean,engine_bestmove_agreement:boolean,engine_score_swing_cp:int>,"
    " game_result struct<outcome:string,result_source:string>"
)
SCHEMA_VERSION = 11
BOUNDS, PERSPECTIVES = ("exact", "lowerbound", "upperbound"), ("side_to_move", "black")


def _all(*tests: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def _score_ok(s: Column) -> Column:
    return F.coalesce(((s["kind"] == "cp") & s["value"].isNotNull()) | ((s["kind"] == "mate") & s["moves"].isNotNull()), F.lit(False))


def _one_of(value: Column, *allowed: str) -> Column:
    """A value that may be absent, else must be one of the allowed."""
    return value.isNull() | value.isin(*allowed)


def _observation_ok(o: Column) -> Column:
    return _all(
        o["engine"].isNotNull(),
        o["depth"] >= 0,
        o["bestmove"].isNotNull(),
        _score_ok(o["score"]),
        _one_of(o["search_limit_kind"], "depth", "nodes"),
        _one_of(o["score_bound"], *BOUNDS),
        _one_of(o["score_perspective"], *PERSPECTIVES),
        _one_of(o["bestmove_kind"], "resign", "win", "no_move"),
        F.forall(
            F.coalesce(o["candidates"], F.array()),
            lambda c: _all(c["multipv"] >= 0, c["bestmove"].isNotNull(), _score_ok(c["score"]), _one_of(c["score_bound"], *BOUNDS)),
        ),
    )


def record_is_valid(r: Column) -> Column:
    """Whether a parsed record has every required field, and only known words."""
    return _all(
        r["schema_version"] >= 0,
        r["sfen"].isNotNull(),
        r["source"]["kind"].isNotNull(),
        r["source"]["path"].isNotNull(),
        r["source"]["ply"] >= 0,
        r["tags"]["phase"].isin("opening", "middlegame", "endgame"),
        r["tags"]["side_to_move"].isin("black", "white"),
        r["tags"]["in_check"].isNotNull(),
        r["tags"]["has_capture"].isNotNull(),
        r["observations"].isNotNull(),
        F.forall(r["observations"], _observation_ok),
        r["stability"].isNull() | r["stability"]["bestmove_agreement"].isNotNull(),
        r["game_result"].isNull()
        | (r["game_result"]["outcome"].isin("black_wins", "white_wins", "draw", "unknown") & r["game_result"]["result_source"].isNotNull()),
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Rows (idx, value) with is_json and record: null where a line is no record. Blank lines fall away.

    Case and types are strict: a number in quotes or out of range makes the record none.
    """
    kept = lines.where(F.trim("value") != "")
    whole = F.from_json("value", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    read = kept.withColumns({"is_json": F.try_parse_json("value").isNotNull(), "_r": whole})
    fit = F.col("is_json") & F.col("_r._bad").isNull() & record_is_valid(F.col("_r"))
    return read.withColumn("record", F.when(fit, F.col("_r").dropFields("_bad"))).drop("_r")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """parsed() of JSON lines files; idx orders rows by file, then place."""
    lines = spark.read.text(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return parsed(lines.select(place.alias("idx"), "value"))


def validate(scanned: DataFrame) -> DataFrame:
    """One row: lines, JSON and record counts, states that are none or repeat, and tags that the state contradicts.

    broken counts lines that are no JSON; JSON that is no record is in neither broken nor valid_records.
    """
    sfen, side = F.col("record.sfen"), F.col("record.tags.side_to_move")
    is_record = F.col("record").isNotNull()
    told = F.when(F.split(F.trim(sfen), r"\s+")[1] == "b", "black").otherwise("white")
    good = is_record & state_is_valid(sfen)
    return scanned.agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.count_if("is_json").alias("valid_json"),
        F.count_if(is_record).alias("valid_records"),
        F.count_if(~F.col("is_json")).alias("broken"),
        F.count_if(is_record & ~state_is_valid(sfen)).alias("invalid_sfens"),
        (F.count_if(is_record) - F.countDistinct(sfen)).alias("duplicate_sfens"),
        F.count_if(good & (side != told)).alias("tag_mismatches"),
    )


def schema_versions(scanned: DataFrame) -> DataFrame:
    return scanned.where("record is not null").groupBy(F.col("record.schema_version").alias("schema_version")).agg(F.count(F.lit(1)).alias("n"))


def flat(scanned: DataFrame) -> DataFrame:
    """The records in the operators' form; values are the side to move's, and absent words have their defaults."""
    r = scanned.where("record is not null").select("idx", "record.*")
    white = F.col("tags.side_to_move") == "white"

    def observation(o: Column) -> Column:
        turned = (o["score_perspective"] == "black") & white
        value = o["score"]["value"]
        return F.struct(
            o["engine"].alias("engine"),
            o["depth"].alias("depth"),
            o["requested_depth"].alias("requested_depth"),
            o["score"]["kind"].alias("kind"),
            F.when(o["score"]["kind"] == "cp", F.when(F.coalesce(turned, F.lit(False)), -value).otherwise(value)).alias("cp"),
            F.coalesce(F.when(o["bestmove_kind"] == "no_move", "none").otherwise(o["bestmove_kind"]), o["bestmove"]).alias("bestmove"),
            o["policy_margin_cp"].alias("margin"),
            F.coalesce(o["score_bound"], F.lit("exact")).alias("bound"),
            F.coalesce(o["was_timeout_salvaged"], F.lit(False)).alias("salvaged"),
        )

    return r.select(
        "idx",
        "sfen",
        F.col("source.path").alias("path"),
        F.col("source.ply").cast("long").alias("ply"),
        F.coalesce("source.root_id", group_of(F.col("source.path"))).alias("group_key"),
        F.col("tags.phase").alias("phase"),
        F.col("tags.side_to_move").alias("side"),
        F.col("tags.in_check").alias("in_check"),
        F.col("tags.has_capture").alias("has_capture"),
        F.coalesce("game_result.outcome", F.lit("unknown")).alias("outcome"),
        F.transform("observations", observation).alias("observations"),
    )


def from_games(positions: DataFrame) -> DataFrame:
    """Extracted positions (sources.games.positions) as records without observations."""
    return positions.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "sfen",
        F.struct("kind", "path", "ply", "root_id", "variation_id", "branch_from_ply").alias("source"),
        F.struct("phase", F.col("side").alias("side_to_move"), "in_check", "has_capture").alias("tags"),
        F.expr("array()").alias("observations"),
        F.when(F.col("result_source").isNotNull(), F.struct("outcome", "result_source")).alias("game_result"),
    )


def write(records: DataFrame, path: str) -> None:
    """Records as JSON lines, one file a partition; null fields are left out."""
    records.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
