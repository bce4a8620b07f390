"""JSON lines of records: what is read, what is refused, and the way from games to records and back."""

import json

from pyspark.sql import functions as F
from test_games import CSA

from plyforge.functions.board import START
from plyforge.functions.positions import QualityConfig
from plyforge.operators import positions as O
from plyforge.sources import games, records


def line(**changes):
    base = {
        "schema_version": 11,
        "sfen": f"{START} b - 1",
        "source": {"kind": "csa", "path": "a", "ply": 1},
        "tags": {"phase": "opening", "side_to_move": "black", "in_check": False, "has_capture": False},
        "observations": [],
    }
    return json.dumps({k: v for k, v in (base | changes).items() if v is not ...})


SEEN = {"engine": "e", "depth": 4, "score": {"kind": "cp", "value": 30}, "bestmove": "7g7f"}
WHITE = {"phase": "opening", "side_to_move": "white", "in_check": False, "has_capture": False}


def scanned(spark, tmp_path, lines):
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    return records.scan(spark, str(tmp_path / "r.jsonl"))


def test_only_whole_records_are_read(spark, tmp_path):
    good = [line(), line(observations=[SEEN]), line(extra=1), line(observations=[SEEN | {"score": {"kind": "mate", "moves": -3}}])]
    bad = [
        line(observations=...),
        line(sfen=None),
        line(schema_version="11"),
        line(source={"kind": "csa", "path": "a", "ply": -1}),
        line(tags=WHITE | {"phase": "late"}),
        line(observations=[SEEN | {"score": {"kind": "cp"}}]),
        line(observations=[SEEN | {"score_bound": "near"}]),
        line(game_result={"outcome": "draw"}),
    ]
    rows = scanned(spark, tmp_path, [*good, "", "  ", *bad, "{bad"]).orderBy("idx").collect()
    assert [r.record is not None for r in rows] == [True] * len(good) + [False] * (len(bad) + 1)
    assert [r.is_json for r in rows] == [True] * (len(good) + len(bad)) + [False]


def test_validate_counts(spark, tmp_path):
    lines = [line(), line(), line(sfen="x"), line(tags=WHITE), line(sfen=...), "nope", "", line(schema_version=3, sfen=f"{START} w - 2", tags=WHITE)]
    frame = scanned(spark, tmp_path, lines)
    assert records.validate(frame).first().asDict() == {
        "total_lines": 7, "valid_json": 6, "valid_records": 5, "broken": 1, "invalid_sfens": 1, "duplicate_sfens": 2, "tag_mismatches": 1,
    }
    assert {tuple(r) for r in records.schema_versions(frame).collect()} == {(11, 4), (3, 1)}
    assert records.validate(frame.where("false")).first().total_lines == 0


def test_flat_values_are_the_side_to_moves(spark, tmp_path):
    black = SEEN | {"score_perspective": "black"}
    rows = records.flat(scanned(spark, tmp_path, [line(tags=WHITE, observations=[black, SEEN]), line(observations=[black])]))
    assert sorted([o.cp for o in r.observations] for r in rows.collect()) == [[-30, 30], [30]]
    kept = O.filter_quality(rows, QualityConfig(min_observations=2, max_score_swing_cp=100))
    assert kept.count() == 1 and rows.first().observations[0].bound == "exact"


def test_games_become_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csa").write_text(CSA)
    made = records.from_games(games.positions(games.read_games(spark, str(tmp_path / "in"))))
    records.write(made, str(tmp_path / "out"))
    back = records.scan(spark, str(tmp_path / "out"))
    assert records.validate(back).first().valid_records == 14
    assert records.flat(back).where(F.col("outcome") == "white_wins").count() == 14
