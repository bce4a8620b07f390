"""The board, and game records of each format on files written here."""

import pytest
from pyspark.sql import functions as F

from plyforge.functions import board as B
from plyforge.plans.formats import CSA, KIF, MATCH, USI
from plyforge.sources import games as G

HEAD = "手合割：平手\n手数----指手----消費時間--\n"


def test_formats_agree():
    csa, kif, log = G.walk_csa(CSA, "a"), G.walk_kif(KIF, "b"), G.walk_match(MATCH, "c")
    for game in (csa, kif, log):
        assert [s["usi"] for s in game.steps] == USI.split()
        assert [s["ply"] for s in game.steps if s["has_capture"]] == [10, 11]
        assert game.outcome == "white_wins"
        assert [s["sfen"] for s in game.steps] == [s["sfen"] for s in csa.steps]
    assert csa.steps[-1]["sfen"] == "lnsgk2nl/1r4g2/p1ppppspp/6p2/1p2B2P1/2P6/PPSPPPP1P/7R1/LN1GKGSNL b b 15"
    assert (csa.reason, kif.reason, log.reason) == ("csa_terminal", "kif_marker", "match_header")


def test_promotion_refused_and_recapture():
    text = HEAD + "1 ７六歩(77)\n2 ３四歩(33)\n3 ２二角(88)\n4 同　飛(82)\n5 中断\n"
    game = G.walk_kif(text, "f")
    assert [s["usi"] for s in game.steps] == ["7g7f", "3c3d", "8h2b", "8b2b"] and game.outcome == "unknown"


@pytest.mark.parametrize(
    ("ending", "outcome", "reason"),
    [
        ("%SENNICHITE", "draw", "csa_terminal"),
        ("%KACHI", "black_wins", "csa_terminal"),
        ("%+ILLEGAL_ACTION", "white_wins", "csa_terminal"),
        ("%CHUDAN", "unknown", "csa_interrupted"),
        ("%MATTA", "unknown", "csa_terminal_undetermined"),
        ("", "unknown", "csa_no_terminal"),
        ("+0055HI", "unknown", "csa_walk_error"),
    ],
)
def test_csa_endings(ending, outcome, reason):
    game = G.walk_csa(CSA.replace("%TORYO", ending), "a")
    assert (game.outcome, game.reason, len(game.steps)) == (outcome, reason, 14)


def test_csa_starts():
    board = G._csa_start(["PI82HI22KA"])
    assert board.text().startswith("lnsgkgsnl/9/p")
    board = G._csa_start(["P1-KY * " + " * " * 7, "P+55OU00FU00FU"])
    assert board.cells[0] == "l" and board.cells[B.square(5, 5)] == "K" and board.hands == {}
    with pytest.raises(G.GameError):
        G.walk_csa("hello", "x")


def test_kif_variations_and_handicap():
    text = KIF + "\n変化：2手\n2 ３四歩(33)\n3 ７六歩(77)\n変化：20手\n20 ８六歩(85)\n変化：1手\n1 ７六歩(77)\n"
    game = G.walk_kif(text, "f")
    assert [(s["path"], s["ply"]) for s in game.steps[14:]] == [("f#var1@2", 2), ("f#var1@2", 3), ("f#var2@1", 1)]
    assert [r["outcome"] for r in game.rows()] == ["white_wins"] * 14 + ["unknown"] * 3
    bishop = "手合割：角落ち\n手数--\n1 ８四歩(83)\n2 ７六歩(77)\n3 ６二銀(71)\n4 投了\nまで3手で先手の勝ち\n変化：2手\n2 ２六歩(27)\n"
    bishop = G.walk_kif(bishop, "f")
    assert bishop.outcome == "white_wins" and [s["mover"] for s in bishop.steps] == ["white", "black", "white", "black"]
    with pytest.raises(G.GameError):
        G.walk_kif("手合割：三枚落ち\n", "f")
    assert G.walk_kif(HEAD + "1 千日手\n", "f").outcome == "draw"
    assert G.decoded(KIF.encode("cp932")) == KIF and G.decoded(b"\xef\xbb\xbf" + KIF.encode()) == KIF


def test_match_logs():
    head = "# Engine1: x (White)\n# Result: Engine2 Win\n"
    late = G.walk_match(head + f"position sfen {B.START} b - 22 moves 7g7f bad 3c3d", "m", "engine1")
    assert [s["ply"] for s in late.steps] == [22] and late.outcome is None
    assert G.walk_match(head + "position startpos moves 7g7f", "m", "engine2").steps == []
    assert G.walk_match(f"position sfen {B.START} b K 1", "m").steps == []


@pytest.mark.parametrize(
    ("state", "valid"),
    [
        (f"{B.START} b - 1", True),
        (f"{B.START} w 2Pb 7", True),
        (f" {B.START}  b - +3 ", True),
        (f"{B.START} b 10P 1", False),
        (f"{B.START} b K 1", False),
        (f"{B.START} b - 0", False),
        (f"{B.START} x - 1", False),
        (f"{B.START} b - {2**32}", False),
        (f"{B.START}/9 b - 1", False),
        (f"{B.START[:-1]} b - 1", False),
        ("", False),
    ],
)
def test_validity_in_python_and_spark(spark, state, valid):
    row = spark.createDataFrame([(state,)], "s string").select(B.state_is_valid(F.col("s")).alias("v"), B.total_material(F.col("s")).alias("m")).first()
    assert B.valid_state(state) == valid and row.v == valid and (row.m is not None) == valid


def test_material_and_hash(spark):
    states = [f"{B.START} b - 1", f"{B.START} b 2Rp 9", "+P8/9/9/9/9/9/9/9/9 w - 1", "x", None]
    rows = spark.createDataFrame([(s,) for s in states], "s string")
    got = rows.select(B.total_material(F.col("s")).alias("m"), B.position_hashes(F.col("s")).alias("h")).collect()
    one = 2 * (9 + 2 * 3 + 2 * 3 + 2 * 5 + 2 * 6 + 8 + 10)
    assert [r.m for r in got] == [one, one + 21, 6, None, None]
    assert got[0].h == got[1].h != got[2].h and got[3].h is None


def test_checks_and_legal_moves():
    start = B.Board.start()
    assert len(set(start.legal_moves())) == 30 and not start.checked()
    assert B.Board.parse("4k4/4G4/4P4/9/9/9/9/9/4K4 w - 2").checked()
    assert not B.Board.parse("4k4/4G4/4P4/9/9/9/9/9/4K4 w - 2").can_move()
    assert B.Board.parse("4k4/9/3NN4/9/9/9/9/9/4K4 w - 2").checked()
    assert not B.Board.parse("4k4/4p4/4L4/9/9/9/9/9/4K4 w - 2").checked()
    # With lances beside the king the pawn drop would mate, which the rules forbid; without them it may be played.
    assert "P*5b" not in set(B.Board.parse("3lkl3/9/4G4/9/9/9/9/9/4K4 b P 1").legal_moves())
    assert "P*5b" in set(B.Board.parse("4k4/9/4G4/9/9/9/9/9/4K4 b P 1").legal_moves())
    assert "P*5c" not in set(B.Board.parse("4k4/9/9/9/9/9/4P4/9/4K4 b P 1").legal_moves())
    for move in ("7g7d", "B*5e", "7g7f+", "0a1b"):
        assert move not in set(start.legal_moves())


def test_legality_columns(spark):
    rows = spark.createDataFrame([(f"{B.START} b - 1", "7g7f"), (f"{B.START} b - 1", "7g7e"), ("bad", "7g7f"), (None, None)], "s string, m string")
    got = rows.select(B.is_legal("s", "m").alias("l"), B.playable("s").alias("p")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (None, None), (None, None)]


def test_folder_of_games(spark, tmp_path):
    (tmp_path / "a.csa").write_text(CSA)
    (tmp_path / "b.kif").write_bytes(KIF.encode("cp932"))
    (tmp_path / "c.csa").write_text("no game")
    (tmp_path / "d.md").write_text("x")
    games = G.read_games(spark, str(tmp_path))
    assert games.where("error is not null").select("file").first().file.endswith("c.csa")
    assert G.positions(games).count() == 28
    first = G.positions(games, dedup="sfen").collect()
    assert len(first) == 14 and {r.kind for r in first} == {"csa"}
    assert G.positions(games, dedup="position").count() == 14
    assert sorted({r.ply for r in G.positions(games, 2, 4, 2).collect()}) == [2, 4]
    assert G.moves(games).count() == 28
    assert G.move_sequences(games).first().sequences == 2
