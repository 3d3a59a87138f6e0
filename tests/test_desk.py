"""Decisions on the queue, the report and the gate with its exit codes."""

import json
from datetime import datetime

import pytest
from test_idfile import FILE, RAW, ROWS

from fieldwright import commands
from fieldwright.operators import desk, identity, idfile, ladder
from fieldwright.operators.relational import ContractError
from fieldwright.sources import lake

MON, TUE = datetime(2026, 9, 7), datetime(2026, 9, 8)


@pytest.fixture()
def state(spark, tmp_path):
    people = [(k, None, k.title(), None, None, k, "QB", None, None, None, None, None, None, None) for k in ("mahomes", "chase", "lamar", "allen")]
    mappings = [
        ("s", "guess", "lamar", "fuzzy", 0.89, False),
        ("s", "wrong", "mahomes", "exact_name", 0.95, False),
        ("s", "tomb", "allen", "rejected", 0.0, False),
        ("s", "dispute", "chase", "manual", 1.0, True),
        ("t", "held", "chase", "fuzzy", 0.89, False),
    ]
    queue = [("s", "tomb", "T", None, None, "rejected", MON, MON, False), ("s", "dispute", "D", None, None, "human_decision_conflict", MON, MON, False), ("s", "lost", "L", "QB", "KC", "no_candidate", MON, MON, False), ("s", "wrong", "W", "QB", "DEN", "x", MON, MON, True), ("s", "guess", "G", None, None, "x", MON, MON, False)]
    out = lake.State(spark, str(tmp_path / "state"))
    out.commit({"players": spark.createDataFrame(people, idfile.PLAYERS), "mappings": spark.createDataFrame(mappings, identity.MAPPINGS), "queue": spark.createDataFrame(queue, ladder.QUEUE)})
    return out


def test_decisions_are_taken_together(spark, state):
    rows = [
        ("s", "guess", "verify", None, None),
        ("s", "wrong", "reject", None, None),
        ("s", "tomb", "verify", None, None),
        ("s", "new", "map", "mahomes", None),  # the rejection in this batch has freed the slot
        ("s", "new2", "map", "mahomes", None),
        ("s", "gone", "reject", None, None),
        ("s", "dispute", "mark", None, False),
        ("s", "lost", "mark", None, None),
        ("s", "nowhere", "mark", None, True),
        ("t", "other", "map", "chase", None),
        ("t", "nobody", "map", "nobody", None),
        ("t", "held", "map", "allen", None),
    ]
    got = desk.commit_decisions(state, spark.createDataFrame(rows, desk.DECISION), TUE)
    assert {k[1]: v for k, v in got.items()} == {
        "guess": "verified", "wrong": "tombstone", "tomb": "rejected", "new": "created", "new2": "source_player_clash", "gone": "missing", "dispute": "still_mapped", "lost": "closed", "nowhere": "missing",
        "other": "source_player_clash", "nobody": "no_such_player", "held": "replaced",
    }
    ids = {r.external_id: r for r in state.read("mappings").collect()}
    assert (ids["guess"].verified, ids["wrong"].method, ids["wrong"].confidence, ids["wrong"].player_id) == (True, "rejected", 0.0, "mahomes")
    assert (ids["new"].player_id, ids["new"].method, ids["new"].verified) == ("mahomes", "manual", True) and ids["held"].player_id == "allen" and "new2" not in ids
    queue = {r.external_id: r for r in state.read("queue").collect()}
    assert {k: r.resolved for k, r in queue.items()} == {"guess": True, "wrong": False, "tomb": False, "dispute": False, "lost": True}
    assert (queue["wrong"].raw_name, queue["wrong"].raw_team, queue["wrong"].reason, queue["wrong"].last_seen) == ("W", "DEN", "rejected", TUE)
    forced = desk.commit_decisions(state, spark.createDataFrame([("s", "dispute", "mark", None, True), ("s", "tomb", "map", "allen", None)], desk.DECISION), TUE)
    assert forced == {("s", "dispute"): "closed", ("s", "tomb"): "replaced"}
    for bad in ([("s", "x", "frob", None, None)], [("s", "x", "mark", None, None), ("s", "x", "verify", None, None)]):
        with pytest.raises(ContractError):
            desk.commit_decisions(state, spark.createDataFrame(bad, desk.DECISION), TUE)


def test_report_and_gate(spark, state):
    told = desk.report(*(state.read(n) for n in ("players", "mappings", "queue")), most=1)
    assert told["players_by_position"] == {"QB": 4} and told["ids_by_source"] == {"s": 4, "t": 1} and told["ids_by_source_method"]["s"] == {"exact_name": 1, "fuzzy": 1, "manual": 1, "rejected": 1}
    assert (told["pending"], told["unmatched"]) == (2, 4) and [r["external_id"] for r in told["pending_rows"]] == ["guess"]
    assert desk.gate(told) == 1
    clean = told | {"pending": 0, "unmatched": 0}
    assert desk.gate(clean) == 0 and desk.gate(clean | {"ids_by_source": {}}) == 1 and desk.gate(clean | {"ids_by_source": {}}, allow_empty=True) == 0


def test_commands_and_exit_codes(spark, tmp_path, capsys):
    root = str(tmp_path / "cli")
    go = lambda *a: (commands.main([root, *a], spark), capsys.readouterr())
    code, out = go("report")
    assert code == 1 and json.loads(out.out)["players_total"] == 0
    assert go("report", "--allow-empty")[0] == 0
    people = [(r[4] or f"x{r[0]}", r[10], "A", "B", r[11], "1990-01-01", 2020, 72, 200, "S", "ACT", "KC") for r in ROWS[:5]]
    spark.createDataFrame(people, RAW).write.parquet(str(tmp_path / "players"))
    spark.createDataFrame(ROWS, FILE).drop("row_no").fillna("NA").coalesce(1).write.option("header", True).csv(str(tmp_path / "ids"))
    code, out = go("seed", "--players", str(tmp_path / "players"), "--playerids", str(tmp_path / "ids"))
    assert code == 0 and json.loads(out.out)["inserted"] == 61
    assert go("report")[0] == 1  # the ambiguous ids wait
    for external_id in ("9898", "10167"):
        assert go("mark", "rotowire", external_id)[0] == 0
    assert go("report")[0] == 0
    assert go("mark", "rotowire", "none")[0] == 1 and go("verify", "sleeper", "4046")[0] == 0
    chase = next(r.player_id for r in lake.State(spark, root).read("players").where("gsis_id = '00-0036900'").collect())
    assert go("reject", "sleeper", "7564")[0] == 0
    assert go("map", "sleeper", "4046", chase)[0] == 0
    code, out = go("seed", "--playerids", str(tmp_path / "ids"))
    assert code == 2 and "4046" in out.err and not out.out
    assert go("seed", "--playerids", str(tmp_path / "nothing"))[0] == 3
