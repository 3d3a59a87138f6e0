"""Leagues, teams, rosters, drafts and picks upserted together."""

import pytest
from pyspark.sql import functions as F

from fieldwright.operators import identity, leagues
from fieldwright.operators.relational import ContractError
from fieldwright.sources import lake

KINDS = {
    "leagues": "platform string, league string, season int, name string, num_teams int",
    "teams": "platform string, league string, season int, team string, display_name string, is_me boolean",
    "rosters": "platform string, league string, season int, week int, team string, player string, slot string, is_starter boolean",
    "drafts": "platform string, league string, season int, draft string, status string",
    "picks": "platform string, league string, season int, draft string, pick_no int, team string, player string, is_keeper boolean",
}
A, B = ("s", "L1", 2026), ("s", "L2", 2026)


def load(spark, **change):
    rows = {
        "leagues": [(*A, "One", 2), (*B, "Two", 1)],
        "teams": [(*A, "1", "Me", True), (*A, "2", "You", False), (*B, "1", "Other", None)],
        "rosters": [(*A, 1, "1", "4046", "QB", True), (*A, 1, "1", "77", "BN", False), (*A, 1, "2", "7564", "WR", True), (*B, 1, "1", "4046", "QB", True)],
        "drafts": [(*A, "D", "drafting"), (*B, "D", "complete")],
        "picks": [(*A, "D", 1, "1", "4046", False), (*A, "D", 2, None, None, False), (*A, "D", 3, "2", "unknown", True), (*B, "D", 1, "1", "7564", False)],
    } | change
    return {n: spark.createDataFrame(rows[n], k) for n, k in KINDS.items()}


@pytest.fixture()
def mappings(spark):
    return spark.createDataFrame([("s", "4046", "mahomes", "gsis", 1.0, False), ("s", "7564", "chase", "manual", 1.0, True), ("s", "77", "guess", "fuzzy", 0.89, False)], identity.MAPPINGS)


def test_a_load_and_a_second_one(spark, tmp_path, mappings):
    state = lake.State(spark, str(tmp_path))
    assert leagues.commit(state, load(spark), mappings) == {"leagues": 2, "teams": 3, "drafts": 2, "picks": 4, "slots": 3, "unresolved": 1}
    get = lambda n: sorted(map(tuple, state.read(n).select(sorted(state.read(n).columns)).collect()), key=repr)
    first = {n: get(n) for n in ("leagues", "teams", "drafts", "picks", "slots")}
    one = state.read("leagues").where("league = 'L1'").head()
    me = state.read("teams").where("is_me").head()
    assert one.my_team_id == me.team_id and me.league_id == one.league_id and state.read("leagues").where("league = 'L2'").head().my_team_id is None
    picks = state.read("picks").join(state.read("drafts").where(F.col("league_id") == one.league_id), "draft_id").orderBy("pick_no").collect()
    assert picks[1].team_id is None and [(p.player_id, p.team_id == me.team_id, p.is_keeper) for p in picks] == [("mahomes", True, False), (None, False, False), (None, False, True)]
    leagues.commit(state, load(spark), mappings)
    assert {n: get(n) for n in first} == first  # again: the same
    later = load(spark, leagues=[(*A, "Renamed", 2)], teams=[(*A, "1", "Me", False), (*A, "2", "You", True)], rosters=[(*A, 1, "1", "77", "BN", False), (*A, 2, "2", "4046", "QB", True)], drafts=[(*A, "D", "complete")], picks=[(*A, "D", 2, "2", "7564", False), (*A, "D", 4, "1", None, False)])
    leagues.commit(state, later, mappings)
    assert state.read("leagues").count() == 2 and state.read("leagues").where("name = 'Renamed'").head().my_team_id != me.team_id
    assert state.read("picks").count() == 5 and state.read("picks").where("player_id = 'chase'").count() == 2
    weeks = {(r.team_id == me.team_id, r.week, r.player_id) for r in state.read("slots").collect()}
    assert weeks == {(False, 1, "chase"), (False, 2, "mahomes"), (False, 1, "mahomes")}  # week 1 of my team is replaced by players nobody knows


@pytest.mark.parametrize(
    "change,said",
    [
        ({"leagues": [(*A, "One", 3), (*B, "Two", 1)]}, "not as many"),
        ({"teams": [(*A, "1", "Me", True), (*A, "2", "You", True), (*B, "1", "Other", None)]}, "several are mine"),
        ({"picks": [(*B, "D", 1, "2", "7564", False)]}, "picks: teams of no such league"),
        ({"picks": [(*A, "E", 1, "1", "7564", False)]}, "a draft is not part"),
        ({"picks": [(*A, "D", 1, "1", "a", False), (*A, "D", 1, "2", "b", False)]}, "picks: keys stand twice"),
        ({"rosters": [(*A, 1, "9", "4046", "QB", True)]}, "rosters: teams of no such league"),
        ({"drafts": [("s", "L9", 2026, "D", "complete")]}, "a league is not part"),
        ({"teams": [(*A, None, "Me", True), (*A, "2", "You", False), (*B, "1", "Other", None)]}, "a key is null"),
    ],
)
def test_refusals_write_nothing(spark, tmp_path, mappings, change, said):
    state = lake.State(spark, str(tmp_path))
    with pytest.raises(ContractError, match=said):
        leagues.commit(state, load(spark, **change), mappings)
    assert state.version() == 0


def test_derived_ids_tell_keys_apart(spark):
    rows = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("ab", "c"), ("a", "bc")], "x string, y string")
    assert rows.select(leagues.derived("l", "x", "y")).distinct().count() == 4
