"""Baselines, walk-forward backtest, the platform source, and simulations of any number."""

import json
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldwright.functions.workers import ship
from fieldwright.operators import baselines, season, valuation, walkforward
from fieldwright.operators.relational import ContractError
from fieldwright.sources import platform_api

SLOTS = {"QB": 1, "RB": 2, "WR": 2, "TE": 1, "K": 1, "DST": 1}
FLEX = {"FLEX": (1, baselines.FLEX_USE)}


def test_ranks_of_the_worked_league():
    assert baselines.last_starter(12, SLOTS, FLEX) == {"QB": 12, "RB": 29, "WR": 29, "TE": 13, "K": 12, "DST": 12}
    ranks = baselines.replacement(12, SLOTS, FLEX)
    assert (ranks["QB"], ranks["WR"], ranks["RB"], ranks["TE"], ranks["K"], ranks["DST"]) == (18, 59, 59, 19, 12, 14)
    assert baselines.replacement(10, {"QB": 1}, held={}) == {"QB": 10}


def test_value_over_replacement_flips_raw_points(spark):
    rows = [("Chase", "WR", 283.3), ("Lamar", "QB", 371.1)] + [(f"w{k}", "WR", 114.2 + (59 - k) * 0.001) for k in range(2, 60)] + [(f"q{k}", "QB", 244.4 + (18 - k) * 0.001) for k in range(2, 19)]
    rows += [("low", "WR", 3.0), ("low", "QB", 2.0), ("none", "QB", None), ("nobody", None, 9.0), ("kicker", "K", 100.0), ("other", "LB", 5.0)]
    board = spark.createDataFrame(rows, "player string, position string, points double").repartition(4)
    got = {(r.player, r.position): r for r in baselines.values(board, baselines.replacement(12, SLOTS, FLEX)).collect()}
    assert got["Chase", "WR"].value == pytest.approx(169.1) and got["Lamar", "QB"].value == pytest.approx(126.7)
    assert got["kicker", "K"].baseline == 100.0  # fewer players than the rank: the last one counts
    assert ("other", "LB") not in got and ("nobody", None) not in got and got["low", "WR"].value < 0
    assert baselines.baselines(board.where("false"), {"QB": 3}).collect() == []


def test_only_the_best_of_a_task_are_shuffled(spark):
    board = spark.range(5000).select(F.col("id").alias("player"), F.when(F.col("id") % 2 == 0, "QB").otherwise("RB").alias("position"), (F.col("id") % 997).cast("double").alias("points")).repartition(4)
    top = baselines.best(board, 18)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 36


def test_flexible_seats_go_to_the_best_left(spark):
    rng = np.random.default_rng(2)
    slots, flex = {"QB": 1, "RB": 2, "WR": 2, "TE": 1}, {"SUPER": (1, ["QB", "RB", "WR", "TE"]), "FLEX": (2, ["RB", "WR", "TE"])}
    for teams in (2, 5):
        rows = [(k, ["QB", "RB", "WR", "TE", "K"][rng.integers(0, 5)], float(rng.integers(0, 40))) for k in range(90)]
        starts, left = defaultdict(int), sorted(rows, key=lambda r: (-r[2], r[0]))
        for p, n in slots.items():
            mine = [r for r in left if r[1] == p][: teams * n]
            starts[p] += len(mine)
            left = [r for r in left if r not in mine]
        for n, ps in (flex["FLEX"], flex["SUPER"]):
            mine = [r for r in left if r[1] in ps][: teams * n]
            for r in mine:
                starts[r[1]] += 1
            left = [r for r in left if r not in mine]
        board = spark.createDataFrame(rows, "player long, position string, points double")
        assert {r.position: r.starters for r in baselines.seats(board, teams, slots, flex).collect()} == dict(starts)


def test_walk_forward_is_a_fit_for_each_period(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[rng.integers(0, 2)], int(rng.integers(1, 8)), Decimal(int(rng.integers(0, 30))), Decimal(int(rng.integers(0, 90)))) for _ in range(150)]
    rows += [("a", 3, None, Decimal(1)), ("a", 3, Decimal(2), None), ("a", None, Decimal(2), Decimal(2)), ("c", 1, Decimal(5), Decimal(5)), ("d", 1, Decimal(5), Decimal(5)), ("d", 2, Decimal(5), Decimal(9))]
    df = spark.createDataFrame(rows, "k string, week int, x decimal(10,2), y decimal(10,2)")
    good = [(k, w, float(x), float(y)) for k, w, x, y in rows if None not in (k, w, x, y)]
    got = {(r.k, r.week): r for r in walkforward.backtest(df, "week", "x", "y", "k").collect()}
    for key in {(k, w) for k, w, _, _ in good}:
        past, now = [(x, y) for k, w, x, y in good if k == key[0] and w < key[1]], [(x, y) for k, w, x, y in good if (k, w) == key]
        if not past:
            assert key not in got
            continue
        px, py = np.array(past).T
        slope = np.polyfit(px, py, 1)[0] if np.ptp(px) > 0 else 0.0
        off = np.array([y - (py.mean() + slope * (x - px.mean())) for x, y in now])
        r = got[key]
        assert (r.n, r.n_before) == (len(now), len(past)) and r.bias == pytest.approx(off.mean()) and r.mae == pytest.approx(np.abs(off).mean())
        assert r.mae_mean == pytest.approx(np.mean([abs(y - py.mean()) for _, y in now]))
    assert walkforward.backtest(df.where("false"), "week", "x", "y").collect() == []


LEAGUE = {"league_id": "L1", "name": "Fixture", "season": "2026", "total_rosters": 2, "roster_positions": ["QB", "SUPER_FLEX", "DEF", "BN"], "scoring_settings": {"rec": 0.5, "pass_td": 4}, "settings": {"waiver_type": 2, "waiver_budget": 100}, "metadata": None, "new_key": [1, {"x": 2}]}
ANSWERS = {
    "/state/nfl": {"week": 1, "leg": 1, "season": "2026", "season_type": "regular", "display_week": 1},
    "/user/me": {"user_id": "U1", "username": "me", "display_name": "Me", "metadata": None},
    "/user/U1/leagues/nfl/2026": [LEAGUE],
    "/league/L1": LEAGUE,
    "/league/L1/rosters": [{"roster_id": 1, "owner_id": "U1", "starters": ["1", "0", "KC"], "players": ["1", "KC", "2"], "reserve": ["2"], "taxi": None, "settings": {"wins": 1, "fpts": 100}}, {"roster_id": 2, "owner_id": None, "starters": None, "players": None, "reserve": None, "taxi": None, "settings": None}],
    "/league/L1/users": [{"user_id": "U1", "display_name": "Me", "is_owner": True, "metadata": {"team_name": "A"}}, {"user_id": "U2", "display_name": "You", "metadata": {}}],
    "/league/L1/matchups/1": [{"roster_id": 1, "matchup_id": 1, "points": 101.5, "starters": ["1"]}, {"roster_id": 2, "matchup_id": None, "points": 0, "starters": None}],
    "/league/L1/transactions/1": [{"transaction_id": "T", "type": "waiver", "status": "complete", "leg": 1, "created": 1756000000000, "roster_ids": [1], "adds": {"9": 1}, "drops": None, "settings": {"waiver_bid": 7}}],
    "/league/L1/drafts": [{"draft_id": "D1", "league_id": "L1", "status": "drafting", "last_picked": None, "draft_order": None}],
    "/draft/D1": {"draft_id": "D1", "league_id": "L1", "status": "drafting", "last_picked": 5, "draft_order": {"U1": 1}, "slot_to_roster_id": {"1": 1}},
    "/draft/D1/picks": [{"pick_no": 1, "round": 1, "draft_slot": 1, "roster_id": 1, "player_id": "9", "is_keeper": None, "metadata": {"amount": "12"}}],
    "/league/L2/rosters": [],
}
REQUESTS = [
    {"endpoint": "state"}, {"endpoint": "user", "user": "me"}, {"endpoint": "user_leagues", "user": "U1", "season": 2026}, {"endpoint": "league", "league": "L1"}, {"endpoint": "rosters", "league": "L1"},
    {"endpoint": "rosters", "league": "L2"}, {"endpoint": "users", "league": "L1"}, {"endpoint": "matchups", "league": "L1", "week": 1}, {"endpoint": "transactions", "league": "L1", "week": 1},
    {"endpoint": "drafts", "league": "L1"}, {"endpoint": "draft", "draft": "D1"}, {"endpoint": "picks", "draft": "D1"},
]


@pytest.fixture(scope="module")
def recorded(tmp_path_factory):
    root = tmp_path_factory.mktemp("platform")
    for path, body in ANSWERS.items():
        (root / path[1:]).parent.mkdir(parents=True, exist_ok=True)
        (root / (path[1:] + ".json")).write_text(json.dumps(body))
    (root / "league" / "bad.json").write_text("<html>busy</html>")
    return f"file://{root}"


def test_all_payloads_by_the_data_source(spark, recorded):
    answers = platform_api.ask(spark, recorded, REQUESTS, suffix=".json", parallel=3, rate=60000)
    assert answers.rdd.getNumPartitions() == 3 and answers.count() == len(REQUESTS)
    assert set(platform_api.PATHS) == set(platform_api.SCHEMAS) and len(platform_api.PATHS) == 11
    get = lambda e: [r.asDict(recursive=True) for r in platform_api.payload(answers, e).collect()]
    (league,) = get("league")
    assert league["scoring_settings"] == {"rec": 0.5, "pass_td": 4.0} and league["metadata"] == {} and league["asked"] == {"endpoint": "league", "league": "L1"}
    assert get("user_leagues")[0]["league_id"] == "L1" and get("state")[0]["week"] == 1 and get("user")[0]["metadata"] == {}
    one, two = sorted(get("rosters"), key=lambda r: r["roster_id"])
    assert one["reserve"] == ["2"] and one["taxi"] == [] and (two["starters"], two["players"], two["settings"], two["co_owners"]) == ([], [], {}, [])
    assert {r["user_id"]: r["metadata"] for r in get("users")} == {"U1": {"team_name": "A"}, "U2": {}}
    assert {r["roster_id"]: (r["matchup_id"], r["points"]) for r in get("matchups")} == {1: (1, 101.5), 2: (None, 0.0)}
    (move,) = get("transactions")
    assert (move["adds"], move["drops"], move["created"]) == ({"9": 1}, {}, 1756000000000)
    assert get("drafts")[0]["draft_order"] == {} and get("draft")[0]["last_picked"] == 5 and get("picks")[0]["metadata"] == {"amount": "12"}
    assert platform_api.ask(spark, recorded, []).collect() == []


def test_missing_and_broken_answers(spark, recorded):
    gone = [{"endpoint": "league", "league": "nope"}, {"endpoint": "state"}]
    with pytest.raises(Exception, match="the platform has no /league/nope"):
        platform_api.ask(spark, recorded, gone, suffix=".json").collect()
    assert platform_api.ask(spark, recorded, gone, suffix=".json", missing="skip").count() == 1
    broken = platform_api.ask(spark, recorded, [{"endpoint": "league", "league": "bad"}], suffix=".json")
    with pytest.raises(Exception, match="(?i)malformed"):
        platform_api.payload(broken, "league").collect()
    with pytest.raises(Exception, match="week"):
        platform_api.ask(spark, recorded, [{"endpoint": "matchups", "league": "L1"}]).collect()


def test_the_bucket_keeps_the_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = platform_api.Bucket(300, 30, lambda: now[0], sleep)
    for _ in range(30):
        bucket.take()
    assert not slept
    for _ in range(10):
        bucket.take()
    assert sum(slept) == pytest.approx(10 * 0.2)
    now[0] += 100
    for _ in range(30):
        bucket.take()
    assert sum(slept) == pytest.approx(2.0)


def test_an_id_twice_in_the_catalogue_is_an_error(spark):
    rows = spark.createDataFrame([("1", "a"), ("KC", "b")], "player_id string, name string")
    assert platform_api.catalogue(rows).count() == 2
    with pytest.raises(ContractError, match="KC"):
        platform_api.catalogue(rows.union(rows.limit(2)))


def test_seasons_of_any_number_and_text_teams(spark):
    ship(spark)
    teams = spark.createDataFrame([(t, 100.0 + k, 20.0) for k, t in enumerate("abcdef")], "team string, mean double, sd double")
    for sims, chunk in ((100, 250), (130, 50)):
        rows = season.monte_carlo(teams, sims, chunk, 6, 4).collect()
        assert {r.team for r in rows} == set("abcdef")
        assert sum(r.title for r in rows) == pytest.approx(1.0) and sum(r.playoffs for r in rows) == pytest.approx(4.0)


def test_adds_and_drops_of_text_ids(spark):
    ship(spark)
    kind = "team string, player string, position string, points double"
    roster = spark.createDataFrame([("t1", "p1", "QB", 10.0), ("t1", "p2", "RB", 5.0), ("t1", "KC", "DST", 1.0)], kind)
    free = spark.createDataFrame([("", "x9", "QB", 14.0), ("", "x8", "RB", 1.0)], kind).drop("team")
    rows = valuation.add_drop(roster, free, {"QB": 1, "RB": 1}).collect()
    assert {(r.team, r.add): (r["drop"], r.gain) for r in rows} == {("t1", "x9"): ("KC", 4.0), ("t1", "x8"): ("KC", 0.0)}
