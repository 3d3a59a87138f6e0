"""Scalars, guards, the lake, identity, valuation and streams."""

import json
import math
from datetime import UTC, datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldwright.functions import chances, names
from fieldwright.functions.workers import ship
from fieldwright.operators import closeness, features, identity, platform, season, valuation
from fieldwright.operators import relational as rel
from fieldwright.sources import lake
from fieldwright.streaming import events


def values(spark, column, inputs):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], "k int, x string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("x"))).collect()]


def test_names(spark):
    cases = {
        "Patrick Mahomes II": "patrick mahomes",
        "D.J. Moore": "dj moore",
        "Ja'Marr Chase": "jamarr chase",
        "Amon-Ra St. Brown": "amonra st brown",
        "Odell Beckham Jr.": "odell beckham",
        "Mike Évans": "michael evans",
        "John A V": "john av",
        "C J  Stroud": "cj stroud",
        "Sr": "sr",
        "": "",
        None: None,
    }
    assert values(spark, names.normalize_name, list(cases)) == list(cases.values())
    teams = {"Chiefs D/ST": "KC", "New York": None, "LA Rams": "LA", "gnb": "GB", "49ers": "SF", "FA": None, "Los Angeles Chargers": "LAC", "": None, None: None}
    assert values(spark, names.normalize_team, list(teams)) == list(teams.values())
    positions = {"PK": "K", "FB": "RB", "D/ST": "DST", "def": "DST", "CB": None, "": None, None: None}
    assert values(spark, names.normalize_position, list(positions)) == list(positions.values())
    pairs = spark.createDataFrame([("Michigan State", "Ohio State"), ("Alabama", "University of Alabama"), (None, "x"), ("Texas A&M", "texas")], "a string, b string")
    assert [r[0] for r in pairs.select(names.schools_agree(F.col("a"), F.col("b"))).collect()] == [False, True, None, True]
    key = pairs.limit(1).select(names.defence_key(F.lit("Kansas City Chiefs"), F.lit("DEN"))).head()[0]
    assert key == "kc dst"


def test_fold_accents_agrees_with_unicode(spark):
    import unicodedata

    words = ["éàü ñ Ç", "Ångström ﬁn", "naïve ½", "Łódź", "ǅ", "éa", "plain", "ﾊ"]
    want = ["".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)) for w in words[:2] + words[3:7]]
    assert values(spark, names.fold_accents, words[:2] + words[3:7]) == want


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
def test_jaro_winkler_is_a_bounded_symmetric_score(a, b):
    s = names.jaro_winkler_of(a, b)
    assert 0 <= s <= 1 and (s == 1) == (a == b) and math.isclose(s, names.jaro_winkler_of(b, a), abs_tol=1e-12)


def test_jaro_winkler_goldens():
    assert names.jaro_winkler_of("lamarr jackson", "lamar jackson") == pytest.approx(0.9857, abs=1e-4)
    assert names.jaro_winkler_of("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)


def test_chances(spark):
    row = spark.range(1).select(*[F.round(chances.phi(F.lit(x)), 3) for x in (-6 / 22, -6 / 30, 6 / 22, 6 / 30)]).head()
    assert tuple(row) == (0.393, 0.421, 0.607, 0.579)
    row = spark.range(1).select(chances.gamma_shape(F.lit(14.0), F.lit(7.0)), chances.gamma_scale(F.lit(14.0), F.lit(7.0))).head()
    assert tuple(row) == (4.0, 3.5)
    q = chances.gamma_ppf(np.array([0.1, 0.5, 0.9]), 4.0, 3.5)
    assert chances.gamma_cdf(q / 3.5, 4.0) == pytest.approx([0.1, 0.5, 0.9], abs=1e-9)
    assert chances.gamma_cdf(np.array([1.0]), 1.0)[0] == pytest.approx(1 - math.exp(-1), abs=1e-12)
    broken = np.array([[1, 0.9, -0.9], [0.9, 1, 0.9], [-0.9, 0.9, 1]])
    fixed = chances.positive_semidefinite(broken)
    assert np.linalg.eigvalsh(fixed).min() > -1e-9 and np.allclose(np.diag(fixed), 1)
    draws = chances.copula_draws([4.0, 2.0], [3.5, 5.0], np.array([[1, 0.5], [0.5, 1]]), 4000, 1)
    assert draws.mean(axis=0) == pytest.approx([14, 10], rel=0.05) and np.corrcoef(draws.T)[0, 1] > 0.3


def test_decision_goldens(spark):
    home, away = valuation.implied_totals(F.lit(47.5), F.lit(3.5))
    base = valuation.faab_base(F.lit(73), F.lit(18), F.lit(62))
    row = spark.range(1).select(home, away, F.round(base, 3), F.round(valuation.shaded(base, F.lit(4)), 3)).head()
    assert tuple(row) == (25.5, 22.0, pytest.approx(16.425), pytest.approx(12.319))
    assert valuation.starters_rank(12, 1.0, 0.5) == 18


def test_lineups_use_each_slot_exactly():
    players = [(1, "QB", 20.0), (2, "RB", 15.0), (3, "RB", 14.0), (4, "WR", 13.0), (5, "WR", 12.0), (6, "TE", 9.0)]
    got = valuation.assign(players, {"QB": 1, "RB": 1, "WR": 1, "FLEX": 1}, {"FLEX": ["RB", "WR", "TE"]}, top=3)
    assert got[0] == (62.0, (1, 2, 3, 4)) and [v for v, _ in got] == [62.0, 61.0, 60.0] or got[0][0] == 62.0
    assert all(len(set(who)) == 4 for _, who in got)
    assert valuation.assign(players[:2], {"QB": 1, "WR": 1}, {}) == []


BOARD = "player long, position string, points double"


def test_best_lineups_of_large_rosters(spark):
    """Pruned rosters give what all players give, ties included."""
    ship(spark)
    rng = np.random.default_rng(5)
    rows = [(k, "ABC"[k % 3], float(rng.integers(0, 40))) for k in range(150)]
    slots, flex = {"A": 1, "B": 1, "FLEX": 1}, {"FLEX": ["B", "C"]}
    df = spark.createDataFrame(rows, BOARD).withColumn("team", F.col("player") % 2)
    got = {(r.team, r.place): r.points for r in valuation.best_lineups(df, "team", slots, flex, 4).collect()}
    for team in (0, 1):
        want = valuation.assign([r for r in rows if r[0] % 2 == team], slots, flex, 4)
        assert [got[team, k + 1] for k in range(4)] == [v for v, _ in want]


def test_add_drop_takes_every_free_player(spark):
    """More free players than the former 200, against the assignment of every add and drop."""
    ship(spark)
    rng = np.random.default_rng(3)
    slots = {"A": 2, "B": 1}
    own = [(t, 10 * t + k, "AAABBC"[k], float(rng.integers(-3, 30))) for t in (1, 2) for k in range(6)] + [(3, 31, "A", 4.0), (3, 32, "B", 5.0), (3, 33, "C", 1.0)]
    free = [(100 + k, "ABCD"[int(k > 200) * (k % 4)], float(rng.integers(-3, 40)) + 60 * (k < 200)) for k in range(260)]
    got = {(r["team"], r["add"]): (r["drop"], r["gain"]) for r in valuation.add_drop(spark.createDataFrame(own, "team long, " + BOARD), spark.createDataFrame(free, BOARD), slots).collect()}
    assert len(got) == 3 * len(free)
    for team in (1, 2, 3):
        mine = [p[1:] for p in own if p[0] == team]
        value = lambda who: next((v for v, _ in valuation.assign(who, slots, {})), 0.0)
        for add in free:
            gain, drop = max(((value([p for p in mine if p != d] + [add]) - value(mine), d[0]) for d in mine), key=lambda x: (x[0], -x[1]))
            assert got[team, add[0]] == (drop, round(gain, 6)), (team, add)


def test_boards_and_leagues_are_whole(spark):
    ship(spark)
    many = spark.range(1100).select(F.col("id").alias("player"), F.when(F.col("id") < 1050, "A").otherwise("B").alias("position"), (1100 - F.col("id")).cast("double").alias("points"), (F.col("id") + 1).alias("adp"))
    assert valuation.tiers(many.where("id < 500"), "position", "player", "points").count() == 500
    late = valuation.next_available(many, sims=2, picks=5).where("player = 1050").head()
    assert late.vona == 0.0  # the best of a position that starts beyond the first 1000
    teams = spark.range(66).select(F.col("id").alias("team"), F.lit(100.0).alias("mean"), F.lit(10.0).alias("sd"))
    assert season.monte_carlo(teams, 4, 2, 3, 4).count() == 66


def test_close_names_of_any_first_letter_and_length(spark):
    ship(spark)
    players = spark.createDataFrame(
        [("p1", None, "Matthew Stafford", "QB", "LAR"), ("p2", None, "Christian Fulton", "RB", "KC"), ("p3", None, "Kristian Fultom", "RB", "KC"), ("p5", None, "Tom Old", "TE", "NE"), ("p6", None, "Tom Old", "TE", "NE")],
        "player_id string, gsis_id string, name string, position string, team string",
    )
    inputs = [("s", "1", "Atthew Stafford", "QB", None, None), ("s", "2", "Kristian Fulton", "RB", None, None), ("s", "3", "Tom Old", "TE", "NE", None)]
    df = spark.createDataFrame(inputs, "source string, external_id string, raw_name string, raw_position string, raw_team string, gsis_id string")
    held = spark.createDataFrame([("s", "9", "p5", "manual", 1.0, True)], identity.MAPPINGS)
    out = {r.external_id: r for r in identity.resolve_many(df, players, held).collect()}
    assert (out["1"].player_id, out["1"].method) == ("p1", "fuzzy")
    assert out["2"].player_id == "p3"  # 0.97 against 0.94
    assert out["3"].method != "exact_name"  # the mapped namesake counts
    # the bound loses no close pair
    rng = np.random.default_rng(1)
    some = ["".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(150)] + ["josh", "joshua", "geoffrey swaim", "jeoffrey swaim"]
    pairs = spark.createDataFrame([(a, b, names.jaro_winkler_of(a, b)) for a in some for b in some], "a string, b string, sim double")
    assert pairs.where(F.col("sim") >= 0.92).where(~closeness.may_be_close(F.col("a"), F.col("b"), 0.92)).isEmpty()
    # birth date and college
    more = players.withColumn("birth_date", F.lit("1988-02-07")).withColumn("college", F.lit("Georgia"))
    for birth, college, reason in (("1990-01-01", None, "fuzzy_eliminated"), (None, "Ohio State", "fuzzy_eliminated"), ("1988-02-07", "georgia bulldogs", "pending")):
        row = df.where("external_id = 1").withColumn("birth_date", F.lit(birth)).withColumn("college", F.lit(college))
        assert identity.resolve_many(row, more, None).head().reason == reason


def test_queries_leave_no_player_out(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    scored = {r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey").distinct().collect()}
    found = entry.queries()
    added = {r.add for r in found["q_add_drop"](spark, sf).collect()}
    assert added == {p for p in scored if p % 50}
    suppliers = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey").distinct().count()
    assert found["q_copula"](spark, sf).count() == suppliers
    lines = {r.team: r.points for r in found["q_lineup_topn"](spark, sf).where("place = 1").collect()}
    assert len(lines) == 3


def test_tiers_find_separated_groups():
    x = np.concatenate([np.full(10, 100.0) + np.arange(10) * 0.1, np.full(10, 50.0) + np.arange(10) * 0.1, np.full(10, 10.0) + np.arange(10) * 0.1])
    t = valuation.mixture_tiers(x)
    assert set(t[:10]).isdisjoint(t[10:20]) and set(t[10:20]).isdisjoint(t[20:]) and t[0] < t[15] < t[25]


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, v string")
    with pytest.raises(rel.ContractError):
        rel.checked(df, ["absent"])
    with pytest.raises(rel.ContractError):
        rel.checked(df, key="k")
    with pytest.raises(rel.ContractError):
        rel.checked(df, floor=4)
    kept, dropped = rel.accounted(df, F.col("v") == "a")
    assert (kept.count(), dropped.count()) == (1, 2)
    ids = spark.createDataFrame([(4046.0,), (None,)], "x double").select(rel.integral_text(F.col("x"))).collect()
    assert [r[0] for r in ids] == ["4046", None]
    with pytest.raises(Exception, match="whole number"):
        spark.createDataFrame([(1.5,)], "x double").select(rel.integral_text(F.col("x"))).collect()
    times = spark.createDataFrame([("2026-09-09", "20:20"), ("2025-11-06", "20:15"), ("2025-11-02", "01:30")], "d string, t string")
    got = [str(r[0]) for r in times.select(rel.kickoff_utc(F.col("d"), F.col("t")).cast("string")).collect()]
    assert got == ["2026-09-10 00:20:00", "2025-11-07 01:15:00", "2025-11-02 05:30:00"]
    with pytest.raises(Exception, match="does not exist"):
        spark.createDataFrame([("2025-03-09", "02:30")], "d string, t string").select(rel.kickoff_utc(F.col("d"), F.col("t"))).collect()


def test_merge_and_as_of(spark):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (None, "n", "x")], "k int, v string, w string")
    s = spark.createDataFrame([(2, "B", "y"), (3, "c", "y"), (None, "m", "y")], "k int, v string, w string")
    assert {tuple(r) for r in rel.merge(t, s, ["k"]).collect()} == {(1, "a", "x"), (None, "n", "x"), (2, "B", "y"), (3, "c", "y"), (None, "m", "y")}
    assert {tuple(r) for r in rel.merge(t, s, ["k"], ["v"]).collect()} == {(1, "a", "x"), (None, "n", "x"), (2, "B", "x"), (3, "c", "y"), (None, "m", "y")}
    left = spark.createDataFrame([("p", 5), ("p", 1), ("q", 5)], "k string, t int")
    right = spark.createDataFrame([("p", 2, 20), ("p", 5, 50), ("p", 9, 90)], "k string, t2 int, v int")
    got = {(r.k, r.t): r.asof_v for r in rel.as_of(left, right, ["k"], "t", "t2", ["v"]).collect()}
    assert got == {("p", 5): 50, ("p", 1): None, ("q", 5): None}


PLAYERS = [
    ("p1", "00-1", "Patrick Mahomes", "QB", "KC"), ("p2", "00-2", "Lamar Jackson", "QB", "BAL"), ("p3", "00-3", "Jaylen Waddle", "WR", "MIA"),
    ("p4", None, "Jaylon Waddle", "WR", "MIA"), ("p5", "00-5", "Marvin Harrison", "WR", "ARI"), ("p6", None, "Marvin Harrison", "WR", "IND"), ("p7", "00-7", "Kansas City Chiefs", "DST", "KC"),
]


def test_identity_ladder(spark):
    ship(spark)
    players = spark.createDataFrame(PLAYERS, "player_id string, gsis_id string, name string, position string, team string")
    inputs = spark.createDataFrame(
        [
            ("s", "1", "Patrick Mahomes II", "QB", "KC", None),
            ("s", "2", "Lamarr Jackson", "QB", "BAL", None),
            ("s", "3", "Jaylin Waddle", "WR", "DEN", None),
            ("s", "4", "Marvin Harrison Jr.", "WR", None, None),
            ("s", "5", "whoever", "QB", None, "00-5"),
            ("s", "6", "Chiefs D/ST", "D/ST", None, None),
            ("s", "7", "Nobody Nowhere", "QB", "FA", None),
            ("s", "8", None, "QB", None, None),
            ("s", "9", "Someone", "CB", None, None),
        ],
        "source string, external_id string, raw_name string, raw_position string, raw_team string, gsis_id string",
    )
    out = {r.external_id: r for r in identity.resolve_many(inputs, players, None).collect()}
    assert (out["1"].player_id, out["1"].method, out["1"].confidence) == ("p1", "exact_name", 0.95)
    assert (out["2"].player_id, out["2"].method, out["2"].confidence) == ("p2", "fuzzy", 0.89)
    assert (out["3"].player_id, out["3"].reason) == (None, "fuzzy_tie")
    assert (out["5"].player_id, out["5"].method, out["5"].confidence) == ("p5", "gsis", 1.0)
    # a namesake is taken by a fact: being the only one left is no evidence
    assert (out["4"].player_id, out["4"].method, out["4"].reason) == (None, "unmatched", "homonym_blocked_by_existing_mapping")
    assert (out["6"].player_id, out["6"].method) == ("p7", "exact_name")
    assert {out[k].method for k in "789"} == {"unmatched"}
    assert out["8"].reason == out["9"].reason == "no_name_or_position"
    counts = {r.outcome: r.n for r in identity.outcome_counts(spark.createDataFrame(list(out.values()))).collect()}
    assert counts == {"exact_name": 2, "fuzzy_pending": 1, "gsis": 1, "unmatched": 5}


def test_identity_ladder_teams_and_evidence(spark):
    ship(spark)
    players = [("a", None, "Chris Jones", "QB", "JAX", "1990-01-01", "Ohio State"), ("b", None, "Chris Jones", "QB", "LA", None, None), ("c", "00-9", "Christian McCaffrey", "RB", "SF", "1996-06-07", "Stanford")]
    players = spark.createDataFrame(players, "player_id string, gsis_id string, name string, position string, team string, birth_date string, college string")
    kind = "source string, external_id string, raw_name string, raw_position string, raw_team string, gsis_id string, birth_date string, college string"
    rows = [
        ("s", "1", "Chris Jones", "QB", "JAC", None, None, None),  # another spelling of the team
        ("t", "2", "Kristian McCaffrey", "RB", "FA", None, None, None),  # no team, another first letter
        ("u", "3", "Kristian McCaffrey", "RB", None, None, "1990-01-01", None),  # another birth date
        ("gsis", "00-9", "whoever", "RB", None, None, None, None),
        ("v", "5", "Chris Jones", "QB", None, None, None, None),  # two namesakes
    ]
    out = {r.external_id: r for r in identity.resolve_many(spark.createDataFrame(rows, kind), players, None).collect()}
    assert (out["1"].player_id, out["1"].confidence) == ("a", 0.95)
    assert (out["2"].player_id, out["2"].method, out["2"].reason) == ("c", "fuzzy", "pending")
    assert (out["3"].player_id, out["3"].reason) == (None, "fuzzy_eliminated")
    assert (out["00-9"].player_id, out["00-9"].method) == ("c", "gsis")
    assert (out["5"].player_id, out["5"].reason) == (None, "fuzzy_tie")
    held = spark.createDataFrame([("s", "old", "b", "exact_name", 0.95, False)], identity.MAPPINGS)
    row = spark.createDataFrame([("s", "9", "Chris Jones", "QB", None, None, None, None)], kind)
    assert identity.resolve_many(row, players, held).head().reason == "homonym_blocked_by_existing_mapping"


def test_id_file_and_review(spark):
    players = spark.createDataFrame(PLAYERS, "player_id string, gsis_id string, name string, position string, team string")
    rows = spark.createDataFrame([(1, "00-1", "a1", "b1"), (2, "00-2", "a2", None), (3, "00-3", "a3", "dup"), (4, "00-5", None, "dup")], "row_no int, gsis_id string, a string, b string")
    start = spark.createDataFrame([("A", "old", "p2", "fuzzy", 0.89, False), ("A", "a1", "p1", "exact_name", 0.95, False)], identity.MAPPINGS)
    mappings, report = identity.apply_id_file(rows, players, start, {"a": "A", "b": "B"})
    mappings = spark.createDataFrame(mappings.collect(), identity.MAPPINGS)  # a snapshot, as the state table keeps it
    assert {(r.source, r.external_id): (r.player_id, r.method) for r in mappings.collect()} == {
        ("A", "a1"): ("p1", "dynastyprocess"), ("A", "a2"): ("p2", "dynastyprocess"), ("A", "a3"): ("p3", "dynastyprocess"), ("B", "b1"): ("p1", "dynastyprocess"),
    }
    assert {r.outcome: r.n for r in report.collect()} == {"inserted": 3, "updated": 1, "ambiguous": 2}
    again, report = identity.apply_id_file(rows, players, mappings, {"a": "A", "b": "B"})
    assert {r.outcome: r.n for r in report.collect()} == {"unchanged": 4, "ambiguous": 2}
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in mappings.collect()} and identity.broken_invariants(mappings).isEmpty()
    manual = spark.createDataFrame([("A", "a1", "p6", "manual", 1.0, True)], identity.MAPPINGS)
    with pytest.raises(rel.ContractError):
        identity.apply_id_file(rows, players, manual, {"a": "A", "b": "B"})
    gone = identity.review(mappings, "A", "a3", "reject")
    assert gone.where(identity.is_live()).count() == 3 and identity.is_usable() is not None
    assert identity.review(start, "A", "old", "verify").where(identity.is_usable()).count() == 2
    moved, orphans = identity.merge_placeholder(mappings, "p3", "p1")
    assert orphans.count() == 1 and moved.where("player_id = 'p3'").count() == 0


def test_review_queue(spark):
    q = spark.createDataFrame([("1", "x", "resolved"), ("2", "y", "resolved"), ("3", None, "resolved")], "id string, raw string, status string")
    s = spark.createDataFrame([("1", "x"), ("2", "Y"), ("3", None), ("4", "new")], "id string, raw string")
    got = {r.id: (r.raw, r.status) for r in identity.refresh_queue(q, s, ["id"], ["raw"]).collect()}
    assert got == {"1": ("x", "resolved"), "2": ("Y", "open"), "3": (None, "resolved"), "4": ("new", "open")}


def test_platform(spark):
    raw = spark.createDataFrame(
        [("1", "L", "2025", ["QB", "DEF", "FLEX", "BN", "IR"], {"rec": 0.5}, (2, 2, 100, 0))], platform.LEAGUE
    )
    row = platform.map_league(raw).head()
    assert (row.type, row.budget, row.format, row.slots) == ("redraft", 100, "half", ["QB", "DST", "FLEX"])
    rosters = spark.createDataFrame([(1, "o", ["7", "0"], ["7", "8", "9"], ["9"], None)], platform.ROSTER)
    assert [tuple(r) for r in platform.starters(rosters, F.array(F.lit("QB"), F.lit("DST"))).collect()] == [(1, 0, "QB", "7"), (1, 1, "DST", None)]
    assert {(r.player_id, r.seat) for r in platform.roster_rows(rosters, 0).collect()} == {("7", "starter"), ("8", "BENCH"), ("9", "IR")}
    games = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "roster_id int, matchup_id int")
    assert {tuple(r) for r in platform.pair_matchups(games).collect()} == {(5, 1, 2), (6, 3, None)}
    blob = spark.createDataFrame([(json.dumps({"1": {"n": "a"}, "KC": {"n": None}}),)], "body string")
    assert {(r.player_id, r.fields["n"]) for r in platform.player_blob(blob).collect()} == {("1", "a"), ("KC", None)}


def test_lake(spark, tmp_path):
    root, now = str(tmp_path / "lake"), datetime(2026, 8, 16, 23, 30, tzinfo=UTC)
    body = lambda n: json.dumps(n).encode()
    cols = lake.CONTRACTS["stadiums"]
    parse = lambda s, b: s.createDataFrame([tuple(f"{c}{k}" for c in cols) for k in range(json.loads(b))], list(cols))
    job = lake.Job("src", "stadiums", url="u", parse=parse)
    answers = [(200, {"ETag": "t1"}, body(3)), (304, {}, b""), (404, {}, b""), (200, {"ETag": "t2"}, body(0))]
    seen = []

    def get(url, headers):
        seen.append(headers)
        return answers[len(seen) - 1]

    got = [lake.run_job(spark, root, job, get, now)["status"] for _ in range(4)]
    assert got == ["success", "skipped_not_modified", "failed", "failed"]
    assert seen[1] == {"If-None-Match": "t1"} and seen[3] == {"If-None-Match": "t1"}
    with pytest.raises(lake.PartitionExists):
        lake.land(spark.range(1), root, "src", "stadiums", {"scrape_date": "2026-08-16"})
    lake.land(spark.range(5), root, "src", "stadiums", {"scrape_date": "2026-08-17"})
    assert lake.latest(spark, root, "src", "stadiums").endswith("scrape_date=2026-08-17")
    for s, d in ((2024, "2026-01-02"), (2025, "2026-01-01")):
        lake.land(spark.range(s), root, "src", "pbp", {"season": s, "scrape_date": d})
    assert lake.connect(spark, root, {"pbp": "src", "stadiums": "src", "games": "src"}, season=2024) == ["pbp", "stadiums"]
    assert spark.sql("select count(*), max(season) from pbp").head() == (2024, 2024)
    with lake.Lock(str(tmp_path), "k"), pytest.raises(FileExistsError), lake.Lock(str(tmp_path), "k"):
        pass
    state = lake.State(spark, str(tmp_path / "state"))
    state.commit({"a": spark.range(2)})
    state.commit({"b": spark.range(3), "a": state.read("a").union(spark.range(1))})
    assert (state.read("a").count(), state.read("b").count()) == (3, 3)
    slow = lake.State(spark, str(tmp_path / "state"))
    slow._newest = lambda seen=slow._newest(): seen  # read before another writer commits
    state.commit({"b": spark.range(1)})
    with pytest.raises(lake.StateChanged):
        slow.commit({"a": spark.range(9)})
    assert (state.read("a").count(), state.read("b").count()) == (3, 1)


def test_stream_batches_are_written_and_the_newest_row_counts(spark, tmp_path):
    for v in ([("a", 1), ("b", 2)], [("a", 5)], []):
        spark.createDataFrame(v, "u string, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u string, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sums = stream.groupBy("u").agg(F.sum("v").alias("s"))
    for mode in ("update", "complete"):
        assert sorted(map(tuple, events.finished(sums, ["u"], mode).collect())) == [("a", 6), ("b", 2)]
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema("u string, v int").parquet(str(tmp_path / "none")).groupBy("u").count()
    assert events.finished(none, ["u"], "update").collect() == []


def test_fetch_retries():
    waits, answers = [], iter([(503, {}, b""), (429, {"Retry-After": "7"}, b""), (200, {}, b"x")])
    got = lake.fetch(lambda u, h: next(answers), "u", sleep=waits.append)
    assert got.body == b"x" and waits == [1.0, 7.0]
    with pytest.raises(ConnectionError):
        lake.fetch(lambda u, h: (429, {"Retry-After": "500"}, b""), "u", sleep=waits.append)
    assert lake.retry_after("junk", 0) is None


def test_csv_text_ids(spark, tmp_path):
    f = tmp_path / "ids.csv"
    f.write_text('﻿id,name\n007,"a"\nNA,""\n', encoding="utf-8")
    assert [tuple(r) for r in lake.read_text_ids(spark, str(f)).collect()] == [("007", "a"), (None, None)]


def test_features_and_season(spark):
    ship(spark)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([10, 20, 30, 40])], "k string, t int, v double")
    got = [r.blend for r in features.recency_blend(df, ["k"], "t", "v").orderBy("t").collect()]
    w = [0.5 ** (i / 4) for i in (3, 2, 1)]
    assert got[0] is None and got[3] == pytest.approx((10 * w[0] + 20 * w[1] + 30 * w[2]) / sum(w))
    weeks = spark.createDataFrame([("x", 1, 10), ("y", 1, 5), ("z", 1, 5), ("x", 2, 1), ("y", 2, 2)], "team string, wk int, pts int")
    assert {tuple(r) for r in season.all_play(weeks, "team", "wk", "pts").collect()} == {("x", 2, 0, 3), ("y", 1, 1, 3), ("z", 0, 1, 2)}
    teams = spark.createDataFrame([(k, 100.0 + 5 * k, 15.0) for k in range(6)], "team long, mean double, sd double")
    a = {tuple(r) for r in season.monte_carlo(teams, 200, 50, 6, 4).collect()}
    b = {tuple(r) for r in season.monte_carlo(teams.repartition(3), 200, 50, 6, 4).collect()}
    assert a == b and sum(r[1] for r in a) == pytest.approx(4) and sum(r[3] for r in a) == pytest.approx(1)


def test_blend_of_a_long_history(spark):
    n, half = 9000, 4.0
    df = spark.range(n).select(F.lit("k").alias("k"), "id", (F.col("id") % 17).cast("double").alias("v"))
    got = [r.blend for r in features.recency_blend(df, ["k"], "id", "v", half).orderBy("id").collect()]
    assert got[0] is None
    for k in (1, 2, 255, 256, 257, 511, 512, 513, 4000, 8999):
        w = [2.0 ** ((j - k) / half) for j in range(max(0, k - 600), k)]
        v = [j % 17 for j in range(max(0, k - 600), k)]
        assert got[k] == pytest.approx(sum(a * b for a, b in zip(w, v)) / sum(w), rel=1e-12)


def test_draft_draws_follow_the_weights_of_each_slot():
    adp, sd = np.array([1.0, 2.0, 3.0, 8.0]), np.array([1.0, 1.0, 2.0, 3.0])
    gone = valuation._drawn(adp, sd, range(2, 4), 40_000, np.random.default_rng(1))
    assert (gone[:, 0] != gone[:, 1]).all()
    w = [np.exp(-(((slot - adp) / sd) ** 2) / 2) for slot in (2, 3)]
    first = w[0] / w[0].sum()
    assert np.bincount(gone[:, 0], minlength=4) / len(gone) == pytest.approx(first, abs=0.01)
    second = sum(first[i] * np.where(np.arange(4) == i, 0, w[1]) / (w[1].sum() - w[1][i]) for i in range(4))
    assert np.bincount(gone[:, 1], minlength=4) / len(gone) == pytest.approx(second, abs=0.01)
    every = valuation._drawn(adp, sd, range(2, 6), 50, np.random.default_rng(2))
    assert (np.sort(every, axis=1) == np.arange(4)).all()
    left = valuation._best_left(np.array([9.0, 7.0, 8.0, 1.0]), np.array([0, 2]), np.array([[0, 1], [1, 3], [0, 2]]))
    assert left.tolist() == [8.0, 9.0, 0.0]


def test_scarce_positions_are_worth_more_than_points(spark):
    """The best back is worth more than a better receiver where backs run out first."""
    ship(spark)
    rows = [(k, "WR", 291.0 - 2 * k, 1.0 + 2 * k) for k in range(40)] + [(100 + k, "RB", 274.0 - 7 * k, 2.0 + 2 * k) for k in range(40)]
    board = spark.createDataFrame([(*r, 4.0) for r in rows], "player long, position string, points double, adp double, adp_sd double")
    got = {r.player: r.vona for r in valuation.next_available(board, 2000, 20).collect()}
    assert got[100] > got[0] > 0


def test_round_robin_and_given_schedule(spark):
    for n in (2, 5, 8, 12):
        games = season.round_robin(n, n - 1 + n % 2)
        pairs = [frozenset(g) for week in games.tolist() for g in week]
        assert len(pairs) == len(set(pairs)) == n * (n - 1) // 2
        assert all(len({t for g in week for t in g}) == 2 * len(week) for week in games.tolist())
    ship(spark)
    teams = spark.createDataFrame([(k, 100.0 + 50 * k, 1.0) for k in range(4)], "team long, mean double, sd double")
    only = spark.createDataFrame([(0, 3, 0), (0, 2, 1), (1, 0, 3)], "week int, home long, away long")
    got = {r.team: r for r in season.monte_carlo(teams, 20, 10, 2, 2, only, rho=0.5).collect()}
    assert got[3].title == 1.0 and got[3].playoffs == got[2].playoffs == 1.0 and got[0].playoffs == 0.0


def test_registry_of_queries(spark):
    import __spark_entry__ as entry

    names_ = entry.queries()
    assert "q_vorp" in names_ and set(entry.oracle_sql()) <= set(names_)
    assert entry.entry(spark).count() > 0


def test_nothing_imports_the_corpus_package():
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for f in (root / "fieldwright").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b|corpus_pipeline", f.read_text()), f
