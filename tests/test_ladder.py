"""The ladder as a write: rungs, slots, evictions, tombstones and the queue, in one state."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fieldwright.functions.workers import ship
from fieldwright.operators import identity, ladder
from fieldwright.operators.relational import ContractError
from fieldwright.sources import lake

PLAYER = "player_id string, gsis_id string, name string, position string, team string, birth_date string, college string"
PEOPLE = [
    ("mahomes", "00-0033873", "Patrick Mahomes", "QB", "KC", "1995-09-17", "Texas Tech"),
    ("chase", "00-0036900", "Ja'Marr Chase", "WR", "CIN", "2000-03-01", "LSU"),
    ("moore", "00-0034827", "DJ Moore", "WR", "BUF", "1997-04-14", "Maryland"),
    ("walker", "00-0038134", "Kenneth Walker III", "RB", "KC", "2000-10-20", "Michigan State; Wake Forest"),
    ("harrison jr", "00-0039849", "Marvin Harrison Jr.", "WR", "ARI", "2002-08-11", "Ohio State"),
    ("harrison sr", "00-0007024", "Marvin Harrison", "WR", "IND", "1972-08-25", "Syracuse"),
    ("lamar", "00-0034796", "Lamar Jackson", "QB", "BAL", "1997-01-07", "Louisville"),
    ("allen", "00-0034857", "Josh Allen", "QB", "BUF", "1996-05-21", "Wyoming; Reedley"),
    ("waddle", "00-0036613", "Jaylen Waddle", "WR", "DEN", "1998-11-25", "Alabama"),
    ("kc dst", None, "Kansas City Chiefs", "DST", "KC", None, None),
]
INPUT = "source string, external_id string, raw_name string, raw_position string, raw_team string, gsis_id string, birth_date string, college string"
MON, TUE = datetime(2026, 9, 7), datetime(2026, 9, 8)


def given(source, external_id, name=None, position=None, team=None, gsis=None, birth=None, college=None):
    return source, external_id, name, position, team, gsis, birth, college


class Desk:
    """A state of mappings and queue, and batches run against it."""

    def __init__(self, spark, root, people=PEOPLE, mappings=(), queue=()):
        ship(spark)
        self.spark, self.state = spark, lake.State(spark, str(root))
        self.players = spark.createDataFrame(list(people), PLAYER)
        self.state.commit({"mappings": spark.createDataFrame(list(mappings), identity.MAPPINGS), "queue": spark.createDataFrame(list(queue), ladder.QUEUE)})

    def run(self, rows, now=MON):
        got = ladder.commit_batch(self.state, self.spark.createDataFrame(rows, INPUT), self.players, now)
        return {(r.source, r.external_id): r for r in got.collect()}

    def ids(self):
        return {(r.source, r.external_id): r for r in self.state.read("mappings").collect()}

    def queue(self):
        return {(r.source, r.external_id): r for r in self.state.read("queue").collect()}


def test_rungs_and_second_run(spark, tmp_path):
    desk = Desk(spark, tmp_path)
    rows = [
        given("s", "4046", "Patrick Mahomes II", "QB", "KC"),
        given("s", "7564", "Ja'Marr Chase", "WR", "CIN"),
        given("s", "4881", "Lamarr Jackson", "QB", "BAL"),
        given("s", "99999", "Nobody Nowhere", "QB", "FA"),
        given("gsis", "00-0038134"),
        given("den", "4046", "Patrick Mahomes", "QB", "DEN"),  # another team: a pending guess
        given("yahoo", "40893", "Marvin Harrison Jr.", "WR"),  # two namesakes, no team
        given("ari", "11628", "Marvin Harrison Jr.", "WR", "ARI"),
        given("pfr", "HarrMa00", "Marvin Harrison", "WR", "IND"),
        given("s", "KC", "Kansas City Chiefs", "DEF", "KC"),
        given("espn", "-16012", "Chiefs D/ST", "D/ST"),
        given("y", "100012", None, "DEF", "KC"),
        given("z", "KC", None, "DEF"),  # the id itself names the team
        given("s", "424242"),
        given("x", "X1", "Kenneth Walker", None, None, "00-0038134"),
        given("x", "X2", "Kenneth Walker"),
        given("old", "4881", "Lamarr Jackson", "QB", "BAL", birth="1994-01-01"),
        given("school", "4881", "Lamarr Jackson", "QB", "BAL", college="Ohio State"),
        given("b", "A1", "Josh Allen", "QB", "BUF"),  # a name beside a fact of the same player
        given("b", "B1", "Joshua Allen", "QB", "BUF", "00-0034857"),
        given("f", "EXACT", "Lamar Jackson", "QB", "BAL"),
        given("f", "AFUZZY", "Lamarr Jackson", "QB", "BAL"),
    ]
    got = desk.run(rows)
    said = {k: (r.player_id or r.guess, r.method, r.outcome, r.reason) for k, r in got.items()}
    assert said == {
        ("s", "4046"): ("mahomes", "exact_name", "resolved", None),
        ("s", "7564"): ("chase", "exact_name", "resolved", None),
        ("s", "4881"): ("lamar", "fuzzy", "pending_review", None),
        ("s", "99999"): (None, "unmatched", "unmatched", "no_candidate"),
        ("gsis", "00-0038134"): ("walker", "gsis", "resolved", None),
        ("den", "4046"): ("mahomes", "fuzzy", "pending_review", None),
        ("yahoo", "40893"): (None, "unmatched", "unmatched", "fuzzy_tie"),
        ("ari", "11628"): ("harrison jr", "exact_name", "resolved", None),
        ("pfr", "HarrMa00"): ("harrison sr", "exact_name", "resolved", None),
        ("s", "KC"): ("kc dst", "exact_name", "resolved", None),
        ("espn", "-16012"): ("kc dst", "exact_name", "resolved", None),
        ("y", "100012"): ("kc dst", "exact_name", "resolved", None),
        ("z", "KC"): ("kc dst", "exact_name", "resolved", None),
        ("s", "424242"): (None, "unmatched", "unmatched", "no_name_or_position"),
        ("x", "X1"): ("walker", "gsis", "resolved", None),
        ("x", "X2"): (None, "unmatched", "unmatched", "no_name_or_position"),
        ("old", "4881"): (None, "unmatched", "unmatched", "fuzzy_eliminated"),
        ("school", "4881"): (None, "unmatched", "unmatched", "fuzzy_eliminated"),
        ("b", "A1"): (None, "unmatched", "unmatched", "no_candidate"),
        ("b", "B1"): ("allen", "gsis", "resolved", None),
        ("f", "EXACT"): ("lamar", "exact_name", "resolved", None),
        ("f", "AFUZZY"): (None, "unmatched", "unmatched", "no_candidate"),
    }
    assert got["s", "4881"].player_id is None and got["s", "4881"].confidence == pytest.approx(0.89)
    ids, queue = desk.ids(), desk.queue()
    assert ("gsis", "00-0038134") not in ids and ids["x", "X1"].confidence == 1.0
    assert set(ids) == {k for k, v in said.items() if v[0]} - {("gsis", "00-0038134")}
    assert set(queue) == {k for k, v in said.items() if v[2] == "unmatched"}
    assert all(not r.resolved and r.first_seen == r.last_seen == MON for r in queue.values())
    again = desk.run(rows, TUE)
    assert desk.ids() == ids
    assert {k: (r.player_id, r.guess, r.outcome) for k, r in again.items()} == {k: (r.player_id, r.guess, r.outcome) for k, r in got.items()}
    later = desk.queue()
    assert all(r.first_seen == MON and r.last_seen == TUE and not r.resolved and r[:6] == queue[k][:6] for k, r in later.items()) and set(later) == set(queue)
    five = [k for k in got if k in (("s", "4046"), ("s", "7564"), ("s", "4881"), ("s", "99999"), ("gsis", "00-0038134"))]
    some = desk.state.read("results").where(F.concat("source", "external_id").isin([a + b for a, b in five]))
    assert {r.outcome: r.n for r in ladder.counts(some).collect()} == {"exact_name": 2, "gsis": 1, "fuzzy_pending": 1, "unmatched": 1}
    # a person verifies the guess: now it is the answer
    desk.state.commit({"mappings": identity.review(desk.state.read("mappings"), "s", "4881", "verify")})
    row = desk.run([given("s", "4881", "Lamarr Jackson", "QB", "BAL")], TUE)["s", "4881"]
    assert (row.player_id, row.guess, row.method, row.outcome) == ("lamar", None, "fuzzy", "resolved")


def test_facts_against_what_is_stored(spark, tmp_path):
    mahomes, chase = "00-0033873", "00-0036900"
    stored = [
        ("same", "1", "mahomes", "exact_name", 0.95, False),
        ("conflict", "E1", "mahomes", "exact_name", 0.95, False),
        ("conflict", "E2", "chase", "dynastyprocess", 1.0, False),
        ("verified", "1", "chase", "fuzzy", 0.89, True),
        ("manual", "1", "chase", "manual", 1.0, True),
        ("agree", "1", "mahomes", "manual", 1.0, True),
        ("displace", "GUESS", "mahomes", "exact_name", 0.95, False),
        ("file", "HOLDER", "mahomes", "dynastyprocess", 1.0, False),
        ("hand", "HOLDER", "mahomes", "manual", 1.0, False),
        ("checked", "HOLDER", "mahomes", "fuzzy", 0.89, True),
        ("move", "E1", "mahomes", "exact_name", 0.95, False),
        ("move", "E2", "chase", "fuzzy", 0.89, False),
        ("swap", "E1", "mahomes", "exact_name", 0.95, False),
        ("swap", "E2", "chase", "exact_name", 0.95, False),
        ("tomb", "1", "mahomes", "rejected", 0.0, False),
        ("freed", "WRONG", "mahomes", "rejected", 0.0, False),
        ("homonym", "11628", "harrison jr", "dynastyprocess", 1.0, False),
    ]
    queue = [("displace", "GUESS", "Pat Mahomes", "QB", "KC", "no_candidate", MON, MON, True), ("gsis", mahomes, None, None, None, "no_candidate", MON, MON, False), ("late", "9", "Pat", "QB", None, "no_candidate", MON, MON, False)]
    desk = Desk(spark, tmp_path, mappings=stored, queue=queue)
    got = desk.run(
        [
            given("same", "1", gsis=mahomes),
            given("conflict", "E1", gsis=chase),
            given("verified", "1", gsis=mahomes),
            given("manual", "1", gsis=mahomes),
            given("agree", "1", gsis=mahomes),
            *(given(s, "4046", "Patrick Mahomes", "QB", "KC", mahomes) for s in ("displace", "file", "hand", "checked", "late2")),
            given("late2", "4047", "Pat", "QB", "KC", mahomes),  # a second fact for the slot
            given("move", "E1", gsis=chase),
            given("swap", "E1", gsis=chase),
            given("swap", "E2", gsis=mahomes),
            given("tomb", "1", "Patrick Mahomes", "QB", "KC", mahomes),
            given("freed", "4046", "Patrick Mahomes", "QB", "KC"),
            given("homonym", "MH-2", "Marvin Harrison", "WR"),
            given("homonym", "MH-3", "Marvin Harrison", "WR", "IND"),
            given("gsis", mahomes),
            given("late", "9", "Patrick Mahomes", "QB", "KC"),
        ],
        TUE,
    )
    said = {k: (r.player_id, r.method, r.reason) for k, r in got.items()}
    none = (None, "unmatched")
    assert said == {
        ("same", "1"): ("mahomes", "gsis", None),
        ("conflict", "E1"): (*none, "upgrade_conflict"),
        ("verified", "1"): ("chase", "fuzzy", "human_decision_conflict"),
        ("manual", "1"): ("chase", "manual", "human_decision_conflict"),
        ("agree", "1"): ("mahomes", "manual", None),
        ("displace", "4046"): ("mahomes", "gsis", None),
        ("file", "4046"): (*none, "duplicate_for_source"),
        ("hand", "4046"): (*none, "duplicate_for_source"),
        ("checked", "4046"): (*none, "duplicate_for_source"),
        ("late2", "4046"): ("mahomes", "gsis", None),
        ("late2", "4047"): (*none, "duplicate_for_source"),
        ("move", "E1"): ("chase", "gsis", None),
        ("swap", "E1"): ("chase", "gsis", None),
        ("swap", "E2"): ("mahomes", "gsis", None),
        ("tomb", "1"): (*none, "rejected"),
        ("freed", "4046"): ("mahomes", "exact_name", None),
        ("homonym", "MH-2"): (*none, "homonym_blocked_by_existing_mapping"),
        ("homonym", "MH-3"): ("harrison sr", "exact_name", None),
        ("gsis", mahomes): ("mahomes", "gsis", None),
        ("late", "9"): ("mahomes", "exact_name", None),
    }
    ids, queue = desk.ids(), desk.queue()
    assert ids["conflict", "E1"].player_id == "mahomes" and ids["verified", "1"].verified and ids["tomb", "1"].method == "rejected"
    assert {("displace", "GUESS"), ("move", "E2"), ("gsis", mahomes)}.isdisjoint(ids) and ids["swap", "E2"].player_id == "mahomes"
    waiting = {k for k, r in queue.items() if not r.resolved}
    assert waiting == {k for k, r in got.items() if r.reason} | {("displace", "GUESS"), ("move", "E2")}
    assert queue["displace", "GUESS"][2:6] == ("Pat Mahomes", "QB", "KC", "displaced")  # what was known of it stays
    assert queue["gsis", mahomes].resolved and queue["late", "9"].resolved and queue["late", "9"].raw_name == "Pat"
    assert identity.broken_invariants(desk.state.read("mappings")).isEmpty()
    # the same batch again: nothing moves but last_seen
    before, seen = desk.ids(), {k: (r[:6], r.resolved) for k, r in queue.items()}
    desk.run([given("conflict", "E1", gsis=chase), given("swap", "E1", gsis=chase), given("displace", "4046", gsis=mahomes)], TUE)
    assert desk.ids() == before and {k: (r[:6], r.resolved) for k, r in desk.queue().items()} == seen


def test_evidence_breaks_or_keeps_ties(spark, tmp_path):
    fake = [*PEOPLE, ("fake", "F-1", "Jaylon Waddle", "WR", "DEN", None, None), ("fake dj", "F-2", "DJ Moor", "WR", "BUF", None, None)]
    rows = [
        given("tie", "7526", "Jaylin Waddle", "WR", "DEN"),
        given("born", "7526", "Jaylin Waddle", "WR", "DEN", birth="1998-11-25"),
        given("school", "7526", "Jaylin Waddle", "WR", "DEN", college="Alabama"),
        given("blank", "7526", "Jaylin Waddle", "WR", "DEN", college="   "),
        given("espn", "3915416", "D.J. Moore", "WR", "BUF"),
    ]
    got = Desk(spark, tmp_path / "a", fake).run(rows)
    assert {k[0]: (r.guess, r.reason) for k, r in got.items() if k[0] != "espn"} == {"tie": (None, "fuzzy_tie"), "born": ("waddle", None), "school": (None, "fuzzy_tie"), "blank": (None, "fuzzy_tie")}
    assert (got["espn", "3915416"].player_id, got["espn", "3915416"].method) == ("moore", "exact_name")
    other = [*PEOPLE, ("fake", "F-1", "Jaylin Waddel", "WR", "DEN", None, None), ("fake mh", "F-3", "Marvon Harrison", "WR", "ARI", None, None)]
    got = Desk(spark, tmp_path / "b", other).run([given("s", "7526", "Jaylin Waddle", "WR", "DEN", college="Alabama"), given("t", "11628", "Marvin Harrisom", "WR", college="Ohio St.")])
    assert got["s", "7526"].guess == "fake"  # an unknown school is no evidence against the better name
    assert got["t", "11628"].guess == "harrison jr"


def test_queue_reopens_only_when_described_anew(spark):
    def after(queue, seen, mapped=()):
        q = spark.createDataFrame(queue, ladder.QUEUE)
        s = spark.createDataFrame(seen, "source string, external_id string, raw_name string, raw_position string, raw_team string, reason string, carried boolean")
        m = spark.createDataFrame(list(mapped), "source string, external_id string")
        return {r.external_id: r for r in ladder.queue_after(q, s, m, TUE).collect()}

    queue = [("s", "a", "Foo", None, None, "x", MON, MON, True), ("s", "b", "Foo", None, None, "x", MON, MON, True), ("s", "c", "Foo", None, None, "x", MON, MON, False), ("s", "d", "Foo", None, None, "x", MON, MON, True)]
    got = after(queue, [("s", "a", "Foo", None, None, "y", False), ("s", "b", "Foo", None, "KC", "y", False), ("s", "d", None, None, None, "displaced", True), ("s", "e", "New", None, None, "y", False)], [("s", "c"), ("s", "nothing")])
    assert {k: (r.raw_name, r.raw_team, r.resolved, r.first_seen, r.last_seen) for k, r in got.items()} == {
        "a": ("Foo", None, True, MON, TUE),
        "b": ("Foo", "KC", False, MON, TUE),
        "c": ("Foo", None, True, MON, MON),
        "d": ("Foo", None, False, MON, TUE),
        "e": ("New", None, False, TUE, TUE),
    }


def test_persist_refuses_rejected_pairs_and_corrects_others(spark):
    held = spark.createDataFrame([("s", "X", "mahomes", "rejected", 0.0, False), ("s", "H", "lamar", "exact_name", 0.95, False), ("s", "M", "allen", "manual", 1.0, True)], identity.MAPPINGS)
    kind = "source string, external_id string, player_id string, method string, confidence double"

    def put(*rows):
        after, ruled, evicted = ladder.persist(spark.createDataFrame(list(rows), kind), held)
        return {(r.external_id): (r.player_id, r.method) for r in after.collect()}, {r.external_id: (r.written, r.reason) for r in ruled.collect()}, {r.external_id for r in evicted.collect()}

    ids, ruled, _ = put(("s", "X", "mahomes", "gsis", 1.0))
    assert ruled == {"X": (False, "rejected")} and ids["X"] == ("mahomes", "rejected")
    ids, ruled, gone = put(("s", "X", "chase", "gsis", 1.0), ("s", "N", "lamar", "gsis", 1.0), ("s", "G", "allen", "gsis", 1.0), ("s", "L", "lamar", "exact_name", 0.95), ("s", "Q", "chase", "exact_name", 0.95))
    assert ruled == {"X": (True, None), "N": (True, None), "G": (False, "duplicate_for_source"), "L": (False, "duplicate_for_source"), "Q": (False, "duplicate_for_source")}
    assert ids == {"X": ("chase", "gsis"), "N": ("lamar", "gsis"), "M": ("allen", "manual")} and gone == {"H"}


def test_commit_is_all_or_nothing(spark, tmp_path, monkeypatch):
    desk = Desk(spark, tmp_path)
    with pytest.raises(ContractError):
        desk.run([given(None, "1", "Patrick Mahomes", "QB", "KC")])
    assert desk.state.version() == 1
    desk.run([given("s", "1", "Patrick Mahomes", "QB", "KC")])
    real, between = ladder.resolve_batch, []

    def slow(*args):
        if not between:  # another writer comes in while this batch is decided
            between.append(1)
            desk.state.commit({"mappings": spark.createDataFrame([("s", "other", "lamar", "manual", 1.0, True)], identity.MAPPINGS)})
        return real(*args)

    monkeypatch.setattr(ladder, "resolve_batch", slow)
    got = desk.run([given("s", "2", "Lamar Jackson", "QB", "BAL")])
    assert got["s", "2"].player_id is None and set(desk.ids()) == {("s", "other")}  # decided anew against what the other wrote
    monkeypatch.setattr(ladder, "_one_id_a_slot", lambda written: (_ for _ in ()).throw(ContractError("no")))
    version = desk.state.version()
    with pytest.raises(ContractError):
        desk.run([given("t", "3", "Ja'Marr Chase", "WR", "CIN")])
    assert desk.state.version() == version and ("t", "3") not in desk.ids()


def test_a_third_of_the_batch_claims_one_slot(spark, tmp_path):
    rows = [given("s", f"{k:04d}", f"Person {k}", "QB", None, "00-0033873" if k % 3 == 0 else None) for k in range(300)]
    desk = Desk(spark, tmp_path)
    got = desk.run(rows)
    assert len(got) == 300 and [k for k, r in got.items() if r.player_id] == [("s", "0000")]
    assert sum(r.reason == "duplicate_for_source" for r in got.values()) == 99 and len(desk.queue()) == 299
