"""Registry seeding and the bulk id file against the golden load."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fieldwright.operators import identity, idfile
from fieldwright.operators.relational import ContractError
from fieldwright.sources import lake

NOW = datetime(2026, 9, 7)
RAW = "gsis_id string, display_name string, first_name string, last_name string, position string, birth_date string, rookie_season int, height int, weight int, college_name string, status string, latest_team string"
PEOPLE = [
    ("00-0033873", "Patrick Mahomes", "QB", "1995-09-17", 2017, "KC"),
    ("00-0036900", "Ja'Marr Chase", "WR", "2000-03-01", 2021, "CIN"),
    ("00-0034827", "DJ Moore", "WR", "1997-04-14", 2018, "BUF"),
    ("00-0038134", "Kenneth Walker III", "RB", "2000-10-20", 2022, "KC"),
    ("00-0033303", "Harrison Butker", "K", "1995-07-14", 2017, "KC"),
    ("00-0036963", "Amon-Ra St. Brown", "WR", "1999-10-24", 2021, "DET"),
    ("00-0039849", "Marvin Harrison Jr.", "WR", "2002-08-11", 2024, "ARI"),
    ("00-0007024", "Marvin Harrison", "WR", "1972-08-25", 1996, "IND"),
    ("00-0029892", "Kyle Juszczyk", "FB", "1991-04-23", 2013, "SF"),
    ("00-0032688", "Robbie Chosen", "WR", "1993-05-09", 2016, "WAS"),
    ("00-0034796", "Lamar Jackson", "QB", "1997-01-07", 2018, "BAL"),
    ("00-0036152", "Lamar Jackson", "CB", "1998-04-13", 2020, "ATL"),
    ("00-0034857", "Josh Allen", "QB", "1996-05-21", 2018, "BUF"),
    ("00-0030833", "Josh Allen", "C", "1991-12-30", 2014, "TB"),
    ("00-0036613", "Jaylen Waddle", "WR", "not a day", 2021, "DEN"),
    ("00-0033869", "Mitchell Trubisky", "QB", "1994-08-20", 2017, "TEN"),
    ("00-0000001", "Test Punter", "P", "1990-01-01", 2012, "SEA"),
]
FILE = "row_no int, mfl_id string, sportradar_id string, fantasypros_id string, gsis_id string, sleeper_id string, espn_id string, yahoo_id string, pfr_id string, rotowire_id string, name string, position string, team string, birthdate string, draft_year int, college string"
ROWS = [
    (0, "13116", "sr-mahomes", "16413", "00-0033873", "4046", "3139477", "30123", "MahoPa00", "11839", "Patrick Mahomes", "QB", "KCC", "1995-09-17", 2017, "Texas Tech"),
    (1, "15281", "sr-chase", "19788", "00-0036900", "7564", "4362628", "33393", "ChasJa00", "15183", "Ja'Marr Chase", "WR", "CIN", "2000-03-01", 2021, "LSU"),
    (2, "13635", "sr-moore", "17265", "00-0034827", "4983", "3915416", "30994", "MoorD.00", "12477", "D.J. Moore", "WR", "BUF", "1997-04-14", 2018, "Maryland"),
    (3, "15711", "sr-walker", "23021", "00-0038134", "8151", "4567048", "33996", "WalkKe00", "15909", "Kenneth Walker III", "RB", "KCC", "2000-10-20", 2022, "Michigan State"),
    (4, "13354", "sr-butker", "16712", "00-0033303", "4227", "3055899", "30346", "ButkHa00", "11783", "Harrison Butker", "PK", "KCC", "1995-07-14", 2017, "Georgia Tech"),
    (5, "17471", "sr-pavia", "28082", None, "13427", "5084180", None, None, "19290", "Diego Pavia", "QB", "FA", "2002-02-16", 2026, "Vanderbilt"),
    (6, "11367", "sr-juszczyk", "11798", "00-0029892", "1379", "16002", "26753", "JuszKy00", "8930", "Kyle Juszczyk", "RB", "SFO", "1991-04-23", 2013, "Harvard"),
    (7, "16614", "sr-harrison", "23064", "00-0039849", "11628", "4432708", "40893", "HarrMa09", "17674", "Marvin Harrison Jr.", "WR", "ARI", "2002-08-11", 2024, "Ohio State"),
    (8, "17556", "sr-reese", "28053", "00-0041509", "13377", "4950400", None, "ReesAr00", "19273", "Arvell Reese", "LB", "NYG", "2005-08-30", 2026, "Ohio State"),
    (9, "12459", "sr-glitch", None, "00-0031320", "2295", "17257", "28118", "SmitKe04", "9898", "Fred Williams", "WR", "KCC", "1988-04-15", 2014, "St. Cloud State"),
    (10, "12571", "sr-glitch", None, "00-0031320", "2295", "17257", "28118", "SmitKe04", "10167", "Kevin Smith", "WR", "SEA", "1991-12-21", 2014, "Washington"),
    (11, "99900", None, None, None, None, None, None, None, None, "Nobody Nowhere", "QB", "FA", None, None, None),
    (12, "99901", None, None, None, "KC", "-16012", None, None, None, "Kansas City Chiefs", "DEF", "KCC", None, None, None),
]
GOLDEN = {
    "inserted": 61, "updated": 0, "unchanged": 0, "created_players": 2, "merged_placeholders": 0, "skipped_no_ids": 1, "skipped_position": 1, "skipped_dst": 0, "skipped_no_person_key": 0,
    "ambiguous_in_file": [("rotowire", "10167"), ("rotowire", "9898")], "blocked_by_existing": [], "blocked_by_rejection": [], "displaced": [],
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = [(g, n, n.split()[0], n.split(" ", 1)[1], p, b, y, 72, 200, "School", "ACT", t) for g, n, p, b, y, t in PEOPLE]
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def seeded(spark, raw, tmp_path_factory):
    state = lake.State(spark, str(tmp_path_factory.mktemp("seeded")))
    assert idfile.commit(state, NOW, raw_players=raw) == {"dropped_by_position": {"CB": 1, "C": 1, "P": 1}}
    return state.read("players")


class Load:
    def __init__(self, spark, root, seeded, mappings=(), players=()):
        self.spark, self.state = spark, lake.State(spark, str(root))
        people = seeded.unionByName(spark.createDataFrame(list(players), idfile.PLAYERS)) if players else seeded
        self.ids = {r.gsis_id or r.name_key: r.player_id for r in people.collect()}
        held = [(s, e, self.ids.get(p, p), *rest) for s, e, p, *rest in mappings]
        self.state.commit({"players": people, "mappings": spark.createDataFrame(held, identity.MAPPINGS)})

    def run(self, rows=ROWS, **kw):
        df = rows if not isinstance(rows, list) else self.spark.createDataFrame(rows, FILE)
        return idfile.commit(self.state, NOW, rows=df, **kw)

    def mappings(self):
        return {(r.source, r.external_id): r for r in self.state.read("mappings").collect()}

    def queue(self):
        return {(r.source, r.external_id): r for r in self.state.read("queue").collect()}


def test_registry_rows(spark, raw, seeded):
    rows, _ = idfile.prepare(raw)
    got = {r.gsis_id: r for r in rows.collect()}
    assert len(got) == 14 and len(rows.columns) == 14
    assert (got["00-0029892"].position, got["00-0029892"].team) == ("RB", "SF")
    walker = got["00-0038134"]
    assert (walker.name_key, walker.birth_date, walker.rookie_year, walker.height, walker.weight) == ("kenneth walker", date(2000, 10, 20), 2022, 72, 200)
    assert got["00-0036613"].birth_date is None
    assert seeded.count() == 46 and seeded.where("position = 'DST'").select("name_key").distinct().count() == 32
    again, _ = idfile.seed(seeded, raw.withColumn("status", F.lit("DEV")))
    assert again.count() == 46 and again.where("status = 'DEV'").count() == 14
    assert {r[0] for r in again.select("player_id").collect()} == {r[0] for r in seeded.select("player_id").collect()}


@pytest.mark.parametrize(
    "change,said",
    [
        (lambda d: d.drop("latest_team"), "latest_team"),
        (lambda d: d.union(d.limit(1)), "duplicate gsis_id"),
        (lambda d: d.withColumn("gsis_id", F.when(F.col("display_name") != "Patrick Mahomes", F.col("gsis_id"))), "null gsis_id"),
        (lambda d: d.where("false"), "no rows of a position"),
        (lambda d: d.where("position = 'P'"), "no rows of a position"),
        (lambda d: d.withColumn("display_name", F.when(F.col("gsis_id") != "00-0033873", F.col("display_name"))), "null or empty name"),
    ],
)
def test_registry_refusals(raw, change, said):
    with pytest.raises(ContractError, match=said):
        idfile.prepare(change(raw))


def test_the_golden_load_twice(spark, tmp_path, seeded):
    load = Load(spark, tmp_path, seeded)
    assert load.run() == GOLDEN
    got, ids = load.mappings(), load.ids
    assert len(got) == 61 and all(r.method == "dynastyprocess" and r.confidence == 1.0 for r in got.values())
    assert got["sleeper", "4046"].player_id == got["espn", "3139477"].player_id == ids["00-0033873"]
    assert got["sleeper", "4227"].player_id == ids["00-0033303"] and got["sleeper", "KC"].player_id == got["espn", "-16012"].player_id == ids["kc dst"]
    people = {r.player_id: r for r in load.state.read("players").collect()}
    pavia = people[got["sleeper", "13427"].player_id]
    assert (pavia.gsis_id, pavia.name_key, pavia.first_name, pavia.last_name, pavia.rookie_year, pavia.college, pavia.birth_date, pavia.team) == (None, "diego pavia", "Diego", "Pavia", 2026, "Vanderbilt", date(2002, 2, 16), None)
    fred = people[got["sleeper", "2295"].player_id]
    assert (fred.gsis_id, fred.name, fred.team) == ("00-0031320", "Fred Williams", "KC")
    assert {k: (r.raw_name, r.resolved) for k, r in load.queue().items()} == {("rotowire", "9898"): ("Fred Williams", False), ("rotowire", "10167"): ("Kevin Smith", False)}
    assert load.run() == GOLDEN | {"inserted": 0, "unchanged": 61, "created_players": 0}
    assert load.mappings() == got and len(people) == 48 == load.state.read("players").count()


def test_what_was_mapped_before(spark, tmp_path, seeded):
    mahomes, chase, moore, walker = "00-0033873", "00-0036900", "00-0034827", "00-0038134"
    held = [
        ("sleeper", "4046", mahomes, "exact_name", 0.95, False),  # the same player, less sure: updated
        ("espn", "9999", chase, "manual", 1.0, True),  # holds the slot: blocks
        ("yahoo", "GUESS", moore, "fuzzy", 0.89, False),  # a guess in the slot: displaced
        ("pfr", "WalkKe00", walker, "rejected", 0.0, False),  # rejected for this player
        ("pfr", "ChasJa00", walker, "rejected", 0.0, False),  # rejected for another: corrected
        ("rotowire", "11839", chase, "exact_name", 0.95, False),  # a guess for another: repointed
    ]
    load = Load(spark, tmp_path, seeded, held)
    assert load.run() == GOLDEN | {"inserted": 56, "updated": 3, "blocked_by_existing": [("espn", "4362628")], "blocked_by_rejection": [("pfr", "WalkKe00")], "displaced": [("yahoo", "GUESS")]}
    rows, ids = load.mappings(), load.ids
    assert rows["sleeper", "4046"].method == "dynastyprocess" and rows["espn", "9999"].method == "manual" and ("yahoo", "GUESS") not in rows
    assert rows["yahoo", "30994"].player_id == ids[moore] and rows["pfr", "WalkKe00"].method == "rejected"
    assert rows["pfr", "ChasJa00"].player_id == ids[chase] and rows["rotowire", "11839"].player_id == ids[mahomes] and rows["rotowire", "15183"].player_id == ids[chase]
    assert {k for k, r in load.queue().items() if not r.resolved} == {("rotowire", "9898"), ("rotowire", "10167"), ("espn", "4362628"), ("pfr", "WalkKe00"), ("yahoo", "GUESS")}
    assert identity.broken_invariants(load.state.read("mappings")).isEmpty()


def test_a_contradiction_stops_everything(spark, tmp_path, seeded, raw):
    load = Load(spark, tmp_path, seeded, [("sleeper", "4046", "00-0036900", "manual", 1.0, False)])
    with pytest.raises(idfile.FileConflict, match="4046"):
        load.run(raw_players=raw)
    assert load.state.version() == 1 and len(load.mappings()) == 1


def test_typed_ids_and_missing_columns(spark, seeded):
    df = spark.createDataFrame(ROWS, FILE)
    whole = idfile._typed(df.withColumn("yahoo_id", F.col("yahoo_id").cast("double")))
    assert {r[0] for r in whole.select("yahoo_id").collect()} == {r[8 - 1] for r in ROWS}
    with pytest.raises(Exception, match="not a whole number"):
        idfile._typed(df.withColumn("yahoo_id", F.col("yahoo_id").cast("double") + 0.5)).collect()
    with pytest.raises(ContractError, match="sleeper_id"):
        idfile._typed(df.drop("sleeper_id"))


def test_defence_rows_and_rows_without_a_key(spark, tmp_path, seeded):
    rows = [r if r[0] != 12 else (*r[:10], "London Monarchs", "DEF", "London Monarchs", *r[13:]) for r in ROWS]
    rows.append((13, None, "sr-x", None, None, "77", None, None, None, None, "No Key", "QB", "KC", None, None, None))
    load = Load(spark, tmp_path, seeded)
    assert load.run(rows) == GOLDEN | {"inserted": 59, "skipped_dst": 1, "skipped_no_person_key": 1}
    assert ("sleeper", "KC") not in load.mappings() and ("sleeper", "77") not in load.mappings()


def test_a_made_up_person_is_folded_into_the_published_one(spark, tmp_path, seeded, raw):
    load = Load(spark, tmp_path, seeded)
    load.run()
    old = load.mappings()["sleeper", "13427"].player_id
    tomb = spark.createDataFrame([("yahoo", "x", old, "rejected", 0.0, False)], identity.MAPPINGS)
    load.state.commit({"mappings": load.state.read("mappings").unionByName(tomb)})
    now = spark.createDataFrame([("00-0099999", "Diego Pavia", "Diego", "Pavia", "QB", "2002-02-16", 2026, 72, 200, "Vanderbilt", "ACT", "KC")], RAW)
    idfile.commit(load.state, NOW, raw_players=raw.union(now))
    keeper = load.state.read("players").where("gsis_id = '00-0099999'").head().player_id
    taken = spark.createDataFrame([("espn", "other", keeper, "manual", 1.0, True)], identity.MAPPINGS)
    load.state.commit({"mappings": load.state.read("mappings").unionByName(taken)})
    rows = [r if r[0] != 5 else (*r[:4], "00-0099999", *r[5:]) for r in ROWS]
    got = load.run(rows)
    assert (got["merged_placeholders"], got["created_players"], got["inserted"], got["unchanged"]) == (1, 0, 0, 60)
    assert got["blocked_by_existing"] == [("espn", "5084180")]
    ids = load.mappings()
    assert ids["sleeper", "13427"].player_id == ids["yahoo", "x"].player_id == keeper and ("espn", "5084180") not in ids
    assert load.state.read("players").where(F.col("player_id") == old).isEmpty() and not load.queue()["espn", "5084180"].resolved
    assert load.run(rows)["merged_placeholders"] == 0
