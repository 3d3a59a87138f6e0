"""League data of a fantasy platform: settings, rosters, matchups and transactions from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roster tokens and league types of the platform.
BENCH = ("BN", "IR", "TAXI")
FLEX = {"FLEX": ["RB", "WR", "TE"], "SUPER_FLEX": ["QB", "RB", "WR", "TE"], "REC_FLEX": ["WR", "TE"], "WRRB_FLEX": ["RB", "WR"]}
LEAGUE_TYPES = {0: "redraft", 1: "keeper", 2: "dynasty"}
DRAFT_STATUSES = ("pre_draft", "drafting", "paused", "complete")

LEAGUE = "league_id string, name string, season string, roster_positions array<string>, scoring_settings map<string,double>, settings struct<num_teams:int,waiver_type:int,waiver_budget:int,type:int>"
ROSTER = "roster_id int, owner_id string, starters array<string>, players array<string>, reserve array<string>, taxi array<string>"


def scoring_format(points: Column) -> Column:
    """ppr, half, standard or custom by the points of a reception."""
    rec = F.element_at(points, F.lit("rec"))
    return F.when(rec == 1.0, "ppr").when(rec == 0.5, "half").when(F.coalesce(rec, F.lit(0.0)) == 0.0, "standard").otherwise("custom")


def starting_slots(tokens: Column) -> Column:
    """Slots without bench, injured reserve and taxi; a defence is DST everywhere."""
    kept = F.filter(F.coalesce(tokens, F.array()), lambda s: ~s.isin(*BENCH))
    return F.transform(kept, lambda s: F.when(s == "DEF", "DST").otherwise(s))


def flex_positions(slot: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in FLEX.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), slot)


def map_league(raw: DataFrame) -> DataFrame:
    """League rows; an unknown type is an error, a budget exists only for bidding waivers."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in LEAGUE_TYPES.items() for x in kv]), F.col("settings.type"))
    return raw.select(
        "league_id",
        "name",
        F.col("season").cast("int").alias("season"),
        F.coalesce(kind, F.raise_error(F.lit("unknown league type"))).alias("type"),
        F.when(F.col("settings.waiver_type") == 2, F.col("settings.waiver_budget")).alias("budget"),
        scoring_format(F.col("scoring_settings")).alias("format"),
        starting_slots(F.col("roster_positions")).alias("slots"),
    )


def starters(rosters: DataFrame, slots: Column) -> DataFrame:
    """Slots beside starters by place; lengths must agree, '0' is an empty slot."""
    same = F.size(slots) == F.size("starters")
    zipped = F.when(same, F.arrays_zip(slots.alias("slot"), F.col("starters").alias("player_id"))).otherwise(F.raise_error(F.lit("slots and starters differ in number")))
    rows = rosters.select("roster_id", F.posexplode(zipped).alias("place", "z"))
    return rows.select("roster_id", "place", "z.slot", F.nullif(F.col("z.player_id"), F.lit("0")).alias("player_id"))


def roster_rows(rosters: DataFrame, week: int) -> DataFrame:
    """A roster's players with where each sits."""
    seats = {"starters": "starter", "reserve": "IR", "taxi": "TAXI"}
    seat = F.lit("BENCH")
    for column, name in reversed(seats.items()):
        seat = F.when(F.array_contains(F.coalesce(column, F.array()), F.col("player_id")), name).otherwise(seat)
    rows = rosters.select("*", F.explode(F.coalesce("players", F.array())).alias("player_id")).where("player_id != '0'")
    return rows.select("roster_id", F.lit(week).alias("week"), "player_id", seat.alias("seat"))


def pair_matchups(rows: DataFrame) -> DataFrame:
    """Home and away by roster number; rosters without a matchup have byes numbered after the rest."""
    games = rows.where("matchup_id is not null").groupBy("matchup_id").agg(F.array_sort(F.collect_list("roster_id")).alias("r"))
    games = games.select(F.col("matchup_id").cast("long").alias("matchup_no"), F.get("r", F.lit(0)).alias("home"), F.get("r", F.lit(1)).alias("away"))
    last = rows.agg(F.coalesce(F.max("matchup_id"), F.lit(0)).alias("last"))
    byes = rows.where("matchup_id is null").select("roster_id", F.row_number().over(Window.orderBy("roster_id")).alias("n")).crossJoin(last)
    return games.unionByName(byes.select((F.col("n") + F.col("last")).cast("long").alias("matchup_no"), F.col("roster_id").alias("home"), F.lit(None).cast("int").alias("away")))


def map_transactions(raw: DataFrame, week: int) -> DataFrame:
    kind = F.when(F.col("type") == "free_agent", F.when(F.size(F.coalesce("adds", F.create_map())) > 0, "add").otherwise("drop")).otherwise(F.col("type"))
    return raw.select("transaction_id", kind.alias("kind"), F.coalesce("leg", F.lit(week)).alias("week"), F.timestamp_millis("created").alias("at"))


def map_picks(raw: DataFrame) -> DataFrame:
    amount = F.nullif(F.element_at("metadata", F.lit("amount")).cast("int"), F.lit(0))
    return raw.select("pick_no", "round", "draft_slot", "roster_id", F.nullif(F.col("player_id"), F.lit("0")).alias("player_id"), F.coalesce("is_keeper", F.lit(False)).alias("keeper"), amount.alias("amount"))


def player_blob(body: DataFrame, column: str = "body") -> DataFrame:
    """A JSON object of player objects to rows of text, with the body's hash as its tag."""
    rows = body.select(F.sha2(column, 256).alias("etag"), F.explode(F.from_json(column, "map<string,map<string,string>>")).alias("player_id", "fields"))
    return rows


def free_agents(catalogue: DataFrame, rosters: DataFrame) -> DataFrame:
    held = rosters.select(F.explode(F.coalesce("players", F.array())).alias("player_id"))
    return catalogue.join(held, "player_id", "left_anti")


def is_defence(player_id: Column) -> Column:
    return ~player_id.rlike("^[0-9]+$")
