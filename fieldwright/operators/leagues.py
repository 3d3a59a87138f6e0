"""Leagues of a platform with their teams, rosters, drafts and picks, upserted together.

Rows come with natural keys (platform, league, season, and what names a team, a draft or a pick in
it).  Ids that rows of other tables point to are derived from these keys, so all tables can be made
at once, a repeated load finds its own rows, and no id has to be fetched back.  Checks come
before any write: keys are unique, every row's league is part of the load, a league has as many
teams as it says and one of them at most is mine, and what names a team names one of the same
league.  A week's roster slots are replaced; everything else is merged.  ``commit`` switches all tables
in one manifest.

Many leagues are one load: every step is a join or an aggregate on a key.  A player that the
crosswalk does not know leaves a pick without player and a roster slot out; both are counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..sources.lake import State
from . import identity as i
from .relational import ContractError, duplicates, merge

LEAGUE = ("platform", "league", "season")
#: Natural keys of each table of a load.
KEYS = {"leagues": LEAGUE, "teams": (*LEAGUE, "team"), "rosters": (*LEAGUE, "week", "team", "player"), "drafts": (*LEAGUE, "draft"), "picks": (*LEAGUE, "draft", "pick_no")}
IDS = {"leagues": "league_id", "teams": "team_id", "drafts": "draft_id"}


def derived(kind: str, *cols: str) -> Column:
    """An id from a natural key; parts are told apart by their length."""
    parts = [F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in cols]
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def check(load: dict[str, DataFrame]) -> None:
    """Refuse a load that contradicts itself; nothing has been written then."""
    for name, keys in KEYS.items():
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        if not load[name].where(null).isEmpty():
            raise ContractError(f"{name}: a key is null")
        if twice := duplicates(load[name], keys).head(3):
            raise ContractError(f"{name}: keys stand twice: {[tuple(r)[: len(keys)] for r in twice]}")
        if name != "leagues" and not load[name].join(load["leagues"], list(LEAGUE), "left_anti").isEmpty():
            raise ContractError(f"{name}: a league is not part of the load")
    per = load["teams"].groupBy(*LEAGUE).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_me").alias("mine"))
    counted = load["leagues"].join(per, list(LEAGUE), "left").select("league", "num_teams", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mine", F.lit(0)).alias("mine"))
    if wrong := counted.where("n != num_teams").head(3):
        raise ContractError(f"teams: not as many as the league says: {[tuple(r)[:3] for r in wrong]}")
    if wrong := counted.where("mine > 1").head(3):
        raise ContractError(f"teams: several are mine: {[r.league for r in wrong]}")
    for name in ("rosters", "picks"):
        if wrong := load[name].where("team is not null").join(load["teams"], [*LEAGUE, "team"], "left_anti").head(3):
            raise ContractError(f"{name}: teams of no such league: {[(r.league, r.team) for r in wrong]}")
    if not load["picks"].join(load["drafts"], [*LEAGUE, "draft"], "left_anti").isEmpty():
        raise ContractError("picks: a draft is not part of the load")


def rows(load: dict[str, DataFrame], mappings: DataFrame) -> dict[str, DataFrame]:
    """The load with derived ids and resolved players, one table for each of the state."""
    known = mappings.where(i.is_usable()).select(F.col("source").alias("platform"), F.col("external_id").alias("player"), "player_id")
    league_id, team_id, draft_id = derived("l", *LEAGUE), derived("t", *LEAGUE, "team"), derived("d", *LEAGUE, "draft")
    teams = load["teams"].select(league_id.alias("league_id"), team_id.alias("team_id"), *[c for c in load["teams"].columns if c not in LEAGUE])
    mine = teams.where("is_me").select("league_id", F.col("team_id").alias("my_team_id"))
    leagues = load["leagues"].withColumn("league_id", league_id).join(mine, "league_id", "left")
    drafts = load["drafts"].select(league_id.alias("league_id"), draft_id.alias("draft_id"), *[c for c in load["drafts"].columns if c not in LEAGUE])
    picks = load["picks"].join(known, ["platform", "player"], "left").withColumns({"draft_id": draft_id, "team_id": F.when(F.col("team").isNotNull(), team_id)})
    picks = picks.select("draft_id", "pick_no", "team_id", "player_id", *[c for c in load["picks"].columns if c not in (*LEAGUE, "draft", "team", "player", "pick_no")])
    slots = load["rosters"].join(known, ["platform", "player"]).withColumn("team_id", team_id)
    slots = slots.select("team_id", "week", "player_id", *[c for c in load["rosters"].columns if c not in (*LEAGUE, "week", "team", "player")])
    return {"leagues": leagues, "teams": teams, "drafts": drafts, "picks": picks, "slots": slots}


def upsert(load: dict[str, DataFrame], held: dict[str, DataFrame], mappings: DataFrame) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """(tables after, counts): held has the state's tables, or none where there are none yet."""
    check(load)
    new = {name: written(df, f"league-{name}") for name, df in rows(load, mappings).items()}
    keys = {"leagues": ["league_id"], "teams": ["team_id"], "drafts": ["draft_id"], "picks": ["draft_id", "pick_no"]}
    after = {name: merge(held[name], new[name], k) if name in held else new[name] for name, k in keys.items()}
    # every team's week that the load tells of is replaced, also where none of its players is known
    told = load["rosters"].select(derived("t", *LEAGUE, "team").alias("team_id"), "week").distinct()
    after["slots"] = held["slots"].join(told, ["team_id", "week"], "left_anti").select(*new["slots"].columns).unionByName(new["slots"]) if "slots" in held else new["slots"]
    counts = {name: df.count() for name, df in new.items()}
    if counts["picks"] != (n := load["picks"].count()):
        raise ContractError(f"{counts['picks']} of {n} picks are left after resolving players")
    counts["unresolved"] = load["rosters"].count() - counts["slots"]
    return after, counts


def commit(state: State, load: dict[str, DataFrame], mappings: DataFrame) -> dict[str, int]:
    """Upsert a load in one manifest; a refusal leaves every table as it was."""
    version, names = state.version(), state.names()
    after, counts = upsert(load, {n: state.read(n) for n in ("leagues", "teams", "drafts", "picks", "slots") if n in names}, mappings)
    state.commit(after, expected=version)
    return counts
