"""The registry and the bulk id file: who exists, and which outside ids are theirs, loaded whole.

``seed`` brings the registry up to date (people by registry id, one defence a team), ``apply``
loads an id file at confidence 1.0.  Both only compute; ``commit`` writes players, mappings and
queue in one manifest, so a load that is refused leaves nothing behind.

A file row finds its person by registry id, by an id that is mapped already (a rejected one counts
for identity only), or becomes a new person; a defence is found by its team and never made.  Where a
person was once made up for want of a registry id and the registry has since published them,
the two are folded into one first.  Ids that stand for several people, or of which a person has
several from one source, are ambiguous and written nowhere.

| The id is | The person's slot is | Outcome |
|-|-|-|
| rejected for this person | - | blocked_by_rejection, queued |
| mapped to this person | - | unchanged, or updated if it was less than a file fact |
| mapped to another, by file, hand or a verified guess | - | the whole load is refused |
| new, rejected for another, or guessed for another | free | inserted or repointed |
| 〃 | held by a guess | the guess is displaced and queued; inserted or repointed |
| 〃 | held by anything else | blocked_by_existing, queued; a guess for another is dropped |

Sets only: each step is a join or an aggregate on (source, id), (source, person) or a person's
key.  Person ids are derived from the key, so a repeated load makes nobody twice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.scratch import written
from ..sources.lake import State
from . import identity as i
from .ladder import KEY, QUEUE, RAW, _one_id_a_slot, queue_after
from .relational import ContractError, accounted, integral_text, keep_first, unpivot

PLAYERS = (
    "player_id string, gsis_id string, name string, first_name string, last_name string, name_key string, position string, team string, "
    "birth_date date, rookie_year int, height int, weight int, college string, status string"
)
# Columns of the two files, and the source that each id column names.
REGISTRY_COLUMNS = ("gsis_id", "display_name", "first_name", "last_name", "position", "birth_date", "rookie_season", "height", "weight", "college_name", "status", "latest_team")
ID_SOURCES = {
    "sportradar_id": "sportradar",
    "fantasypros_id": "fantasypros",
    "sleeper_id": "sleeper",
    "espn_id": "espn",
    "yahoo_id": "yahoo",
    "pfr_id": "pfr",
    "rotowire_id": "rotowire",
}
FILE_COLUMNS = ("mfl_id", "gsis_id", *ID_SOURCES, "name", "position", "team", "birthdate", "draft_year", "college")
COUNTS = ("inserted", "updated", "unchanged", "created_players", "merged_placeholders", "skipped_no_ids", "skipped_position", "skipped_dst", "skipped_no_person_key")
LISTS = ("ambiguous_in_file", "blocked_by_existing", "blocked_by_rejection", "displaced")


class FileConflict(ContractError):
    """The id file contradicts mappings that outrank it."""


def person_id(key: Column) -> Column:
    return F.concat(F.lit("p-"), F.substring(F.sha2(key, 256), 1, 32))


def _require(df: DataFrame, columns) -> None:
    if missing := sorted(set(columns) - set(df.columns)):
        raise ContractError(f"missing columns {missing}")


def _day(c: Column) -> Column:
    return F.try_to_date(c.cast("string"), "yyyy-MM-dd")


def prepare(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry rows in columns of ``PLAYERS``, dropped rows by position).  One pass checks them:
    registry ids are there and unique, names are not empty, and some rows are kept."""
    _require(raw, REGISTRY_COLUMNS)
    known = raw.withColumn("_position", names.normalize_position(F.col("position")))
    kept, dropped = accounted(known, F.col("_position").isNotNull())
    rows = kept.select(
        person_id(F.concat(F.lit("gsis:"), F.col("gsis_id"))).alias("player_id"),
        "gsis_id",
        F.col("display_name").alias("name"),
        "first_name",
        "last_name",
        names.normalize_name(F.col("display_name")).alias("name_key"),
        F.col("_position").alias("position"),
        names.normalize_team(F.col("latest_team")).alias("team"),
        _day(F.col("birth_date")).alias("birth_date"),
        F.col("rookie_season").cast("int").alias("rookie_year"),
        F.col("height").cast("int").alias("height"),
        F.col("weight").cast("int").alias("weight"),
        F.col("college_name").alias("college"),
        "status",
    )
    empty = F.coalesce(F.col("name_key"), F.lit("")) == ""
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gsis_id").isNull()).alias("nulls"), F.count_if(empty).alias("empty")).head()
    if not seen.n:
        raise ContractError("no rows of a position that counts")
    if seen.nulls:
        raise ContractError(f"{seen.nulls} rows have null gsis_id")
    if not rows.groupBy("gsis_id").count().where("count > 1").isEmpty():
        raise ContractError("duplicate gsis_id")
    if seen.empty:
        raise ContractError(f"{seen.empty} rows have a null or empty name")
    return rows, dropped.groupBy("position").agg(F.count(F.lit(1)).alias("n"))


def defences(spark) -> DataFrame:
    """One player for each team's defence."""
    rows = [(team, city, nick) for team, city, nick, _ in names.TEAMS]
    df = spark.createDataFrame(rows, "team string, first_name string, last_name string")
    key = names.defence_key(F.col("team"))
    filled = df.withColumns({"name_key": key, "player_id": person_id(key), "name": F.concat_ws(" ", "first_name", "last_name"), "position": F.lit("DST")})
    return _as_players(filled)


def _as_players(df: DataFrame) -> DataFrame:
    fields = [f.strip().split(" ") for f in PLAYERS.split(",")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


def seed(players: DataFrame, raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(players after, dropped rows by position): people are updated by registry id and keep their
    player id; defences that are not there yet are added."""
    rows, dropped = prepare(raw)
    old = players.where("gsis_id is not null").select("gsis_id", F.col("player_id").alias("_old"))
    rows = rows.join(old, "gsis_id", "left").withColumn("player_id", F.coalesce("_old", "player_id")).drop("_old")
    new = defences(players.sparkSession)
    new = new.join(players.where("position = 'DST'").select("name_key"), "name_key", "left_anti")
    rest = players.join(rows.select("gsis_id"), "gsis_id", "left_anti")
    return _as_players(rest).unionByName(_as_players(rows)).unionByName(_as_players(new)), dropped


def _typed(rows: DataFrame) -> DataFrame:
    """Ids as text: whole floating numbers without their fraction, others are an error."""
    _require(rows, FILE_COLUMNS)
    kinds = dict(rows.dtypes)
    text = lambda c: integral_text(F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    ids = ("mfl_id", "gsis_id", *ID_SOURCES)
    numbered = rows if "row_no" in rows.columns else rows.withColumn("row_no", F.monotonically_increasing_id())
    return numbered.select("row_no", *[text(c).alias(c) for c in ids], *[F.col(c).cast("string").alias(c) for c in ("name", "position", "team", "birthdate", "college")], F.col("draft_year").cast("int").alias("draft_year"))


def _cells(rows: DataFrame, *more: str) -> DataFrame:
    return unpivot(rows.select("row_no", *more, *ID_SOURCES), ["row_no", *more], ID_SOURCES, "source", "external_id")


def _by_known_id(rows: DataFrame, mappings: DataFrame) -> DataFrame:
    """(row_no, hit): the person of a row's first id, in the order of the columns, that has a mapping."""
    order = F.element_at(F.create_map(*[F.lit(x) for n, s in enumerate(ID_SOURCES.values()) for x in (s, n)]), F.col("source"))
    known = mappings.select(*KEY, "player_id")
    return _cells(rows).join(known, KEY).groupBy("row_no").agg(F.min_by("player_id", order).alias("hit"))


def reconcile(rows: DataFrame, players: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mappings after, persons folded away, ids that found their slot taken).

    A person without registry id (no defence) whose id stands in a file row of a registry person is
    the same person: ids and rejections go over, an id only if the keeper's slot of its source is
    free; of several ids for one slot that of the earlier row goes."""
    people = players.select("player_id", "gsis_id", "position")
    keepers = people.where("gsis_id is not null").select("gsis_id", F.col("player_id").alias("keeper"))
    guests = people.where("gsis_id is null and position != 'DST'").select(F.col("player_id").alias("hit"))
    pairs = rows.where("gsis_id is not null").select("row_no", "gsis_id").join(_by_known_id(rows, mappings), "row_no").join(keepers, "gsis_id").join(guests, "hit", "left_semi")
    folded = written(pairs.where("hit != keeper").groupBy("hit").agg(F.min("row_no").alias("row_no"), F.min_by("keeper", "row_no").alias("keeper")), "idfile-folded")
    moving = mappings.join(folded.withColumnRenamed("hit", "player_id"), "player_id")
    live = moving.where(i.is_live())
    taken = mappings.where(i.is_live()).select("source", F.col("player_id").alias("keeper"))
    free = live.join(taken, ["source", "keeper"], "left_anti")
    first = free.groupBy("source", "keeper").agg(F.min_by("external_id", F.struct("row_no", "external_id")).alias("external_id")).withColumn("goes", F.lit(True))
    ruled = moving.join(first.select(*KEY, "goes"), KEY, "left").withColumn("goes", F.coalesce("goes", ~i.is_live()))
    columns = mappings.columns
    gone = ruled.where("goes").withColumn("player_id", F.col("keeper")).select(*columns)
    after = mappings.join(folded.select(F.col("hit").alias("player_id")), "player_id", "left_anti").select(*columns).unionByName(gone)
    return after, folded.select(F.col("hit").alias("player_id")), ruled.where("not goes").select(*KEY)


def _assigned(rows: DataFrame, players: DataFrame, mappings: DataFrame) -> DataFrame:
    """Rows with ``person`` (null for a defence that nobody knows) and ``made`` for one to be made."""
    people = players.where("gsis_id is not null").select("gsis_id", F.col("player_id").alias("by_registry"))
    teams = players.where("position = 'DST'").select(F.col("name_key").alias("defence"), F.col("player_id").alias("by_team"))
    is_team = F.col("position_norm") == "DST"
    key = F.when(is_team, names.defence_key(F.col("name"), F.col("team")))
    met = rows.withColumn("defence", key).join(people, "gsis_id", "left").join(teams, "defence", "left").join(_by_known_id(rows, mappings), "row_no", "left")
    made = F.coalesce(F.concat(F.lit("gsis:"), F.col("gsis_id")), F.concat(F.lit("mfl:"), F.col("mfl_id")))
    found = F.when(is_team, F.coalesce("by_team", "hit")).otherwise(F.coalesce("by_registry", "hit"))
    return met.withColumns({"made": F.when(~is_team & found.isNull(), made), "person": F.coalesce(found, F.when(~is_team, person_id(made)))})


def apply(rows: DataFrame, players: DataFrame, mappings: DataFrame, queue: DataFrame, now: datetime) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """({players, mappings, queue} after, counts by field, listed ids by field).

    rows may bring ``row_no``, the order of the file; otherwise rows count as they are read."""
    typed = _typed(rows).withColumn("position_norm", names.normalize_position(F.col("position")))
    has_id = F.coalesce(*[F.col(c) for c in ID_SOURCES]).isNotNull()
    skip = (
        F.when(F.coalesce("gsis_id", "mfl_id").isNull(), "skipped_no_person_key")
        .when(F.col("position_norm").isNull(), "skipped_position")
        .when(~has_id, "skipped_no_ids")
    )
    typed = written(typed.withColumn("skip", skip), "idfile-rows")
    use = typed.where("skip is null").drop("skip")

    merged, folded, orphans = reconcile(use, players, mappings)
    merged = written(merged, "idfile-merged")
    people = players.join(folded, "player_id", "left_anti")
    assigned = written(_assigned(use, people, merged), "idfile-assigned")
    mine = assigned.where("person is not null")

    long = _cells(mine, "person").select(*KEY, F.col("person").alias("player_id")).distinct()
    shared = long.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(KEY)
    many = long.groupBy("source", "player_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "player_id")
    ambiguous = written(long.join(shared, KEY, "left_semi").union(long.join(many, ["source", "player_id"], "left_semi").select(long.columns)).select(KEY).distinct(), "idfile-ambiguous")
    clean = long.join(ambiguous, KEY, "left_anti")

    soft = ~F.col("method").isin(*i.PROTECTED) & ~F.col("verified")
    own = merged.select(*KEY, F.col("player_id").alias("old"), "method", "confidence", soft.alias("soft"))
    met = clean.join(own, KEY, "left")
    rejected, mapped = F.coalesce(F.col("method") == i.REJECTED, F.lit(False)), F.col("old").isNotNull()
    other = mapped & ~rejected & (F.col("old") != F.col("player_id"))
    met = written(met.withColumns({"stale": other & F.col("soft"), "clash": other & ~F.col("soft")}), "idfile-met")
    clashes = met.where("clash").orderBy(*KEY).select(*KEY, "old", "player_id").head(20)
    if clashes:
        raise FileConflict(f"the id file contradicts mappings that outrank it: {[tuple(c) for c in clashes]}")

    stays = merged.where(i.is_live()).join(met.where("stale").select(KEY), KEY, "left_anti")
    holders = stays.select("source", "player_id", F.col("external_id").alias("holder"), soft.alias("soft_holder"))
    met = met.join(holders, ["source", "player_id"], "left")
    held = F.col("holder").isNotNull() & (F.col("holder") != F.col("external_id"))
    outcome = (
        F.when(rejected & (F.col("old") == F.col("player_id")), "blocked_by_rejection")
        .when(mapped & ~rejected & ~F.col("stale") & (F.col("method") == i.FILE) & (F.col("confidence").cast("double") >= 1 - i.EPSILON), "unchanged")
        .when(mapped & ~rejected & ~F.col("stale"), "updated")
        .when(held & ~F.col("soft_holder"), "blocked_by_existing")
        .when(mapped, "repointed")
        .otherwise("inserted")
    )
    met = written(met.withColumn("outcome", outcome), "idfile-outcome")
    wrote = met.where(F.col("outcome").isin("inserted", "repointed", "updated"))
    displaced = met.where(F.col("outcome").isin("inserted", "repointed") & held).select("source", F.col("holder").alias("external_id"))
    verified = F.coalesce(F.col("_verified"), F.lit(False))
    kept_mark = merged.select(*KEY, F.col("verified").alias("_verified"))
    fresh = wrote.join(kept_mark, KEY, "left").select(*KEY, "player_id", F.lit(i.FILE).alias("method"), F.lit(1.0).cast("float").alias("confidence"), F.when(F.col("outcome") == "updated", verified).otherwise(False).alias("verified"))
    dropped = met.where("stale and outcome = 'blocked_by_existing'").select(KEY)
    rest = merged.join(fresh.select(KEY), KEY, "left_anti").join(displaced.unionByName(dropped), KEY, "left_anti")
    after = rest.select(*fresh.columns).unionByName(fresh)

    wanted = mine.where("made is not null").join(clean.select(F.col("player_id").alias("person")).distinct(), "person", "left_semi").join(people.select(F.col("player_id").alias("person")), "person", "left_anti")
    first, last = names.name_parts(F.col("name"))
    made = keep_first(wanted, ["person"], ["row_no"]).select(
        F.col("person").alias("player_id"),
        "gsis_id",
        "name",
        first.alias("first_name"),
        last.alias("last_name"),
        names.normalize_name(F.col("name")).alias("name_key"),
        F.col("position_norm").alias("position"),
        names.normalize_team(F.col("team")).alias("team"),
        _day(F.col("birthdate")).alias("birth_date"),
        F.col("draft_year").alias("rookie_year"),
        "college",
    )
    made = written(_as_players(made), "idfile-made")

    said = _cells(use, "name", "position", "team").groupBy(KEY).agg(F.min_by(F.struct(F.col("name").alias("raw_name"), F.col("position").alias("raw_position"), F.col("team").alias("raw_team")), "row_no").alias("r"))
    live = merged.where(i.is_live()).select(KEY)
    refused = [
        ambiguous.join(live, KEY, "left_anti").withColumn("reason", F.lit("ambiguous_in_file")),
        met.where("outcome = 'blocked_by_existing'").select(*KEY, F.col("outcome").alias("reason")),
        met.where("outcome = 'blocked_by_rejection'").select(*KEY, F.col("outcome").alias("reason")),
        displaced.withColumn("reason", F.lit("displaced")),
        orphans.join(fresh.select(KEY), KEY, "left_anti").withColumn("reason", F.lit("slot_taken")),
    ]
    told = refused[0]
    for part in refused[1:]:
        told = told.unionByName(part)
    told = told.groupBy(KEY).agg(F.min("reason").alias("reason")).join(said, KEY, "left")
    seen = told.select(*KEY, *[F.col("r")[c].alias(c) for c in RAW], "reason", F.col("r").isNull().alias("carried"))
    mapped_now = met.where(F.col("outcome").isin("inserted", "repointed")).select(KEY)
    queued = queue_after(queue, seen, mapped_now, now)

    counted = [
        met.where("outcome not in ('blocked_by_existing', 'blocked_by_rejection')").select(F.when(F.col("outcome") == "repointed", "updated").otherwise(F.col("outcome")).alias("field")),
        typed.where("skip is not null").select(F.col("skip").alias("field")),
        assigned.where("person is null").select(F.lit("skipped_dst").alias("field")),
        made.select(F.lit("created_players").alias("field")),
        folded.select(F.lit("merged_placeholders").alias("field")),
    ]
    every = rows.sparkSession.createDataFrame([(c,) for c in COUNTS], "field string")
    fields = counted[0]
    for part in counted[1:]:
        fields = fields.unionByName(part)
    counts = every.join(fields.groupBy("field").agg(F.count(F.lit(1)).alias("n")), "field", "left").select("field", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    listed = ambiguous.withColumn("field", F.lit("ambiguous_in_file")).unionByName(met.where("outcome like 'blocked%'").select(*KEY, F.col("outcome").alias("field"))).unionByName(displaced.withColumn("field", F.lit("displaced")))
    return {"players": people.select(*made.columns).unionByName(made), "mappings": after, "queue": queued}, counts, listed.select("field", *KEY)


def report(counts: DataFrame, listed: DataFrame) -> dict:
    """The load's thirteen fields; lists are of ids that need a person's look."""
    out: dict = {r.field: r.n for r in counts.collect()}
    for field in LISTS:
        out[field] = sorted((r.source, r.external_id) for r in listed.where(F.col("field") == field).collect())
    return out


def tables(state: State) -> dict[str, DataFrame]:
    spark, held = state.spark, state.names()
    return {n: state.read(n) if n in held else spark.createDataFrame([], s) for n, s in (("players", PLAYERS), ("mappings", i.MAPPINGS), ("queue", QUEUE))}


def commit(state: State, now: datetime, raw_players: DataFrame | None = None, rows: DataFrame | None = None) -> dict:
    """Seed the registry, load an id file, or both, in one manifest; a refusal leaves the old state."""
    version, held = state.version(), tables(state)
    out: dict = {}
    if raw_players is not None:
        held["players"], dropped = seed(held["players"], raw_players)
        held["players"] = written(held["players"], "idfile-players")
        out["dropped_by_position"] = {r.position: r.n for r in dropped.collect()}
    if rows is not None:
        held, counts, listed = apply(rows, held["players"], held["mappings"], held["queue"], now)
        out |= report(counts, listed)
    state.commit(held, expected=version, check=_one_id_a_slot)
    return out
