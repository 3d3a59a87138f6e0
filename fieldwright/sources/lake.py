"""The raw lake: contracts, conditional fetch, write-once partitions, journal and views.

Partitions are written by Spark to a temporary folder beside their place and published by
a rename, so readers never see half a partition and nothing is ever overwritten."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import ContractError, checked

# Columns that each landed asset must have.
CONTRACTS: dict[str, tuple[str, ...]] = {
    "players": (
        "gsis_id", "display_name", "first_name", "last_name", "position", "position_group", "birth_date", "college_name", "height", "weight",
        "status", "rookie_season", "latest_team", "espn_id", "pfr_id",
    ),
    "stats_player_week": (
        "player_id", "player_display_name", "position", "season", "week", "season_type", "game_id", "team", "opponent_team", "completions",
        "attempts", "passing_yards", "passing_tds", "passing_interceptions", "passing_epa", "carries", "rushing_yards", "rushing_tds", "rushing_epa",
        "receptions", "targets", "receiving_yards", "receiving_tds", "receiving_air_yards", "receiving_epa", "target_share", "air_yards_share",
        "wopr", "racr", "fantasy_points", "fantasy_points_ppr",
    ),
    "snap_counts": (
        "game_id", "pfr_game_id", "season", "game_type", "week", "player", "pfr_player_id", "position", "team", "opponent", "offense_snaps",
        "offense_pct", "defense_snaps", "defense_pct", "st_snaps", "st_pct",
    ),
    "depth_charts": (
        "dt", "team", "player_name", "espn_id", "gsis_id", "pos_grp", "pos_abb", "pos_name", "pos_slot", "pos_rank",
    ),
    "injuries": (
        "season", "season_type", "game_type", "team", "week", "gsis_id", "position", "full_name", "first_name", "last_name", "report_primary_injury",
        "report_secondary_injury", "report_status", "practice_primary_injury", "practice_secondary_injury", "practice_status",
    ),
    "pbp": (
        "play_id", "game_id", "season", "week", "season_type", "posteam", "defteam", "play_type", "desc", "down", "ydstogo", "qtr", "yardline_100",
        "game_seconds_remaining", "yards_gained", "air_yards", "epa", "wp", "success", "pass_attempt", "rush_attempt", "complete_pass", "touchdown",
        "passer_player_id", "rusher_player_id", "receiver_player_id",
    ),
    "games": (
        "game_id", "season", "game_type", "week", "gameday", "gametime", "away_team", "home_team", "away_score", "home_score", "location",
        "away_rest", "home_rest", "away_moneyline", "home_moneyline", "spread_line", "total_line", "div_game", "roof", "surface", "temp", "wind",
        "stadium_id",
    ),
    "stadiums": (
        "stadium_id", "stadium_name", "lat", "lon", "altitude", "heading", "surface_type", "roof_type", "tz",
    ),
    "playerids": (
        "mfl_id", "sportradar_id", "fantasypros_id", "gsis_id", "sleeper_id", "espn_id", "yahoo_id", "pfr_id", "rotowire_id", "name", "merge_name",
        "position", "team", "birthdate", "draft_year",
    ),
}
SEASONAL = ("stats_player_week", "snap_counts", "depth_charts", "injuries", "pbp")
FLOORS = {"playerids": 8000}
RETRY_STATUS = (408, 425, 429, *range(500, 600))
MOST_TRIES, MOST_BACKOFF, MOST_RETRY_AFTER, ERROR_CHARS = 5, 30.0, 120.0, 2000


class PartitionExists(RuntimeError):
    """A partition of this key has been landed before."""


@dataclass(frozen=True)
class Fetched:
    body: bytes
    etag: str | None


class NotModified:
    pass


class NotFound:
    pass


def retry_after(value: str | None, now: float) -> float | None:
    """Seconds to wait, from seconds or an HTTP date."""
    if not value:
        return None
    try:
        return max(0.0, float(value))
    except ValueError:
        try:
            return max(0.0, parsedate_to_datetime(value).timestamp() - now)
        except (TypeError, ValueError):
            return None


def fetch(get: Callable[[str, dict], tuple[int, dict, bytes]], url: str, etag: str | None = None, sleep=time.sleep) -> Fetched | NotModified | NotFound:
    """Conditional GET with bounded retries.  ``get`` (url, headers) -> (status, headers, body) is the
    transport, so a local folder or a recorded answer serves as well as a network."""
    headers, wait = ({"If-None-Match": etag} if etag else {}), 1.0
    for attempt in range(1, MOST_TRIES + 1):
        try:
            status, got, body = get(url, headers)
        except OSError:
            if attempt == MOST_TRIES:
                raise
            status, got, body = 503, {}, b""
        if status == 304:
            return NotModified()
        if status == 404:
            return NotFound()
        if 200 <= status < 300:
            return Fetched(body, got.get("ETag"))
        if status not in RETRY_STATUS or attempt == MOST_TRIES:
            raise ConnectionError(f"{url}: status {status}")
        after = retry_after(got.get("Retry-After"), time.time())
        if after is not None and after > MOST_RETRY_AFTER:
            raise ConnectionError(f"{url}: asked to wait {after:.0f} s")
        sleep(wait if after is None else after)
        wait = min(MOST_BACKOFF, wait * 2)
    raise AssertionError("unreachable")


def body_tag(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def scrape_date(now: datetime) -> str:
    return now.astimezone(UTC).strftime("%Y-%m-%d")


def partition_path(root: str, source: str, asset: str, keys: dict[str, object]) -> str:
    return "/".join([root, "raw", source, asset, *[f"{k}={v}" for k, v in keys.items()]])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename_new(spark: SparkSession, temp, at) -> bool:
    """Rename a file or folder to a name that must be free; False where it is taken."""
    sc = spark.sparkContext
    fs, hadoop = temp.getFileSystem(sc._jsc.hadoopConfiguration()), sc._jvm.org.apache.hadoop.fs
    plain = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(fs.makeQualified(temp), fs.makeQualified(at), plain)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def land(df: DataFrame, root: str, source: str, asset: str, keys: dict[str, object]) -> int:
    """Write a partition once; returns its rows.  A second landing raises and changes nothing."""
    spark, target = df.sparkSession, partition_path(root, source, asset, keys)
    fs, at = _fs(spark, target)
    if fs.exists(at):
        raise PartitionExists(target)
    made = partition_path(root, source, asset, {}) + f"/.landing-{uuid.uuid4().hex}"
    _, temp = _fs(spark, made)
    try:
        df.write.option("compression", "zstd").parquet(made)
        rows = spark.read.parquet(made).count()
        fs.mkdirs(at.getParent())
        if not _rename_new(spark, temp, at):
            raise PartitionExists(target)
        return rows
    finally:
        fs.delete(temp, True)


def partitions(spark: SparkSession, root: str, source: str, asset: str) -> list[str]:
    """Leaf folders of an asset, in name order (only names are listed)."""
    fs, at = _fs(spark, partition_path(root, source, asset, {}))
    if not fs.exists(at):
        return []
    out, todo = [], [at]
    while todo:
        here = todo.pop()
        inner = [s for s in fs.listStatus(here) if s.isDirectory() and "=" in s.getPath().getName()]
        if inner:
            todo += [s.getPath() for s in inner]
        elif here.toString() != at.toString():
            out.append(here.toString())
    return sorted(out)


def latest(spark: SparkSession, root: str, source: str, asset: str, season: int | None = None) -> str | None:
    """The newest partition, of one season where asked."""
    found = [p for p in partitions(spark, root, source, asset) if season is None or f"/season={season}/" in p + "/"]
    return max(found, default=None)


def read_latest(spark: SparkSession, root: str, source: str, asset: str, season: int | None = None) -> DataFrame | None:
    """The newest partition with its path keys as columns."""
    path = latest(spark, root, source, asset, season)
    if path is None:
        return None
    return spark.read.option("basePath", partition_path(root, source, asset, {})).parquet(path)


def connect(spark: SparkSession, root: str, assets: dict[str, str], season: int | None = None) -> list[str]:
    """Temporary views over the newest partitions; a missing asset is left out.  Names returned."""
    made = []
    for asset, source in assets.items():
        df = read_latest(spark, root, source, asset, season if asset in SEASONAL else None)
        if df is not None:
            df.createOrReplaceTempView(asset)
            made.append(asset)
    return made


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet or CSV by suffix; CSV needs a schema and keeps quoted-empty cells as ''."""
    if path.endswith(".csv"):
        return read_csv(spark, path, schema)
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    reader = spark.read.option("header", True).option("nullValue", "NA").option("encoding", "UTF-8")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_text_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every column text, 'NA' and '' null, a byte-order mark dropped from the first header."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    named = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    return named.select(*[F.when(~F.col(c).isin("NA", ""), F.col(c)).alias(c) for c in named.columns])


def validate(df: DataFrame, asset: str, season: int | None = None) -> DataFrame:
    checked(df, CONTRACTS[asset], floor=FLOORS.get(asset, 1))
    if season is not None and "season" in df.columns and not df.where(~F.col("season").eqNullSafe(F.lit(season))).isEmpty():
        raise ContractError(f"rows of other seasons in {asset} {season}")
    return df


JOURNAL = "run_id string, source string, asset string, season int, started_at timestamp, finished_at timestamp, status string, etag string, rows long, error string"


@dataclass
class Job:
    """One asset's landing: fetch, parse, validate, persist, land; subclasses override a step."""

    source: str
    asset: str
    seasonal: bool = False
    url: str = ""
    parse: Callable[[SparkSession, bytes], DataFrame] | None = None
    persist: Callable[[DataFrame], None] | None = None
    extra: dict = field(default_factory=dict)

    def address(self, season: int | None) -> str:
        return self.url.format(season=season)

    def keys(self, season: int | None, day: str) -> dict[str, object]:
        return ({"season": season} if self.seasonal else {}) | {"scrape_date": day}


_jobs: dict[str, Job] = {}


def register(name: str, job: Job) -> Job:
    if name in _jobs:
        raise ValueError(f"job {name} is registered twice")
    _jobs[name] = job
    return job


def get_job(name: str) -> Job:
    if name not in _jobs:
        raise KeyError(f"no job {name}; there are {sorted(_jobs)}")
    return _jobs[name]


class Journal:
    """Append-only run log as small Parquet files: the last row of a run holds its state."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root}/journal"

    def append(self, **row) -> None:
        df = self.spark.createDataFrame([row], JOURNAL)
        df.coalesce(1).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(JOURNAL).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], JOURNAL)
        last = F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), F.struct(F.col("finished_at").isNotNull(), "finished_at"))
        return rows.groupBy("run_id").agg(last.alias("r")).select("run_id", "r.*")

    def last_tag(self, source: str, asset: str, season: int | None) -> str | None:
        """Tag of the newest success; only a success moves it."""
        mine = self.runs().where((F.col("source") == source) & (F.col("asset") == asset) & F.col("season").eqNullSafe(F.lit(season)) & (F.col("status") == "success"))
        row = mine.orderBy(F.col("finished_at").desc_nulls_last(), F.desc("started_at")).select("etag").head()
        return row[0] if row else None

    def expire(self, before: Column) -> DataFrame:
        """Rows that retention keeps."""
        return self.runs().where(F.col("started_at") >= before)


class Lock:
    """A driver-side lock file per key around read, decide, write."""

    def __init__(self, folder: str, key: str):
        self.path = Path(folder) / (hashlib.sha256(key.encode()).hexdigest() + ".lock")

    def __enter__(self):
        self.path.parent.mkdir(parents=True, exist_ok=True)
        os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        return self

    def __exit__(self, *_):
        self.path.unlink()


def run_job(spark: SparkSession, root: str, job: Job, get, now: datetime, season: int | None = None) -> dict:
    """One landing with its journal: success, skipped_not_modified, skipped or failed."""
    journal, run = Journal(spark, root), uuid.uuid4().hex
    season = season if job.seasonal else None
    base = {"run_id": run, "source": job.source, "asset": job.asset, "season": season, "started_at": now.replace(tzinfo=None)}
    journal.append(**base, finished_at=None, status="running", etag=None, rows=None, error=None)
    status, tag, rows, error = "failed", None, None, None
    try:
        got = fetch(get, job.address(season), journal.last_tag(job.source, job.asset, season))
        if isinstance(got, NotModified):
            status = "skipped_not_modified"
        elif isinstance(got, NotFound):
            status, error = ("skipped", None) if job.seasonal else ("failed", "not found")
        else:
            df = validate(job.parse(spark, got.body), job.asset, season)
            if job.persist:  # state first, lake second: a repeated run repairs either
                job.persist(df)
            tag = got.etag or body_tag(got.body)
            try:
                rows, status = land(df, root, job.source, job.asset, job.keys(season, scrape_date(now))), "success"
            except PartitionExists:
                status = "skipped"
    except Exception as e:
        error = str(e)[:ERROR_CHARS]
    journal.append(**base, finished_at=datetime.now(UTC).replace(tzinfo=None), status=status, etag=tag, rows=rows, error=error)
    return base | {"status": status, "rows": rows, "error": error}


def report_json(result: dict) -> str:
    return json.dumps(result, default=str, sort_keys=True)


class StateChanged(RuntimeError):
    """Another writer committed since the state was read; read again and repeat."""


class State:
    """Versioned state tables: new snapshots become visible together by one numbered manifest.

    The highest number counts.  A manifest appears whole, by a rename that does not overwrite, so
    a reader sees the old or the new state and of two writers one gets ``StateChanged``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _newest(self) -> tuple[int, dict[str, str]]:
        fs, at = _fs(self.spark, f"{self.root}/manifests")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()] if fs.exists(at) else []
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/manifests/{max(numbers):012d}").collect()
        return max(numbers), json.loads("\n".join(r[0] for r in text))

    def version(self) -> int:
        return self._newest()[0]

    def names(self) -> set[str]:
        return set(self._newest()[1])

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self._newest()[1][table])

    def commit(self, tables: dict[str, DataFrame], expected: int | None = None, check: Callable[[dict[str, DataFrame]], None] | None = None) -> None:
        """Write all snapshots, then switch; a failure before leaves the old state as it was.

        expected: the version that the tables were made from; if another one counts by now, the
        commit is refused.  check: looks at the written snapshots and raises to refuse them."""
        number, old = self._newest()
        if expected is not None and number != expected:
            raise StateChanged(f"{self.root} is at {number}, not at {expected}")
        made = {}
        for name, df in tables.items():
            made[name] = f"{self.root}/{name}/v={uuid.uuid4().hex}"
            df.write.option("compression", "zstd").parquet(made[name])
        if check:
            check({name: self.spark.read.schema(tables[name].schema).parquet(path) for name, path in made.items()})
        fs, temp = _fs(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(old | made), "utf-8"))
        out.close()
        _, at = _fs(self.spark, f"{self.root}/manifests/{number + 1:012d}")
        if not _rename_new(self.spark, temp, at):
            fs.delete(temp, False)
            raise StateChanged(f"{self.root} is at {number + 1} already")
