"""A fantasy platform's REST answers as a Spark data source, and its eleven payloads as rows.

``spark.read.format("platform")`` asks for a list of addresses and returns one row for each
answer: the body as text, untouched.  Addresses are dealt over ``parallel`` tasks; each task has its
part of the allowed rate and of the burst, so all tasks together keep the platform's limit without
talking to each other, and a task that is run again asks only for its own addresses.

``payload`` turns bodies into rows by the endpoint's schema: unknown keys are ignored, null lists
and maps are empty, a body that is not JSON is an error, a list gives a row for each element.

A missing address is an error (as is one that is forbidden), unless ``missing`` is ``skip``.  The
transport is ``base`` (http, https, or a folder of recorded answers as ``file://``)."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.workers import ship
from ..operators.relational import ContractError, duplicates
from .lake import NotFound, fetch

# Addresses and fields of the platform's answers.
PATHS = {
    "state": "/state/nfl",
    "user": "/user/{user}",
    "user_leagues": "/user/{user}/leagues/nfl/{season}",
    "league": "/league/{league}",
    "rosters": "/league/{league}/rosters",
    "users": "/league/{league}/users",
    "matchups": "/league/{league}/matchups/{week}",
    "transactions": "/league/{league}/transactions/{week}",
    "drafts": "/league/{league}/drafts",
    "draft": "/draft/{draft}",
    "picks": "/draft/{draft}/picks",
}
LISTS = ("user_leagues", "rosters", "users", "matchups", "transactions", "drafts", "picks")
_USER = "user_id string, username string, display_name string, is_owner boolean, metadata map<string,string>"
_LEAGUE = (
    "league_id string, name string, season string, season_type string, status string, total_rosters int, draft_id string, previous_league_id string, "
    "roster_positions array<string>, scoring_settings map<string,double>, settings map<string,double>, metadata map<string,string>"
)
_DRAFT = (
    "draft_id string, league_id string, season string, type string, status string, start_time bigint, last_picked bigint, "
    "draft_order map<string,int>, slot_to_roster_id map<string,int>, settings map<string,double>, metadata map<string,string>"
)
SCHEMAS = {
    "state": "week int, leg int, season string, season_type string, display_week int, previous_season string",
    "user": _USER,
    "users": _USER,
    "league": _LEAGUE,
    "user_leagues": _LEAGUE,
    "rosters": "roster_id int, league_id string, owner_id string, co_owners array<string>, starters array<string>, players array<string>, reserve array<string>, taxi array<string>, settings map<string,double>, metadata map<string,string>",
    "matchups": "roster_id int, matchup_id int, points double, starters array<string>, players array<string>, starters_points array<double>, players_points map<string,double>",
    "transactions": "transaction_id string, type string, status string, leg int, created bigint, creator string, roster_ids array<int>, adds map<string,int>, drops map<string,int>, settings map<string,double>",
    "drafts": _DRAFT,
    "draft": _DRAFT,
    "picks": "pick_no int, round int, draft_slot int, roster_id int, player_id string, picked_by string, is_keeper boolean, metadata map<string,string>",
}
RATE, BURST, PARALLEL = 300.0, 30, 4
ANSWERS = "endpoint string, path string, asked string, body string"


class Bucket:
    """Permission to ask, ``rate`` times a minute with ``burst`` at once."""

    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.each, self.most, self.clock, self.sleep = 60.0 / rate, max(1.0, burst), clock, sleep
        self.left, self.at = self.most, clock()

    def take(self) -> None:
        now = self.clock()
        self.left, self.at = min(self.most, self.left + (now - self.at) / self.each), now
        if self.left < 1:
            wait = (1 - self.left) * self.each
            self.sleep(wait)
            self.left, self.at = 1.0, self.clock()
        self.left -= 1


class Asked(InputPartition):
    def __init__(self, requests: list[dict]):
        self.requests = requests


def _get(url: str, headers: dict) -> tuple[int, dict, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=10) as got:
            return getattr(got, "status", None) or 200, dict(got.headers), got.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), b""
    except urllib.error.URLError as e:
        if isinstance(e.reason, FileNotFoundError):  # a recorded answer that is not there
            return 404, {}, b""
        raise OSError(str(e.reason)) from e


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["base"].rstrip("/")
        self.requests = json.loads(options["requests"])
        self.parallel = max(1, min(int(options.get("parallel", PARALLEL)), len(self.requests)))
        self.rate, self.burst = float(options.get("rate", RATE)), float(options.get("burst", BURST))
        self.missing, self.suffix = options.get("missing", "error"), options.get("suffix", "")
        for r in self.requests:
            PATHS[r["endpoint"]].format(**r)  # every address can be told before any is asked

    def partitions(self) -> list[Asked]:
        return [Asked(self.requests[k :: self.parallel]) for k in range(self.parallel)]

    def read(self, partition: Asked) -> Iterator[tuple]:
        bucket = Bucket(self.rate / self.parallel, self.burst / self.parallel)

        def get(url, headers):
            bucket.take()
            return _get(url, headers)

        for r in partition.requests:
            path = PATHS[r["endpoint"]].format(**r)
            got = fetch(get, f"{self.base}{path}{self.suffix}")
            if isinstance(got, NotFound):
                if self.missing == "skip":
                    continue
                raise FileNotFoundError(f"the platform has no {path}")
            yield r["endpoint"], path, json.dumps(r, sort_keys=True), got.body.decode("utf-8")


class Platform(DataSource):
    """options: base, requests (a JSON list of {endpoint, ...}), parallel, rate, burst, missing, suffix."""

    @classmethod
    def name(cls) -> str:
        return "platform"

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def ask(spark: SparkSession, base: str, requests: list[dict], **options) -> DataFrame:
    """Answers to all requests; nothing is asked before the frame is used."""
    ship(spark)
    spark.dataSource.register(Platform)
    if not requests:
        return spark.createDataFrame([], ANSWERS)
    reader = spark.read.format("platform").option("base", base).option("requests", json.dumps(requests))
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def _filled(name: str, kind: T.DataType) -> Column:
    """Null lists and maps as empty ones, elements without null."""
    c = F.col(name)
    if isinstance(kind, T.ArrayType):
        return F.coalesce(c, F.array().cast(kind))
    if isinstance(kind, T.MapType):
        return F.coalesce(c, F.create_map().cast(kind))
    return c


def payload(answers: DataFrame, endpoint: str) -> DataFrame:
    """Rows of one endpoint's answers, with the address they came from and the request's own fields."""
    fields = T.StructType.fromDDL(SCHEMAS[endpoint])
    many = endpoint in LISTS
    kind = T.ArrayType(fields) if many else fields
    rows = answers.where(F.col("endpoint") == endpoint)
    body = F.from_json("body", kind, {"mode": "FAILFAST"})
    rows = rows.select("path", F.from_json("asked", "map<string,string>").alias("asked"), (F.explode(body) if many else body).alias("r"))
    return rows.select("path", "asked", "r.*").select("path", "asked", *[_filled(f.name, f.dataType).alias(f.name) for f in fields.fields])


def catalogue(rows: DataFrame, key: str = "player_id") -> DataFrame:
    """The newest player catalogue as a reference map; an id that stands twice is an error."""
    twice = duplicates(rows, [key]).head(5)
    if twice:
        raise ContractError(f"ids that stand more than once in the catalogue: {[r[0] for r in twice]}")
    return rows
