"""Hourly weather from an HTTP service, as a Spark data source, and from stored responses.

The batch source `station_hours` makes one partition a location and calendar block, so that a lost
task asks for its own block again. `responses` names a folder of stored JSON answers, one a
location, to be read instead of the service; tests and closed networks use it.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.weather import sun_position
from ..operators import cube
from ..registry import LOCATIONS, SUN_VARIABLES, VARIABLES, as_list, checked_locations, checked_variables, converted, request_parameters, source_columns
from . import cache, pacing

# The service's addresses, the models pinned for each, the first day of the counts, read timeouts, retries and waits in seconds, words of a refusal.
SERVICES = {"archive": "https://archive-api.open-meteo.com/v1/archive", "forecast": "https://api.open-meteo.com/v1/forecast"}
MODELS = {"archive": "era5", "forecast": "ecmwf_ifs025"}
FIRST_DAY = "1966-01-01"
TIMEOUTS = {"archive": 300, "forecast": 60}
RETRIES, BACKOFF, LIMIT_WAIT, LIMIT_WORDS = 5, 0.2, 90, "limit exceeded"
#: Seconds for which an answer of the forecast service may be used again.
ANSWER_AGE = 3600


class RateLimited(RuntimeError):
    """The service went on refusing a request for its rate."""


def _refusal(body: bytes | str) -> str | None:
    """The reason why the service refuses, as it stands in an answer; null if it doesn't."""
    try:
        answer = json.loads(body)
    except ValueError:
        return None
    return str(answer.get("reason", "no reason given")) if isinstance(answer, dict) and answer.get("error") else None


def fetched(url: str, timeout: float, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep, get: Callable | None = None, leave: Callable[[], None] = lambda: None) -> dict:
    """The JSON answer of url; failures are tried again after ever longer waits, refusals for their rate after LIMIT_WAIT.

    The service tells of an exceeded limit by status 429 or in an ordinary answer. Any other refusal
    is an error at once. leave() is called before every try.
    """
    get = get or (lambda u, t: urllib.request.urlopen(u, timeout=t).read())
    for attempt in range(retries + 1):
        leave()
        pause = BACKOFF * 2**attempt
        try:
            body, code = get(url, timeout), 200
        except urllib.error.HTTPError as e:
            body, code = e.read() if e.fp else b"", e.code
            if code not in (400, 429, 500, 502, 503, 504):
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == retries:
                raise
            wait(pause)
            continue
        reason = _refusal(body)
        limited = code == 429 or reason is not None and LIMIT_WORDS in reason.lower()
        if code == 200 and reason is None:
            return json.loads(body)
        if not limited and code in (200, 400):
            raise ValueError(f"the service refuses: {reason or f'status {code}'}")
        if attempt == retries:
            raise RateLimited(reason or "status 429") if limited else urllib.error.HTTPError(url, code, reason or "the service fails", None, None)
        wait(LIMIT_WAIT if limited else pause)
    raise AssertionError("unreachable")


def kept_answer(folder: str, key: str, fetch: Callable[[], dict], most_age: float = ANSWER_AGE, clock: Callable[[], float] = time.time) -> dict:
    """The answer to a request, from the shared folder if it was put there less than most_age seconds ago, else fetched and put there whole."""
    path = os.path.join(folder, hashlib.sha256(key.encode()).hexdigest() + ".json")
    try:
        with open(path) as f:
            kept = json.load(f)
        if kept["key"] == key and 0 <= clock() - kept["at"] < most_age:
            return kept["answer"]
    except (FileNotFoundError, ValueError, KeyError):  # none yet, or not one of ours
        pass
    answer = fetch()
    os.makedirs(folder, exist_ok=True)
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "w") as f:
        json.dump({"key": key, "at": clock(), "answer": answer}, f)
    os.replace(made, path)
    return answer


def rows_of(location: str, answer: dict, columns: list[str]) -> Iterator[tuple]:
    """location, datetime and the columns of an answer's hours; times run from `start` in steps of `interval`, its end left out."""
    hourly = answer["hourly"]
    if "time" in hourly:
        times = [datetime.datetime.fromisoformat(t) for t in hourly["time"]]
    else:
        start = datetime.datetime.fromtimestamp(hourly["start"], datetime.UTC).replace(tzinfo=None)
        n = (hourly["end"] - hourly["start"]) // hourly["interval"]
        times = [start + datetime.timedelta(seconds=hourly["interval"] * i) for i in range(n)]
    values = [hourly[c] for c in columns]
    for i, t in enumerate(times):
        yield (location, t, *[None if v[i] is None or v[i] != v[i] else float(v[i]) for v in values])


class _Block(InputPartition):
    def __init__(self, location: str, lo: str, hi: str):
        self.location, self.lo, self.hi = location, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.service = options.get("service", "archive")
        self.locations, self.columns = json.loads(options["locations"]), json.loads(options["columns"])
        self.parameters, self.responses = json.loads(options.get("parameters", "{}")), (options.get("responses") or "").removeprefix("file://")
        self.pacer, self.answers, self.most_age = options.get("pacer"), options.get("answers"), float(options.get("mostage", ANSWER_AGE))
        self.start, self.end, self.years = options.get("start"), options.get("end"), int(options.get("chunkyears", options.get("chunkYears", 1)))

    def partitions(self):
        if self.service == "forecast":
            return [_Block(x, "", "") for x in self.locations]
        start, end = datetime.date.fromisoformat(self.start), datetime.date.fromisoformat(self.end)
        blocks = cache.chunks(start, end, self.years)
        return [_Block(x, max(lo, start).isoformat(), hi.isoformat()) for x in self.locations for lo, hi, _, _ in blocks]

    def _leave(self, partition):
        """Waits for its turn where requests are paced."""
        if self.pacer:
            days = (datetime.date.fromisoformat(partition.hi) - datetime.date.fromisoformat(partition.lo)).days + 1 if partition.lo else 1
            pacing.ask(self.pacer, cache.call_weight(days, len(self.columns)))

    def read(self, partition):
        lat, lon = self.locations[partition.location]
        if self.responses:
            self._leave(partition)
            with open(f"{self.responses}/{partition.location}.json") as f:
                answer = json.load(f)
        else:
            dates = {"start_date": partition.lo, "end_date": partition.hi} if partition.lo else {}
            asked = {**self.parameters, **dates, "latitude": lat, "longitude": lon, "models": MODELS[self.service]}
            url = f"{SERVICES[self.service]}?{urllib.parse.urlencode(asked)}"
            ask = lambda: fetched(url, TIMEOUTS[self.service], leave=lambda: self._leave(partition))
            # Forecasts are asked for again and again; an archive's block is read once.
            answer = kept_answer(self.answers, url, ask, self.most_age) if self.answers and self.service == "forecast" else ask()
        for row in rows_of(partition.location, answer, self.columns):
            if not partition.lo or partition.lo <= row[1].date().isoformat() <= partition.hi:
                yield row


class StationHours(DataSource):
    """location, datetime and the source columns asked for, by hour (UTC)."""

    @classmethod
    def name(cls) -> str:
        return "station_hours"

    def schema(self) -> str:
        return "location string, datetime timestamp, " + ", ".join(f"`{c}` double" for c in json.loads(self.options["columns"]))

    def reader(self, schema):
        return _Reader(dict(self.options))


def _read(spark: SparkSession, service: str, locations, variables, options: dict, add_sun: bool) -> DataFrame:
    names = [v for v in variables if v not in SUN_VARIABLES]
    spark.dataSource.register(StationHours)
    places = checked_locations(locations)
    source = spark.read.format("station_hours").option("service", service).option("locations", json.dumps(places)).option("columns", json.dumps(source_columns(names)))
    hours = source.option("parameters", json.dumps(request_parameters(names) | options.pop("parameters", {}))).options(**{k: v for k, v in options.items() if v is not None}).load()
    out = hours.select("location", "datetime", *converted(names))
    return with_sun(out) if add_sun or len(names) < len(variables) else out


def with_sun(hours: DataFrame) -> DataFrame:
    """Adds the sun's altitude and azimuth at each hour and location; they are computed, never stored."""
    pairs = [x for n, (lat, lon) in LOCATIONS.items() for x in (F.lit(n), F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon")))]
    place = F.create_map(*pairs)[F.col("location")]
    altitude, azimuth = sun_position(F.unix_seconds(F.col("datetime").cast("timestamp")).cast("double"), place["lat"], place["lon"])
    return hours.withColumns({"sun_altitude": altitude, "sun_azimuth": azimuth})


def archive(spark: SparkSession, locations, variables, start: str, end: str, add_sun: bool = False, responses: str | None = None, chunk_years: int = 1, pacer: str | None = None) -> DataFrame:
    """Hours of the archive; with `pacer`, the address of a pacing.Pacer, every request waits for its leave."""
    variables = checked_variables(variables, "archive")
    return _read(spark, "archive", locations, variables, {"start": start, "end": end, "chunkYears": str(chunk_years), "responses": responses, "pacer": pacer}, add_sun)


def fill_cache(spark: SparkSession, to: str, locations=None, start: str = FIRST_DAY, end: str | None = None, years: int = 5, overwrite: bool = False, limits=pacing.LIMITS,
               together: int = 4, most_wait: float = 3600, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, responses: str | None = None) -> cache.Backfill:
    """Brings the cache `to` up to date with the archive, all its variables, within the service's limits.

    What earlier runs asked within a day is remembered beside the cache and counts. A run takes the
    blocks that the day still allows, `together` at a time, and leaves the others (`waiting`) for the
    next. An error leaves all written blocks in place and goes on to the caller.
    """
    locations = as_list(locations or LOCATIONS)
    names = [v for v, spec in VARIABLES.items() if spec.archived]
    n_columns, log = len(source_columns(names)), f"{to.rstrip('/')}-requests"
    days = lambda lo, hi: (datetime.date.fromisoformat(hi) - datetime.date.fromisoformat(lo)).days + 1
    known = pacing.recent(spark, log, clock() - max(limits)[0])
    ledger = pacing.Ledger(limits, clock, known)
    last = datetime.date.fromisoformat(end) if end else cache.default_end()
    before = set(known)
    host = "127.0.0.1" if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.driver.host")
    with pacing.Pacer(ledger, host, most_wait, sleep) as pacer:
        fetch = lambda some, lo, hi: archive(spark, some, names, lo, hi, responses=responses, chunk_years=years, pacer=pacer.address)
        try:
            return cache.backfill(spark, to, locations, datetime.date.fromisoformat(start), last, years, fetch, lambda lo, hi: cache.call_weight(days(lo, hi), n_columns), ledger.left(), together, overwrite)
        finally:
            if new := [x for x in ledger.spent if x not in before]:
                pacing.keep(spark, log, new)


def forecast(spark: SparkSession, locations, variables, lag_days: int = 0, forecast_days: int = 0, add_sun: bool = False, responses: str | None = None, answers: str | None = None, most_age: float = ANSWER_AGE) -> DataFrame:
    """Hours of the forecast; with `answers`, a folder that all tasks share, a request made less than most_age seconds ago is not made again."""
    variables = checked_variables(variables, "forecast")
    return _read(spark, "forecast", locations, variables, {"parameters": {"past_days": lag_days, "forecast_days": forecast_days + 1}, "responses": responses, "answers": answers, "mostage": str(most_age)}, add_sun)


def weather(spark: SparkSession, locations, variables, source: str = "cache", resolution: str = "hourly", cache_dir: str | None = None, years=None, doy: tuple[int, int] | None = None,
            start: str | None = None, end: str | None = None, lag_days: int = 0, forecast_days: int = 0, add_sun: bool = False, responses: str | None = None) -> DataFrame:
    """Hours, or days with their lags, from the cache, the archive or a forecast.

    Daily values of a date are there only if every variable, location and lag is known.
    """
    if source not in ("cache", "archive", "forecast") or resolution not in ("hourly", "daily"):
        raise ValueError("source is cache, archive or forecast; resolution is hourly or daily")
    if resolution == "daily" and lag_days < 1:
        raise ValueError("daily values need a lag of at least one day")
    if resolution == "daily" and (sun := [v for v in as_list(variables) if v in SUN_VARIABLES]):
        raise ValueError(f"{sun} have no daily value")
    if source == "cache" and not cache_dir:
        raise ValueError("the cache's folder is needed")
    if source == "archive" and not (start and end):
        raise ValueError("the archive needs a first and a last day")
    locations, variables = as_list(locations), checked_variables(variables, source)
    checked_locations(locations)
    stored = [v for v in variables if v not in SUN_VARIABLES]
    if source == "cache":
        wide = cache.widened_doy(doy, lag_days) if doy and resolution == "daily" else doy
        hours = cache.load(spark, cache_dir, locations, stored, years, wide).drop("year", "doy")
        hours = with_sun(hours) if add_sun or len(stored) < len(variables) else hours
    elif source == "archive":
        hours = archive(spark, locations, variables, start, end, add_sun, responses)
    else:
        hours = forecast(spark, locations, variables, lag_days, forecast_days, add_sun, responses)
    if resolution == "hourly":
        return cube.checked_unique(hours, ("location", "datetime"))
    long = hours.select("location", F.to_date("datetime").alias("date"), F.hour("datetime").alias("hour"), *stored)
    days = cube.daily(cube.dense(cube.checked_unique(long)), {v: VARIABLES[v].daily for v in stored})
    lagged = cube.keep_complete(cube.lags(days, lag_days, tuple(stored)), tuple(stored), len(locations) * lag_days)
    return lagged.where(F.dayofyear("date").between(*doy)) if doy else lagged
