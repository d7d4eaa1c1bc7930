"""Requests of many tasks kept within a service's limits: one ledger on the driver that every task asks first.

A task opens a connection to the driver, names the weight of its request and waits for leave. Leave is
given in order of asking, at a time when the request fits into every rolling window, so neither the
number of tasks nor a lost task's second try can exceed the limits.
"""

from __future__ import annotations

import secrets
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable
from multiprocessing.connection import Client, Listener

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Weighted calls that the free service allows in a minute, an hour and a day.
LIMITS = ((60, 600), (3600, 5_000), (86_400, 10_000))
WAITING = 4096


class BudgetSpent(RuntimeError):
    """Leave would come later than the run is willing to wait."""


class Ledger:
    """Weights and times of the requests made, against limits (seconds, most weight) of rolling windows."""

    def __init__(self, limits: Iterable[tuple[float, float]] = LIMITS, clock: Callable[[], float] = time.time, spent: Iterable[tuple[float, float]] = ()):
        self.limits, self.clock = tuple(limits), clock
        self._kept = max(seconds for seconds, _ in self.limits)
        self.spent = deque(sorted(spent))

    def left(self) -> float:
        """What the longest window still allows now."""
        seconds, most = max(self.limits)
        return most - sum(w for t, w in self.spent if t > self.clock() - seconds)

    def wait(self, weight: float) -> float:
        """Seconds until a request of this weight fits into every window; a weight beyond a limit is an error."""
        now, wait = self.clock(), 0.0
        while self.spent and self.spent[0][0] <= now - self._kept:
            self.spent.popleft()
        for seconds, most in self.limits:
            if weight > most:
                raise ValueError(f"a request of weight {weight:g} never fits into {most:g} in {seconds:g} seconds")
            over = sum(w for t, w in self.spent if t > now - seconds) + weight - most
            for t, w in self.spent:  # the oldest in the window leave it first
                if over <= 1e-9:
                    break
                if t > now - seconds:
                    over, wait = over - w, max(wait, t + seconds - now)
        return wait

    def add(self, weight: float) -> None:
        self.spent.append((self.clock(), weight))


class Pacer:
    """Serves a ledger to tasks while the `with` block lasts; `address` goes to them as text.

    Whoever has to wait for longer than `most_wait` seconds is refused instead, with BudgetSpent.
    """

    def __init__(self, ledger: Ledger, host: str = "127.0.0.1", most_wait: float = 3600, sleep: Callable[[float], None] = time.sleep):
        self.ledger, self.most_wait, self.sleep, self._key = ledger, most_wait, sleep, secrets.token_hex(16)
        self._listener = Listener((host, 0), backlog=WAITING, authkey=self._key.encode())
        self.address = f"{host}:{self._listener.address[1]}:{self._key}"

    def __enter__(self) -> Pacer:
        self._thread = threading.Thread(target=self._serve, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._ended = True
        try:
            ask(self.address, 0.0)
        except (OSError, EOFError, BudgetSpent):
            pass
        self._thread.join(10)
        self._listener.close()

    _ended = False

    def _serve(self) -> None:
        while not self._ended:
            try:
                with self._listener.accept() as caller:
                    try:
                        caller.send(self._leave(float(caller.recv())))
                    except ValueError as e:
                        caller.send(("never", str(e)))
            except Exception:  # noqa: BLE001  a caller that went away or had no key must not end the others' service
                continue

    def _leave(self, weight: float) -> tuple[str, str]:
        while (wait := self.ledger.wait(weight)) > 0:
            if wait > self.most_wait:
                return "spent", f"the limits leave no room for {wait:.0f} seconds"
            self.sleep(max(wait, 1e-3))
        if weight:
            self.ledger.add(weight)
        return "go", ""


def ask(address: str, weight: float) -> None:
    """Waits until the ledger at this address has room for a request of this weight, and takes it."""
    host, port, key = address.split(":")
    with Client((host, int(port)), authkey=key.encode()) as driver:
        driver.send(weight)
        said, why = driver.recv()
    if said != "go":
        raise BudgetSpent(why) if said == "spent" else ValueError(why)


def recent(spark: SparkSession, path: str, since: float) -> list[tuple[float, float]]:
    """Requests (time, weight) that earlier runs left at path; none if there are none."""
    try:
        rows = spark.read.parquet(path).where(F.col("at") > since).select("at", "weight").collect()  # a day's requests at most
    except AnalysisException:
        return []
    return [(r["at"], r["weight"]) for r in rows]


def keep(spark: SparkSession, path: str, spent: Iterable[tuple[float, float]]) -> DataFrame:
    """Adds requests to those at path."""
    df = spark.createDataFrame([(float(t), float(w)) for t, w in spent], "at double, weight double").coalesce(1)
    df.write.mode("append").parquet(path)
    return df
