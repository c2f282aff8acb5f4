"""Keyed stateful folds over time-ordered events: token bucket, circuit breakers, retry budget, prefix cache.

Each fold is a class with state and one step; `batch` runs it over a table, a key's rows in order of time in
one group; `stream` runs the same step with Structured Streaming state, so both give the same rows. A key's
events are a sequence by definition; keys are spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class TokenBucket:
    """Starts full; refills lazily at `rate` tokens a second up to `burst`; an event takes one token or is refused."""

    rate: float
    burst: float
    tokens: float = -1.0
    at: int = 0

    def step(self, ms: int, row: dict) -> dict:
        if self.tokens < 0:
            self.tokens, self.at = self.burst, ms
        self.tokens = min(self.burst, self.tokens + max(0, ms - self.at) * self.rate / 1000)
        self.at = max(ms, self.at)
        ok = self.tokens >= 1
        if ok:
            self.tokens -= 1
        return {"admitted": ok, "level": round(self.tokens, 6)}


@dataclass
class Breaker:
    """Opens after `limit` failures in a row; after `cooldown` ms one probe is let through, which closes or reopens it."""

    limit: int
    cooldown: int
    failures: int = 0
    open_at: int = -1

    def step(self, ms: int, row: dict) -> dict:
        if self.open_at >= 0 and ms - self.open_at < self.cooldown:
            return {"passed": False, "state": "open"}
        probe = self.open_at >= 0
        if row["ok"]:
            self.failures, self.open_at = 0, -1
            return {"passed": True, "state": "closed"}
        self.failures += 1
        if probe or self.failures >= self.limit:
            self.open_at, self.failures = ms, 0
            return {"passed": True, "state": "open"}
        return {"passed": True, "state": "closed"}


@dataclass
class RollingBreaker:
    """Opens when, of at least `volume` events in (now - width, now], a share of `share` or more failed; the window is
    then cleared. While open, for `cooldown` ms, nothing passes or counts."""

    width: int
    volume: int
    share: float
    cooldown: int
    window: list | None = None
    open_at: int = -1

    def step(self, ms: int, row: dict) -> dict:
        if self.open_at >= 0 and ms - self.open_at < self.cooldown:
            return {"passed": False, "state": "open"}
        self.open_at = -1
        self.window = [w for w in self.window or [] if w[0] > ms - self.width] + [[ms, bool(row["ok"])]]
        failed = sum(not ok for _, ok in self.window)
        if len(self.window) >= self.volume and failed >= self.share * len(self.window):
            self.open_at, self.window = ms, []
            return {"passed": True, "state": "open"}
        return {"passed": True, "state": "closed"}


@dataclass
class RetryBudget:
    """Starts at `cap`; a first attempt earns `ratio`, up to the cap; a retry costs 1 or is refused."""

    ratio: float
    cap: float
    left: float = -1.0

    def step(self, ms: int, row: dict) -> dict:
        if self.left < 0:
            self.left = self.cap
        if not row["retry"]:
            self.left = min(self.cap, self.left + self.ratio)
            return {"allowed": True, "left": round(self.left, 6)}
        ok = self.left >= 1
        if ok:
            self.left -= 1
        return {"allowed": ok, "left": round(self.left, 6)}


@dataclass
class PrefixCache:
    """Requests are lists of block digests and sizes. The longest live cached prefix is read at `read` times the price
    and lives on; what is new is written at `write` times the price if the whole has `least` tokens."""

    ttl: int
    least: int = 1024
    read: float = 0.1
    write: float = 1.25
    live: dict | None = None

    def step(self, ms: int, row: dict) -> dict:
        live = {k: v for k, v in (self.live or {}).items() if v > ms}
        digests, sizes = list(row["digests"]), [int(x) for x in row["sizes"]]
        keys = ["/".join(digests[: k + 1]) for k in range(len(digests))]
        hit = max((k + 1 for k, key in enumerate(keys) if key in live), default=0)
        total, cached = sum(sizes), sum(sizes[:hit])
        written = total - cached if total >= self.least else 0
        if hit:
            live[keys[hit - 1]] = ms + self.ttl
        if written and keys:
            live[keys[-1]] = ms + self.ttl
        self.live = live
        return {"cached": cached, "written": written, "billed": round(cached * self.read + written * self.write + (total - cached - written), 6)}


def batch(events: DataFrame, key: str, fold: Callable[[], object], out: str) -> DataFrame:
    """events (key, event_id, ms, …) to (key, event_id, out): a key's rows by ms and event_id."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ms", "event_id"], kind="stable")
        f = fold()
        found = [f.step(int(r["ms"]), r) for r in rows.to_dict("records")]
        return pd.concat([rows[[key, "event_id"]].reset_index(drop=True), pd.DataFrame(found)], axis=1)

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandas(run, f"{key} {kind}, event_id long, {out}")


def stream(events: DataFrame, key: str, fold: Callable[[], object], out: str) -> DataFrame:
    """The same of a stream; state is the fold's fields as JSON."""

    def run(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        f = fold()
        if state.exists:
            for name, value in json.loads(state.get[0]).items():
                setattr(f, name, value)
        rows = pd.concat(list(chunks)).sort_values(["ms", "event_id"], kind="stable")
        found = [f.step(int(r["ms"]), r) for r in rows.to_dict("records")]
        state.update((json.dumps(asdict(f)),))
        yield pd.concat([rows[[key, "event_id"]].reset_index(drop=True), pd.DataFrame(found)], axis=1)

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, {out}", "state string", "append", GroupStateTimeout.NoTimeout)
