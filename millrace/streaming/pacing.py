"""More keyed folds: pacing by tokens, by additive increase and by what a server's headers say; retries; micro-batches.

Like those of state.py, each has state and one step on a key's events in order of time, and runs with state.batch.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass
class Pacer:
    """Each request waits for a token: tokens come at `rate` a second, up to `burst`; waiting requests queue up."""

    rate: float
    burst: float = 1.0
    tokens: float = -1.0
    at: float = 0.0

    def step(self, ms: int, row: dict) -> dict:
        if self.tokens < 0:
            self.tokens, self.at = self.burst, ms
        now = max(float(ms), self.at)
        self.tokens = min(self.burst, self.tokens + (now - self.at) * self.rate / 1000)
        wait = max(0.0, (1 - self.tokens) / self.rate * 1000)
        self.tokens += wait * self.rate / 1000 - 1
        self.at = now + wait
        return {"sent_ms": round(self.at, 3), "wait_ms": round(self.at - ms, 3)}

    def set_rate(self, rate: float, ms: float) -> None:
        """Another rate; what has come till now comes at the old one."""
        self.tokens = min(self.burst, self.tokens + max(0.0, ms - self.at) * self.rate / 1000)
        self.at, self.rate = max(self.at, ms), rate


@dataclass
class Aimd:
    """A rate that rises by `step_up` with each success and is cut to `cut` of it by a refusal; refusals within `hold` ms of
    a cut belong to it and change nothing. Between `least` and `most`."""

    rate: float
    step_up: float = 0.1
    cut: float = 0.5
    hold: int = 1000
    least: float = 0.1
    most: float = 1000.0
    cut_at: float = -math.inf

    def step(self, ms: int, row: dict) -> dict:
        if row["ok"]:
            self.rate = min(self.most, self.rate + self.step_up)
        elif ms - self.cut_at >= self.hold:
            self.rate, self.cut_at = max(self.least, self.rate * self.cut), ms
        return {"rate": round(self.rate, 6)}


@dataclass
class Headers:
    """Estimates a server's refill from the remaining tokens it tells: the change plus what it admitted, over windows of
    `window` ms or more, smoothed by `weight`; windows that end at the cap only tell that there is at least so much, and
    the estimate probes upwards by `probe` a second for each second."""

    cap: float
    window: int = 500
    weight: float = 0.5
    probe: float = 2.0
    estimate: float = 0.0
    start: float = -1.0
    remaining: float = 0.0
    admitted: int = 0

    def step(self, ms: int, row: dict) -> dict:
        if self.start < 0:
            self.start, self.remaining = ms, float(row["remaining"])
            return {"estimate": round(self.estimate, 6)}
        self.admitted += 1
        span = ms - self.start
        if span >= self.window:
            seen = (float(row["remaining"]) - self.remaining + self.admitted) / span * 1000
            if row["remaining"] >= self.cap:
                self.estimate = max(self.estimate, seen) + self.probe * span / 1000
            else:
                self.estimate = seen if not self.estimate else self.weight * seen + (1 - self.weight) * self.estimate
            self.start, self.remaining, self.admitted = ms, float(row["remaining"]), 0
        return {"estimate": round(self.estimate, 6)}


@dataclass
class Batches:
    """Items are collected until there are `size`, or until the first has waited `wait` ms; which batch an item is in, and
    when its batch closes at the latest."""

    size: int
    wait: int
    number: int = 0
    held: int = 0
    opened: float = -math.inf

    def step(self, ms: int, row: dict) -> dict:
        if self.held and (self.held >= self.size or ms >= self.opened + self.wait):
            self.number, self.held = self.number + 1, 0
        if not self.held:
            self.opened = ms
        self.held += 1
        return {"batch": self.number, "closes_ms": int(self.opened + self.wait)}


@dataclass
class Probe:
    """Concurrency limit: an event asks for a slot at its time and holds it for `busy_ms`; it waits for the first that is free."""

    slots: int
    free: list = field(default_factory=list)

    def step(self, ms: int, row: dict) -> dict:
        self.free = sorted(self.free)
        start = float(ms) if len(self.free) < self.slots else max(float(ms), self.free.pop(0))
        self.free.append(start + float(row["busy_ms"]))
        return {"start_ms": round(start, 3), "end_ms": round(start + float(row["busy_ms"]), 3)}


def retried(outcomes: list[bool], delays: list[float], start: float, latency: float) -> dict:
    """A request's attempts until the first success or the last allowed one: when each is sent, and how it ends."""
    at, sent = start, []
    for k, ok in enumerate(outcomes):
        sent.append(round(at, 3))
        at += latency
        if ok:
            return {"ok": True, "attempts": k + 1, "sent_ms": sent, "end_ms": round(at, 3)}
        if k < len(delays):
            at += delays[k]
        else:
            break
    return {"ok": False, "attempts": len(sent), "sent_ms": sent, "end_ms": round(at, 3)}
