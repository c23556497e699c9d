"""Radar readings of one device from its raw states, message by message."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, floor, isnan
from statistics import median

from ..operators import radar


class Bridge:
    """The states of one device between two batches of its messages. scale stretches the spans of time of movement, smoothing and apnea."""

    def __init__(self, period: float, stale: float, memory: tuple | None = None, scale: float = 1.0):
        self.period, self.stale = period, stale
        self.move_s, self.smooth_s, self.hold_s, self.prior_s = (scale * x for x in (radar.MOVE_WINDOW_S, radar.SMOOTH_S, radar.APNEA_HOLD_S, radar.APNEA_PRIOR_S))
        self.t, self.tick, self.breath, self.distance, self.presence, self.since, self.valid, near, rates = memory or (None, None, None, None, None, None, None, [], [])
        self.near, self.rates = [tuple(x) for x in near or []], [tuple(x) for x in rates or []]

    def memory(self) -> tuple:
        return (self.t, self.tick, self.breath, self.distance, self.presence, self.since, self.valid, self.near, self.rates)

    def readings(self, messages: Iterable[tuple]) -> Iterator[tuple]:
        """Takes (t, what, value) in order of time, what being breath, distance, presence or heart, and gives the ticks up to the last one."""
        for t, what, value in messages:
            if self.t is not None and t < self.t:
                continue
            yield from self._ticks(t, False)
            self.t = t
            if what == "breath":
                self.breath = value
            elif what == "presence":
                self.presence = bool(value)
            elif what == "distance":
                self.distance = value
                if not isnan(value):
                    self.near.append((t, value))
        if self.t is not None:
            yield from self._ticks(self.t, True)

    def silence(self) -> Iterator[tuple]:
        """The ticks after the last message that it is still fresh for, once no message can come before them."""
        if self.t is not None:
            yield from self._ticks(self.t + self.stale, True)

    def _ticks(self, until: float, included: bool) -> Iterator[tuple]:
        """The ticks that nothing more can change: before a message at `until`, or up to it at the end of a batch."""
        if self.t is None:
            return
        k = ceil(self.t / self.period) if self.tick is None else max(self.tick + 1, ceil(self.t / self.period))
        last = floor(until / self.period)
        while k <= last and (included or k * self.period < until):
            now = k * self.period
            if now - self.t > self.stale:
                break
            self.tick = k
            if self.breath is not None:
                yield self._reading(now)
            k += 1

    def _reading(self, now: float) -> tuple:
        self.near = [x for x in self.near if now - x[0] <= self.move_s]
        span = [v for _, v in self.near]
        move = 0.1 if len(span) < 2 else max(0.0, min(1.0, (max(span) - min(span)) / radar.MOVE_SCALE_CM))
        here = True if self.presence is None else self.presence
        able = here and self.distance is not None and radar.DISTANCE_RANGE[0] <= self.distance <= radar.DISTANCE_RANGE[1] and move <= radar.MOVE_REJECT
        if able and radar.RATE_RANGE[0] <= self.breath <= radar.RATE_RANGE[1]:
            self.rates.append((now, self.breath))
            self.valid = now
        gone = able and self.valid is not None and radar.RECENT_S < now - self.valid <= self.prior_s
        self.since = (now if self.since is None else self.since) if gone else None
        stopped = gone and now - self.since >= self.hold_s
        self.rates = [x for x in self.rates if now - x[0] <= self.smooth_s]
        smooth = median(v for _, v in self.rates) if self.rates else None
        return (now, 0.0 if stopped or smooth is None else smooth, move, here, bool(stopped), move > radar.MOVE_REJECT, smooth is not None, self.distance, self.breath)
