"""Grouping change events: quiet periods, a cap on waiting, and the last state of each path."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """``key, first, last, events`` of runs of events with less than ``gap`` between two. Works on streams with a watermark as well."""
    return events.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), gap)).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("events")).drop("session_window")


def last_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key: an aggregate of one struct, so each map task sends a row per key."""
    rest = [c for c in events.columns if c != key and c not in order]
    best = events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_e"))
    return best.select(key, "_e.*")


class Quiet:
    """When a batch of changes is due: after ``quiet`` seconds without another, and in any case ``longest`` after its first, so that a source that never pauses is still served."""

    def __init__(self, quiet: float = 0.5, longest: float = 5.0) -> None:
        self.quiet, self.longest = quiet, longest
        self.first: float | None = None
        self.last = 0.0

    def due(self, now: float) -> bool:
        return self.first is not None and (now - self.last >= self.quiet or now - self.first >= self.longest)

    def saw(self, now: float) -> None:
        if self.first is None:
            self.first = now
        self.last = now

    def closed(self) -> None:
        self.first = None


def batches(times: Iterable[float], quiet: float = 0.5, longest: float = 5.0) -> Iterator[list[int]]:
    """Indices of events (in order of time, in seconds) that one batch holds, by :class:`Quiet`."""
    rule, held = Quiet(quiet, longest), []
    for i, t in enumerate(times):
        if rule.due(t):
            yield held
            held = []
            rule.closed()
        rule.saw(t)
        held.append(i)
    if held:
        yield held
