"""Keeping a store current while files change."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources import corpus
from siltstone.sources.store import IndexReport, Store

#: How often the stream looks.
LOOK_EVERY = "200 milliseconds"


@dataclass(frozen=True)
class Event:
    """``kind``: ready (the first pass is done), indexed, progress, error or stopped."""

    kind: str
    report: IndexReport | None = None
    message: str = ""


class Watch:
    """A store that follows its files from ``start`` to ``stop`` and is written by nobody else meanwhile.

    A full pass catches up first. Then every batch names the paths that differ from the snapshot
    before, however they came to: a rename or an atomic save needs no rule of its own, and what changed
    back is no change. A batch closes after ``quiet`` seconds without a change, at the latest
    ``longest`` after its first. A batch that fails is told as an error and its paths are tried again
    with the next one; the stream goes on. A batch that is repeated after the driver died finds the hashes it left and
    does nothing twice.
    """

    def __init__(self, store: Store, roots: Sequence[str], checkpoint: str, tell: Callable[[Event], None] = lambda e: None, quiet: float = 0.5, longest: float = 5.0) -> None:
        self.store, self.roots, self.checkpoint, self.tell = store, list(roots), checkpoint, tell
        self.quiet, self.longest = quiet, longest
        self.stopping = threading.Event()
        self.again: set[str] = set()
        self.query: StreamingQuery | None = None
        self._held = ExitStack()

    def start(self) -> Watch:
        self._held.enter_context(self.store.holding())
        try:
            done = self.store.index(self.roots, progress=lambda text: self.tell(Event("progress", message=text)), stop=self.stopping.is_set)
            self.tell(Event("ready", done))
            rows = corpus.changes(self.store.spark, self.roots, f"{self.checkpoint}/snapshots", self.quiet, self.longest)
            self.query = rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint).trigger(processingTime=LOOK_EVERY).start()
        except BaseException:
            self._held.close()
            raise
        return self

    def _batch(self, rows: DataFrame, _: int) -> None:
        if rows.isEmpty():
            return
        paths = rows.select("path")
        if self.again:
            paths = paths.unionByName(self.store.spark.createDataFrame([(p,) for p in sorted(self.again)], "path string"))
        try:
            done = self.store.index_changed(paths)
        except Exception as e:  # told, and tried again with the next change
            self.again |= {r["path"] for r in rows.limit(10_000).collect()}
            self.tell(Event("error", message=f"{type(e).__name__}: {e}"[:500]))
            return
        self.again.clear()
        if done.indexed or done.removed:
            self.tell(Event("indexed", done))

    def wait(self, seconds: float | None = None) -> bool:
        """Until it is stopped, or so long; whether it ended."""
        return self.stopping.wait(seconds)

    def stop(self) -> None:
        """Also from a signal handler or another thread; the batch at work is finished first."""
        self.stopping.set()
        if self.query is not None:
            self.query.stop()
        self._held.close()
        self.tell(Event("stopped"))


def watch(store: Store, roots: Sequence[str], checkpoint: str, tell: Callable[[Event], None] = lambda e: None, quiet: float = 0.5, longest: float = 5.0) -> Watch:
    return Watch(store, roots, checkpoint, tell, quiet, longest).start()
