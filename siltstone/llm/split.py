"""Splitting oversized items at natural boundaries, by pointer doubling.

Every line of an item is a boundary. For each boundary the table ``reach`` holds the farthest
legal end of a piece that starts there, ``cut`` the end that is taken (the last blank line
within reach, else the last line end), and ``follow`` the boundary where the next piece starts,
``overlap`` lines before the cut. Squaring ``follow`` (``follow = follow[follow]``) and marking
what the marked boundaries point to yields every greedy cut of every item of a batch in
log2(lines) array operations, without walking the items.

A natural cut is forced if every chain visits it, wherever the chain starts before it. ``visits``
counts the chains through each boundary with the same squaring.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans.tables import stage

MAX_CHARS = 800
OVERLAP_LINES = 2
#: Up to so many bytes the gains are broadcast.
BROADCAST_BYTES = 32 << 20


class Lines:
    """The lines of a batch of texts, one behind the other in arrays."""

    def __init__(self, texts: list[str]) -> None:
        start, end, blank, item, first = [], [], [], [], []
        for i, text in enumerate(texts):
            first.append(len(start))
            at = 0
            for line in text.split("\n"):
                stop = at + len(line)
                start.append(at)
                end.append(stop - 1 if line.endswith("\r") and stop < len(text) else stop)
                blank.append(not line.strip())
                item.append(i)
                at = stop + 1
            if len(start) > first[-1] + 1 and start[-1] == len(text):  # a final line break opens no line
                for x in (start, end, blank, item):
                    x.pop()
        first.append(len(start))
        self.start, self.end = np.array(start, np.int64), np.array(end, np.int64)
        self.blank, self.item = np.array(blank, bool), np.array(item, np.int64)
        self.first = np.array(first, np.int64)

    def last(self) -> np.ndarray:
        """For each line the number of the line behind its item's last."""
        return self.first[self.item + 1]


def _far(start: np.ndarray, end: np.ndarray, item: np.ndarray, limit: int) -> np.ndarray:
    """For each unit the number behind the farthest unit that ends within ``limit`` of its start.

    Items are put on one axis with room between them, so that a single binary search serves all.
    """
    step = (int(end.max()) if len(end) else 0) + limit + 2
    return np.searchsorted(item * step + end, item * step + start + limit, side="right")


def successors(lines: Lines, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(reach, cut, follow)`` of every line; a line longer than the limit is a piece of its own."""
    n = len(lines.start)
    own = np.arange(n)
    reach = np.maximum(_far(lines.start, lines.end, lines.item, limit), own + 1)
    blank_before = np.maximum.accumulate(np.where(lines.blank, own, -1)) if n else own
    natural = blank_before[reach - 1] + 1  # behind the last blank line within reach
    used = np.maximum.accumulate(np.where(~lines.blank, own, -1)) if n else own
    ends = reach == lines.last()
    cut = np.where(ends | (natural <= own + 1) | (used[natural - 1] < own), reach, natural)
    next_blank = (reach < n) & lines.blank[np.minimum(reach, n - 1)] if n else ends
    cut = np.where(next_blank & ~ends, reach, cut)  # the line just behind is blank: nothing is torn
    follow = np.where(cut == lines.last(), own, np.maximum(cut - overlap, own + 1))
    return reach, cut, follow


def mark(follow: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which boundaries the chains from ``roots`` visit, by squaring the successor table."""
    seen = np.zeros(len(follow), bool)
    seen[roots] = True
    while True:
        seen[follow[seen]] = True
        squared = follow[follow]
        if np.array_equal(squared, follow):
            return seen
        follow = squared


def visits(follow: np.ndarray) -> np.ndarray:
    """How many starts have chains that visit each boundary, their own start included, by squaring the successor table.

    The end of a chain is a number behind the table or the boundary itself. After k rounds ``seen``
    counts the starts within 2^k steps of a boundary, and ``hop`` is 2^k steps long.
    """
    n = len(follow)
    hop = np.append(np.where(follow <= np.arange(n), n, np.minimum(follow, n)), n)
    seen = np.append(np.ones(n, np.int64), 0)
    while (hop < n).any():
        far = np.bincount(hop, weights=seen, minlength=n + 1)
        far[n] = 0
        seen = seen + far.astype(np.int64)
        hop = hop[hop]
    return seen[:n]


def pieces_of(texts: list[str], limit: int = MAX_CHARS, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, int, str]]:
    """``(item, first line, last line, text)`` of all pieces; lines count from 0.

    A piece of only blank text is dropped; a single line over the limit is cut every ``limit``
    characters, all its pieces naming that line.
    """
    lines = Lines(texts)
    if not len(lines.start):
        return []
    _, cut, follow = successors(lines, limit, overlap)
    out = []
    for at in np.flatnonzero(mark(follow, lines.first[:-1])):
        i, base = lines.item[at], lines.first[lines.item[at]]
        text = texts[i][lines.start[at] : lines.end[cut[at] - 1]]
        if text.strip():
            for k in range(0, len(text), limit):
                out.append((int(i), int(at - base), int(cut[at] - 1 - base), text[k : k + limit]))
    return out


def blocks_of(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of every maximal run of lines that aren't blank."""
    full = ~lines.blank
    new = np.ones(len(full), bool)
    new[1:] = lines.item[1:] != lines.item[:-1]
    before, after = np.roll(full, 1), np.roll(full, -1)
    opens = full & (new | ~before)
    closes = full & (np.roll(new, -1) | ~after)
    if len(full):
        closes[-1] = full[-1]
    return np.flatnonzero(opens), np.flatnonzero(closes)


def forced_of(texts: list[str], limit: int = MAX_CHARS) -> list[tuple[int, int]]:
    """``(item, line)`` of the natural cuts that every legal splitting at blank lines has to make.

    The successor table is that over blocks, without overlap: a piece ends behind the farthest block
    within the limit. A block that the chains of all earlier blocks of its item visit begins a piece in
    every splitting. It is a natural cut if it and the block before fit in a piece each.
    """
    lines = Lines(texts)
    if not len(lines.start):
        return []
    a, z = blocks_of(lines)
    start, end, item = lines.start[a], lines.end[z], lines.item[a]
    own = np.arange(len(a))
    first = np.searchsorted(item, item)
    last = np.searchsorted(item, item, side="right")
    follow = np.maximum(_far(start, end, item, limit), own + 1)
    through = visits(np.where(follow >= last, len(a), follow))
    fits = end - start <= limit
    cut = (own > first) & (through == own - first + 1) & fits & np.roll(fits, 1)
    at = np.flatnonzero(cut)
    return [(int(i), int(n)) for i, n in zip(item[at], a[at] - lines.first[item[at]], strict=True)]


def oversized(chunks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    return chunks.where(F.length("text") > limit)


def _first_line(batch: pa.RecordBatch) -> list[int]:
    return [1 if x is None else x for x in batch.column("start_line").to_pylist()]


def split(chunks: DataFrame, limit: int = MAX_CHARS, overlap: int = OVERLAP_LINES) -> DataFrame:
    """All chunks with the oversized ones replaced by their pieces, ``ord`` moved on by the pieces before.

    Returns ``chunk_id, piece, file_id, ord, start_line, end_line, text``. Rows within the limit
    pass unchanged but for ``ord``; null texts pass as they are; a null ``start_line`` counts as 1
    in a piece. A repeated row repeats its pieces and their numbers; a null ``ord`` or ``file_id`` stays
    as it is. An oversized chunk of only blank text has no piece. Other columns are not kept.
    """
    cols = ["chunk_id", "file_id", "ord", "start_line", "end_line", "text"]
    rows = chunks.select(*cols)
    whole = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= limit).withColumn("piece", F.lit(0))

    def cut(batches):
        for b in batches:
            first, got = _first_line(b), pieces_of(b.column("text").to_pylist(), limit, overlap)
            if got:
                i = np.array([g[0] for g in got])
                lo = np.array([first[g[0]] + g[1] for g in got], np.int32)
                hi = np.array([first[g[0]] + g[2] for g in got], np.int32)
                piece = np.arange(len(i)) - np.searchsorted(i, i)
                take = b.select(["chunk_id", "file_id", "ord"]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([*take.columns, pa.array(lo), pa.array(hi), pa.array([g[3] for g in got], pa.string()), pa.array(piece, pa.int32())], [*cols, "piece"])

    parts = stage(oversized(rows, limit).mapInArrow(cut, "chunk_id long, file_id long, ord int, start_line int, end_line int, text string, piece int"), "pieces")
    out = moved_on(whole.unionByName(parts), oversized(rows, limit).select("chunk_id", "file_id", "ord"), parts.select("chunk_id", "file_id", "ord", "piece"))
    return out.select("chunk_id", "piece", "file_id", "ord", "start_line", "end_line", "text")


def moved_on(rows: DataFrame, large: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` with ``ord`` increased by what the oversized chunks before it gained, and by its own ``piece``.

    Only the numbers of the oversized chunks (``large``) and of their pieces are brought together: per
    file and bucket of 1,024 old numbers what the buckets before gained, and the gains inside. Files
    without an oversized chunk and all texts stay where they are, unless there are too many such
    gains to broadcast (``BROADCAST_BYTES``).
    """
    key = ["chunk_id", "file_id", "ord"]
    named = large.where("file_id is not null and ord is not null").distinct()
    n = parts.groupBy(*key).agg((F.max("piece") + 1).alias("n"))
    gains = named.join(n, key, "left").select("file_id", "ord", (F.coalesce("n", F.lit(0)) - 1).alias("gain")).where("gain <> 0")
    inside = gains.groupBy("file_id", F.shiftright("ord", 10).alias("bucket")).agg(F.sum("gain").alias("total"), F.collect_list(F.struct("ord", "gain")).alias("gains"))  # at most 1,024 numbers
    order = Window.partitionBy("file_id").orderBy("bucket")
    before = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = rows.groupBy("file_id").agg(F.max(F.shiftright("ord", 10)).alias("top"))
    sums = inside.withColumn("before", before).withColumn("next", F.lead("bucket").over(order)).join(top, "file_id")
    # a bucket without a gain of its own has the sum of the last one with a gain before it
    each = sums.withColumn("at", F.explode(F.sequence("bucket", F.coalesce(F.col("next") - 1, "top"))))
    own = F.col("at") == F.col("bucket")
    each = stage(each.select(F.col("file_id").alias("_file"), F.col("at").alias("_at"), F.when(own, F.col("before")).otherwise(F.col("before") + F.col("total")).alias("_before"), F.when(own, F.col("gains")).alias("_gains")), "gains")
    size = each.agg(F.coalesce(F.sum(48 + 16 * F.coalesce(F.size("_gains"), F.lit(0))), F.lit(0)).alias("n")).first()["n"]
    few = F.broadcast(each) if size <= BROADCAST_BYTES else each
    here = rows.join(few, (F.col("file_id") == F.col("_file")) & (F.shiftright("ord", 10) == F.col("_at")), "left")
    earlier = F.aggregate("_gains", F.lit(0).cast("long"), lambda t, g: t + F.when(g["ord"] < F.col("ord"), g["gain"]).otherwise(0))
    gained = F.coalesce("_before", F.lit(0)) + F.coalesce(earlier, F.lit(0))
    return here.withColumn("ord", (F.col("ord") + gained + F.col("piece")).cast("int")).drop("_file", "_at", "_before", "_gains")


def forced_cuts(chunks: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """``chunk_id, line_no`` of the natural cuts that every legal splitting has to make."""

    def find(batches):
        for b in batches:
            first, got = _first_line(b), forced_of(b.column("text").to_pylist(), limit)
            if got:
                ids = b.column("chunk_id").take(pa.array([i for i, _ in got]))
                yield pa.RecordBatch.from_arrays([ids, pa.array([first[i] + n for i, n in got], pa.int64())], ["chunk_id", "line_no"])

    return oversized(chunks.select("chunk_id", "start_line", "text"), limit).mapInArrow(find, "chunk_id long, line_no long")
