"""Scalar expressions that reports and paths need, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KB = 1024


def _shifted(n: Column, bits: int) -> Column:
    """``n`` divided by a power of two, to whole numbers; halves go to the even one."""
    q, rest, half = F.shiftright(n, bits), n.bitwiseAND((1 << bits) - 1), 1 << (bits - 1)
    return q + F.when((rest > half) | ((rest == half) & (q % 2 == 1)), 1).otherwise(0)


def human_bytes(n: Column) -> Column:
    """``B``, ``KB`` without and ``MB`` with one decimal. Halves go to the even digit; null for null."""
    n = n.cast("long")
    tenths = _shifted(n * 10, 20)
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(n < KB, F.format_string("%d B", n)).when(n < KB * KB, F.concat(_shifted(n, 10).cast("string"), F.lit(" KB"))).otherwise(mb)


def human_duration(seconds: Column) -> Column:
    """``s`` below a minute, ``m`` below an hour, else ``h`` with one decimal."""
    return F.when(seconds < 60, F.format_string("%.0fs", seconds)).when(seconds < 3600, F.format_string("%.0fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+/*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def score_text(score: Column) -> Column:
    return F.format_string("%.3f", score)


def shard_name(start: Column) -> Column:
    """Shards are named by their first id, padded to 16 digits."""
    return F.lpad(start.cast("string"), 16, "0")


def resident_bytes(n: Column, dim: int, bits: int) -> Column:
    """Estimated memory of a shard of quantized vectors: codes twice, norm, id and map entry."""
    return n * F.lit(2 * dim * bits // 8 + 4 + 8 + 24)


def utf8_lossy(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


def is_binary(content: Column, window: int = 8192) -> Column:
    """Whether the first bytes hold a zero byte."""
    return F.contains(F.substring(content, 1, window), F.lit(b"\0"))


def progress(scanned: int, total: int, chunks: int, seconds: float) -> str:
    """How far an indexing run is, how fast, and how long the rest takes at that pace."""
    rate = chunks / seconds if seconds > 0 else 0.0
    left = (total - scanned) * seconds / scanned if scanned else 0.0
    return f"{scanned}/{total} files, {rate:.1f} chunks/s, {left:.0f}s left"
