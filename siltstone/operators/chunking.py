"""Splitting texts into chunks of whole lines.

Lines are taken while their UTF-8 bytes, with a byte for each line break, stay below the limit.
A chunk that isn't the last is followed by one that starts two lines before its end, but at least
one line further on. A single line of more characters than the limit becomes several chunks.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.plans.tables import spread

MAX_CHARS = 800
OVERLAP_LINES = 2
CHUNKS = "array<struct<ord:int,start_line:int,end_line:int,text:string>>"
#: White space by Unicode's property, which is not quite what ``str.strip`` takes.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a final line break opens no further line."""
    found = text.split("\n")
    complete, rest = found[:-1], found[-1]
    return [x[:-1] if x.endswith("\r") else x for x in complete] + ([rest] if rest else [])


def chunks_of(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP_LINES) -> list[tuple[int, int, str]]:
    """``(first line, last line, text)``, lines counted from 1. Blank stretches give none."""
    lines = lines_of(text)
    sizes = [len(x.encode("utf-8", "surrogatepass")) for x in lines]
    out: list[tuple[int, int, str]] = []
    at = 0
    while at < len(lines):
        end, used = at + 1, sizes[at] + 1
        while end < len(lines) and used + sizes[end] < limit:
            used += sizes[end] + 1
            end += 1
        body = "\n".join(lines[at:end])
        if not body.strip(_SPACE):
            at = end
            continue
        if len(body) > limit:
            out += [(at + 1, end, body[i : i + limit]) for i in range(0, len(body), limit)]
        else:
            out.append((at + 1, end, body))
        at = len(lines) if end == len(lines) else max(end - overlap, at + 1)
    return out


def chunk_column(text: Column, limit: int = MAX_CHARS) -> Column:
    """The chunks of a text as an array, batch-wise in Arrow; null for a null text."""

    @F.pandas_udf(CHUNKS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"ord": i, "start_line": a, "end_line": b, "text": x} for i, (a, b, x) in enumerate(chunks_of(t, limit))])

    return split(text)


def chunked(documents: DataFrame, key: str, limit: int = MAX_CHARS) -> DataFrame:
    """``key, ord, start_line, end_line, text``. Streams from Arrow batch to Arrow batch, so a long text costs its own size only."""
    names = [key, "ord", "start_line", "end_line", "text"]

    def split(batches):
        for b in batches:
            rows = [(i, n, *c) for i, t in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True) if t for n, c in enumerate(chunks_of(t, limit))]
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

    return spread(documents.select(key, "text")).mapInArrow(split, f"{key} long, ord int, start_line int, end_line int, text string")
