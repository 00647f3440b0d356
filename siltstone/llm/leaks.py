"""Evaluation texts leaking into training text, by winnowing.

A text is a sequence of words without case, accents, punctuation and invisible characters. Of
every ``GUARANTEE - GRAM + 1`` successive ``GRAM``-word hashes the smallest is kept, so two texts
that share ``GUARANTEE`` words in a row share a kept hash of them. Hits are then extended to both
sides; a pair counts if the shared run reaches ``GUARANTEE`` words.

The evaluation set is small beside the corpus. Up to ``PROBE_CHARS`` characters its fingerprints and
words are sent to the tasks, which probe and extend in one pass over the corpus without a shuffle.
A larger set is joined by fingerprint, and runs are extended from the two word hash arrays.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.tables import spread

GUARANTEE = 12
GRAM = 6
PROBE_CHARS = 8_000_000
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _unseen() -> re.Pattern:
    """Characters that are dropped: marks, format and control characters but for white space, and blank letters."""
    blank = (0x115F, 0x1160, 0x3164, 0xFFA0)
    gone = [i for i in range(0x110000) if i in blank or (kind := unicodedata.category(chr(i))) in ("Mn", "Me", "Cf") or (kind == "Cc" and not chr(i).isspace())]
    cut = [k for k in range(len(gone)) if k == 0 or gone[k] != gone[k - 1] + 1] + [len(gone)]
    spans = "".join(f"\\U{gone[x]:08x}-\\U{gone[y - 1]:08x}" for x, y in zip(cut, cut[1:], strict=False))
    return re.compile(f"[{spans}]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case, accents and invisible characters."""
    if not text:
        return []
    if text.isascii():
        return _ASCII_WORD.findall(_CONTROL.sub("", text).lower())
    return _WORD.findall(_unseen().sub("", unicodedata.normalize("NFKD", text).casefold()))


class Hasher:
    """64-bit hashes of words, remembered for the words of a task up to a bound."""

    KEEP = 1 << 20

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest as digest

        known = self.known
        if len(known) > self.KEEP:
            known.clear()
        return np.fromiter((known.get(w) or known.setdefault(w, digest(w)) for w in ws), np.uint64, len(ws))


def grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of the ``k`` words from each position of concatenated word hashes."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Which hashes are the smallest of some ``window`` successive ones; of equal ones all are kept."""
    n = len(g) - window + 1
    if n < 1:
        return np.zeros(len(g), bool)
    least = g[:n].copy()
    for i in range(1, window):
        np.minimum(least, g[i : i + n], out=least)
    most = np.zeros(len(g), np.uint64)
    for i in range(window):
        np.maximum(most[i : i + n], least, out=most[i : i + n])
    return g <= most


class Batch:
    """Word hashes of several texts, one behind the other, with the fingerprints of each."""

    def __init__(self, texts: list[str | None], hasher: Hasher, guarantee: int, gram: int) -> None:
        each = [hasher(words(t)) for t in texts]
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in each])]).astype(np.int64)
        self.h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        self.text, self.key, self.at = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if len(self.h) < guarantee:
            return
        g = grams(self.h, gram)
        of = np.repeat(np.arange(len(each)), np.diff(self.first))[: len(g)]
        at = np.arange(len(g))
        whole = at + gram <= self.first[of + 1]
        long = np.diff(self.first)[of] >= guarantee
        window = guarantee - gram + 1
        # windows that reach into the next text only add fingerprints; the ones within a text all have their smallest kept
        kept = winnow(np.where(whole, g, np.iinfo(np.uint64).max), window) & whole & long
        self.at = np.flatnonzero(kept)
        self.key, self.text = g[kept], of[kept]

    def run(self, at: int, text: int, other: np.ndarray, j: int) -> int:
        lo, hi = self.first[text], self.first[text + 1]
        return extend(self.h[lo:hi], at - int(lo), other, j)


def extend(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the longest equal run of ``a`` and ``b`` through positions ``i`` and ``j``."""
    n = min(len(a) - i, len(b) - j)
    differs = a[i : i + n] != b[j : j + n]
    ahead = int(differs.argmax()) if differs.any() else n
    m = min(i, j)
    differs = (a[i - m : i] != b[j - m : j])[::-1]
    return ahead + (int(differs.argmax()) if differs.any() else m)


class Probe:
    """Fingerprints of a set of items, to be looked up in."""

    def __init__(self, items: list[tuple[int, str]], guarantee: int, gram: int) -> None:
        self.guarantee = guarantee
        self.ids = [i for i, _ in items]
        own = Batch([t for _, t in items], Hasher(), guarantee, gram)
        self.texts = [own.h[lo:hi] for lo, hi in zip(own.first, own.first[1:], strict=False)]
        order = np.argsort(own.key, kind="stable")
        self.key, self.item = own.key[order], own.text[order]
        self.at = (own.at - own.first[own.text])[order]

    def leaks(self, batch: Batch) -> set[tuple[int, int]]:
        """``(number of the text, item id)`` of texts and items with ``guarantee`` common words in a row."""
        lo, hi = np.searchsorted(self.key, batch.key, "left"), np.searchsorted(self.key, batch.key, "right")
        got: set[tuple[int, int]] = set()
        for k in np.flatnonzero(hi > lo):
            text = int(batch.text[k])
            for m in range(lo[k], hi[k]):
                item = int(self.item[m])
                if (text, self.ids[item]) not in got and batch.run(int(batch.at[k]), text, self.texts[item], int(self.at[m])) >= self.guarantee:
                    got.add((text, self.ids[item]))
        return got


def leaks(documents: DataFrame, items: DataFrame, guarantee: int = GUARANTEE, gram: int = GRAM, probe_chars: int = PROBE_CHARS) -> DataFrame:
    """``doc_id, item_id`` once for each document and item with ``guarantee`` common words in a row.

    Null and empty texts, and texts of fewer words, leak nothing. A document that repeats another
    is reported for itself. Extra columns are not kept.
    """
    items = items.where("text is not null").select("item_id", "text")
    n_chars = items.select(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if n_chars > probe_chars:
        return _joined(documents, items, guarantee, gram)
    rows = [(r["item_id"], r["text"]) for r in items.collect()]  # at most probe_chars characters

    def find(batches):
        probe, hasher = Probe(rows, guarantee, gram), Hasher()
        for b in batches:
            got = sorted(probe.leaks(Batch(b.column("text").to_pylist(), hasher, guarantee, gram)))
            doc = b.column("doc_id").take(pa.array([t for t, _ in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array([i for _, i in got], pa.int64())], ["doc_id", "item_id"])

    return spread(documents.select("doc_id", "text")).mapInArrow(find, "doc_id long, item_id long").distinct()


def _signed(h: np.ndarray) -> list[int]:
    return h.view(np.int64).tolist()


def _fingerprint_rows(df: DataFrame, key: str, guarantee: int, gram: int) -> DataFrame:
    """``key, fp, before, after``: each kept gram with as many word hashes to both sides as decide a run of ``guarantee``."""

    def emit(batches):
        hasher = Hasher()
        for b in batches:
            ids, own, out = b.column(key).to_pylist(), Batch(b.column("text").to_pylist(), hasher, guarantee, gram), []
            for at, text, fp in zip(own.at, own.text, own.key.view(np.int64), strict=True):
                h = own.h[own.first[text] : own.first[text + 1]]
                i = int(at - own.first[text])
                out.append((ids[text], int(fp), _signed(h[max(0, i - guarantee) : i][::-1].copy()), _signed(h[i : i + guarantee].copy())))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], [key, "fp", "before", "after"])

    return df.where("text is not null").select(key, "text").mapInArrow(emit, f"{key} long, fp long, before array<long>, after array<long>")


def _joined(documents: DataFrame, items: DataFrame, guarantee: int, gram: int) -> DataFrame:
    """The same for an evaluation set of any size: an equi-join on fingerprints; hot ones are split by AQE.

    A shared run through the fingerprint has its length from the words on both sides, of which
    ``guarantee`` each are enough to decide.
    """
    a = _fingerprint_rows(documents, "doc_id", guarantee, gram)
    b = _fingerprint_rows(items, "item_id", guarantee, gram).select("item_id", "fp", F.col("before").alias("before_b"), F.col("after").alias("after_b"))

    def equal(x: str, y: str):
        n = F.least(F.size(x), F.size(y))
        differs = F.array_position(F.zip_with(F.slice(F.col(x), F.lit(1), n), F.slice(F.col(y), F.lit(1), n), lambda p, q: p == q), False)
        return F.when(differs > 0, differs - 1).otherwise(n)

    hits = a.join(b, "fp").where(equal("before", "before_b") + equal("after", "after_b") >= guarantee)
    return hits.select("doc_id", "item_id").distinct()
