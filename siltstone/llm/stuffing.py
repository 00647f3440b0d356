"""Keyword-stuffed and link-list pages, by term recurrence and the lack of function words.

A page is cut into segments (lines; long lines by sentence ends and every ``WIDE`` characters).
For each word the gap to its last and next occurrence is taken, and for windows of ``WINDOW``
words the positional autocorrelation: how often the same word stands again at one fixed lag.
A segment is stuffing if it is

- mostly links or tags, or a few words and the host they lead to,
- content words most of which recur within ``NEAR`` words, with next to no function words,
- the same at one lag, with some function words but no sentence (a phrase repeated with a
  changing word),
- a trail of navigation (names with arrows between them), or
- a list of a few words between separators, with next to no function words and no sign of a
  sentence, table, figure or code, in a run of such lists that has ``MANY`` distinct words. Nothing
  needs to recur in it; a short list is honest.

Code, logs, tables of figures and pinned versions are told by their signs and never count. A page
is a case if stuffing makes up more than ``SHARE`` of what is judged. Null and empty texts are no
cases. Every character of a text is judged. Recurrence is counted only where the segments that may
be stuffing at all, by their links and function words, make up enough of the page.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltstone.plans.tables import spread

SHARE = 0.5
NEAR = 48
WINDOW = 64
LAGS = 24
WIDE = 400
MANY = 24
#: Function words of the corpus' languages, which no sentence of some length does without.
FUNCTION = frozenset(
    """the of and to a an in is it its that this these those for on with as was were be been by are at from not nor or but have has had if when then than only we
    our you your they their he she his her i my there here what who which nobody every each some any all no so must may can could would should will do does did
    before after between because while until since into over under about without within per
    der die das den dem des und ist sind war nicht ein eine einen einem einer von zu zum zur mit auf für im in am an als auch wird werden wurde haben hat wenn kein
    keine dann nach bei bis aus dass es sie er wir ihr sich noch nur oder aber vom über unter später jede jeder jedes gibt
    le la les l un une des du de et est sont dans que qui pour pas sur au aux ne ce cette se par avec sans plus ou mais nous vous ils elle il on quand chaque dès
    el los las lo una y o en es son por con no que del al se su sus para como si cuando cada hay sin ya más desde entre después antes ayer""".split()
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/\S*|<a\s[^>]*>|(?<!\w)#\w[\w-]*", re.I)
_HOST = re.compile(r"\(?\b[\w-]+(?:\.[\w-]+)*\.[a-z]{3,10}\)?\s*$", re.I)
_CODE = re.compile(r"[{}\[\]();=<>$`\\]|::|->|\w\.\w+\(|\w_\w")
_FIGURE = re.compile(r"(?<!\S)\S*\d\S*")
_SENTENCE = re.compile(r"[.!?][\"')]*\s*$")
_BREAK = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý¿¡\"'(])")
_SEPARATORS = re.compile(r"[|»›/,;•·>]|\s[-–—]\s")
_ARROW = re.compile(r"[»›]")
_NO_LIST = re.compile(r"[{}\[\]()=<$`\\]|::|->|\w[._]\w|^\s*\||:.*:", re.S)
_META = re.compile(r"<meta\s+name=.keywords.[^>]*>", re.I)


def segments(text: str) -> list[tuple[int, int]]:
    """Start and end of the segments of a text that aren't blank."""
    out = []
    at = 0
    for line in text.split("\n"):
        end, lo = at + len(line), at
        if len(line) > WIDE:
            cuts = [at + m.end() for m in _BREAK.finditer(line)]
            for c in [*cuts, end]:
                while c - lo > WIDE:
                    k = text.rfind(" ", lo + 1, lo + WIDE)
                    k = k if k > lo else lo + WIDE
                    out.append((lo, k))
                    lo = k
                out.append((lo, c))
                lo = c
        else:
            out.append((at, end))
        at = end + 1
    return [(a, b) for a, b in out if text[a:b].strip()]


def recurrence(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word whether it recurs within ``NEAR`` words, and the autocorrelation at the best lag around it."""
    n = len(ids)
    near, best = np.zeros(n, bool), np.zeros(n)
    if n < 2:
        return near, best
    order = np.lexsort((np.arange(n), ids))
    close = (ids[order[1:]] == ids[order[:-1]]) & (np.diff(order) <= NEAR)
    near[order[1:]] |= close
    near[order[:-1]] |= close
    w = min(WINDOW, n)
    centre = np.clip(np.arange(n) - w // 2, 0, n - w)
    for lag in range(1, min(LAGS, n - 1) + 1):
        same = np.zeros(n + 1)
        hit = ids[lag:] == ids[:-lag]
        np.cumsum(np.r_[hit, np.zeros(lag, bool)], out=same[1:])
        np.maximum(best, (same[centre + w] - same[centre]) / max(w - lag, 1), out=best)
    return near, np.minimum(best, 1)


def is_list(seg: str, n: int) -> bool:
    """Whether a segment of ``n`` words is a list: four items or more of 2.5 words on the average, and no sign of anything else."""
    items = 1 + len(_SEPARATORS.findall(seg.strip().rstrip(",;|·•")))
    return items >= 4 and n <= 2.5 * items and not _SENTENCE.search(seg) and not _NO_LIST.search(seg) and len(_FIGURE.findall(seg)) <= 0.1 * n


def is_trail(seg: str, n: int) -> bool:
    """Whether a segment of ``n`` words is a trail of navigation: three names or more with arrows between them."""
    items = 1 + len(_ARROW.findall(seg.strip().strip("»›")))
    return items >= 3 and n <= 2.5 * items and not _SENTENCE.search(seg)


def stuffed_share(text: str, share: float = SHARE) -> float:
    """The share of the judged characters that is stuffing, or 0 where it can't be more than ``share``."""
    parts: list[tuple[str, int, int, int, int]] = []
    words: list[str] = []
    functions: list[int] = []  # of each segment
    may = total = 0
    for a, b in segments(text):
        seg = text[a:b]
        size = len(seg.strip())
        here = _WORD.findall(seg.lower())
        lo = len(words)
        words += here
        own = sum(map(FUNCTION.__contains__, here))
        functions.append(own)
        links = sum(len(m.group()) for m in _LINK.finditer(seg)) if "/" in seg or "#" in seg or "www." in seg.lower() or "<" in seg else 0
        parts.append((seg, size, lo, len(words), links))
        total += size
        if links >= 0.5 * size or own < 0.3 * len(here) or _META.search(seg) or is_trail(seg, len(here)):
            may += size
    if may <= share * total:
        return 0.0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    function = np.fromiter(map(FUNCTION.__contains__, words), bool, len(words))
    near, best = recurrence(ids)
    content_near, lags = np.r_[0, np.cumsum(near & ~function)], np.r_[0, np.cumsum(best)]
    bad = 0
    run, run_words = 0, set()  # the lists since the last segment of another form
    for (seg, size, lo, hi, links), own in zip(parts, functions, strict=True):
        n = hi - lo
        if _META.search(seg) or links >= 0.5 * size:
            bad += size
            continue
        if n < 2:
            continue
        f = own / n
        recur = (content_near[hi] - content_near[lo]) / max(1, n - own)
        lag = (lags[hi] - lags[lo]) / n
        coded = not links and (len(_CODE.findall(seg)) >= 2 + n / 12 or len(_FIGURE.findall(seg)) >= max(3, 0.25 * len(seg.split())))
        listed = len(_SEPARATORS.findall(seg)) >= max(2, n / 5)
        if not coded and ((f <= 0.15 and recur >= 0.6 + f) or (f < 0.3 and lag >= 0.45 and recur >= 0.6 and not _SENTENCE.search(seg)) or (f < 0.05 and n >= 4 and (listed or links) and recur >= 0.3) or (f < 0.05 and n >= 5 and recur >= 0.4) or (f == 0 and n <= 10 and _HOST.search(seg))):
            bad += size
        elif f <= 0.25 and is_trail(seg, n):
            bad += size
        elif f < 0.05 and is_list(seg, n):
            run += size
            run_words.update(ids[lo:hi].tolist())
        elif coded or n > 3:
            bad += run if len(run_words) >= MANY else 0
            run, run_words = 0, set()
    bad += run if len(run_words) >= MANY else 0
    return bad / total if total else 0.0


def found(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id`` of the pages that consist for the most part of keywords, tags, navigation or links. Repeated rows come out repeatedly."""

    def judge(batches):
        for b in batches:
            keep = [i for i, t in enumerate(b.column("text").to_pylist()) if t and stuffed_share(t, share) > share]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64()))], ["doc_id"])

    return spread(documents.select("doc_id", "text")).mapInArrow(judge, "doc_id long")
