import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import split

SCHEMA = "chunk_id long, file_id long, ord int, start_line int, end_line int, text string, piece string, line_no int"


def walked(texts, limit, overlap):
    """The same cuts, item by item and line by line."""
    out = []
    for i, text in enumerate(texts):
        lines = split.Lines([text])
        if not len(lines.start):
            continue
        _, cut, follow = split.successors(lines, limit, overlap)
        at = 0
        while True:
            out.append((i, at, int(cut[at])))
            if follow[at] == at:
                break
            at = int(follow[at])
    return out


lines = st.lists(st.sampled_from(["", "  ", "short", "a longer line of text", "x" * 45, "tab\r"]), max_size=30).map("\n".join)


@settings(deadline=None, max_examples=200)
@given(st.lists(lines, min_size=1, max_size=4), st.integers(20, 60), st.integers(0, 3))
def test_pointer_doubling_equals_the_walk(texts, limit, overlap):
    got = {(i, a, b) for i, a, b, _ in split.pieces_of(texts, limit, overlap)}
    want = set()
    for i, at, end in walked(texts, limit, overlap):
        s = split.Lines([texts[i]])
        if texts[i][s.start[at] : s.end[end - 1]].strip():
            want.add((i, at, end - 1))
    assert got == want


@settings(deadline=None, max_examples=200)
@given(lines, st.integers(20, 60), st.integers(0, 3))
def test_pieces_hold_everything_and_fit(text, limit, overlap):
    found = split.pieces_of([text], limit, overlap)
    assert all(len(p) <= limit for *_, p in found)
    stored = text.split("\n")
    shown = {n for _, a, b, _ in found for n in range(a, b + 1)}
    assert all(not x.strip() for n, x in enumerate(stored) if n not in shown)
    whole = [p for p in found]
    for p, q in zip(whole, whole[1:]):
        if p[1] != q[1] and q[1] <= p[2] and overlap:
            assert p[2] - q[1] + 1 <= overlap


@settings(deadline=None, max_examples=150)
@given(lines, st.integers(20, 60))
def test_forced_cuts_by_definition(text, limit):
    blocks, now = [], None
    at = 0
    rows = text.split("\n")
    for n, raw in enumerate(rows):
        end = at + len(raw) - (raw.endswith("\r") and n < len(rows) - 1)
        if raw.strip():
            now = (now[0], now[1], end) if now else (n, at, end)
        elif now:
            blocks.append(now)
            now = None
        at += len(raw) + 1
    blocks += [now] if now else []
    want = [(0, b[0]) for a, b in zip(blocks, blocks[1:]) if a[2] - a[1] <= limit and b[2] - b[1] <= limit and b[2] - a[1] > limit]
    assert split.forced_of([text], limit) == want


def test_natural_cut_is_preferred():
    text = "\n".join(["aaaa"] * 4 + [""] + ["bbbb"] * 3)
    found = split.pieces_of([text], 30, 1)
    assert [(a, b) for _, a, b, _ in found] == [(0, 4), (4, 7)]


def test_table_cases(spark):
    big = "\n\n".join(["w" * 500, "v" * 500])
    rows = [(1, 1, 0, 10, None, big, "p", 1), (2, 1, 1, None, None, "x" * 2000, "p", 1), (3, 1, 2, 1, 1, None, "p", 1), (4, 1, 3, 1, 1, "", "p", 1), (5, None, None, 1, 1, "ok", "p", 1), (1, 1, 0, 10, None, big, "p", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in split.forced_cuts(df).collect()] == [(1, 12), (1, 12)]
    out = split.split(df).collect()
    own = sorted((r["ord"], r["chunk_id"], r["start_line"], r["end_line"]) for r in out if r["file_id"] == 1)
    assert [o[0] for o in own] == [0, 0, 1, 1, 2, 3, 4, 5, 6]  # the repeated row repeats its numbers
    assert sorted((r["ord"], r["chunk_id"]) for r in out if r["file_id"] == 1 and r["chunk_id"] > 1) == [(2, 2), (3, 2), (4, 2), (5, 3), (6, 4)]
    assert [r["ord"] for r in out if r["chunk_id"] == 5] == [None]
    assert sum(len(r["text"]) for r in out if r["chunk_id"] == 2) == 2000 and {r["start_line"] for r in out if r["chunk_id"] == 2} == {1}
    assert sum(r["text"] is None for r in out) == 1
    assert split.split(df.limit(0)).count() == 0 and split.forced_cuts(df.limit(0)).count() == 0


def test_mark_reaches_all_roots():
    follow = np.array([2, 3, 4, 4, 4, 6, 6])
    assert split.mark(follow, np.array([0, 5])).tolist() == [True, False, True, False, True, True, True]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40))
def test_visits_counts_the_chains(steps):
    n = len(steps)
    follow = np.minimum(np.arange(n) + steps, n)
    want = np.zeros(n, int)
    for i in range(n):
        while i < n:
            want[i] += 1
            i = int(follow[i])
    assert split.visits(follow).tolist() == want.tolist()


def test_numbers_move_on_over_buckets(spark, monkeypatch):
    """A long file with oversized chunks here and there, one of them blank, against a plain count."""
    text = {5: "x" * 900, 1023: "y" * 2000, 1024: "z" * 801, 3000: " " * 900}
    rows = [(i, 7, i, 1, 1, text.get(i, "short"), "p", 1) for i in range(5000)] + [(9000 + i, 8, i, 1, 1, "short", "p", 1) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    want, at = {}, 0
    for i in range(5000):
        n = {5: 2, 1023: 3, 1024: 2, 3000: 0}.get(i, 1)
        want |= {(i, k): at + k for k in range(n)}
        at += n
    want |= {(9000 + i, 0): i for i in range(3)}
    for few in (split.BROADCAST_BYTES, 0):
        monkeypatch.setattr(split, "BROADCAST_BYTES", few)
        assert {(r["chunk_id"], r["piece"]): r["ord"] for r in split.split(df).collect()} == want
