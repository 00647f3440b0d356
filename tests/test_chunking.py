from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import chunking


def test_long_line_gives_three():
    assert [len(t) for _, _, t in chunking.chunks_of("x" * 2400)] == [800] * 3


def test_every_line_is_covered():
    text = "\n".join(f"line {i}" for i in range(1, 201))
    found = chunking.chunks_of(text)
    assert {n for a, b, _ in found for n in range(a, b + 1)} == set(range(1, 201))
    assert all(len(t) <= 800 for _, _, t in found)
    assert all(y[0] > x[0] for x, y in zip(found, found[1:]))
    assert all(y[0] == x[1] - 1 for x, y in zip(found, found[1:]))


def test_blank_and_line_ends():
    assert chunking.chunks_of("") == [] and chunking.chunks_of("\n\n   \n") == []
    assert chunking.chunks_of("a\r\nb\r\n") == [(1, 2, "a\nb")]
    assert chunking.chunks_of("a\x0bb") == [(1, 1, "a\x0bb")]


@settings(deadline=None)
@given(st.lists(st.text(alphabet="aé \t\r", max_size=900), max_size=25))
def test_invariants(lines):
    text = "\n".join(lines)
    found = chunking.chunks_of(text)
    stored = chunking.lines_of(text)
    shown = {n for a, b, _ in found for n in range(a, b + 1)}
    assert all(stored[n - 1].strip() == "" for n in range(1, len(stored) + 1) if n not in shown)
    assert all(len(t) <= 800 for _, _, t in found)


def test_in_spark(spark):
    df = spark.createDataFrame([(1, "a\nb", "x"), (2, None, "x"), (3, "", "x"), (4, "y" * 1000, "x")], "doc_id long, text string, ord string")
    rows = chunking.chunked(df, "doc_id").collect()
    assert [(r["doc_id"], r["ord"], r["start_line"], r["end_line"]) for r in rows] == [(1, 0, 1, 2), (4, 0, 1, 1), (4, 1, 1, 1)]
    one = df.select("doc_id", chunking.chunk_column(df.text).alias("c")).collect()
    assert [None if r["c"] is None else len(r["c"]) for r in one] == [1, None, 0, 2]
    assert chunking.chunked(df.limit(0), "doc_id").count() == 0
