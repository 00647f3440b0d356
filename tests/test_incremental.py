import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import incremental as inc
from siltstone.plans import folders

T0 = dt.datetime(2025, 1, 1)
FILES = "path string, hash string, indexed_at timestamp_ntz, extra int"
LISTING = "arrival_no long, path string, hash string, seen_at timestamp_ntz, indexed_at int"


def at(n):
    return T0 + dt.timedelta(hours=n)


def intervals(rows):
    return sorted((r["lo"], r["hi"]) for r in rows.collect())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.sets(st.integers(65_500, 65_570)), b=st.sets(st.integers(65_500, 65_570)))
def test_merged_islands_hold_exactly_the_numbers(spark, a, b):
    table = lambda s: spark.createDataFrame([(x,) for x in s] + [(None,)], "n long")
    merged = inc.merge_intervals(inc.islands(table(a), "n"), inc.islands(table(b), "n"))
    found = intervals(merged)
    assert sorted(x for lo, hi in found for x in range(lo, hi + 1)) == sorted(a | b)
    assert all(y[0] > x[1] for x, y in zip(found, found[1:]))
    left = inc.pending(table(range(65_490, 65_580)), "n", merged)
    assert {r["n"] for r in left.collect()} == set(range(65_490, 65_580)) - a - b


def test_late_numbers_are_picked_up_and_nothing_twice(spark, tmp_path):
    ledger = inc.Ledger(spark, str(tmp_path / "ledger"))
    rows = lambda *n: spark.createDataFrame([(i, f"r{i}") for i in n], "seq long, v string")
    assert ledger.run(rows(1, 2, 5), "seq", lambda df: df) == 1
    with pytest.raises(ValueError):
        ledger.run(rows(1, 2, 3, 5), "seq", lambda df: (_ for _ in ()).throw(ValueError("worker died")))
    assert ledger.version() == 1
    assert ledger.run(rows(1, 2, 3, 5, 7, 7), "seq", lambda df: df) == 2
    assert sorted(r["seq"] for r in ledger.output(2).collect()) == [3, 7, 7]
    assert intervals(ledger.done()) == [(1, 3), (5, 5), (7, 7)]
    assert ledger.pending(rows(1, 2, 3, 4, 5, 7), "seq").count() == 1


def test_the_loser_of_a_race_commits_nothing(spark, tmp_path, monkeypatch):
    """The rival publishes after the loser has written everything and just before it publishes."""
    root = str(tmp_path / "ledger")
    rows = lambda *n: spark.createDataFrame([(i,) for i in n], "seq long")
    ledger, rival = inc.Ledger(spark, root), inc.Ledger(spark, root)
    publish = folders.publish
    raced = []

    def late(*a):
        if not raced:
            raced.append(1)
            assert rival.run(rows(1), "seq", lambda x: x) == 1
        return publish(*a)

    monkeypatch.setattr(inc.folders, "publish", late)
    with pytest.raises(RuntimeError, match="another run"):
        ledger.run(rows(1, 2), "seq", lambda x: x)
    assert ledger.version() == 1 and intervals(ledger.done()) == [(1, 1)]
    assert len(folders.names(spark, f"{root}/data")) == 1
    assert ledger.run(rows(1, 2), "seq", lambda x: x) == 2
    assert [r["seq"] for r in ledger.output(2).collect()] == [2]


def test_a_run_that_dies_before_it_publishes_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "ledger")
    rows = spark.createDataFrame([(3,), (4,)], "seq long")
    ledger = inc.Ledger(spark, root)

    def killed(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(inc.folders, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.run(rows, "seq", lambda x: x)
    assert ledger.version() == 0 and ledger.done().count() == 0 and not folders.names(spark, f"{root}/data")
    assert ledger.run(rows, "seq", lambda x: x) == 1 and intervals(ledger.done()) == [(3, 4)]


def test_runs_take_gaps_and_repeat_what_nobody_applied(spark, tmp_path):
    files = spark.createDataFrame([("/a", "aa", at(5), 1), ("/b", "bb", at(5), 1), ("/dead", "", at(5), 1)], FILES)
    runs = spark.createDataFrame([("ok", at(6)), ("ok", at(5)), ("killed", None)], "outcome string, finished_at timestamp_ntz")
    first = [(1, "/a", "aa", at(1), 0), (2, "/b", "zz", at(1), 0), (3, "/dead", "dd", at(2), 0), (4, "/blind", None, at(2), 0), (8, "/new", "nn", at(9), 0)]
    listing = spark.createDataFrame(first, LISTING)
    seed = inc.reflected(files, listing, runs)
    assert intervals(seed) == [(1, 2), (4, 4)]
    assert inc.reflected(files, listing, runs.limit(0)).count() == 0
    ledger = inc.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.seed(seed) == 1 and ledger.outstanding() == []
    assert inc.next_run(ledger, files, listing) == 2
    assert sorted(r["path"] for r in ledger.output(2).collect()) == ["/dead", "/new"]
    assert intervals(ledger.done()) == [(1, 4), (8, 8)]
    # late arrivals: one older than what is known of /new, one that changes /a; nobody has applied the last output
    listing = spark.createDataFrame([*first, (6, "/new", "older", at(3), 0), (7, "/a", "a2", at(8), 0)], LISTING)
    assert inc.next_run(ledger, files, listing) == 3
    assert sorted(r["path"] for r in ledger.output(3).collect()) == ["/a", "/dead", "/new"]
    files = spark.createDataFrame([("/a", "a2", at(10), 1), ("/b", "bb", at(5), 1), ("/dead", "dd", at(10), 1), ("/new", "nn", at(10), 1)], FILES)
    ledger.mark_applied(3)
    assert ledger.outstanding() == []
    assert inc.next_run(ledger, files, listing) == 4 and ledger.output(4).count() == 0
    assert intervals(ledger.done()) == [(1, 4), (6, 8)]


def test_an_older_late_arrival_does_not_hide_the_newest(spark):
    """The newest says unchanged and is processed; the late one differs but is older."""
    files = spark.createDataFrame([("/a", "aa", at(5), 1)], FILES)
    listing = spark.createDataFrame([(1, "/a", "aa", at(9), 0), (2, "/a", "old", at(7), 0)], LISTING)
    done = inc.islands(listing.where("arrival_no = 1"), "arrival_no")
    assert inc.paths_to_index(files, listing, done).count() == 0


def test_spans_beyond_doubles(spark):
    big = (1 << 60) + 65_535
    df = spark.createDataFrame([(big,), (big + 1,), (-1,), (None,)], "n long")
    got = sorted(tuple(r) for r in inc.islands(df, "n").collect())
    assert got == [(-1, -1, -1), (big >> 16, big, big), ((big >> 16) + 1, big + 1, big + 1)]
    assert inc.pending(df, "n", inc.islands(df.where(f"n = {big}"), "n")).count() == 2


def test_paths_to_index(spark):
    files = spark.createDataFrame(
        [("/a", "AA", at(5), 1), ("/same", "bb", at(5), 1), ("/open", "", at(5), 1), ("/late", "cc", at(5), 1), ("/nohash", None, at(5), 1), (None, "x", at(1), 1), ("/gone", "dd", at(1), 1)], FILES
    )
    listing = spark.createDataFrame(
        [
            (1, "/./a", "ab", at(6), 0), (2, "//same", "BB", at(9), 0), (3, "/open", "ee", at(1), 0), (4, "/late", "zz", at(4), 0), (5, "/new//x", "ff", at(1), 0),
            (6, "/new/x", None, at(9), 0), (7, "/blind", None, at(9), 0), (8, None, "aa", at(9), 0), (9, "/nohash", "aa", at(1), 0), (9, "/nohash", "aa", at(1), 0),
        ],
        LISTING,
    )
    found = sorted(r["path"] for r in inc.paths_to_index(files, listing).collect())
    assert found == ["/a", "/new/x", "/nohash", "/open"]
    again = files.where("false").select("path").unionByName(spark.createDataFrame([("/a",), ("/same",), ("/gone",)], "path string"))
    done = inc.islands(listing.where("arrival_no in (1, 3)"), "arrival_no")
    assert sorted(r["path"] for r in inc.paths_to_index(files, listing, done, again).collect()) == ["/a", "/new/x", "/nohash", "/open"]
    assert sorted(r["path"] for r in inc.paths_to_index(files, listing, done).collect()) == ["/new/x", "/nohash", "/open"]
    assert inc.paths_to_index(files, listing.limit(0)).count() == 0
    assert inc.paths_to_index(files.limit(0), listing).count() == 6


def test_equal_times_take_the_later_arrival(spark):
    listing = spark.createDataFrame([(2, "/a", "x", at(1), 0), (1, "/a", "y", at(1), 0)], LISTING)
    assert inc.newest_observation(listing).select(F.col("seen_hash")).first()[0] == "x"
