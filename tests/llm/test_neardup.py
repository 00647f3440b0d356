import random
import re

import pytest

from siltstone.llm import neardup
from siltstone.plans.tables import stage

SCHEMA = "chunk_id long, file_id long, text string, a string, b string"


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()


def brute(rows, least=0.6):
    s = {i: (f, shingles(t)) for i, f, t, *_ in rows}
    return {(x, y) for x in s for y in s if x < y and s[x][0] != s[y][0] and None not in (s[x][0], s[y][0]) and s[x][1] and s[y][1] and len(s[x][1] & s[y][1]) / len(s[x][1] | s[y][1]) >= least}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    out, n = [], 0
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        for v in range(4):
            w = list(words)
            for _ in range(v * 2):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append((n, n % 7, " ".join(w), "", ""))
            n += 1
    same = out[0][2]
    out += [(500, 50, same.upper(), "", ""), (501, 51, same, "", ""), (502, 51, same, "", ""), (503, 52, None, "", ""), (504, 53, "", "", ""), (505, 54, "few words", "", ""), (506, None, same, "", "")]
    return out + [out[3]]


def test_pairs_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in neardup.pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert neardup.pairs(df.limit(0)).count() == 0


def test_shards_larger_than_a_tree_lose_nothing(spark, rows):
    described = stage(neardup.described(spark.createDataFrame(rows, SCHEMA)))
    want = {tuple(r) for r in neardup.candidates(described).collect()}
    for size in (2, 1):
        got = {tuple(r) for r in neardup.candidates(described, shard_size=size).collect()}
        assert len(want - got) <= 0.02 * len(want)  # unlike candidates may be missed
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in neardup.pairs(df, shard_size=2).collect()} == brute(rows)


def test_a_tree_prunes_where_the_radius_is_small():
    rng = random.Random(3)
    tree = neardup.Tree()
    for f in range(1000):
        tree.insert(rng.getrandbits(512), f)
    for radius, share in ((2, 0.4), (neardup.RADIUS, 1.0)):
        tree.visited = 0
        tree.within(rng.getrandbits(512), radius)
        assert tree.visited <= share * 1000


def test_visited(spark, rows):
    got = neardup.visited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and all(0 < r["visited"] <= r["could_visit"] for r in got)
    assert neardup.visited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_follows_only_edges_within_the_radius():
    rng = random.Random(1)
    codes = [rng.getrandbits(128) for _ in range(60)]
    codes += [c ^ (1 << rng.randrange(128)) for c in codes[:30]] + codes[:5]
    tree = neardup.Tree()
    for i, c in enumerate(codes):
        tree.insert(c, i)
    for c in codes[:20]:
        for radius in (0, 3, 50):
            assert sorted(tree.within(c, radius)) == [i for i, x in enumerate(codes) if (x ^ c).bit_count() <= radius]


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["chunk_id"]: r for r in neardup.groups(df).collect()}
    assert len({got[i]["class_id"] for i in (0, 500, 501, 502, 506)}) == 1
    assert got[1]["group_id"] == got[0]["group_id"] != got[40]["group_id"]
    assert not {503, 504, 505} & set(got)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    edges = spark.createDataFrame(chain, "a long, b long")
    roots = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in (100, 101, 102)} == {100}
    assert neardup.components(edges.limit(0)).count() == 0
