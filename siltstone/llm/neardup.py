"""Near-duplicate records, by BK-trees over the Hamming distance of min-hash codes.

A record is the set of its runs of three successive words. ``BANDS`` x ``ROWS`` of its min-hashes
give it one shard key for each band, and ``NIBBLE`` bits of each of ``HASHES`` min-hashes its code. Two
sets of similarity s differ in a share (1 - s) / 2 of the bits, give or take 0.026, and
at least one shard is common but for a share (1 - s^3)^24 (0.3 % at 0.6, 0.02 % at 0.7).

A BK-tree prunes little at such a similarity: unlike records are half of all bits apart (256 of 512),
give or take 11, and edges between them all lie within the radius of 148. So the shards cut
the work: every shard that holds two or more records has a BK-tree of its own. Children are keyed by
their integer distance to the parent, and a search follows only the edges within the radius, which
are nearly all (``visited`` has the figures).

First the keys alone are brought together, and only records that share one send their codes. Trees hold at most
``SHARD`` records. A larger shard, such as the pages of one template, is cut by the other bands of
its codes (of which a pair misses all with 0.005 % at 0.6); what still is larger then is split among several trees, each searched by the records of
the ones after it. What the trees find is checked on the sets themselves.

Records with the same set are one class throughout and only expanded at the end, where the result
has to name every pair.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans.tables import spread, stage

THRESHOLD = 0.6
BANDS, ROWS = 24, 3
HASHES, NIBBLE = 128, 4
RADIUS = 148
SHARD = 4096
LEAST_WORDS = 20
FEW = 500_000
KNOWN = 1 << 20
_WORD = re.compile(r"\w+")
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


class Shingles:
    """Distinct hashes of three successive words of each text of a batch, sorted within each text."""

    def __init__(self, texts: list[str | None], known: dict[str, int]) -> None:
        from xxhash import xxh3_64_intdigest as digest

        each = []
        for t in texts:
            ws = _WORD.findall(t.lower()) if t else []
            each.append(ws if len(ws) >= LEAST_WORDS else [])
        if len(known) > 1 << 20:
            known.clear()
        flat = np.fromiter((known.get(w) or known.setdefault(w, digest(w)) for ws in each for w in ws), np.uint64)
        n = np.array([len(ws) for ws in each], np.int64)
        if not len(flat):
            self.hash, self.first = flat, np.zeros(len(texts) + 1, np.int64)
            return
        text = np.repeat(np.arange(len(n)), n)
        h = _mix(_mix(_mix(flat)[:-2] + flat[1:-1]) + flat[2:])
        inside = text[:-2] == text[2:]
        h, text = h[inside], text[:-2][inside]
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])] if len(h) else np.zeros(0, bool)
        self.hash, text = h[new], text[new]
        self.first = np.searchsorted(text, np.arange(len(n) + 1))


def signatures(s: Shingles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(which texts, class, keys of the bands, code in bytes)`` of the texts that have shingles."""
    which = np.flatnonzero(np.diff(s.first))
    if not len(which):
        return which, np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64), np.zeros((0, HASHES * NIBBLE // 8), np.uint8)
    starts = s.first[which]
    least = np.empty((HASHES, len(which)), np.uint64)
    for i in range(HASHES):
        least[i] = np.minimum.reduceat(s.hash * _A[i] + _B[i], starts)
    one = _mix(s.hash)
    whole = _mix(np.add.reduceat(one, starts)) ^ np.bitwise_xor.reduceat(one * _M2, starts)
    keys = np.empty((len(which), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(which), b + 1, np.uint64)
        for r in range(ROWS):
            k = _mix(k ^ least[b * ROWS + r])
        keys[:, b] = k
    nibbles = (_mix(least) & _U(15)).astype(np.uint8)
    return which, whole.view(np.int64), keys.view(np.int64), np.ascontiguousarray((nibbles[::2] << 4 | nibbles[1::2]).T)


_DESCRIBED = "chunk_id long, file_id long, class long, code binary, shards array<long>"


def described(chunks: DataFrame) -> DataFrame:
    """``chunk_id, file_id, class, code, shards`` of the chunks of at least ``LEAST_WORDS`` words.

    Of the chunks of one class that a task meets only the first has a code and keys (but for a class
    that comes again after ``KNOWN`` others), so that copies don't pile up in their shards.
    """
    names = [f.split(" ")[0] for f in _DESCRIBED.split(", ")]

    def describe(batches):
        known: dict[str, int] = {}
        seen: set[int] = set()
        for b in batches:
            which, whole, keys, code = signatures(Shingles(b.column("text").to_pylist(), known))
            new = np.zeros(len(which), bool)
            if len(seen) > KNOWN:
                seen.clear()
            for i, c in enumerate(whole.tolist()):
                if c not in seen:
                    seen.add(c)
                    new[i] = True
            take = b.select(["chunk_id", "file_id"]).take(pa.array(which))
            told = np.cumsum(new) - 1
            own = keys[new]
            shards = pa.array([own[t] if n else None for t, n in zip(told.tolist(), new.tolist(), strict=True)], pa.list_(pa.int64()))
            codes = pa.array([code[i].tobytes() if n else None for i, n in enumerate(new.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*take.columns, pa.array(whole), codes, shards], names)

    rows = chunks.where(F.length("text") >= 2 * LEAST_WORDS - 1).select("chunk_id", "file_id", "text")
    return spread(rows).mapInArrow(describe, _DESCRIBED)


class Tree:
    """A BK-tree: the edge to a child has the integer distance of its code to the parent's."""

    __slots__ = ("codes", "items", "edges", "visited")

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.items: list[list[int]] = []
        self.edges: list[dict[int, int]] = []
        self.visited = 0

    def insert(self, code: int, item: int) -> None:
        at = 0 if self.codes else -1
        while at >= 0:
            d = (self.codes[at] ^ code).bit_count()
            if not d:
                self.items[at].append(item)
                return
            nxt = self.edges[at].get(d)
            if nxt is None:
                self.edges[at][d] = len(self.codes)
                break
            at = nxt
        self.codes.append(code)
        self.items.append([item])
        self.edges.append({})

    def within(self, code: int, radius: int) -> list[int]:
        """Items at most ``radius`` away; only edges between d - radius and d + radius are followed."""
        found: list[int] = []
        todo = [0] if self.codes else []
        while todo:
            at = todo.pop()
            self.visited += 1
            d = (self.codes[at] ^ code).bit_count()
            if d <= radius:
                found += self.items[at]
            for edge, child in self.edges[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def _tree_pass(batches, radius: int, counts: bool = False):
    """Rows sorted by shard, tree and role (members first) -> pairs, or how much of the trees was visited. Holds one tree at a time.

    A member searches what its tree holds so far and enters it; others only search.
    """
    last, tree = None, Tree()

    def report():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (members, could, tree.visited)], ["members", "could_visit", "visited"])

    members = could = 0
    for b in batches:
        left, right = [], []
        for shard, at, i, raw, own in zip(*(b.column(c).to_pylist() for c in ("shard", "tree", "id", "code", "member")), strict=True):
            if (shard, at) != last:
                if counts and members:
                    yield report()
                last, tree, members, could = (shard, at), Tree(), 0, 0
            code = int.from_bytes(raw)
            could += len(tree.codes)
            near = tree.within(code, radius)
            left += [i] * len(near)
            right += near
            if own:
                tree.insert(code, i)
                members += 1
        if not counts:
            x, y = np.array(left, np.int64), np.array(right, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
    if counts and members:
        yield report()


def _together(keyed: DataFrame) -> DataFrame:
    """``shard, id, n``: the rows of ``keyed(shard, id)`` whose shard holds ``n`` > 1 different ids. 16 bytes a row are shuffled, once."""
    one = keyed.repartition("shard").groupBy("shard", "id").agg(F.lit(1).alias("_"))
    return one.withColumn("n", F.count("*").over(Window.partitionBy("shard"))).where("n > 1").select("shard", "id", "n")


def _members(rows: DataFrame, shard_size: int) -> DataFrame:
    """``shard, tree, id, code, member``: which trees each class enters or searches. ``rows`` is the staged result of :func:`described`."""
    told = rows.where("shards is not null")
    first = stage(_together(told.select(F.explode("shards").alias("shard"), F.col("class").alias("id"))), "shards")
    small = first.where(F.col("n") <= shard_size).select("shard", "id", F.lit(1).alias("trees"))
    large = first.where(F.col("n") > shard_size)
    if not large.isEmpty():
        placed = told.select(F.col("class").alias("id"), F.hex("code").alias("digits"), F.posexplode("shards").alias("own", "shard"))  # a digit for each min-hash
        cut = large.join(placed, ["shard", "id"]).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)))).where("band <> own")
        cut = cut.select(F.xxhash64("shard", "band", F.substring("digits", F.col("band") * ROWS + 1, F.lit(ROWS))).alias("shard"), "id")
        again = stage(_together(cut), "fresh-shards")
        small = small.unionByName(again.select("shard", "id", F.ceil(F.col("n") / shard_size).cast("int").alias("trees")))
    codes = told.select(F.col("class").alias("id"), "code")
    wanted = small.select("id").distinct()
    codes = codes.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("code").alias("code"))
    home = F.pmod(F.xxhash64("id"), F.col("trees")).cast("int")
    placed = small.join(codes, "id").select("shard", "id", "code", home.alias("home"), F.explode(F.sequence(F.lit(0), home)).alias("tree"))
    return placed.select("shard", "tree", "id", "code", (F.col("tree") == F.col("home")).alias("member"))


def candidates(rows: DataFrame, radius: int = RADIUS, shard_size: int = SHARD) -> DataFrame:
    """Pairs ``a < b`` of class ids whose codes lie within ``radius`` in a common shard. ``rows`` is the staged result of :func:`described`."""
    ordered = _members(rows, shard_size).repartition("shard", "tree").sortWithinPartitions("shard", "tree", F.desc("member"))
    return ordered.mapInArrow(lambda it: _tree_pass(it, radius), "a long, b long").distinct()


def visited(chunks: DataFrame, radius: int = RADIUS, shard_size: int = SHARD) -> DataFrame:
    """How much of the trees the searches visit, by tree size: ``least_members`` (a power of two), ``trees, could_visit, visited, share``."""
    rows = stage(described(chunks.where("file_id is not null")), "described")
    ordered = _members(rows, shard_size).repartition("shard", "tree").sortWithinPartitions("shard", "tree", F.desc("member"))
    told = ordered.mapInArrow(lambda it: _tree_pass(it, radius, True), "members long, could_visit long, visited long")
    size = F.pow(2.0, F.floor(F.log2("members"))).cast("long").alias("least_members")
    each = told.groupBy(size).agg(F.count("*").alias("trees"), F.sum("could_visit").alias("could_visit"), F.sum("visited").alias("visited"))
    return each.withColumn("share", F.when(F.col("could_visit") > 0, F.col("visited") / F.col("could_visit")))


def sets_of(chunks: DataFrame) -> DataFrame:
    """``chunk_id, s``: the distinct shingle hashes."""

    def compute(batches):
        known: dict[str, int] = {}
        for b in batches:
            s = Shingles(b.column("text").to_pylist(), known)
            lists = pa.ListArray.from_arrays(pa.array(s.first.astype(np.int32)), pa.array(s.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), lists], ["chunk_id", "s"])

    return chunks.select("chunk_id", "text").mapInArrow(compute, "chunk_id long, s array<long>")


def linked_classes(chunks: DataFrame, rows: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD) -> DataFrame:
    """``class_a, class_b, similarity`` of different classes with at least ``threshold``.

    ``rows`` is the staged result of :func:`described`.
    """
    pairs = stage(candidates(rows, shard_size=shard_size), "candidates")
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    of = stage(rows.select("class", "chunk_id").join(wanted, "class", "left_semi").groupBy("class").agg(F.min("chunk_id").alias("chunk_id")), "wanted")
    few = F.broadcast(of) if of.count() <= FEW else of  # at most 16 bytes a row
    sets = stage(sets_of(chunks.select("chunk_id", "text").join(few.select("chunk_id"), "chunk_id", "left_semi")).join(few, "chunk_id").select("class", "s"), "sets")
    a = sets.select(F.col("class").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("class").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    checked = pairs.join(a, "a").join(b, "b").select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))
    linked = checked.where(F.col("similarity") >= threshold).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")
    return linked.distinct()  # a repeated chunk row repeats its set


def pairs(chunks: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD) -> DataFrame:
    """``chunk_id_a < chunk_id_b`` of different files with at least ``threshold`` similarity.

    Chunks of fewer than ``LEAST_WORDS`` words, null and empty texts are in no pair. Chunks with
    a null ``file_id`` are in none either, as nobody knows whether the files differ. Repeated
    chunk ids count once. Every pair of equal sets is named, as the result requires.
    """
    rows = stage(described(chunks.where("file_id is not null")), "described")
    links = linked_classes(chunks, rows, threshold, shard_size)
    member = rows.select("class", "chunk_id", "file_id").distinct()
    a = member.select(F.col("class").alias("class_a"), F.col("chunk_id").alias("x"), F.col("file_id").alias("fx"))
    b = member.select(F.col("class").alias("class_b"), F.col("chunk_id").alias("y"), F.col("file_id").alias("fy"))
    across = links.join(a, "class_a").join(b, "class_b").where("fx <> fy").select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))
    more = rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    again = member.join(more, "class", "left_semi")
    p, q = again.select("class", F.col("chunk_id").alias("chunk_id_a"), F.col("file_id").alias("fx")), again.select("class", F.col("chunk_id").alias("chunk_id_b"), F.col("file_id").alias("fy"))
    within = p.join(q, "class").where("chunk_id_a < chunk_id_b and fx <> fy").select("chunk_id_a", "chunk_id_b")
    return across.unionByName(within)


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component of ``edges(a, b)``.

    Labels spread along the edges and are then doubled (a node takes its root's root), so the
    rounds grow with the logarithm of a component's diameter. Each round is a written table.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = spread.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = stage(spread.join(jump, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "old"), "labels")
        labels = new.select("node", "root")
        if new.where("root <> old").isEmpty():
            return labels


def groups(chunks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``chunk_id, group_id, class_id, links`` for every chunk that can be a case.

    ``group_id`` is the smallest class of the chunk's component, ``class_id`` its class of equal
    sets, ``links`` the number of other classes its own is linked to (within a file or across).
    """
    rows = stage(described(chunks), "described")
    links = stage(linked_classes(chunks, rows, threshold), "links")
    edges = links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    roots = components(edges)
    degree = edges.select("a").union(edges.select(F.col("b").alias("a"))).groupBy("a").count()
    out = rows.select("chunk_id", "class").join(roots, F.col("class") == F.col("node"), "left").join(degree, F.col("class") == F.col("a"), "left")
    return out.select("chunk_id", F.coalesce("root", "class").alias("group_id"), F.col("class").alias("class_id"), F.coalesce("count", F.lit(0)).alias("links"))
