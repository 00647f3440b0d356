"""Most similar vectors for every vector, with randomly rotated one-bit codes.

Vectors fall into lists by their nearest of ``k`` centroids. Within a list each vector o is known by
the signs of its residual to the centroid, padded with zeros to ``BITS`` dimensions and rotated at
random (``BITS`` packed bits), the residual's length and the correction <sign(o), o> / sqrt(BITS).
A searching vector's residual q is rotated alike. From the bits and scalars alone

    <o, q> ~ <sign(o), q> / correction,  off by at most  EPS * sqrt((1 - c^2) / c^2) / sqrt(BITS - 1)

(up to chance, EPS standard deviations). Bits, scalars and bound are laid out so that one matrix
product gives every pair's *upper bound*. The k-th best of the few with the highest bounds is a
threshold, and only vectors whose bound reaches it are compared exactly; those that decide the order
once more in double precision.

A vector searches its own list first. Its k-th best similarity there goes with it to other lists,
and only to those that can hold a better one: the ball of that distance has to cross both the
hyperplane half-way to the other centroid (all members are nearer to their own) and the list's own
ball. Most vectors ask none; of those that might ask more, the ``PROBES - 1`` lists of the nearest
centroids are asked, which is the loss that is accepted (``probes=None`` asks them all).

Equal vectors are one class: it searches once and is found under its ``k + 1`` smallest ids, which
is all that anyone's k nearest can contain of it. The centroids are fitted to a sample of at most
``2 * SAMPLE`` rows; every row is indexed and searches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.plans.tables import spread, stage

K = 5
PROBES = 8
EPS = 3.0
BITS = 256
SEEDS = 12
SAMPLE = 65_536
LISTS_MAX = 16_384
BLOCK = 8192
#: What single precision may be off by, in a similarity and in a squared distance.
FUZZ = np.float32(2e-6)
SLACK = 1e-4


def rotation(dim: int, bits: int = BITS) -> np.ndarray:
    """A fixed random rotation of ``bits`` dimensions, as far as it concerns the first ``dim``."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(7)).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim].astype(np.float32)


def fit(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centroids of the unit vectors ``x`` by k-means; a centroid that lost all its vectors moves to one far from its own."""
    rng = np.random.Generator(np.random.PCG64(11))
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near, best = _nearest(x, c, 1)
        near, best = near[:, 0], best[:, 0]
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        c[full] = np.add.reduceat(x[order], np.r_[0, np.cumsum(n[full])[:-1]], axis=0) / n[full, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-best)[: len(empty)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` nearest centroids of each row, nearest first, and the squared distances less the row's own square."""
    half = (c * c).sum(1)
    out, dist = np.empty((len(x), m), np.int32), np.empty((len(x), m), np.float32)
    for at in range(0, len(x), 2048):
        d = half - 2 * (x[at : at + 2048] @ c.T)
        if m == 1:
            best = d.argmin(1)[:, None]
        elif m < d.shape[1]:
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
        else:
            best = np.broadcast_to(np.arange(d.shape[1]), d.shape)[:, :m]
        v = np.take_along_axis(d, best, 1)
        order = np.argsort(v, axis=1)
        out[at : at + 2048], dist[at : at + 2048] = np.take_along_axis(best, order, 1), np.take_along_axis(v, order, 1)
    return out, dist


def matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, unit vectors)`` of the valid entries: of the right length, finite and not all zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ok = np.flatnonzero(size == dim)
    flat = lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((flat * flat).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return ok[good], flat[good] / norm[good, None]


class Block:
    """The codes of the vectors of one list (or a part of a large one), ready to be searched."""

    def __init__(self, x: np.ndarray, ids: pa.ListArray, centroid: np.ndarray, turn: np.ndarray) -> None:
        self.x, self.centroid, self.turn = x, centroid, turn
        self.x32 = x.astype(np.float32)
        self.ids = ids.flatten().to_numpy()
        self.first = np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
        r = (self.x32 - centroid) @ turn.T
        self.bits = turn.shape[0]
        square = np.einsum("ij,ij->i", r, r)
        length = np.sqrt(square) + np.float32(1e-12)
        fix = np.abs(r).sum(1) / (length * np.sqrt(np.float32(self.bits)))
        fix = np.where(fix > 0, fix, 1)  # 0 only where the vector is the centroid
        error = np.sqrt(np.maximum(0, 1 - fix**2)) / fix / np.sqrt(np.float32(max(1, self.bits - 1)))
        self.codes = np.packbits(r > 0, axis=1)
        self.scalars = np.stack([length / fix / np.sqrt(np.float32(self.bits)), EPS * error * length, -square / 2], axis=1)

    def columns(self) -> np.ndarray:
        """Codes and scalars as the right side of the product that gives the bounds."""
        signs = np.unpackbits(self.codes, axis=1, count=self.bits).astype(np.float32)
        signs *= 2
        signs -= 1
        signs *= self.scalars[:, :1]
        return np.concatenate([signs, self.scalars[:, 1:]], axis=1).T

    def search(self, q: np.ndarray, k: int, tau: np.ndarray | None = None, columns: np.ndarray | None = None):
        """``(found per row, ids, similarities, kept per row, threshold)`` of the unit vectors ``q``.

        Ids and similarities (to 12 decimals) are those of the ``k`` best, equal ones by id, as far as
        they reach the row's ``tau``. ``kept`` counts what was compared exactly; ``threshold`` is the
        similarity of the ``k``-th best vector, -2 if there are fewer.
        """
        q32, n, m = q.astype(np.float32), len(self.x), len(q)
        r = (q32 - self.centroid) @ self.turn.T
        square = np.einsum("ij,ij->i", r, r)
        left = np.concatenate([r, np.sqrt(square)[:, None], np.ones((m, 1), np.float32)], axis=1)
        bound = left @ (self.columns() if columns is None else columns)  # less 1 - square / 2, the same for a whole row
        least = np.full(m, -2, np.float32) if tau is None else tau.astype(np.float32) - FUZZ
        if tau is None and n > SEEDS:
            best = np.argpartition(bound, n - SEEDS, axis=1)[:, n - SEEDS :]
            seeds = np.matmul(self.x32[best], q32[:, :, None])[:, :, 0]
            least = np.partition(seeds, SEEDS - k, axis=1)[:, SEEDS - k] - FUZZ
        i, j = np.divmod(np.flatnonzero(bound >= (least - 1 + square / 2 - FUZZ)[:, None]), n)
        kept = np.bincount(i, minlength=m) + (SEEDS if tau is None and n > SEEDS else 0)
        sim = np.einsum("ij,ij->i", q32[i], self.x32[j])
        order = np.lexsort((-sim, i))
        i, j, sim = i[order], j[order], sim[order]
        start = np.searchsorted(i, np.arange(m + 1))
        full = np.flatnonzero(np.diff(start) >= k)
        threshold = np.full(m, -2, np.float32)
        threshold[full] = sim[start[full] + k - 1]
        close = sim >= np.maximum(threshold, least)[i] - FUZZ
        i, j = i[close], j[close]
        exact = np.round(np.einsum("ij,ij->i", q[i], self.x[j]), 12)
        n_ids = self.first[j + 1] - self.first[j]
        at = np.repeat(self.first[j] - np.r_[0, np.cumsum(n_ids)[:-1]], n_ids) + np.arange(int(n_ids.sum()))
        i, ids, exact = np.repeat(i, n_ids), self.ids[at], np.repeat(exact, n_ids)
        order = np.lexsort((ids, -exact, i))
        i = i[order]
        take = np.arange(len(i)) - np.searchsorted(i, i) < k
        return np.bincount(i[take], minlength=m), ids[order][take], exact[order][take], kept, threshold


class Lists:
    """What every task knows of the lists: centroids, radii, and which other lists a vector has to ask."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray, probes: int | None) -> None:
        self.c, self.radii, self.probes = centroids, radii, probes
        self.square = np.einsum("ij,ij->i", centroids, centroids)

    def others(self, q: np.ndarray, home: int, tau: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, list)`` of the lists besides ``home`` that may hold a vector more similar than ``tau``."""
        if len(self.c) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        far2 = np.maximum(0, (q * q).sum(1)[:, None] + self.square - 2 * (q @ self.c.T))
        reach = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(tau, -1)) + SLACK)
        apart = np.sqrt(np.maximum(0, self.square + self.square[home] - 2 * (self.c @ self.c[home])))
        ok = far2 - far2[:, home : home + 1] <= 2 * reach[:, None] * apart + SLACK
        ok &= far2 <= (reach[:, None] + self.radii) ** 2 + SLACK
        ok[:, home] = False
        ok[:, self.radii < 0] = False
        if self.probes is not None and self.probes - 1 < ok.shape[1]:
            many = np.flatnonzero(ok.sum(1) > self.probes - 1)
            if len(many):
                d = np.where(ok[many], far2[many], np.float32(9))
                near = np.argpartition(d, self.probes - 1, axis=1)[:, : self.probes - 1]
                ok[many] = False
                ok[many[:, None], near] = True
        return np.nonzero(ok)


_FOUND = "c1 long, c2 long, ids array<long>, sims array<double>, seen long, kept long, list int, tau float, x binary"
_NAMES = [f.split(" ")[0] for f in _FOUND.split(", ")]


def _lists_of(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def _answers(c1: pa.Array, c2: pa.Array, found, n: int) -> pa.RecordBatch:
    counts, ids, sims, kept, _ = found
    none = lambda t: pa.nulls(len(c1), t)
    cols = [c1, c2, _lists_of(ids, counts), _lists_of(sims, counts), pa.array(np.full(len(c1), n)), pa.array(kept.astype(np.int64)), none(pa.int32()), none(pa.float32()), none(pa.binary())]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _asks(c1: pa.Array, c2: pa.Array, x: pa.BinaryArray, rows: np.ndarray, lists: np.ndarray, tau: np.ndarray) -> pa.RecordBatch:
    at = pa.array(rows)
    none = lambda t: pa.nulls(len(rows), t)
    cols = [c1.take(at), c2.take(at), none(pa.list_(pa.int64())), none(pa.list_(pa.float64())), none(pa.int64()), none(pa.int64()), pa.array(lists.astype(np.int32)), pa.array(tau[rows].astype(np.float32)), x.take(at)]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _packed(x: np.ndarray) -> pa.BinaryArray:
    """Rows of single-precision numbers as bytes, which the JVM passes on without looking into them."""
    n, size = x.shape[0], x.shape[1] * 4
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x, np.float32))])


def _unit(x: pa.BinaryArray, dim: int) -> np.ndarray:
    _, offsets, data = x.buffers()
    first = np.frombuffer(offsets, np.int32)[x.offset]
    v = np.frombuffer(data, np.float32, len(x) * dim, first).reshape(-1, dim).astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _searched(batches, dim: int, k: int, lists: Lists, at_home: bool):
    """Rows sorted by list, block and role (stored first) -> answers, and at home also what is asked of other lists.

    At home the stored rows of a block search it themselves. Holds one block beside a batch.
    """
    turn = rotation(dim)
    key, stored, block, columns = None, [], None, None

    def close():
        """The block of the stored rows so far, and what it yields at home."""
        nonlocal stored, block, columns
        rows, stored = pa.Table.from_batches(stored).combine_chunks(), []
        c1, c2, xs, ids = (rows.column(c).combine_chunks() for c in ("c1", "c2", "x", "ids"))
        block = Block(_unit(xs, dim), ids, lists.c[key[0]], turn)
        columns = block.columns()
        if at_home:
            for at in range(0, len(block.x), 256):
                q = block.x[at : at + 256]
                found = block.search(q, k, None, columns)
                own = [a.slice(at, len(q)) for a in (c1, c2, xs)]
                yield _answers(own[0], own[1], found, len(block.x))
                row, other = lists.others(q.astype(np.float32), key[0], found[4])
                if len(row):
                    yield _asks(*own, row, other, found[4])

    for b in batches:
        if not b.num_rows:
            continue
        home, part, role = (b.column(c).to_numpy() for c in ("list", "block", "role"))
        cut = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1]), True])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            here = (int(home[lo]), int(part[lo]))
            if here != key:
                if stored and at_home:
                    yield from close()
                key, stored, block = here, [], None
            rows = b.slice(lo, hi - lo)
            if role[lo] == 0:
                stored.append(rows)
                continue
            if block is None:
                if not stored:
                    continue
                yield from close()
            q, tau = _unit(rows.column("x"), dim), rows.column("tau").to_numpy(zero_copy_only=False)
            for at in range(0, len(q), 256):
                found = block.search(q[at : at + 256], k, None if at_home else tau[at : at + 256], columns)
                yield _answers(rows.column("c1").slice(at, 256), rows.column("c2").slice(at, 256), found, len(block.x))
    if stored and at_home:
        yield from close()


def _described(rows: DataFrame, dim: int, centroids: np.ndarray) -> DataFrame:
    """``chunk_id, c1, c2, list, far, x``: class, list and squared distance from the centroid of every valid vector, and the vector in single precision."""

    def describe(batches):
        from xxhash import xxh3_128_intdigest as digest

        mask = (1 << 64) - 1
        for b in batches:
            at, unit = matrix(b.column("embedding"), dim)
            raw = b.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
            h = [digest(v.tobytes()) for v in raw]
            c1, c2 = (np.array([v >> s & mask for v in h], np.uint64).view(np.int64) for s in (0, 64))
            near, best = _nearest(unit.astype(np.float32), centroids, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk_id").take(pa.array(at)), pa.array(c1), pa.array(c2), pa.array(near[:, 0]), pa.array(np.maximum(0, best[:, 0] + 1)), _packed(raw)],
                ["chunk_id", "c1", "c2", "list", "far", "x"],
            )

    return rows.mapInArrow(describe, "chunk_id long, c1 long, c2 long, list int, far float, x binary")


def _searches(vectors: DataFrame, k: int, probes: int | None, lists: int | None) -> tuple[DataFrame, DataFrame] | None:
    """``(members, answers)``: chunk ids with their class, and what each class found, an answer for each block it searched."""
    spark = vectors.sparkSession
    rows = vectors.where("chunk_id is not null and embedding is not null").select("chunk_id", "embedding")
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n")  # a row for each length
    head = lengths.where("n > 0").first()
    if head is None:
        return None
    dim, n = head["n"], head["count"]
    k_lists = lists or int(min(LISTS_MAX, max(1, round(1.6 * n**0.5))))
    share = int(min(1.0, min(SAMPLE, max(2048, 32 * k_lists)) / n) * (1 << 30))
    sample = rows.where((F.shiftrightunsigned(F.xxhash64("chunk_id"), 34) < share) & (F.size("embedding") == dim)).limit(2 * SAMPLE).select("embedding").toArrow()
    _, x = matrix(sample.column("embedding"), dim)
    centroids = fit(x.astype(np.float32), min(k_lists, len(x))) if len(x) else np.zeros((1, dim), np.float32)
    coded = stage(_described(spread(rows), dim, centroids), "coded")
    members = coded.select("chunk_id", "c1", "c2").distinct()
    few = members.withColumn("_r", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("chunk_id"))).where(F.col("_r") <= k + 1)
    ids = few.groupBy("c1", "c2").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    one = coded.groupBy("c1", "c2").agg(*(F.first(c).alias(c) for c in ("list", "far", "x")))  # of one class all are alike
    classes = stage(one.join(ids, ["c1", "c2"]), "classes")
    sizes = classes.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each list, at most LISTS_MAX
    radii = np.full(len(centroids), -1, np.float32)
    for r in sizes:
        radii[r["list"]] = np.sqrt(r["far"])
    known = Lists(centroids, radii, probes)
    parts = F.broadcast(spark.createDataFrame([(int(r["list"]), -(-int(r["n"]) // BLOCK)) for r in sizes], "list int, blocks int"))
    own = F.pmod(F.xxhash64("c1"), F.col("blocks").cast("long")).cast("int")
    cols = ["list", "block", "role", "c1", "c2", "tau", "ids", "x"]
    no_ids, no_tau = F.expr("cast(array() as array<long>)").alias("ids"), F.lit(None).cast("float").alias("tau")
    base = classes.join(parts, "list").withColumn("block", own)
    stored = base.select("list", "block", F.lit(0).alias("role"), "c1", "c2", no_tau, "ids", "x")
    # the members of a list of several blocks search the other blocks too
    foreign = base.where("blocks > 1").select("list", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("block"))).alias("block"), F.lit(1).alias("role"), "c1", "c2", no_tau, no_ids, "x")
    together = lambda a, b: a.select(*cols).unionByName(b.select(*cols)).repartition("list", "block").sortWithinPartitions("list", "block", "role")
    home = stage(together(stored, foreign).mapInArrow(lambda it: _searched(it, dim, k + 1, known, True), _FOUND), "home")
    asked = home.where("list is not null").select("c1", "c2", "list", "tau", "x").join(parts, "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "c1", "c2", "tau", no_ids, "x")
    away = together(stored, asked).mapInArrow(lambda it: _searched(it, dim, k + 1, known, False), _FOUND)
    answers = ["c1", "c2", "ids", "sims", "seen", "kept"]
    return members, home.where("list is null").select(*answers).unionByName(away.select(*answers))


def neighbours(vectors: DataFrame, k: int = K, probes: int | None = PROBES, lists: int | None = None) -> DataFrame:
    """``chunk_id, ids, sims``: the ``k`` most similar others of every vector, best first.

    Ids are distinct; of rows with one id the vectors are taken to be equal. Null vectors, all-zero
    and non-finite ones and those of another length than most are left out. Of equal
    similarities (to 12 decimals) the smaller id comes first. Fewer than ``k`` others may be found
    where the lists searched hold fewer. Extra columns are not kept.
    """
    searched = _searches(vectors, k, probes, lists)
    if searched is None:
        return vectors.sparkSession.createDataFrame([], "chunk_id long, ids array<long>, sims array<double>")
    members, near = searched
    # at most probes * blocks short arrays for each class
    merged = near.where(F.size("ids") > 0).groupBy("c1", "c2").agg(F.flatten(F.collect_list(F.arrays_zip("sims", "ids"))).alias("all"))
    best = merged.select("c1", "c2", F.slice(F.array_sort(F.transform("all", lambda p: F.struct((-p["sims"]).alias("far"), p["ids"].alias("id")))), 1, k + 1).alias("best"))
    own = F.slice(F.filter("best", lambda p: p["id"] != F.col("chunk_id")), 1, k)
    return members.join(best, ["c1", "c2"]).select("chunk_id", own.alias("own")).select("chunk_id", F.col("own.id").alias("ids"), F.transform("own.far", lambda v: -v).alias("sims"))


def kept_share(vectors: DataFrame, k: int = K, probes: int | None = PROBES, lists: int | None = None) -> DataFrame:
    """One row: of the pairs whose codes were compared, how many and which share was compared exactly, and how many blocks a vector searches."""
    searched = _searches(vectors, k, probes, lists)
    if searched is None:
        return vectors.sparkSession.createDataFrame([(0, 0, None, None)], "estimated long, compared long, share double, blocks double")
    total = searched[1].groupBy("c1", "c2").agg(F.sum("seen").alias("seen"), F.sum("kept").alias("kept"), F.count("*").alias("blocks"))
    total = total.agg(F.sum("seen").alias("estimated"), F.sum("kept").alias("compared"), F.avg("blocks").alias("blocks"))
    return total.select("estimated", "compared", (F.col("compared") / F.col("estimated")).alias("share"), "blocks")


def pairs(vectors: DataFrame, k: int = K) -> DataFrame:
    """``chunk_id_a < chunk_id_b`` where at least one is among the other's ``k`` most similar."""
    each = neighbours(vectors, k).select("chunk_id", F.explode("ids").alias("other"))
    return each.select(F.least("chunk_id", "other").alias("chunk_id_a"), F.greatest("chunk_id", "other").alias("chunk_id_b")).distinct()
