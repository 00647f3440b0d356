"""Filling fixed-capacity containers, by exact-complement hashing over item lengths.

How many items of each length there are is all that a packing needs to know: at most
``capacity`` numbers, however many items. On these the driver draws up *recipes* (a multiset of
lengths, and how many containers use it). Sums of one, two and three lengths are indexed by their
value; gaps are filled exactly from that index while counts last, and by best fit otherwise.
Executors then give every item its place: its rank among the items of its length falls in the
slots of one recipe. No step moves more than ``doc_id``, length and rank of an item.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm import tokens
from siltstone.plans.tables import stage

CAPACITY = 4096


@dataclass
class Recipe:
    lengths: dict[int, int]
    times: int
    base: int = 0


class Availability:
    """Counts per length, and which sums of up to three available lengths exist."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64).copy()
        self.there = self.n > 0

    def take(self, length: int, k: int) -> None:
        self.n[length] -= k
        self.there[length] = self.n[length] > 0

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.there[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths that sum to ``gap``; the most uneven such pair, which spends the long ones first."""
        half = gap // 2
        if half < 1 or gap > 2 * self.largest(len(self.n) - 1):
            return None
        ok = self.there[1 : half + 1] & self.there[gap - half : gap][::-1]
        if gap % 2 == 0 and self.n[half] < 2:
            ok[half - 1] = False
        at = int(ok.argmax()) if ok.any() else -1
        return (gap - 1 - at, at + 1) if at >= 0 else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths that sum to ``gap``; the shortest of them as long as possible."""
        most = self.largest(len(self.n) - 1)
        low = max(1, gap - 2 * most)
        for c in np.flatnonzero(self.there[low : gap // 3 + 1])[::-1] + low:
            long = np.arange(max(-(-(gap - c) // 2), 1), min(most, gap - 2 * c) + 1)
            ok = self.there[long] & self.there[gap - c - long]
            for a in long[ok][:4]:  # of one c, at most three can want a length twice
                three = (int(a), int(gap - c - a), int(c))
                if all(self.n[x] >= three.count(x) for x in three):
                    return three
        return None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)

    def largest(self, gap: int) -> int:
        """The longest available length of at most ``gap``; 0 if there is none."""
        fit = np.flatnonzero(self.there[: gap + 1])
        return int(fit[-1]) if len(fit) else 0


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Recipe]:
    """Recipes that use each of ``counts[length]`` items exactly once.

    Each recipe is repeated until one of its lengths runs out, so there are at most a few times
    as many recipes as lengths, whatever the number of items.
    """
    have = Availability(counts)
    have.take(0, int(have.n[0]))
    out: list[Recipe] = []
    while length := have.largest(capacity):
        chosen, gap = [length], capacity - length
        have.take(length, 1)
        while gap:
            found = have.exact(gap) or ((x,) if (x := have.largest(gap)) else None)
            if found is None:
                break
            for x in found:
                have.take(x, 1)
            chosen += found
            gap -= sum(found)
        recipe: dict[int, int] = {}
        for x in chosen:
            recipe[x] = recipe.get(x, 0) + 1
        more = int(min(have.n[x] // k for x, k in recipe.items()))
        for x, k in recipe.items():
            have.take(x, k * more)
        out.append(Recipe(recipe, more + 1))
    return out


def items(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, part, token_from, n``: whole documents, or the parts of those over the capacity.

    An oversized document has as many full parts as fit and one with the rest. Documents without
    tokens take no room and give no item.
    """
    last = F.floor((F.col("n_tokens") - 1) / F.lit(capacity)).cast("int")
    cut = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part").cast("long") * capacity
    return cut.select("doc_id", "part", start.alias("token_from"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("n"))


def _slots(recipes: list[Recipe], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank of each recipe's slots, its number per container and its first container."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(capacity + 1, np.int64)
    base = 0
    for r in recipes:
        for x, k in r.lengths.items():
            rows.setdefault(x, []).append((int(used[x]), k, base))
            used[x] += k * r.times
        base += r.times
    return {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in rows.items()}


def pack_items(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``container`` to a table with ``n`` between 1 and ``capacity``. The table is read three times, so it should be staged."""
    rows = placed.withColumn("_at", F.spark_partition_id())
    rank = F.row_number().over(Window.partitionBy("n", "_at").orderBy("doc_id", "part")) - 1
    rows = stage(rows.withColumn("_rank", rank), "packing")
    per = rows.groupBy("n", "_at").count()
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("n").count().collect():  # one row for each length: at most capacity
        counts[r["n"]] = r["count"]
    slots = _slots(plan(counts, capacity), capacity)
    before = Window.partitionBy("n").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("n").alias("_n"), F.col("_at").alias("_a"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = rows.join(offsets, (F.col("n") == F.col("_n")) & (F.col("_at") == F.col("_a"))).withColumn("_rank", F.col("_rank") + F.col("_before"))

    @F.pandas_udf("long")
    def container(n: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(n), np.int64)
        ns, ranks = n.to_numpy(), rank.to_numpy()
        order = np.argsort(ns, kind="stable")
        for x, at in zip(*_runs(ns[order]), strict=True):
            rows_x = order[at[0] : at[1]]
            first, per_container, base = slots[int(x)]
            k = np.searchsorted(first, ranks[rows_x], side="right") - 1
            out[rows_x] = base[k] + (ranks[rows_x] - first[k]) // per_container[k]
        return pd.Series(out)

    return ranked.withColumn("container", container("n", "_rank")).drop("_at", "_rank", "_n", "_a", "_before")


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    if not len(ordered):
        return ordered, []
    cut = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    return ordered[cut[:-1]], list(zip(cut[:-1], cut[1:], strict=True))


def pack(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``doc_id, part, token_from, n, container`` for all tokens of all documents.

    Null and empty texts have no tokens and no row. Repeated rows are items of their own. Only
    documents over the capacity have more than one part. Extra columns are not kept.
    """
    return pack_items(items(stage(tokens.sizes(documents, vocabulary), "sizes"), capacity), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the lower bound of containers, and the share of unused space."""
    per = packed.groupBy("container").agg(F.sum("n").alias("used"), F.count("*").alias("k"))
    total = per.agg(F.sum("k").alias("items"), F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.withColumn("least", F.ceil(F.col("tokens") / capacity)).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * capacity))


def oversized(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``doc_id`` of documents that had to be split: those of whose parts the packing put some in one container and some in others."""
    packed = pack(documents, capacity, vocabulary)
    per = packed.groupBy("doc_id").agg(F.max("part").alias("last"), F.min("container").alias("least"), F.max("container").alias("most"))
    return per.where("last > 0 and least < most").select("doc_id")
