"""Several stores searched as one."""

from __future__ import annotations

import os
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.filters import Filter
from siltstone.operators import fusion
from siltstone.sources.store import Store


#: Paths that one listing shows at most.
PATHS_MOST = 10_000


def store_dirs(given: Sequence[str], env: str | None = None) -> list[str]:
    """The given directories, else those of the environment variable, else the default one."""
    if given:
        return list(given)
    named = [p for p in (env if env is not None else os.environ.get("SILTSTONE_STORE", "")).split(os.pathsep) if p]
    return named or [".siltstone"]


def labels(dirs: Sequence[str]) -> list[str]:
    """A directory's name, its parent's if it is hidden; where several would be called alike, the whole path."""

    def own(d: str) -> str:
        name = os.path.basename(d)
        return (os.path.basename(os.path.dirname(d)) or name) if name.startswith(".") else name

    short = [own(d) for d in dirs]
    return [d if short.count(s) > 1 else s for d, s in zip(dirs, short, strict=True)]


class Fleet:
    def __init__(self, spark: SparkSession, dirs: Iterable[str]) -> None:
        real = list(dict.fromkeys(os.path.realpath(d) for d in dirs))
        self.spark = spark
        self.stores = [Store.open_existing(spark, d) for d in real]
        self.labels = labels(real)

    def chosen(self, only: Sequence[str] | None = None) -> list[tuple[int, str, Store]]:
        everything = [(i, n, s) for i, (n, s) in enumerate(zip(self.labels, self.stores, strict=True))]
        wanted = list(dict.fromkeys(only or []))
        if unknown := [w for w in wanted if w not in self.labels]:
            raise ValueError(f"no store named {', '.join(unknown)}; open stores: {', '.join(self.labels)}")
        return [x for x in everything if not wanted or x[1] in wanted]

    def writable(self, only: Sequence[str] | None = None) -> Store:
        found = self.chosen(only)
        if len(found) != 1:
            raise ValueError(f"name one store to write to; open stores: {', '.join(self.labels)}")
        return found[0][2]

    def matching_files(self, narrowed: Filter) -> int:
        return sum(s.matching_files(narrowed) for s in self.stores)

    def search(self, query: str, k: int = 8, narrowed: Filter | None = None, only: Sequence[str] | None = None) -> DataFrame:
        """The ``k`` best of all stores, ``store`` null where only one is open. A query is embedded once for each model."""
        vectors: dict[str, list[float]] = {}
        ranked = []
        for i, name, store in self.chosen(only):
            v = vectors.setdefault(store.model, vectors.get(store.model) or store.query_vector(query))
            ranked.append(store.search(query, k, narrowed, v).withColumn("store", F.lit(name if len(self.stores) > 1 else None).cast("string")).withColumn("store_ord", F.lit(i)))
        hits = fusion.merge(reduce(DataFrame.unionByName, ranked), k)
        return hits.orderBy("merged").select("score", "path", "start_line", "end_line", "text", "store", "similarity")

    def paths(self, narrowed: Filter, limit: int, only: Sequence[str] | None = None) -> tuple[list[str], int]:
        """At most ``limit`` paths (and ``PATHS_MOST``) in order of store and path, and how many more there are."""
        parts = [s.files().where(narrowed.predicate(F.col("path"))).select(F.lit(i).alias("o"), F.lit(n).alias("n"), "path") for i, n, s in self.chosen(only)]
        all_paths = reduce(DataFrame.unionByName, parts)
        rows = all_paths.orderBy("o", "path").limit(min(max(limit, 1), PATHS_MOST)).collect()
        shown = [f"[{r['n']}] {r['path']}" if len(self.stores) > 1 else r["path"] for r in rows]
        return shown, all_paths.count() - len(rows)

    def stats(self) -> list[tuple[str, dict]]:
        return [(n, s.stats()) for n, s in zip(self.labels, self.stores, strict=True)]
