"""Path, extension and language filters as Spark predicates.

A filter is a conjunction of groups, each a disjunction of glob patterns on the lower-cased path.
It is applied to the files before anything ranks, so a search sees only the chunks of those.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions of each language name.
LANGUAGES = {
    "c": ["c", "h"],
    "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "csharp": ["cs"],
    "css": ["css", "sass", "scss"],
    "go": ["go"],
    "haskell": ["hs"],
    "html": ["htm", "html"],
    "java": ["java"],
    "javascript": ["cjs", "js", "jsx", "mjs"],
    "json": ["json"],
    "kotlin": ["kt", "kts"],
    "lua": ["lua"],
    "markdown": ["markdown", "md"],
    "ocaml": ["ml", "mli"],
    "php": ["php"],
    "python": ["py", "pyi"],
    "ruby": ["rb"],
    "rust": ["rs"],
    "scala": ["sc", "scala"],
    "shell": ["bash", "sh", "zsh"],
    "sql": ["sql"],
    "swift": ["swift"],
    "toml": ["toml"],
    "typescript": ["cts", "mts", "ts", "tsx"],
    "yaml": ["yaml", "yml"],
}


def glob_to_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``*`` crosses ``/``, ``?`` is one character, ``[...]`` a class, ``[^...]`` its complement.

    A class that is never closed matches nothing, as in the glob it comes from.
    """
    out, rest = [], pattern
    while rest:
        head, rest = rest[0], rest[1:]
        if head == "*":
            rest = rest.lstrip("*")
            out.append(".*")
        elif head == "?":
            out.append(".")
        elif head == "[":
            negated = rest.startswith("^")
            start = 1 if negated else 0
            end = rest.find("]", start + 1)  # a bracket right at the start stands for itself
            if end < 0:
                return r"\A(?!)"
            members = re.sub(r"([\\\[\]^&~|])", r"\\\1", rest[start:end])
            out.append(f"[{'^' if negated else ''}{members}]")
            rest = rest[end + 1 :]
        else:
            out.append(re.escape(head))
    return r"(?s)\A" + "".join(out) + r"\z"


def anchored(pattern: str) -> str:
    """Lower case; a relative pattern matches below any directory."""
    pattern = pattern.lower()
    return pattern if pattern.startswith("/") else "*/" + pattern


@dataclass(frozen=True)
class Filter:
    """Groups of globs: any of a group, all groups. No group selects everything."""

    groups: tuple[tuple[str, ...], ...] = ()

    @classmethod
    def of(cls, paths: Iterable[str] = (), exts: Iterable[str] = (), langs: Iterable[str] = ()) -> Filter:
        wanted = [e.lstrip(".").lower() for e in exts]
        for name in langs:
            known = LANGUAGES.get(name.lower())
            if known is None:
                raise ValueError(f"unknown language {name!r}; known: {', '.join(LANGUAGES)}")
            wanted += known
        groups = (tuple(anchored(p) for p in paths), tuple(anchored(f"*.{e}") for e in dict.fromkeys(wanted)))
        return cls(tuple(g for g in groups if g))

    def __bool__(self) -> bool:
        return bool(self.groups)

    def predicate(self, path: Column) -> Column:
        low = F.lower(path)
        per_group = [reduce(lambda a, b: a | b, (low.rlike(glob_to_regex(p)) for p in g)) for g in self.groups]
        return reduce(lambda a, b: a & b, per_group, F.lit(True))


def languages(spark: SparkSession) -> DataFrame:
    """``lang, extensions`` as a table."""
    return spark.createDataFrame([(k, ",".join(v)) for k, v in LANGUAGES.items()], "lang string, extensions string")


def matching_files(files: DataFrame, f: Filter) -> DataFrame:
    return files.where(f.predicate(F.col("path")))


def allowed_chunks(files: DataFrame, chunks: DataFrame, f: Filter) -> DataFrame:
    """``chunk_id`` of the chunks of matching files; the files are the filtered, smaller side."""
    return chunks.select("chunk_id", "file_id").join(matching_files(files, f).select("file_id"), "file_id", "left_semi").select("chunk_id")


def listed_paths(files: DataFrame, f: Filter, limit: int) -> DataFrame:
    """The first ``limit`` matching paths in order, and beside each how many are left out in total."""
    paths = matching_files(files, f).select("path")
    left = paths.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("left_out"))
    return paths.orderBy("path").limit(limit).crossJoin(left)  # a single row
