"""Files below some directories as a table, and changes to them as a stream.

Hidden names, the store's own directory and what ``.gitignore`` files exclude (nested, with
negation, also outside repositories), a repository's own excludes and the user's are left out. The driver lists names only; executors read
the contents, so bytes never pass through the driver.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from siltstone.streaming.sessions import Quiet

STORE_DIR = ".siltstone"
#: Larger files, and empty ones, have no text.
MAX_FILE_BYTES = 8 << 20
#: Contents that are read before they are passed on.
BATCH_BYTES = 4 << 20
SCHEMA = "path string, bytes long, hash string, content binary"


class Ignore:
    """The rules of one ``.gitignore`` file."""

    def __init__(self, base: str, lines: Iterable[str]) -> None:
        self.base, self.rules = base, []
        for line in lines:
            rule = line.rstrip("\n").rstrip("\r")
            rule = rule if rule.endswith("\\ ") else rule.rstrip()
            if not rule or rule.startswith("#"):
                continue
            keep = rule.startswith("!")
            rule = rule[1:] if keep else rule.removeprefix("\\")
            only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
            if rule:
                self.rules.append((re.compile(self._regex(rule)), keep, only_dirs))

    @staticmethod
    def _regex(rule: str) -> str:
        anywhere = "/" not in rule
        parts = rule.lstrip("/").split("/")
        out = ["(?:.*/)?"] if anywhere else []
        for i, part in enumerate(parts):
            last = i == len(parts) - 1
            if part == "**":
                out.append(".+" if last else "(?:.*/)?")
                continue
            name = fnmatch.translate(part).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z")
            out.append(name.replace(".*", "[^/]*") + ("" if last else "/"))
        return "^" + "".join(out) + "$"

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept by a negation, None: no rule applies. The last rule counts."""
        rel = os.path.relpath(path, self.base)
        found = None
        for regex, keep, only_dirs in self.rules:
            if (is_dir or not only_dirs) and regex.match(rel):
                found = not keep
        return found


def _ignored(path: str, is_dir: bool, rules: list[Ignore]) -> bool:
    for r in reversed(rules):  # the nearest directory's file first
        v = r.verdict(path, is_dir)
        if v is not None:
            return v
    return False


def _rules_of(path: str, base: str) -> list[Ignore]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return [Ignore(base, f)]
    except OSError:
        return []


def _rules_at(directory: str) -> list[Ignore]:
    """What a directory's own file excludes, and before it, as it counts less, what its repository excludes for this clone alone."""
    return _rules_of(os.path.join(directory, ".git", "info", "exclude"), directory) + _rules_of(os.path.join(directory, ".gitignore"), directory)


def _rules_of_user(base: str) -> list[Ignore]:
    """The user's excludes: the file that ``~/.gitconfig`` names, else the usual one."""
    home = os.path.expanduser("~")
    named = os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config"), "git", "ignore")
    try:
        with open(os.path.join(home, ".gitconfig"), encoding="utf-8", errors="replace") as f:
            for line in f:
                if m := re.match(r"\s*excludesfile\s*=\s*(.+?)\s*$", line, re.I):
                    named = os.path.expanduser(m.group(1).strip('"'))
    except OSError:
        pass
    return _rules_of(named, base)


def walk(roots: Iterable[str]) -> Iterator[str]:
    """Real paths of regular files below the roots, each once. A root that is a file is given as such."""
    seen: set[str] = set()
    for root in roots:
        top = os.path.realpath(root)
        above, at = [], os.path.dirname(top)
        while True:
            above = _rules_at(at) + above
            if at == os.path.dirname(at):
                break
            at = os.path.dirname(at)
        todo = [(top, _rules_of_user(top) + above, False)]
        while todo:
            path, rules, plain = todo.pop()  # plain: a file and no link, below real directories only
            if plain or os.path.isfile(path):
                real = path if plain else os.path.realpath(path)
                if real not in seen:
                    seen.add(real)
                    yield real
                continue
            try:
                entries = sorted(os.scandir(path), key=lambda e: e.name, reverse=True)
            except OSError:
                continue
            rules = rules + _rules_at(path)
            for e in entries:
                if e.name.startswith(".") or e.name == STORE_DIR:
                    continue
                is_dir = e.is_dir(follow_symlinks=False)
                if (is_dir or e.is_file()) and not _ignored(e.path, is_dir, rules):
                    todo.append((e.path, rules, e.is_file(follow_symlinks=False)))


def read_file(path: str) -> tuple[str, int | None, str | None, bytes | None]:
    """``path, bytes, hash, content``; the size decides before anything is read."""
    try:
        size = os.path.getsize(path)
        if not 0 < size <= MAX_FILE_BYTES:
            return path, size, None, None
        with open(path, "rb") as f:
            content = f.read()
        return path, size, hashlib.sha256(content).hexdigest(), content
    except OSError:
        return path, None, None, None


def read_batches(paths: Iterable[str], contents: bool = True) -> Iterator[pa.RecordBatch]:
    """The files as Arrow batches of some ``BATCH_BYTES`` of contents, which are read but not kept without ``contents``."""
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "bytes", "hash", "content"])

    for p in paths:
        rows.append(read_file(p) if contents else (*read_file(p)[:3], None))
        held += 1024 + len(rows[-1][3] or b"")
        if held >= BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


class Paths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.roots, self.parts = options["roots"].split(os.pathsep), int(options.get("partitions", 64))
        self.contents = options.get("contents") != "false"

    def partitions(self):
        paths = list(walk(self.roots))
        n = max(1, min(self.parts, len(paths)))
        return [Paths(paths[i::n]) for i in range(n)]

    def read(self, partition: Paths):
        yield from read_batches(partition.paths, self.contents)


class SnapshotStream(SimpleDataSourceStreamReader):
    """Creations, edits and deletions as rows, by what a snapshot (time and size of each file) has that the one before hasn't.

    A batch closes after ``quiet`` seconds without another change, ``longest`` seconds after its first
    at the latest. An offset is the number of a snapshot in the directory ``snapshots``.
    """

    def __init__(self, options: dict) -> None:
        self.roots, self.kept = options["roots"].split(os.pathsep), options["snapshots"]
        self.rule, self.seen = Quiet(float(options.get("quiet", 0)), float(options.get("longest", 5))), None
        os.makedirs(self.kept, exist_ok=True)

    def _snapshot(self) -> dict[str, list]:
        out = {}
        for p in walk(self.roots):
            try:
                s = os.stat(p)
                out[p] = [s.st_mtime_ns, s.st_size]
            except OSError:
                continue
        return out

    def _load(self, n: int) -> dict[str, list]:
        if not n:
            return {}
        with open(os.path.join(self.kept, f"{n}.json"), encoding="utf-8") as f:
            return json.load(f)

    def _save(self, n: int, files: dict[str, list]) -> None:
        tmp = os.path.join(self.kept, f".{n}-{os.getpid()}")
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(files, f)
        os.replace(tmp, os.path.join(self.kept, f"{n}.json"))

    @staticmethod
    def _between(before: dict[str, list], now: dict[str, list]) -> Iterator[tuple[str, bool]]:
        return iter([(p, True) for p, s in now.items() if before.get(p) != s] + [(p, False) for p in before if p not in now])

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def read(self, start: dict):
        before, files, now = self._load(start["snapshot"]), self._snapshot(), time.monotonic()
        if files == before:
            self.rule.closed()
            self.seen = files
            return iter([]), start
        if files != self.seen:
            self.rule.saw(now)
            self.seen = files
        if not self.rule.due(now):
            return iter([]), start
        self.rule.closed()
        end = {"snapshot": start["snapshot"] + 1}
        self._save(end["snapshot"], files)
        return self._between(before, files), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._between(self._load(start["snapshot"]), self._load(end["snapshot"]))

    def commit(self, end: dict) -> None:
        """Snapshots before this one are asked for no more."""
        for name in os.listdir(self.kept):
            if name.endswith(".json") and int(name[:-5]) < end["snapshot"]:
                os.unlink(os.path.join(self.kept, name))


class Corpus(DataSource):
    """``spark.read.format("corpus").option("roots", ...)`` for contents, ``readStream`` for changes."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA if self.options.get("changes") != "true" else "path string, exists boolean"

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options)

    def simpleStreamReader(self, schema) -> SnapshotStream:
        return SnapshotStream(self.options)


def corpus(spark: SparkSession, roots: Iterable[str], partitions: int = 64, contents: bool = True) -> DataFrame:
    """The files below the roots; without ``contents`` their digests are made where they are read and ``content`` is null."""
    spark.dataSource.register(Corpus)
    return spark.read.format("corpus").option("roots", os.pathsep.join(roots)).option("partitions", partitions).option("contents", str(contents).lower()).load()


def read_paths(spark: SparkSession, paths: DataFrame, contents: bool = True) -> DataFrame:
    """The files of a table of paths, read by the executors."""

    def read(batches):
        for b in batches:
            yield from read_batches(b.column("path").to_pylist(), contents)

    return paths.select("path").mapInArrow(read, SCHEMA)


def changes(spark: SparkSession, roots: Iterable[str], snapshots: str, quiet: float = 0.0, longest: float = 5.0) -> DataFrame:
    """``path, exists`` of what changes below the roots. ``snapshots`` belongs to the query's checkpoint."""
    spark.dataSource.register(Corpus)
    stream = spark.readStream.format("corpus").option("roots", os.pathsep.join(roots)).option("changes", "true")
    return stream.option("snapshots", snapshots).option("quiet", quiet).option("longest", longest).load()
