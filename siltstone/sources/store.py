"""A store: versioned Parquet tables that are indexed incrementally and searched as DataFrames.

Chunks, vectors and postings are appended in segments and never rewritten; ``files`` is written
anew in each generation. Every indexing of a file has a ``file_id`` of its own, so a chunk is live
if and only if its ``file_id`` is in the current ``files``. A generation is a small JSON file that
names its segments and its ``files`` table and appears by an exclusive rename after all it names
is written: a hash is never visible before the vectors it stands for, and a run that dies leaves
only unnamed directories, which ``clean`` removes.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import embedding, scalars
from siltstone.functions.filters import Filter, matching_files
from siltstone.operators import chunking, fusion, keyword
from siltstone.operators.stored import shard_of
from siltstone.plans import folders
from siltstone.plans.tables import own_folder, stage
from siltstone.sources import corpus
from siltstone.sources.markup_text import extract

FORMAT_VERSION = 3
#: Part of every stored hash, so that a better reader reads old files again.
READER_VERSION = "1"
FILES = "file_id long, path string, hash string, bytes long, indexed_at timestamp"
CHUNKS = "chunk_id long, file_id long, ord int, start_line int, end_line int, text string"
VECTORS = "chunk_id long, file_id long, embedding array<float>, shard long"
POSTINGS = "term string, chunk_id long, file_id long, positions array<int>, n_tokens int, bucket int"
LENGTHS = "chunk_id long, file_id long, n_tokens int"
#: What one pass over files makes of them before they are numbered.
CUT = "part int, file_no long, chunk_no long, path string, hash string, bytes long, ord int, start_line int, end_line int, text string, embedding array<float>"
SEGMENT_TABLES = {"chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS}
#: What the files of a table are laid out by.
LAID_OUT_BY = {"vectors": "shard", "postings": "bucket"}
#: Files that one commit indexes at most, and about how many seconds it may take; what a run that dies has committed is not done again.
SLICE_FILES, SLICE_SECONDS = 10_000, 30.0
#: Files of the first commit of a run, which tells the pace.
FIRST_FILES = 500

#: Ids of files that are broadcast at most.
SENT_FILES = 500_000


@dataclass(frozen=True)
class Generation:
    number: int = 0
    model: str = embedding.DEFAULT
    format_version: int = FORMAT_VERSION
    files: str = ""
    segments: tuple[str, ...] = ()
    next_file_id: int = 1
    next_chunk_id: int = 1


@dataclass
class IndexReport:
    scanned: int = 0
    indexed: int = 0
    unchanged: int = 0
    skipped: int = 0
    removed: int = 0
    chunks: int = 0
    remaining: int = 0


class Locked(RuntimeError):
    pass


class WriterLock:
    """One writer for each store; a lock left behind by a dead process holds nobody up."""

    def __init__(self, root: str) -> None:
        self.path = os.path.join(root, "index.lock")

    def __enter__(self) -> WriterLock:
        self.file = open(self.path, "a+", encoding="utf-8")  # noqa: SIM115
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            self.file.seek(0)
            holder = self.file.read().strip() or "a process that left no name"
            self.file.close()
            raise Locked(f"the writer of {os.path.dirname(self.path)} is {holder}; wait for it") from None
        self.file.truncate(0)
        self.file.write(f"process {os.getpid()}, since {time.strftime('%Y-%m-%d %H:%M:%S')}")
        self.file.flush()
        return self

    def __exit__(self, *_) -> None:
        fcntl.flock(self.file, fcntl.LOCK_UN)
        self.file.close()


class Store:
    def __init__(self, spark: SparkSession, root: str, model: str | None = None, create: bool = True) -> None:
        self.spark, self.root = spark, os.path.realpath(root)
        self._known_totals: dict[int, tuple[int, float]] = {}
        self._held = False
        if not os.path.isdir(os.path.join(self.root, "generations")):
            if not create:
                raise FileNotFoundError(f"no store at {root}")
            os.makedirs(os.path.join(self.root, "generations"), exist_ok=True)
            self._publish(Generation(0, model or embedding.DEFAULT))
        now = self.generation()
        if now.format_version > FORMAT_VERSION:
            raise ValueError(f"store has format {now.format_version}, this program knows {FORMAT_VERSION}")
        if now.format_version < FORMAT_VERSION:
            raise ValueError(f"store has the older format {now.format_version}; index into a new one")
        if model and model != now.model:
            raise ValueError(f"store was made with model {now.model}, not {model}")
        self.model = now.model

    @classmethod
    def open_existing(cls, spark: SparkSession, root: str) -> Store:
        return cls(spark, root, create=False)

    # ---- generations

    def generation(self) -> Generation:
        """The newest; asked for by every reading call, so that a reader sees what others committed."""
        names = sorted(n for n in os.listdir(os.path.join(self.root, "generations")) if n.endswith(".json"))
        with open(os.path.join(self.root, "generations", names[-1]), encoding="utf-8") as f:
            d = json.load(f)
        return Generation(**(d | {"segments": tuple(d["segments"])}))

    def _publish(self, g: Generation) -> None:
        target = os.path.join(self.root, "generations", f"{g.number:012d}.json")
        tmp = f"{target}.{uuid.uuid4().hex}"
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(asdict(g), f)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(tmp, target)  # fails if the number is taken
        finally:
            os.unlink(tmp)

    def clean(self) -> int:
        """Remove directories that no generation names. Only under the lock."""
        now = self.generation()
        named, gone = {now.files, *now.segments}, 0
        for kind in ("files", "segments"):
            top = os.path.join(self.root, kind)
            for name in os.listdir(top) if os.path.isdir(top) else ():
                if f"{kind}/{name}" not in named:
                    shutil.rmtree(os.path.join(top, name))
                    gone += 1
        return gone

    # ---- tables

    def files(self, g: Generation | None = None) -> DataFrame:
        g = g or self.generation()
        return self.spark.read.schema(FILES).parquet(os.path.join(self.root, g.files)) if g.files else self.spark.createDataFrame([], FILES)

    def table(self, name: str, g: Generation | None = None) -> DataFrame:
        """Live rows of a segment table."""
        g = g or self.generation()
        schema = SEGMENT_TABLES[name]
        if not g.segments:
            return self.spark.createDataFrame([], schema)
        paths = [os.path.join(self.root, s, name) for s in g.segments]
        if name in LAID_OUT_BY:  # each segment has directories of its own
            rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths])
        else:
            rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.join(self.sent_whole(self.files(g).select("file_id"), g), "file_id", "left_semi")

    def sent_whole(self, files: DataFrame, g: Generation | None = None) -> DataFrame:
        """Rows of files, of an id and another number at most, as the small side of a join if so few were ever indexed: texts, vectors and postings stay where they are then."""
        return F.broadcast(files) if (g or self.generation()).next_file_id <= SENT_FILES else files

    # ---- indexing

    @contextmanager
    def holding(self):
        """Be the only writer for as long as this lasts, over several runs."""
        with WriterLock(self.root):
            self._held = True
            try:
                yield self
            finally:
                self._held = False

    def _lock(self):
        return nullcontext() if self._held else WriterLock(self.root)

    def index(self, roots: Iterable[str], sweep: bool = True, budget: float | None = None, progress: Callable[[str], None] | None = None, stop: Callable[[], bool] | None = None) -> IndexReport:
        """Bring the store up to date with what a walk of ``roots`` finds; ``sweep`` drops recorded files that are gone.

        Commits are sized by the pace so far, to ``SLICE_SECONDS`` and to what is left of ``budget``
        seconds. ``progress`` is told how far it is after each, ``stop`` asked whether to go on; what is
        left is counted as remaining, and nothing is swept then.
        """
        roots = list(roots)
        return self._index(corpus.corpus(self.spark, roots, contents=False).select("path", "bytes", "hash"), sweep, budget, None, progress, stop)

    def index_changed(self, paths: DataFrame) -> IndexReport:
        """The same for single paths; those that are gone are dropped, nothing else is."""
        recorded = self.files().select("path")
        paths = stage(paths.select("path").distinct(), "changed")
        seen = corpus.read_paths(self.spark, paths, contents=False).select("path", "bytes", "hash")
        gone = _missing(recorded.join(paths, "path", "left_semi"))
        return self._index(seen.where("bytes is not null"), False, None, gone)

    def _index(self, listing: DataFrame, sweep: bool, budget: float | None, gone: DataFrame | None = None, progress: Callable[[str], None] | None = None, stop: Callable[[], bool] | None = None) -> IndexReport:
        began = time.monotonic()
        with self._lock():
            self.clean()
            g = self.generation()
            seen = stage(listing.withColumn("hash", F.when(F.col("hash").isNotNull(), F.concat(F.lit(READER_VERSION + ":"), "hash"))), "seen")
            own = self.files(g).select(F.col("path").alias("_path"), F.col("hash").alias("_hash"))
            status = F.when(F.col("hash").isNull(), "skipped").when(F.col("hash") == F.col("_hash"), "unchanged").otherwise("todo")
            judged = stage(seen.join(own, F.col("path") == F.col("_path"), "left").select("path", "bytes", "hash", status.alias("status")), "judged")
            counts = {r["status"]: r["count"] for r in judged.groupBy("status").count().collect()}
            report = IndexReport(scanned=sum(counts.values()), unchanged=counts.get("unchanged", 0), skipped=counts.get("skipped", 0))
            total = counts.get("todo", 0)
            todo = _numbered(judged.where("status = 'todo'").select("path", "bytes", "hash"), "n", 0) if total else None
            at, working = 0, time.monotonic()
            while at < total:
                now = time.monotonic()
                pace = at / (now - working) if at else None
                size = FIRST_FILES if pace is None else int(pace * SLICE_SECONDS)
                if budget is not None and at:
                    size = min(size, int(pace * (began + budget - now)))
                if (at and budget is not None and size < 1) or (stop is not None and stop()):
                    report.remaining = total - at
                    break
                end = at + max(1, min(size, SLICE_FILES))
                end = min(end, total)
                g = self._commit(g, todo.where((F.col("n") >= at) & (F.col("n") < end)).drop("n"), end - at, report)
                at = end
                if progress is not None:
                    progress(scalars.progress(at, total, report.chunks, time.monotonic() - working))
            if report.remaining:
                return report
            if sweep or gone is not None:
                lost = stage(gone if gone is not None else _missing(self.files(g).select("path")), "lost")
                report.removed = lost.count()
                if report.removed:
                    g = self._write_files(g, self.files(g).join(lost, "path", "left_anti"), g.segments, g.next_file_id, g.next_chunk_id)
        return report

    def _commit(self, g: Generation, part: DataFrame, size: int, report: IndexReport) -> Generation:
        """Read, chunk and embed the ``size`` files of ``part`` and publish them with the ones they replace gone.

        One pass reads, cuts and embeds and numbers files and chunks within its tasks; the numbers of the
        tasks before are added when that is known. What is then written from it is written at the same time.
        """
        folder = own_folder(self.spark, "cut")
        try:
            _cut(part, embedding.maker(g.model)).write.parquet(f"{folder}/rows")
            cut = self.spark.read.schema(CUT).parquet(f"{folder}/rows")
            sizes = {r["part"]: (r["files"], r["chunks"]) for r in cut.groupBy("part").agg((F.max("file_no") + 1).alias("files"), (F.max("chunk_no") + 1).alias("chunks")).collect()}  # a row for each task
            n_files, n_chunks = (sum(x[i] for x in sizes.values()) for i in (0, 1))
            report.indexed += n_files
            report.chunks += n_chunks
            report.skipped += size - n_files
            if not n_files:
                return g
            before, file_id, chunk_id = [], g.next_file_id, g.next_chunk_id
            for p in range(max(sizes) + 1):
                before.append((file_id, chunk_id))
                file_id, chunk_id = file_id + sizes.get(p, (0, 0))[0], chunk_id + sizes.get(p, (0, 0))[1]
            base = lambda i: F.array(*(F.lit(b[i]).cast("long") for b in before))[F.col("part")]
            rows = cut.withColumn("file_id", base(0) + F.col("file_no")).withColumn("chunk_id", base(1) + F.col("chunk_no"))
            segment = f"segments/{g.number + 1:012d}-{uuid.uuid4().hex[:8]}"
            at = os.path.join(self.root, segment)

            def texts() -> None:
                rows.select("chunk_id", "file_id", "ord", "start_line", "end_line", "text").write.option("compression", "zstd").parquet(f"{at}/chunks")
                self._write_words(at)

            def vectors() -> None:
                rows.select("chunk_id", "file_id", "embedding", shard_of(F.col("chunk_id")).alias("shard")).write.option("compression", "zstd").partitionBy("shard").parquet(f"{at}/vectors")

            with ThreadPoolExecutor(2) as pool:
                for done in [pool.submit(texts), pool.submit(vectors)]:
                    done.result()
            new = rows.where("ord = 0").select("file_id", "path", "hash", "bytes", F.current_timestamp().alias("indexed_at"))
            old = self.files(g).join(F.broadcast(new.select("path")), "path", "left_anti").select("file_id", "path", "hash", "bytes", "indexed_at")  # SLICE_FILES paths at most
            return self._write_files(g, old.unionByName(new), (*g.segments, segment), g.next_file_id + n_files, g.next_chunk_id + n_chunks)
        finally:
            folders.remove(self.spark, folder)

    def _write_files(self, g: Generation, files: DataFrame, segments: tuple[str, ...], next_file: int, next_chunk: int) -> Generation:
        name = f"files/{g.number + 1:012d}-{uuid.uuid4().hex[:8]}"
        files.select("file_id", "path", "hash", "bytes", "indexed_at").write.parquet(os.path.join(self.root, name))
        new = replace(g, number=g.number + 1, files=name, segments=segments, next_file_id=next_file, next_chunk_id=next_chunk)
        self._publish(new)
        return new

    def forget(self, path: str) -> int:
        """Drop one file; the number of chunks that went."""
        with self._lock():
            g = self.generation()
            own = self.files(g).where(F.col("path") == os.path.realpath(path))
            n = self.table("chunks", g).join(own.select("file_id"), "file_id", "left_semi").count()
            if not own.isEmpty():
                self._write_files(g, self.files(g).where(F.col("path") != os.path.realpath(path)), g.segments, g.next_file_id, g.next_chunk_id)
            return n

    def compact(self) -> None:
        """One segment of the live rows instead of many with dead ones."""
        with self._lock():
            g = self.generation()
            segment = f"segments/{g.number + 1:012d}-{uuid.uuid4().hex[:8]}"
            for name, schema in SEGMENT_TABLES.items():
                cols = [c.split()[0] for c in schema.split(", ")]
                rows, by = self.table(name, g).select(*cols), LAID_OUT_BY.get(name)
                (rows.repartition(by).write.partitionBy(by) if by else rows.write).parquet(os.path.join(self.root, segment, name))
            self._write_files(g, self.files(g), (segment,), g.next_file_id, g.next_chunk_id)

    def backfill(self) -> int:
        """Rebuild the inverted index of segments that lack it, from their chunks. The number of segments mended."""
        with self._lock():
            mended = 0
            for segment in self.generation().segments:
                at = os.path.join(self.root, segment)
                if not os.path.exists(f"{at}/postings/_SUCCESS") or not os.path.exists(f"{at}/lengths/_SUCCESS"):
                    self._write_words(at)
                    mended += 1
            return mended

    def _write_words(self, at: str) -> None:
        for name in ("postings", "lengths"):
            shutil.rmtree(f"{at}/{name}", ignore_errors=True)
            os.makedirs(f"{at}/{name}")
        keyword.write_words(self.spark.read.schema(CHUNKS).parquet(f"{at}/chunks"), f"{at}/postings", f"{at}/lengths", ["chunk_id", "file_id"])
        for name in ("postings", "lengths"):
            open(f"{at}/{name}/_SUCCESS", "wb").close()  # noqa: SIM115

    # ---- reading

    def __len__(self) -> int:
        """Vectors that a search sees."""
        return self.table("vectors").count()

    def shards(self) -> DataFrame:
        """``shard, start_id, n_vectors`` of the live vectors."""
        return self.table("vectors").groupBy("shard").agg(F.min("chunk_id").alias("start_id"), F.count("*").alias("n_vectors"))

    def warm(self) -> int:
        """Keep the live vectors in the executors' storage memory, spilling to disk; how many there are."""
        return self.table("vectors").persist().count()

    def stats(self) -> dict:
        g = self.generation()
        f = self.files(g).agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        return {"files": f["files"], "chunks": self.table("chunks", g).count(), "bytes": f["bytes"], "model": g.model, "dim": embedding.load(g.model).dim}

    def matching_paths(self, narrowed: Filter) -> DataFrame:
        return matching_files(self.files(), narrowed).select("path").orderBy("path")

    def matching_files(self, narrowed: Filter) -> int:
        return matching_files(self.files(), narrowed).count()

    def query_vector(self, query: str) -> list[float]:
        model = embedding.load(self.model)
        return [float(x) for x in model.embed([model.query_text(query)])[0]]

    def search(self, query: str, k: int = 8, narrowed: Filter | None = None, vector: list[float] | None = None) -> DataFrame:
        """``position, score, similarity, path, start_line, end_line, text, chunk_id``."""
        g = self.generation()
        if vector is not None and len(vector) != embedding.load(g.model).dim:
            raise ValueError(f"the store's vectors have {embedding.load(g.model).dim} numbers, not {len(vector)}")
        drop = lambda name: self.table(name, g).drop("file_id")
        return fusion.search(self.files(g), self.table("chunks", g), drop("vectors"), drop("postings"), self._totals(g), query, vector or self.query_vector(query), max(k, 0), narrowed)

    def _totals(self, g: Generation) -> tuple[int, float]:
        """Of a generation's live texts; asked once for each."""
        if g.number not in self._known_totals:
            self._known_totals = {g.number: keyword.totals(self.table("lengths", g))}
        return self._known_totals[g.number]


def _cut(part: DataFrame, make: Callable[[], embedding.Embedder]) -> DataFrame:
    """The chunks of the files of ``part``, embedded; files and chunks have the task's number and their own within it."""
    names = [c.split()[0] for c in CUT.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def cut(batches):
        task, model, n_files, n_chunks, held, rows = TaskContext.get().partitionId(), make(), 0, 0, 0, []

        def batch() -> pa.RecordBatch:
            x = model.embed([r[-1] for r in rows])
            embedded = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float32()))
            return pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), embedded], names)

        for b in batches:
            for path, size, digest in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "hash")), strict=True):
                text = extract(path, corpus.read_file(path)[3])
                found = chunking.chunks_of(text) if text is not None else []
                for i, (first, last, body) in enumerate(found):
                    rows.append((task, n_files, n_chunks, path, digest, size, i, first, last, body))
                    n_chunks += 1
                    held += len(body)
                n_files += bool(found)
                if held >= corpus.BATCH_BYTES:
                    yield batch()
                    held, rows = 0, []
        if rows:
            yield batch()

    return part.select("path", "bytes", "hash").repartition(part.sparkSession.sparkContext.defaultParallelism).mapInArrow(cut, CUT)


def _numbered(df: DataFrame, name: str, start: int) -> DataFrame:
    """Adds consecutive ids from ``start``: places within the partitions of a written table, behind the rows of those before."""
    rows = stage(df.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_m", 33)
    sizes = sorted((r["p"], r["count"]) for r in rows.groupBy(part.alias("p")).count().collect())  # a row for each partition
    before, total = [], start
    for p, n in sizes:
        before.append((p, total))
        total += n
    base = F.broadcast(df.sparkSession.createDataFrame(before, "_p long, _base long"))
    return rows.join(base, part == F.col("_p")).withColumn(name, F.col("_base") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m", "_p", "_base")


def _missing(paths: DataFrame) -> DataFrame:
    """Paths that no longer exist, asked for by the executors."""

    def look(batches):
        for b in batches:
            yield b[~b["path"].map(os.path.exists)]

    return paths.select("path").mapInPandas(look, "path string")
