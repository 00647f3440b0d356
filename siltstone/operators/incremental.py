"""Processing only new or changed records.

Progress is a set of disjoint closed intervals of sequence numbers that were *seen and
committed*. A run subtracts them from what is available now, so a number that was handed out
early but became visible late lies in a gap and is still picked up, and a number is never
processed twice. The merged intervals become visible with the run's output, by one small file that
names the folder of both: a run that dies before it leaves neither.

Intervals are kept as rows split at multiples of ``SPAN``. Subtraction and merging are windows
on the span, with at most ``SPAN`` numbers in any group, however many
intervals or records there are; nothing is collected to the driver.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.plans import folders

SPAN_BITS = 16
SPAN = 1 << SPAN_BITS
INTERVALS = T.StructType(
    [
        T.StructField("span", T.LongType()),
        T.StructField("lo", T.LongType()),
        T.StructField("hi", T.LongType()),
    ]
)


def _span(seq: Column) -> Column:
    return F.shiftright(seq.cast("long"), SPAN_BITS)


def islands(df: DataFrame, seq: str) -> DataFrame:
    """The disjoint intervals that the numbers of ``df[seq]`` form. Null numbers belong to none."""
    numbers = df.select(F.col(seq).cast("long").alias("n")).where("n is not null").distinct()
    numbers = numbers.withColumn("span", _span(F.col("n")))
    run = F.col("n") - F.row_number().over(Window.partitionBy("span").orderBy("n"))
    return numbers.withColumn("run", run).groupBy("span", "run").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select("span", "lo", "hi")


def merge_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two interval tables, with overlapping and adjacent intervals joined."""
    order = Window.partitionBy("span").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0)
    joined = a.unionByName(b).withColumn("starts", starts).withColumn("part", F.sum("starts").over(order))
    return joined.groupBy("span", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("span", "lo", "hi")


def marked(df: DataFrame, seq: str, done: DataFrame, name: str = "pending") -> DataFrame:
    """``df`` with a column ``name``: whether no interval of ``done`` holds the row's number.

    Rows and intervals of a span are put in order, and each row looks at the last interval that
    begins at or before it. Null numbers can't be accounted for and are not pending.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    here = F.col(f"`{seq}`").cast("long")
    ends = done.select("span", F.col("lo").alias("at"), F.lit(0).alias("role"), "hi")
    rows = df.select(_span(here).alias("span"), here.alias("at"), F.lit(1).alias("role"), F.lit(None).cast("long").alias("hi"), row)
    before = Window.partitionBy("span").orderBy("at", "role").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.where("at is not null").unionByName(ends, allowMissingColumns=True).withColumn("until", F.last("hi", ignorenulls=True).over(before))
    known = both.where("role = 1").select("row", (F.col("until").isNull() | (F.col("at") > F.col("until"))).alias("flag"))
    return known.unionByName(rows.where("at is null").select("row", F.lit(False).alias("flag"))).select("row.*", F.col("flag").alias(name))


def pending(df: DataFrame, seq: str, done: DataFrame) -> DataFrame:
    """Rows of ``df`` whose number no interval of ``done`` holds.

    Rows with a null number can't be accounted for and are left out; repeated rows stay.
    """
    return marked(df, seq, done, "_pending").where("_pending").drop("_pending")


class Ledger:
    """Committed progress in a directory: ``commits/N`` is a file that names the folder with the intervals and output of commit N.

    A commit writes everything to a folder of its own and then publishes it under the next number, by
    an exclusive link or rename of that one file, so output and progress appear together or not at
    all. Of two runs that race for one number the loser fails, leaves nothing and can be repeated.

    What a commit put out counts as applied once ``mark_applied`` says so. Until then its output is
    part of ``outstanding``, so that whoever applies it may die and ask again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        for name in ("commits", "applied", "data"):
            folders.make(spark, f"{self.root}/{name}")

    def _numbers(self, name: str) -> list[int]:
        return sorted(int(n) for n in folders.names(self.spark, f"{self.root}/{name}") if n.isdigit())

    def version(self) -> int:
        return max(self._numbers("commits"), default=0)

    def _folder(self, version: int) -> str:
        return f"{self.root}/data/{json.loads(folders.read(self.spark, f'{self.root}/commits/{version:012d}'))['folder']}"

    def done(self) -> DataFrame:
        """Intervals committed so far."""
        at = self.version()
        return self._intervals(at)

    def _intervals(self, version: int) -> DataFrame:
        if not version:
            return self.spark.createDataFrame([], INTERVALS)
        return self.spark.read.schema(INTERVALS).parquet(f"{self._folder(version)}/intervals")

    def pending(self, df: DataFrame, seq: str) -> DataFrame:
        return pending(df, seq, self.done())

    def _commit(self, at: int, write) -> int:
        """Publish what ``write`` puts into a new folder as the commit after ``at``."""
        name = uuid.uuid4().hex
        folder = f"{self.root}/data/{name}"
        published = False
        try:
            write(folder)
            published = folders.publish(self.spark, f"{self.root}/commits/{at + 1:012d}", json.dumps({"folder": name}))
            if not published:
                raise RuntimeError(f"another run committed {at + 1} first; repeat this one")
            return at + 1
        finally:
            if published:
                folders.remove(self.spark, f"{folder}/input")
            else:
                folders.remove(self.spark, folder)

    def seed(self, intervals: DataFrame) -> int:
        """Commit that the numbers of ``intervals`` were processed before this ledger was kept."""
        at = self.version()
        return self._commit(at, lambda folder: merge_intervals(self._intervals(at), intervals).write.parquet(f"{folder}/intervals"))

    def run(self, df: DataFrame, seq: str, work) -> int:
        """Apply ``work`` to the pending rows and commit its result with their numbers.

        The pending rows are written first: ``work`` and the new intervals then see the same rows,
        even if more become visible meanwhile. Returns the commit's number.
        """
        at = self.version()
        done = self._intervals(at)

        def write(folder: str) -> None:
            pending(df, seq, done).write.parquet(f"{folder}/input")
            rows = self.spark.read.schema(df.schema).parquet(f"{folder}/input")
            work(rows).write.parquet(f"{folder}/output")
            merge_intervals(done, islands(rows, seq)).write.parquet(f"{folder}/intervals")

        return self._commit(at, write)

    def output(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(version)}/output")

    def mark_applied(self, version: int) -> None:
        """Say that the outputs of all commits up to ``version`` were applied."""
        folders.publish(self.spark, f"{self.root}/applied/{version:012d}", "{}")

    def outstanding(self) -> list[DataFrame]:
        """Outputs of the commits that nobody has applied yet, one for each."""
        applied = max(self._numbers("applied"), default=0)
        at = [v for v in self._numbers("commits") if v > applied]
        return [self.output(v) for v in at if "output" in folders.names(self.spark, self._folder(v))]


def reduced(path: Column) -> Column:
    """``//`` and ``/./`` become ``/``, however often repeated."""
    return F.regexp_replace(path, r"/(?:\.?/)+", "/")


def newest_observation(listing: DataFrame) -> DataFrame:
    """Per reduced path the observation of the greatest ``seen_at`` among those with a hash.

    An aggregate of one struct, so each map task sends a single row per path. Of equal times the
    later arrival counts.
    """
    seen = listing.where("path is not null and hash is not null").select(
        reduced(F.col("path")).alias("path"),
        F.struct(F.col("seen_at"), F.col("arrival_no"), F.lower("hash").alias("hash")).alias("o"),
    )
    best = seen.groupBy("path").agg(F.max("o").alias("o"))
    return best.select("path", F.col("o.seen_at").alias("seen_at"), F.col("o.hash").alias("seen_hash"))


def reflected(files: DataFrame, listing: DataFrame, runs: DataFrame) -> DataFrame:
    """Intervals of the arrivals that finished runs have processed, to seed a ledger for a store that had none.

    An arrival is done if it was seen by the end of the last run that went well, and either has no
    hash (there was nothing to read) or is accounted for in ``files``: durably stored with that digest,
    or indexed no earlier than it was seen. What a failed or killed run left (no row, no durable
    hash, an older digest) stays pending, whenever it arrived. Without a successful run nothing is done.
    """
    ok = runs.where("outcome = 'ok' and finished_at is not null").agg(F.max("finished_at").alias("last_ok"))
    recorded = files.where("path is not null and hash <> ''").select(F.col("path").alias("_path"), F.lower("hash").alias("_hash"), "indexed_at")
    seen = listing.where("arrival_no is not null").select("arrival_no", reduced(F.col("path")).alias("_p"), F.lower("hash").alias("_h"), "seen_at")
    past = seen.join(F.broadcast(ok)).where("seen_at <= last_ok")  # a single row
    blind = past.where("_h is null or _p is null").select("arrival_no")
    known = past.where("_h is not null").join(recorded, F.col("_p") == F.col("_path")).where("_hash = _h or seen_at <= indexed_at").select("arrival_no")
    return islands(blind.unionByName(known), "arrival_no")


def paths_to_index(files: DataFrame, listing: DataFrame, done: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Paths that the next run has to index: new, changed, or recorded without durable vectors.

    ``done`` holds the arrival numbers that were processed; of the other arrivals' paths the newest
    observation *of the whole listing* decides, so that a late, older one doesn't hide a newer that
    was processed. ``asked`` holds paths of earlier runs that nobody has applied; they are judged again,
    like those without a row or durable hash in ``files`` (null or empty), which a run may have left
    after their arrivals were committed. Null paths and observations without a hash count for
    nothing; an empty listing gives no row.
    """
    flagged = listing.withColumn("_pending", F.lit(True)) if done is None else marked(listing, "arrival_no", done, "_pending")
    return _judged(files, flagged, asked)


def _judged(files: DataFrame, flagged: DataFrame, asked: DataFrame | None) -> DataFrame:
    recorded = files.where("path is not null").select("path", F.lower("hash").alias("hash"), "indexed_at")
    seen = flagged.where("path is not null").select(
        reduced(F.col("path")).alias("path"),
        F.when(F.col("hash").isNotNull(), F.struct(F.col("seen_at"), F.col("arrival_no"), F.lower("hash").alias("hash"))).alias("o"),
        F.col("_pending").alias("pending"),
    )
    if asked is not None:
        seen = seen.unionByName(asked.where("path is not null").select("path", F.lit(True).alias("pending")), allowMissingColumns=True)
    best = seen.groupBy("path").agg(F.max("o").alias("o"), F.max("pending").alias("pending")).where("o is not null")
    both = best.select("path", "pending", F.col("o.seen_at").alias("seen_at"), F.col("o.hash").alias("seen_hash")).join(recorded, "path", "left")
    unfinished = F.col("hash").isNull() | (F.col("hash") == "")
    changed = F.col("pending") & (F.col("seen_at") > F.col("indexed_at")) & (F.col("seen_hash") != F.col("hash"))
    return both.where(unfinished | changed).select("path").distinct()


def next_run(ledger: Ledger, files: DataFrame, listing: DataFrame) -> int:
    """Commit the paths of the arrivals that no earlier run has processed, with those arrivals' numbers; the number of the commit.

    What earlier commits put out and nobody applied comes out again. An arrival that becomes visible
    while this runs is left to the next run.
    """
    asked = None
    for out in ledger.outstanding():
        asked = out if asked is None else asked.unionByName(out)

    def work(rows: DataFrame) -> DataFrame:
        flagged = marked(listing, "arrival_no", islands(rows, "arrival_no"), "_other")
        return _judged(files, flagged.withColumn("_pending", F.col("arrival_no").isNotNull() & ~F.col("_other")), asked)

    return ledger.run(listing, "arrival_no", work)
