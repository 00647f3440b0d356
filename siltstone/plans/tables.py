"""Reading the store's tables and staging intermediate ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import folders


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory; columns and filters reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine) a temporary folder is set.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get()
    if not conf.get("spark.master", "local").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="siltstone-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folders.make_for_session(spark, path)
    return path


_KEPT: dict[tuple, tuple[str, object]] = {}


def once(spark: SparkSession, key: tuple, make):
    """What ``make()`` gives, made once for a session, and again if the shared folder was emptied since."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _KEPT or not folders.exists(spark, _KEPT[full][0]):
        mark = own_folder(spark, "mark")
        _KEPT[full] = mark, make()
    return _KEPT[full][1]


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs no recomputation of the stages before,
    and lets several consumers share one evaluation.
    """
    spark = df.sparkSession
    path = own_folder(spark, name) + "/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan out to all cores before costly work if it has fewer parts than there are cores.

    Spark makes at least a part for each core as soon as there are 4 MB (its open cost) for each, so
    what moves is less than that times the cores; any larger table stays where it is. A table of one
    file and row group would else be one task however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
