"""Tables cut off from their lineage, in the folder all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from cinderglass.llm.words import trimmed

#: Used only where the session names no folder and all tasks run on this machine.
FALLBACK_DIR = "/tmp/checkpoints/cinderglass"
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``BATCH_BYTES`` in a session that has Spark's default for them.

    A batch is held by the JVM and by Python, several times over while it is built, in
    each task of an executor; rows here are whole texts.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("bB") == str(64 << 20):
        spark.conf.set(name, str(BATCH_BYTES))


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return it read back.

    Lineage ends there: a lost executor costs a reread of files, not a rerun.  The files
    go when the application ends, or earlier by ``unstash``.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    at, files = _hadoop(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(schema).parquet(path)
    out._stashed = path
    return out


def unstash(*frames: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_stashed", None):
            at, files = _hadoop(df.sparkSession, path)
            files.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for ``rows`` rows of which a task should hold ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def count_of(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def widened(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with the fields of a schema string after it; any field name is right."""
    return StructType([*df.schema.fields, *_parse_datatype_string(added).fields])


def map_rows(df: DataFrame, run, added: str) -> DataFrame:
    """``df.mapInArrow`` for a function that adds columns; any names, also with dots, go through it."""
    small_batches(df.sparkSession)
    names = df.columns
    safe = df.toDF(*(f"column {k}" if "." in c or "`" in c else c for k, c in enumerate(names)))
    schema = widened(safe, added)
    return safe.mapInArrow(trimmed(run), schema).toDF(*names, *schema.names[len(names) :])


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
