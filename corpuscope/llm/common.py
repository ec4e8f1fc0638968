"""What several operators share: reading tables, words, and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space and the five ASCII controls tab to carriage return.
#: ``bytes.split()`` cuts UTF-8 text in exactly this way.
WORD = r"[^\x20\x09-\x0D]+"
#: What a Python worker keeps from task to task, until a task of another operator calls ``give_back``.
HELD: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. A private one is made only where the session names none."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpuscope-")
        sc.setCheckpointDir(path)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)  # only what is there can be marked
    system.deleteOnExit(where)
    return path


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes the rows as a table in the shared folder and reads them back: this cuts the lineage, and the rows
    outlive any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Removes tables of the shared folder that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def looked_up(rows: DataFrame, classes: DataFrame, key: str, parts: int = 10_000) -> DataFrame:
    """``rows`` with the columns of ``classes``, which has one row for each ``key`` of ``rows``, and its number of rows as ``n``.

    A key may hold any share of the rows. Keys with more than ``1 / parts`` of all rows are less than ``parts``, so these go to all
    tasks; the rows of other keys are few and meet by key.
    """
    n = rows.count()
    often = F.col("n") > max(200, n // parts)
    hot = classes.where(often).drop("n")
    names = [key, *(c for c in rows.columns if c != key), *(c for c in classes.columns if c not in (key, "n"))]
    near = rows.join(F.broadcast(hot), key).select(*names)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(~often).drop("n"), key).select(*names)
    return near.unionByName(rest)


def sifted(rows: DataFrame, key: str, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (one column), and few others: those whose hash has its bit set in a bitmap of ``2 ** bits`` bits.

    All tasks get the bitmap, 2 MB whatever the number of ids, so rows that a join would drop need not move to it. With more ids than bits
    it keeps everything, which costs time but changes nothing.
    """
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << bits))
    ids = ids.toDF("_id").select(spot("_id").alias("_spot"))
    maps = ids.groupBy(F.bitmap_bucket_number("_spot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    marked = rows.withColumn("_spot", spot(key)).withColumn("_bucket", F.bitmap_bucket_number("_spot")).withColumn("_at", F.bitmap_bit_position("_spot"))
    octet = F.conv(F.hex(F.expr("substring(_bits, int(_at div 8) + 1, 1)")), 16, 10).cast("int")
    return marked.join(F.broadcast(maps), "_bucket").where(octet.bitwiseAND(F.expr("shiftleft(1, int(_at % 8))")) != 0).select(*rows.columns)


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns of the given names, which an operator needs for itself, under other names; and what to select at the end for
    the caller's columns under their own names."""
    taken, new = {n.lower() for n in (*names, *docs.columns)}, []
    for c in docs.columns:
        held = c
        while held.lower() in {n.lower() for n in names} or (held != c and held.lower() in taken):
            held += "_"
        taken.add(held.lower())
        new.append(held)
    return docs.toDF(*new), [F.col(f"`{held}`").alias(c) for held, c in zip(new, docs.columns, strict=True)]


def n_words(column) -> F.Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """From now on Python gets at most ``rows`` rows at once. Texts run to megabytes: with the 10,000 rows that Spark
    sends by default, a worker and the JVM's buffers hold hundreds of megabytes, which they do not give back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """In a Python worker: lets go of what earlier tasks left, and returns free memory to the machine. Workers outlive their tasks and stages, and
    neither Arrow nor the C library returns free memory by itself, so an executor's workers would add up the peaks of all stages."""
    HELD.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(batches: Iterator) -> Iterator:
    """The batches of a task that begins and ends with as little memory as its worker can have."""
    give_back()
    yield from batches
    give_back()


def plus(schema: T.StructType, ddl: str) -> T.StructType:
    """A schema with the columns of ``ddl`` after its own."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
