"""What the operators of this subpackage share: tables, shared storage and bounded joins."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word and white space as the contracts define them (ASCII white space only).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: the session's spark.checkpoint.dir.

    Only where a session on one machine names none (a test) is a temporary folder made.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomstone-')}")
        path = context.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Bytes in a file of what is written between steps.
FILE = 32 << 20


def gathered(df: DataFrame, like: DataFrame) -> DataFrame:
    """`df` in no more partitions than a frame of the size of `like` asks for, or than there are cores, so that it isn't written in splinters.

    The size is the planner's: of a table that is read, its bytes on disk; otherwise at least what there is.
    """
    size = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size // FILE), 1 << 30)))


def materialize(df: DataFrame, label: str, compression: str | None = None, like: DataFrame | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends at files that outlive executors.

    With `like` it is written in partitions gathered() by that frame's size.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    (df if like is None else gathered(df, like)).write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Remove what was written to a path of the shared folder and is not read any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def rows_of(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch, made into Python values a few at a time."""
    for start in range(0, batch.num_rows, step):
        yield from zip(*(column.slice(start, step).to_pylist() for column in batch.columns))


def give_back() -> None:
    """Return what a worker has freed to the system, for workers outlive their tasks. Nothing happens where the C library can't."""
    import ctypes

    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_cache() -> dict:
    """What a Python worker keeps from task to task. Functions reach it by value, so that their globals don't last."""
    return sys.modules.setdefault("_loomstone_worker", types.ModuleType("_loomstone_worker")).__dict__.setdefault("kept", {})


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that the planner must not broadcast, whatever its threshold: it takes exploded rows for as few bytes as there were before."""
    return side.hint("merge")


def attach_small(big: DataFrame, small: DataFrame, keys: list[str], limit: int = 100_000, size: int = 32 << 20, salts: int = 32) -> DataFrame:
    """Left join of `big` with a keyed `small` side that is expected, but not known, to be small.

    Up to `limit` rows and `size` bytes of text (both counted here) the small side is broadcast. Beyond
    that both sides are salted, so that a key holding a third of all rows still spreads over `salts` tasks.
    Keys must not be null on either side of a match.
    """
    texts = [F.coalesce(F.octet_length(F.col(name)), F.lit(0)) for name, kind in small.dtypes if kind == "string"]
    told = small.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0)).alias("size")).first()
    if told["n"] <= limit and told["size"] <= size:
        return big.join(F.broadcast(small), keys, "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = big.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return spread.join(merged(salted), [*keys, "_salt"], "left").drop("_salt")


#: Rows of one key that one task of a join takes.
HOT = 100_000


def join_spread(big: DataFrame, small: DataFrame, keys: list[str], n: str, calm: bool = False) -> DataFrame:
    """Inner join of `big` with `small`, which has one row for each of `keys` and in `n` the rows of `big` that have it, or more.

    Keys of more than HOT rows are spread over n / HOT tasks. They are broadcast to `big`: they can't be more
    than its rows / HOT (the sum of n over HOT, where n says more). `calm` says that there are none.
    """
    if calm:
        return big.join(small.drop(n), keys)
    parts = F.ceil(F.col(n) / HOT).cast("int")
    crowded = small.filter(F.col(n) > HOT).select(*keys, parts.alias("_parts"))
    if crowded.isEmpty():
        return big.join(small.drop(n), keys)
    dealt = F.when(F.col("_parts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int")).otherwise(0)
    spread = big.join(F.broadcast(crowded), keys, "left").withColumn("_salt", dealt).drop("_parts")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(n) > HOT, parts - 1).otherwise(0)))).drop(n)
    return spread.join(salted, [*keys, "_salt"]).drop("_salt")


def rows_apart(docs: DataFrame, names: list[str] | None = None, **columns: Column) -> DataFrame:
    """`docs` (or the columns `names` of it) as one column `row`, beside the columns made here: no name of `docs` clashes with theirs."""
    row = F.struct(*[F.col(f"`{name}`") for name in (docs.columns if names is None else names)])
    return docs.select(row.alias("row"), *[column.alias(name) for name, column in columns.items()])


def words_of(text: Column) -> Column:
    """The array of words of a text; null gives the empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def doc_key(doc_id: Column) -> Column:
    """crc32 of doc_id as text, unsigned; null counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
