"""What several operators of this subpackage need: shared storage, folds and samples."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-JVM session without that setting gets a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a small frame that one task takes, where their number is known before it is made.
ROWS_PER_TASK = 25_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A reliable checkpoint of a small frame.

    ``rows`` is about how many it has at most. Then it is made in as many tasks as that needs, not in one
    for each shuffle partition: every task of a checkpoint or of the shuffle after it leaves files of its
    own, which take more room than a few rows do.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(1 + rows // ROWS_PER_TASK)).checkpoint(eager=True)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, files of a shuffle go as soon as the action that made them has ended, not at some collection of
    the driver's garbage. Results of actions stay; nothing but a new action reads them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, giving freed memory back to the system at the end of each task:
    workers live on and would hold it while later stages need it."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def text_mark(text: Column) -> Column:
    """A digest that tells texts apart, null from empty too."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.md5(text.cast("binary")))


#: A key is hot if it holds this part of all rows or more, so there are at most as many hot keys.
HOT = 1000


def hot_join(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for each key and, in ``count``, how many of the
    ``total`` rows have that key.

    The facts of hot keys are broadcast: at most ``HOT`` rows, by counting. So the rows of a hot key
    stay where they are, and what is shuffled has no key with more than a ``HOT``-th of all rows.
    """
    hot = F.col(count) * HOT >= total
    few = F.broadcast(facts.where(hot))
    rest = rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(facts.where(~hot), keys))


def bounded_sample(df: DataFrame, group: str, counts: dict, bound: int | dict) -> DataFrame:
    """At most ``bound`` rows of each group (or ``bound[group]``), those with the smallest hash of the whole row.

    ``counts`` are the groups' sizes. A threshold on the hash, a little above the share that is
    wanted, drops nearly all rows where they are read, so that what is ranked is bounded however
    large the table is. The hash takes in the row's contents, so rows that repeat a key are rows
    of their own; equal rows share a hash and are counted in the ranking.
    """
    wanted = {g: bound if isinstance(bound, int) else bound.get(g, 0) for g in counts}
    hashed = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 30))
    # Six standard deviations above the share: that too few rows pass is out of the question.
    share = {g: min(1.0, (wanted[g] + 6 * wanted[g] ** 0.5 + 20) / max(1, n)) for g, n in counts.items()}
    least = F.coalesce(*[F.when(F.col(group) == g, F.lit(int(s * (1 << 30)))) for g, s in share.items()], F.lit(0))
    places = Window.partitionBy(group).orderBy("h_", *df.columns)
    passed = df.withColumn("h_", hashed).where(F.col("h_") < least).withColumn("place_", F.row_number().over(places))
    most = F.coalesce(*[F.when(F.col(group) == g, F.lit(n)) for g, n in wanted.items()], F.lit(0))
    return passed.where(F.col("place_") <= most).drop("h_", "place_")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
