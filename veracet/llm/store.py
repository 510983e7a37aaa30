"""Shared storage, size-checked joins and distributed prefix sums for the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side with at most this many rows, and this many bytes by the planner's estimate (of a written table: its
#: files), is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

#: Rows of an Arrow batch in the steps that are written to the shared folder.
ARROW_ROWS = 1000

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.  Where both are
    unset, a local master gets one of its own; on a cluster that is an error, as executors don't see the driver's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="veracet-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/veracet-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``new_path`` has named."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            if spark._sc._jsc is None:
                return
            drop(spark, path)
        except Exception:  # the session or its JVM has ended; what is left in a checkpoint folder is harmless
            return


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """What runs inside sends Python at most ``rows`` rows at a time: texts and packed arrays are long rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, path: str | None = None, rows: int = ARROW_ROWS) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of any executor.  rows: see ``small_batches``."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    with small_batches(spark, rows):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins with right broadcast if it is small, and by shuffle (AQE splits hot keys) beyond.

    right is counted first, so it should be a written table.
    """
    if is_small(right, rows):
        right = F.broadcast(right)
    return left.join(right, on, how)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return estimate <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


def null_safe(column: str | Column) -> Column:
    """A group key that is never null: 'v' and the value, or 'n'."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), column.cast("string")))


def binned_quantiles(df: DataFrame, key: str, score: str, shares: dict[str, float], bins: int) -> DataFrame:
    """(key, a column for each share): quantiles of a positive score, counted in bins of a 1 / ``bins`` of a doubling, so that
    a key's values are never gathered."""
    binned = df.filter(F.col(score) > 0).groupBy(key, F.floor(F.log2(score) * bins).alias("_bin")).agg(F.count("*").alias("n"))
    lists = binned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_bin", "n"))).alias("_bins"), F.sum("n").alias("_all"))

    def quantile(share: float) -> Column:
        seen = F.aggregate(
            "_bins", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at")),
            lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), F.when(a["at"].isNull() & (a["n"] + b["n"] >= share * F.col("_all")), b["_bin"]).otherwise(a["at"]).alias("at")),
        )
        return F.pow(F.lit(2.0), (seen["at"] + 0.5) / bins)

    return lists.select(key, *[quantile(share).alias(name) for name, share in shares.items()])


def running_total(df: DataFrame, key: list[str], order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, in ``order`` within ``key``.

    No task sees a whole key: rows are dealt by range of (key, order), summed for each range, and only the sums
    of (range, key) meet in a window; that table has a row for each range and key in it.  Rows that tie in
    ``order`` are kept apart by every other column, so reruns agree.
    """
    rest = [c for c in df.columns if c not in key + order]
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *key, *order, *rest).withColumn("_range", F.spark_partition_id()), name)
    sums = dealt.groupBy("_range", *key).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy("_range", *key).orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, -1)
    out_col = F.coalesce(F.sum(value).over(within), F.lit(0))
    joined = dealt.withColumn("_in", out_col)
    sums = sums.select(F.col("_range").alias("_r2"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], "_base")
    on = joined["_range"] == sums["_r2"]
    for i, c in enumerate(key):
        on = on & joined[c].eqNullSafe(sums[f"_k{i}"])
    joined = joined.join(sums, on, "left")
    return joined.withColumn(out, F.col("_in") + F.col("_base")).select(*df.columns, out)
