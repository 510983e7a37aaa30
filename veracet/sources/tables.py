"""Readers and writers: typed tables, latest-wins upserts, compare-and-set updates and CSV.

Every function takes and returns DataFrames; nothing is collected.  Paths may be in any store that Spark reads.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, schema: StructType | str | None = None, format: str = "parquet") -> DataFrame:
    """A table; with a schema, unknown fields are dropped and missing ones are null."""
    reader = spark.read.format(format)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def lookup(df: DataFrame, **keys: object) -> DataFrame:
    """Rows whose columns have these values; a key of None is not asked for."""
    for name, value in keys.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return newest(df, keys, 1, *order)


def newest(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def appended(df: DataFrame, path: str) -> None:
    """Adds rows to a table; an empty addition writes nothing."""
    if not df.isEmpty():
        df.write.mode("append").parquet(path)


def upserted(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current with changes put in the place of rows with their keys; the last of several changes wins by ``_seq``, if there."""
    if "_seq" in changes.columns:
        changes = latest(changes, keys, F.col("_seq").desc()).drop("_seq")
    return current.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def compare_and_set(current: DataFrame, changes: DataFrame, keys: Sequence[str], revision: str = "revision") -> tuple[DataFrame, DataFrame]:
    """The table after changes whose revision is the stored one, and each change with ``applied``."""
    stored = current.select(*keys, F.col(revision).alias("_stored"))
    judged = changes.join(stored, list(keys), "left").withColumn("applied", F.coalesce(F.col("_stored") == F.col(revision), F.lit(False))).drop("_stored")
    taken = judged.filter("applied").drop("applied").withColumn(revision, F.col(revision) + 1)
    return upserted(current, taken, keys), judged


def claimed(queue: DataFrame, now: Column) -> DataFrame:
    """The due items after a worker took them: processing, one attempt more, no next attempt, no error."""
    due = queue.filter((F.col("status") == "queued") & (F.col("next_attempt").isNull() | (F.col("next_attempt") <= now)))
    return due.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "last_attempt": now, "next_attempt": F.lit(None).cast("timestamp"), "last_error": F.lit(None).cast("string")})


def deleted(current: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return current.join(keys, list(on), "left_anti")


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page of an ordered table: number from 1, size 1 to 100."""
    number, size = max(1, number), min(100, max(1, size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def write_csv(df: DataFrame, path: str) -> None:
    """Quoted by RFC 4180: quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def csv_field(x: Column) -> Column:
    """A field as CSV has it: quoted if it holds a comma, a quote or a line break."""
    return F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit("")))


def sitemap_urls(xml: Column) -> Column:
    """The distinct addresses of a sitemap or sitemap index, in order of appearance."""
    loc = F.lit("(?is)<(?:[a-z]+:)?loc[^>]*>(.*?)</(?:[a-z]+:)?loc>")
    found = F.transform(F.regexp_extract_all(xml, loc, F.lit(1)), lambda u: F.trim(F.regexp_replace(u, "\\s+", "")))
    return F.filter(F.array_distinct(found), lambda u: u != "")


def sitemaps(df: DataFrame, xml: str) -> DataFrame:
    """Adds ``urls`` and ``is_index`` to rows with sitemap texts."""
    out = df.withColumn("_xml", F.coalesce(F.col(xml), F.lit("")))
    index = F.col("_xml").rlike("(?i)<(?:[a-z]+:)?sitemapindex") | (F.col("_xml").rlike("(?i)<(?:[a-z]+:)?sitemap[ >]") & ~F.col("_xml").rlike("(?i)<(?:[a-z]+:)?urlset"))
    return out.withColumns({"urls": sitemap_urls(F.col("_xml")), "is_index": index}).drop("_xml")


def sitemap_locations(site: Column, robots: Column, hints: Column) -> Column:
    """Where a site's sitemaps may be: those of robots.txt, the two usual places, and hints, first seen first."""
    usual = F.array(F.concat(site, F.lit("/sitemap.xml")), F.concat(site, F.lit("/sitemap_index.xml")))
    everything = F.concat(F.coalesce(robots, F.array().cast("array<string>")), usual, F.coalesce(hints, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(everything, lambda u: F.trim(u)), lambda u: u.rlike("^https?://")))


def robots_rules(text: Column) -> Column:
    """The rules for all agents in a robots.txt as array<struct<allow, path>>, comments and blank paths dropped."""
    start = F.struct(F.lit(False).alias("mine"), F.lit(True).alias("head"), F.array().cast("array<struct<allow:boolean,path:string>>").alias("rules"))

    def step(state: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, "#.*$", ""))
        field, value = F.lower(F.trim(F.substring_index(bare, ":", 1))), F.trim(F.regexp_replace(bare, "^[^:]*:", ""))
        agent = field == "user-agent"
        rule = field.isin("allow", "disallow") & (value != "")
        mine = F.when(agent, F.when(state["head"], state["mine"]).otherwise(F.lit(False)) | (value == "*")).otherwise(state["mine"])
        rules = F.when(rule & state["mine"], F.concat(state["rules"], F.array(F.struct((field == "allow").alias("allow"), F.lower(value).alias("path"))))).otherwise(state["rules"])
        return F.struct(mine.alias("mine"), F.when(agent, True).when(rule, False).otherwise(state["head"]).alias("head"), rules.alias("rules"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\r?\n"), start, step)["rules"]


def robots_blocks(rules: Column, path: Column) -> Column:
    """Whether the longest fitting disallow prefix is longer than the longest fitting allow prefix; no rules allow all."""

    def longest(allow: bool) -> Column:
        fits = F.filter(rules, lambda r: (r["allow"] == F.lit(allow)) & F.lower(path).startswith(r["path"]))
        return F.coalesce(F.array_max(F.transform(fits, lambda r: F.length(r["path"]))), F.lit(0))

    return longest(False) > longest(True)


def settled(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder: its plan is cut there, and both uses of it see the same rows.

    The folder is that of the context or of spark.checkpoint.dir; where both are unset a local master gets one of its own, and on a
    cluster that is an error, as executors don't see the driver's folders.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="veracet-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank, 1 for the first of all rows in order; ties are in any order, so order should have none.

    Rows are dealt by ranges of the order and numbered in each; a range begins after the counts of those before it, and those
    counts alone meet in one window.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    within = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_range", before.alias("_before"))
    return within.join(counts, "_range").withColumn("rank", (F.col("_in") + F.col("_before")).cast("int")).drop("_range", "_in", "_before")
