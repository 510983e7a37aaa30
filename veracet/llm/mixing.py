"""Mixing sources to target weights by blocks of words, with DataFrame functions only.

1. Sizes (words) are summed by source; targets share ``TOTAL`` times all sizes by weight, none above
   ``MOST`` times its source's size, the excess reshared by weight (water filling, solved by sorting the sources).
2. A source's documents, laid end to end by doc_id, are packed into blocks of ``BLOCK`` words; a source gives
   target / BLOCK slots in all.
3. For each output shard, source counts are drawn multinomially: each of the shard's slots takes the source in
   whose share a hash of (seed, shard, slot) falls.  Counts summed over the shards before number the slots of each
   source.  A source's draws beyond its slots are void and those it lacks form one last shard, so that shards
   vary as drawn while each source's total is its target.
4. The t-th slot of a source is block p(t mod blocks) of its epoch t div blocks, p being an affine permutation
   of the block indices chosen by source, seed and epoch.  Slots join blocks by (source, index).

No table here has the texts but the first, which is read for its word counts alone.  Word offsets come from range partitions
(``running_total``), so a source that holds a third of all rows is never in one task.

Defined results: null text has size 0 and takes nothing; null sources are one source, last in order; repeated rows
are one document each, told apart by nothing (their doc_id's rows get the same figures only if equal); an empty table
gives an empty result; a source of size 0 has target 0; other columns are ignored (and kept by ``mixed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracet.llm.store import join_small, running_total, written

BLOCK = 64
SHARD_SLOTS = 4096
TOTAL = 1.5
MOST = 2.0
WEIGHTS = (3, 1, 2)
SEED = 17
#: Cells that divide [0, 1): a source's share covers a run of cells, so a draw finds its source by an equi-join.
CELLS = 4096
#: Primes for the affine permutations; one that does not divide the number of blocks is coprime to it.
PRIMES = (1_000_003, 998_244_353, 1_000_000_007, 1_000_000_009)
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """sizes: source, source_size (one row per source).  Adds weight, target and share (its part of all slots).

    With sources ordered by most * size / weight, those before some place get most * size, and the rest share what
    is left by weight; the place is the first whose own share does not exceed its bound.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(weight, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    level = F.when(F.col("source_size") > 0, most * F.col("source_size") / F.col("weight")).otherwise(0.0)
    everything = Window.partitionBy(F.lit(0))
    by_level = Window.orderBy(level, F.col("source").isNull(), F.encode("source", "utf-8"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    lot = total * F.sum("source_size").over(everything)
    ranked = ranked.withColumn("_each", (lot - full) / F.sum("weight").over(after)).withColumn("_level", level)
    free = F.min(F.when(F.col("_each") <= F.col("_level"), F.struct("_level", "_each"))).over(everything)
    bound = most * F.col("source_size")
    target = F.when(free.isNull() | (F.col("_level") < free["_level"]), bound).otherwise(F.least(bound, F.col("weight") * free["_each"]))
    return ranked.withColumn("target", F.coalesce(target, F.lit(0.0)).cast("double")).drop("_each", "_level")


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def _permuted(t: Column, blocks: Column, key: Column, seed: int) -> Column:
    """The block of slot t: (p * (t mod blocks) + shift) mod blocks, shift by source and epoch."""
    at = t % blocks
    epoch = ((t - at) / blocks).cast("long")
    prime = F.lit(PRIMES[-1])
    for p in reversed(PRIMES[:-1]):
        prime = F.when(blocks % p != 0, F.lit(p)).otherwise(prime)
    step = F.pmod(prime, blocks)
    shift = F.pmod(F.xxhash64(key, epoch, F.lit(seed)), blocks)
    # the product stays below 2**63 while blocks < 2**31; beyond, halves of the step are multiplied in turn
    product = (step.cast("decimal(38,0)") * at.cast("decimal(38,0)")) % blocks.cast("decimal(38,0)")
    small = (step * at) % blocks
    return F.pmod(F.when(blocks < (1 << 31), small).otherwise(product.cast("long")) + shift, blocks)


def block_draws(sizes: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(source, block, times) for each block that the mix takes; sizes: what ``targets`` returns, written."""
    spark = sizes.sparkSession
    quota = sizes.filter("source_size > 0").select(
        "source", "target",
        F.ceil(F.col("source_size") / block).cast("long").alias("blocks"),
        (F.col("target") / F.col("source_size")).alias("_times"),
    )
    # the blocks of a source have source_size / blocks words each on average; none is taken more than MOST times
    quota = quota.withColumn("slots", F.least(F.round(F.col("_times") * F.col("blocks")), F.ceil("_times") * F.col("blocks")).cast("long"))
    lot = Window.partitionBy(F.lit(0))
    ordered = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = quota.withColumn("_to", F.sum("slots").over(ordered)).withColumn("_all", F.sum("slots").over(lot))
    quota = written(quota.withColumn("_from", F.col("_to") - F.col("slots")), "quota")
    total = quota.agg(F.sum("slots")).first()[0] or 0
    shards = -(-total // SHARD_SLOTS)
    cells = quota.filter("slots > 0").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") * CELLS / F.col("_all")), F.floor((F.col("_to") * CELLS - 1) / F.col("_all"))))
    )
    cells = written(cells.select("source", "_cell", (F.col("_from") / F.col("_all")).alias("_lo"), (F.col("_to") / F.col("_all")).alias("_hi")), "cells")
    draws = spark.range(0, total).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), _unit(F.lit(seed), F.col("id")).alias("_u"))
    draws = draws.withColumn("_cell", F.floor(F.col("_u") * CELLS))
    draws = join_small(draws, cells, "_cell", "inner").filter("_lo <= _u and _u < _hi")
    drawn = draws.groupBy("shard", "source").agg(F.count("*").alias("drawn"))
    # the slots of a source are numbered over its shards; a table of (shard, source) counts
    drawn = running_total(drawn, ["source"], ["shard"], "drawn", "first", "draws")
    last = drawn.groupBy("source").agg(F.sum("drawn").alias("got")).select(F.col("source").alias("_s"), "got")
    last = quota.join(last, quota["source"].eqNullSafe(F.col("_s")), "left")
    last = last.select(F.lit(shards).cast("long").alias("shard"), "source", F.greatest(F.lit(0), F.col("slots") - F.coalesce("got", F.lit(0))).alias("drawn"), F.coalesce("got", F.lit(0)).alias("first"))
    drawn = drawn.select("shard", "source", "drawn", "first").unionByName(last.filter("drawn > 0"))
    own = quota.select(F.col("source").alias("_s"), "blocks", "slots")
    drawn = written(drawn, "shard-counts")
    drawn = join_small(drawn, own, F.col("source").eqNullSafe(F.col("_s")), "inner")
    drawn = drawn.withColumn("_end", F.least(F.col("slots"), F.col("first") + F.col("drawn"))).filter("first < _end")
    slots = drawn.select("source", "blocks", F.explode(F.sequence(F.col("first"), F.col("_end") - 1)).alias("t"))
    at = _permuted(F.col("t"), F.col("blocks"), F.coalesce("source", F.lit("\u0000null")), seed)
    return slots.select("source", at.alias("block")).groupBy("source", "block").agg(F.count("*").alias("times"))


def mix_report(documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, pieces (from, words, times within it) and text_hash."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), word_count().alias("size"))
    offsets = running_total(rows, ["source"], ["doc_id", "text_hash"], "size", "begin", "sizes")
    offsets = written(offsets.withColumn("_row", F.monotonically_increasing_id()), "offsets")
    sizes = offsets.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = written(targets(sizes, weights, total, most), "targets")
    draws = block_draws(sizes, seed, block)
    end = F.col("begin") + F.col("size")
    parts = offsets.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))))
    parts = parts.withColumn("_a", F.greatest(F.col("begin"), F.col("block") * block)).withColumn("_n", F.least(end, (F.col("block") + 1) * block) - F.col("_a"))
    parts = parts.select("_row", F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("_a") - F.col("begin")).alias("at"), F.col("_n").alias("n"))
    took = parts.join(draws, F.col("_s").eqNullSafe(F.col("source")) & (F.col("_b") == F.col("block")))
    took = took.groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("at", "n", "times"))).alias("pieces"))
    out = offsets.join(took, "_row", "left")
    own = sizes.select(F.col("source").alias("_s"), "source_size", "target")
    out = join_small(out, own, F.col("source").eqNullSafe(F.col("_s")))
    pieces = F.coalesce("pieces", F.array().cast("array<struct<at:bigint,n:bigint,times:bigint>>"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), pieces.alias("pieces"), "text_hash")


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: for the k-th time that any of its words are taken, a row with those words.

    A document whose words are all taken keeps its text as it is; else the words taken are joined by one space.  Rows with
    one doc_id are told apart by source and text; rows that are alike in all three are laid out one after the other, and
    their other columns are those of one of them.
    """
    columns = documents.columns
    key = ["__veracet_id", "__veracet_source", "__veracet_hash"]
    report = mix_report(documents, **options).select(
        F.col("doc_id").alias(key[0]), F.col("source").alias(key[1]), F.col("text_hash").alias(key[2]), F.col("size").alias("__veracet_size"), F.col("taken").alias("__veracet_taken"), F.col("pieces").alias("__veracet_pieces")
    )
    report = written(report, "mix-report")
    same = F.col("doc_id").eqNullSafe(F.col(key[0])) & F.col("source").eqNullSafe(F.col(key[1])) & (F.xxhash64("text") == F.col(key[2]))
    twice = written(report.groupBy(*key).agg(F.count("*").alias("__veracet_rows")).filter("__veracet_rows > 1").select(*key), "alike")
    if not twice.isEmpty():  # each row alike once, as it meets the pieces of all of them
        alike = join_small(documents, twice, same, "left_semi").withColumn(key[2], F.xxhash64("text")).dropDuplicates(["doc_id", "source", key[2]]).drop(key[2])
        documents = join_small(documents, twice, same, "left_anti").unionByName(alike)
    both = documents.join(report.filter("__veracet_taken > 0"), same)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("__veracet_pieces", lambda p: p["times"]))))
    both = both.withColumn("__veracet_copy", copy)
    both = both.withColumn("__veracet_mine", F.filter("__veracet_pieces", lambda p: p["times"] >= F.col("__veracet_copy")))
    words = F.aggregate("__veracet_mine", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    both = both.withColumn("__veracet_words", F.when(words < F.col("__veracet_size"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    cut = F.array_join(F.flatten(F.transform("__veracet_mine", lambda p: F.slice("__veracet_words", (p["at"] + 1).cast("int"), p["n"].cast("int")))), " ")
    both = both.withColumn("text", F.when(F.col("__veracet_words").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        both = both.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return both.select(*columns)
