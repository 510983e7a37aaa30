"""Merging claims to canonical values, conflicts, and changes between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def same_value(a: Column, b: Column) -> Column:
    """Numbers within max(0.5, 2 % of the first), else equal texts of any case."""
    x, y = a.try_cast("double"), b.try_cast("double")
    text = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= F.greatest(F.lit(0.5), F.abs(x) * 0.02)).otherwise(text)


def merged(claims: DataFrame) -> DataFrame:
    """Folds the claims of each (product, attribute) in order of time into one canonical value.

    claims: product_id, attribute, value, weight, confidence, observed, source_id and seq.  A claim that agrees raises weight and
    confidence; one that disagrees flags a conflict, and takes over if it weighs more, or nearly as much and is newer.
    The fold is an aggregate over the sorted claims of one attribute of one product, so it is as long as its sources are many.
    """
    kind = "struct<value:string,weight:double,confidence:double,observed:timestamp,source_id:bigint,conflict:boolean,evidence:int>"
    start = F.lit(None).cast(kind)
    ordered = F.array_sort(F.collect_list(F.struct("observed", "source_id", "seq", "value", "weight", "confidence")))

    def state(c: Column, conflict: Column, evidence: Column, weight: Column, confidence: Column) -> Column:
        return F.struct(
            c["value"].alias("value"), weight.alias("weight"), confidence.alias("confidence"), c["observed"].alias("observed"), c["source_id"].alias("source_id"),
            conflict.alias("conflict"), evidence.cast("int").alias("evidence"),
        ).cast(kind)

    def step(s: Column, c: Column) -> Column:
        n = s["evidence"] + 1
        bonus = F.least(F.lit(0.14), s["evidence"] * 0.07)
        agrees = same_value(s["value"], c["value"])
        wins = (c["weight"] > s["weight"]) | ((c["weight"] >= 0.98 * s["weight"]) & (c["observed"] > s["observed"]))
        up = F.least(F.greatest(F.round(F.greatest(s["confidence"], c["confidence"]) + 0.05 + bonus, 4), F.lit(0.05)), F.lit(0.99))
        taken = F.least(F.greatest(F.round(c["confidence"] + bonus - 0.20, 4), F.lit(0.05)), F.lit(0.99))
        held = F.least(F.greatest(F.round(s["confidence"] + bonus - 0.20, 4), F.lit(0.05)), F.lit(0.99))
        return (
            F.when(s.isNull(), state(c, F.lit(False), F.lit(1), c["weight"], c["confidence"]))
            .when(agrees, state(s, s["conflict"], n, F.greatest(s["weight"], c["weight"]), up))
            .when(wins, state(c, F.lit(True), n, c["weight"], taken))
            .otherwise(state(s, F.lit(True), n, s["weight"], held))
        )

    out = claims.groupBy("product_id", "attribute").agg(ordered.alias("_c"))
    return out.withColumn("m", F.aggregate("_c", start, step)).select("product_id", "attribute", "m.*")


def conflicts(evidence: DataFrame, definitions: DataFrame, canonical: DataFrame) -> DataFrame:
    """Attributes on which sources contradict each other: numbers spread beyond max(0.5, 3 %), more than one text, or a
    conflict that the merge has flagged.

    evidence: product_id, attribute, value; canonical: product_id, attribute, value, winner, has_conflict, confidence (the
    greater of its weight and confidence) and evidence (count).  Attributes with one claim and no flag are left out.  The
    severity goes by the merge's flag; what is suggested is the canonical value, with its source.
    """
    numeric = F.col("value_type").isin("integer", "decimal")
    n = F.col("value").try_cast("double")
    said = evidence.groupBy("product_id", "attribute").agg(F.min(n).alias("low"), F.max(n).alias("high"), F.count(n).alias("numbers"), F.countDistinct(F.lower(F.trim("value"))).alias("values"))
    held = canonical.select("product_id", "attribute", F.col("value").alias("suggested"), F.col("winner").alias("suggested_source"), F.col("confidence").alias("suggested_confidence"), F.col("evidence").alias("claims"), "has_conflict")
    out = said.join(held, ["product_id", "attribute"]).join(definitions.select("attribute", "value_type"), "attribute", "left")
    spread = numeric & (F.col("numbers") >= 2) & ((F.col("high") - F.col("low")) > F.greatest(F.lit(0.5), F.abs(F.col("high")) * 0.03))
    texts = F.col("value_type").isin("string", "boolean") & (F.col("values") > 1)
    reason = F.when(spread, "numeric spread").when(texts, "different values").when(F.col("has_conflict"), "flagged")
    out = out.filter((F.col("claims") >= 2) | F.col("has_conflict")).withColumn("reason", reason).filter("reason is not null")
    severity = F.when(F.col("has_conflict"), 0.90).otherwise(0.75)
    return out.select("product_id", "attribute", "reason", severity.alias("severity"), F.col("values").alias("n_values"), "suggested", "suggested_source", "suggested_confidence")


def changed(a: Column, b: Column) -> Column:
    """Texts that differ but for case and outer blanks; two missing ones don't."""
    return ~F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def delta(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Both: keys, attribute, value.  A row for each attribute that is new, gone or different, numbered in its entity."""
    p = previous.select(*keys, "attribute", F.col("value").alias("old_value"))
    c = current.select(*keys, "attribute", F.col("value").alias("new_value"))
    out = p.join(c, [*keys, "attribute"], "full").filter(changed(F.col("old_value"), F.col("new_value")))
    kind = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").otherwise("changed")
    return out.withColumn("kind", kind).withColumn("change_no", F.row_number().over(Window.partitionBy(*keys).orderBy("attribute")))


def version_changes(versions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Change events of values over time: each version whose value differs from the one before; the first is a change from nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = versions.withColumn("old_value", F.lag("value").over(w)).withColumnRenamed("value", "new_value")
    return out.filter(changed(F.col("old_value"), F.col("new_value")))


def content_changes(pages: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Pages whose text differs from the page before of their key (unchanged ones are skipped before extraction)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hashed = pages.withColumn("content_hash", F.upper(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return hashed.withColumn("unchanged", F.coalesce(F.lag("content_hash").over(w) == F.col("content_hash"), F.lit(False)))
