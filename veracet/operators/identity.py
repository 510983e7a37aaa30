"""Identity of products: which known product a source's product is, by ordered rules, without comparing all pairs."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracet.functions.text import text_similarity

CONFIDENCE = {"gtin": 1.00, "part_number": 0.98, "brand_model": 0.97, "attributes": 0.93}
SIMILAR = 0.86
#: The least similarity of model numbers with which brand, model and title together can reach ``SIMILAR``.
LEAST_MODEL = (SIMILAR - 0.20 - 0.35) / 0.45
#: Categories whose part numbers identify a product, and whose variants are told apart.
PART_NUMBER_CATEGORIES = ("smartphone", "tablet", "headphones", "speakers")


def fingerprint_similarity(a: str, b: str) -> F.Column:
    """Of two rows with gtin, brand, model_number and title, named by prefixes: 1 for equal gtin; 0.91 for equal brand and
    near model and title; else a blend."""
    same = lambda c: F.coalesce(F.lower(F.trim(F.col(f"{a}{c}"))) == F.lower(F.trim(F.col(f"{b}{c}"))), F.lit(False))
    model, title = text_similarity(f"{a}model_number", f"{b}model_number"), text_similarity(f"{a}title", f"{b}title")
    brand = F.when(same("brand"), 1.0).otherwise(0.0)
    return (
        F.when(same("gtin"), 1.0)
        .when(same("brand") & (model >= 0.90) & (title >= 0.45), 0.91)
        .otherwise(F.round(0.20 * brand + 0.45 * model + 0.35 * title, 4))
    )


def match(incoming: DataFrame, known: DataFrame, variant_keys: tuple[str, ...] = (), identity_keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per incoming product: source_product_id, product_id (null: none), rule, confidence.

    incoming: source_product_id, category, gtin, brand, model_number, title, and the columns named by the keys, among them
    manufacturer_part_number if there is one; known: product_id and the same.  Blank values compare with nothing.  Rules in order:

    1. gtin;
    2. in a category of ``PART_NUMBER_CATEGORIES``, its manufacturer part number, unless brand or model contradict;
    3. brand and model number;
    4. two or more identity keys of a category, if none that both have differs; the most equal ones first;
    5. fingerprint similarity of at least ``SIMILAR``.

    In those categories a known product of the same category that differs in a variant key is no match by rules 3 to 5.  Ties
    go to the smallest product_id.  Known products that are alike in all columns are one; rule 4 meets by pairs of equal
    keys, and rule 5 compares the different models of a brand, so that no rule compares all pairs of products.
    """
    norm = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    columns = [c for c in known.columns if c != "product_id"]
    k = known.groupBy(*columns).agg(F.min("product_id").alias("k_product_id")).withColumnsRenamed({c: f"k_{c}" for c in columns})
    differs = lambda c: F.coalesce(norm(c) != norm(f"k_{c}"), F.lit(False))
    equal = lambda c: F.coalesce(norm(c) == norm(f"k_{c}"), F.lit(False))
    strong = F.coalesce(norm("category").isin(*PART_NUMBER_CATEGORIES), F.lit(False))
    clash = F.lit(False)
    for c in variant_keys:
        clash = clash | differs(c)
    clash = strong & equal("category") & clash
    least = F.min("k_product_id")

    def left_over(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, "source_product_id", "left_anti")

    matches = []
    by_gtin = k.withColumn("_key", norm("k_gtin")).filter("_key is not null").groupBy("_key").agg(least.alias("product_id"))
    matches.append(incoming.join(by_gtin, norm("gtin") == F.col("_key")).select("source_product_id", "product_id", F.lit("gtin").alias("rule"), F.lit(1.0).alias("similarity")))
    rest = left_over(incoming, matches[-1])

    def first(pairs: DataFrame, rule: str) -> None:
        nonlocal rest
        matches.append(pairs.groupBy("source_product_id").agg(least.alias("product_id")).select("source_product_id", "product_id", F.lit(rule).alias("rule"), F.lit(1.0).alias("similarity")))
        rest = left_over(rest, matches[-1])

    if "manufacturer_part_number" in columns:
        same = (norm("category") == norm("k_category")) & (norm("manufacturer_part_number") == norm("k_manufacturer_part_number"))
        first(rest.filter(strong).join(k, same).filter(~differs("brand") & ~differs("model_number")), "part_number")
    first(rest.join(k, (norm("brand") == norm("k_brand")) & (norm("model_number") == norm("k_model_number"))).filter(~clash), "brand_model")

    if len(identity_keys) > 1:
        def pairs_of(rows: DataFrame, prefix: str, row_id: str) -> DataFrame:
            """(category, two equal keys) of each row: what two rows must share to match."""
            two = [F.struct(F.lit(f"{a}+{b}").alias("keys"), norm(prefix + a).alias("a"), norm(prefix + b).alias("b")) for a, b in itertools.combinations(identity_keys, 2)]
            out = rows.select(row_id, norm(f"{prefix}category").alias("_category"), F.explode(F.array(*two)).alias("_two"))
            return out.filter("_two.a is not null and _two.b is not null")

        met = pairs_of(rest, "", "source_product_id").join(pairs_of(k, "k_", "k_product_id"), ["_category", "_two"]).select("source_product_id", "k_product_id").distinct()
        both = met.join(rest, "source_product_id").join(k, "k_product_id").filter(~clash)
        for c in identity_keys:
            both = both.filter(~differs(c))
        best = both.withColumn("_n", sum(equal(c).cast("int") for c in identity_keys)).groupBy("source_product_id").agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("k_product_id").alias("id"))).alias("b"))
        matches.append(best.select("source_product_id", F.col("b.id").alias("product_id"), F.lit("attributes").alias("rule"), F.lit(1.0).alias("similarity")))
        rest = left_over(rest, matches[-1])

    mine = rest.select(norm("brand").alias("_brand"), "model_number").distinct()
    theirs = k.select(norm("k_brand").alias("_brand"), "k_model_number").distinct()
    near = mine.join(theirs, "_brand").filter(text_similarity("model_number", "k_model_number") >= LEAST_MODEL)
    near = near.select("_brand", F.col("model_number").alias("_m"), F.col("k_model_number").alias("_km"))
    both = rest.join(near, (norm("brand") == F.col("_brand")) & rest["model_number"].eqNullSafe(F.col("_m")))
    both = both.join(k, (norm("k_brand") == F.col("_brand")) & k["k_model_number"].eqNullSafe(F.col("_km"))).filter(~clash)
    both = both.withColumn("similarity", fingerprint_similarity("", "k_")).filter(F.col("similarity") >= SIMILAR)
    best = both.groupBy("source_product_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("k_product_id").alias("id"))).alias("b"))
    matches.append(best.select("source_product_id", F.col("b.id").alias("product_id"), F.lit("similarity").alias("rule"), (-F.col("b.s")).alias("similarity")))

    found = functools.reduce(DataFrame.unionByName, matches)
    out = incoming.select("source_product_id").join(found, "source_product_id", "left")
    confidence = F.when(F.col("rule").isNull(), 0.0).when(F.col("rule") == "similarity", F.least(F.lit(0.99), F.round(0.60 + 0.35 * F.col("similarity"), 4)))
    for rule, value in CONFIDENCE.items():
        confidence = confidence.when(F.col("rule") == rule, value)
    return out.select("source_product_id", "product_id", F.coalesce("rule", F.lit("none")).alias("rule"), confidence.alias("confidence"))
