"""Queries over the scores (M) on the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracet.functions import scores
from veracet.operators import quality
from veracet.plans.catalog import query
from veracet.sources import tables, views


@query(
    "m01_claim_confidence",
    "SELECT product_id, source_id, attribute, round(least(0.99, greatest(0.05, confidence_pct / 100.0 + CASE WHEN contains('supplier#00000000' || source_id, '0000000' || (product_id % 100)) THEN 0.12 ELSE 0 END)), 4) AS confidence FROM v_evidence",
    "v_evidence",
)
def m01(spark: SparkSession, d: str) -> DataFrame:
    e = views.evidence(spark, d)
    source = F.concat(F.lit("Supplier#00000000"), F.col("source_id").cast("string"))
    brand = F.concat(F.lit("0000000"), (F.col("product_id") % 100).cast("string"))
    return e.select("product_id", "source_id", "attribute", scores.candidate_confidence(F.col("confidence_pct") / 100, source, brand).alias("confidence"))


@query(
    "m02_merged_confidence",
    "SELECT product_id, attribute, round(least(0.99, greatest(0.05, round(confidence_pct / 100.0 + CASE WHEN has_conflict THEN -0.20 ELSE 0.05 END + least(0.14, (evidence - 1) * 0.07), 4))), 4) AS confidence FROM v_canonical",
    "v_canonical",
)
def m02(spark: SparkSession, d: str) -> DataFrame:
    merged = scores.merged_confidence(F.col("confidence_pct") / 100, F.col("evidence"), ~F.col("has_conflict"))
    return views.canonical(spark, d).select("product_id", "attribute", merged.alias("confidence"))


@query(
    "m03_source_quality",
    "SELECT source_id, round(CAST(0.70 * c + 0.30 * k AS DECIMAL(28,10)), 4) AS quality FROM (SELECT source_id, round(avg(confidence_pct) / 100, 4) AS c, round(count(*) / (count(DISTINCT product_id) * 8), 4) AS k FROM v_evidence GROUP BY source_id)",
    "v_evidence",
)
def m03(spark: SparkSession, d: str) -> DataFrame:
    g = views.evidence(spark, d).groupBy("source_id").agg(F.round(F.avg("confidence_pct") / 100, 4).alias("c"), F.round(F.count("*") / (F.countDistinct("product_id") * 8), 4).alias("k"))
    return g.select("source_id", scores.source_quality(F.col("c"), F.col("k")).alias("quality"))


@query(
    "m05_attribute_reliability",
    "SELECT product_id, attribute, least(1.0, greatest(0.05, round(0.55 * avg_confidence + 0.25 * confidence_pct / 100 + 0.15 * f + 0.05 * CASE WHEN evidence >= 2 THEN 1.0 ELSE 0.9 END, 4))) AS reliability FROM (SELECT c.*, a.avg_confidence, CASE WHEN attribute IN ('quantity', 'tax') THEN CASE WHEN has_conflict THEN 0.65 ELSE 0.97 END ELSE CASE WHEN has_conflict THEN 0.55 ELSE 0.95 END END AS f"
    " FROM v_canonical c JOIN (SELECT product_id, attribute, round(avg(confidence_pct) / 100, 4) AS avg_confidence FROM v_evidence GROUP BY ALL) a USING (product_id, attribute))",
    "v_canonical",
)
def m05(spark: SparkSession, d: str) -> DataFrame:
    a = views.evidence(spark, d).groupBy("product_id", "attribute").agg(F.round(F.avg("confidence_pct") / 100, 4).alias("a"))
    defs = F.broadcast(views.definitions(spark).select("attribute", "sensitivity"))
    rows = views.canonical(spark, d).join(a, ["product_id", "attribute"]).join(defs, "attribute", "left")
    value = scores.attribute_reliability(F.col("confidence_pct") / 100, F.col("a"), F.col("evidence"), F.coalesce("sensitivity", F.lit("medium")), F.col("has_conflict"))
    return rows.select("product_id", "attribute", value.alias("reliability"))


@query(
    "m06_merge_weight",
    "SELECT product_id, source_id, attribute, least(1.0, greatest(0.05, round(0.72 * 0.9 * (confidence_pct / 100.0) * 0.9 * 1.0 * CASE WHEN age <= 30 THEN 0.88 WHEN age <= 90 THEN 0.76 ELSE 0.65 END, 4))) AS weight FROM (SELECT *, date_diff('day', observed, TIMESTAMP '2002-06-01') AS age FROM v_evidence)",
    "v_evidence",
)
def m06(spark: SparkSession, d: str) -> DataFrame:
    e = views.evidence(spark, d)
    none = F.lit(None).cast("double")
    w = scores.merge_weight(none, F.lit(0.9), F.col("confidence_pct") / 100, none, none, scores.recency_factor(F.col("observed"), F.lit("2002-06-01").cast("timestamp")))
    return e.select("product_id", "source_id", "attribute", w.alias("weight"))


@query(
    "m11_trust_components",
    "SELECT user_id AS entity, CASE WHEN n = 0 THEN 0 ELSE round(least(1.0, n / 12 * 0.7 + v / 6 * 0.3), 4) END AS price_volatility, round(1 - least(1.0, least(k, 40) / 20), 4) AS spec_stability FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n, count(DISTINCT CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) % 4 END) AS v,"
    " count(*) FILTER (event_type = 'signup') AS k FROM events GROUP BY user_id)",
)
def m11(spark: SparkSession, d: str) -> DataFrame:
    buys = F.col("attribute") == "purchase"
    g = views.changes(spark, d).groupBy("entity").agg(F.count_if(buys).alias("n"), F.countDistinct(F.when(buys, F.col("value"))).alias("v"), F.count_if(F.col("attribute") == "signup").alias("k"))
    return g.select("entity", scores.price_volatility(F.col("n"), F.col("v")).alias("price_volatility"), scores.spec_stability(F.col("k")).alias("spec_stability"))


@query(
    "m13_disagreement_adjustment",
    "SELECT source_id, category, attribute, least(1.20, greatest(0.45, round(CAST(1 - 0.5 * dr + 0.25 * wr AS DECIMAL(28,10)), 4))) AS adjustment FROM (SELECT e.source_id, e.category, e.attribute, round(count(*) FILTER (e.value <> c.value) / count(*), 4) AS dr, round(count(*) FILTER (e.source_id = c.winner) / count(*), 4) AS wr"
    " FROM v_evidence e JOIN v_canonical c ON e.product_id = c.product_id AND e.attribute = c.attribute AND c.evidence > 1 GROUP BY ALL)",
    "v_evidence v_canonical",
)
def m13(spark: SparkSession, d: str) -> DataFrame:
    c = quality.disagreements(views.evidence(spark, d), views.canonical(spark, d))
    return c.select("source_id", "category", "attribute", scores.disagreement_adjustment(F.col("disagreement_rate"), F.col("win_rate")).alias("adjustment"))


@query(
    "m14_queue_priorities",
    "SELECT item_id, priority, row_number() OVER (ORDER BY priority DESC, attempts DESC, enqueued, item_id) AS rank FROM (SELECT *, round(importance * 30 + 0.5 * 30 + least(1.0, attempts / 4) * 25 + CASE WHEN attempts = 0 THEN round(s * 0.55, 4) ELSE s END * 15, 2) AS priority"
    " FROM (SELECT *, CASE WHEN age >= 30 THEN 1.0 WHEN age >= 14 THEN 0.85 WHEN age >= 7 THEN 0.70 WHEN age >= 1 THEN 0.45 ELSE 0.20 END AS s FROM (SELECT *, date_diff('day', enqueued, TIMESTAMP '1999-06-01') AS age FROM v_queue WHERE status = 'queued')))",
    "v_queue",
)
def m14(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d).filter("status = 'queued'")
    stale = scores.adaptive_staleness(scores.staleness(F.col("enqueued"), F.lit("1999-06-01").cast("timestamp")), F.lit(0.95), F.col("attempts"))
    q = q.withColumn("priority", scores.crawl_priority(F.col("importance"), F.lit(0.5), F.least(F.lit(1.0), F.col("attempts") / 4), stale))
    order = [F.desc("priority"), F.desc("attempts"), "enqueued", "item_id"]
    return tables.ranked(q, order).select("item_id", "priority", "rank")


@query(
    "m15_priority_reasons",
    "SELECT item_id, concat_ws(',', CASE WHEN importance >= 0.7 THEN 'trusted source' END, CASE WHEN attempts / 4 >= 0.5 THEN 'changes often' END, CASE WHEN last_error IS NOT NULL THEN 'attributes missing' END) AS reasons FROM v_queue",
    "v_queue",
)
def m15(spark: SparkSession, d: str) -> DataFrame:
    missing = F.when(F.col("last_error").isNotNull(), 1).otherwise(0)
    reasons = scores.priority_reasons(F.col("importance"), F.col("attempts") / 4, missing, F.lit(0.2))
    return views.queue(spark, d).select("item_id", F.array_join(reasons, ",").alias("reasons"))


@query(
    "m16_next_interval",
    "SELECT item_id, round(greatest(lo, least(hi, round((lo + hi) / 2, 0) * CASE WHEN importance >= 0.85 THEN 0.75 WHEN importance >= 0.7 THEN 0.90 WHEN importance >= 0.5 THEN 1.10 ELSE 1.40 END * CASE WHEN v >= 0.8 THEN 0.25 WHEN v >= 0.6 THEN 0.45 WHEN v >= 0.4 THEN 0.75 ELSE 1.30 END * pow(1.8, attempts) * (1.15 - importance * 0.55))), 4) AS minutes FROM"
    " (SELECT *, CASE WHEN c >= 0.7 THEN 60 ELSE 1440 END AS lo, CASE WHEN c <= 0.2 THEN 43200 ELSE 10080 END AS hi, (0.5 + c + 0.1) / 3 AS v FROM (SELECT *, attempts / 4 AS c FROM v_queue))",
    "v_queue",
)
def m16(spark: SparkSession, d: str) -> DataFrame:
    change = F.col("attempts") / 4
    minutes = scores.next_interval(F.col("importance"), F.col("attempts"), F.col("importance"), F.lit(0.5), change, F.lit(0.1), F.lit(0.95), F.lit(0.0))
    return views.queue(spark, d).select("item_id", F.round(minutes, 4).alias("minutes"))


@query(
    "m17_page_volatility",
    "SELECT source_name, day, round(CAST(0.40 * extractable + 0.35 * no_product + 0.25 * (1 - success) AS DECIMAL(28,10)), 4) AS volatility FROM v_snapshots",
    "v_snapshots",
)
def m17(spark: SparkSession, d: str) -> DataFrame:
    return views.snapshots(spark, d).select("source_name", "day", scores.page_volatility(F.col("extractable"), F.col("no_product"), F.col("success")).alias("volatility"))


_CAND = (
    "SELECT p_partkey AS candidate, CAST(p_size * 2 AS DOUBLE) AS crawlable, CAST(p_partkey % 100 AS DOUBLE) AS relevant, CAST(p_size * 7 % 100 AS DOUBLE) AS extractable, CAST(p_partkey * 3 % 100 AS DOUBLE) AS catalog, p_partkey % 4 AS dup, p_partkey % 3 = 0 AS compatible, p_partkey % 2 = 0 AS reachable, p_partkey % 11 <> 0 AS allowed FROM part"
)
_HEUR = (
    "round(greatest(0, least(100, CASE WHEN allowed THEN h ELSE least(h, 10.0) END)), 2)"
)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    c = views.table(spark, d, "part").select(
        k.alias("candidate"), (s * 2).cast("double").alias("crawlable"), (k % 100).cast("double").alias("relevant"), (s * 7 % 100).cast("double").alias("extractable"), (k * 3 % 100).cast("double").alias("catalog"),
        (k % 4).alias("dup"), (k % 3 == 0).alias("compatible"), (k % 2 == 0).alias("reachable"), (k % 11 != 0).alias("allowed"),
    )
    return c.withColumn("risk", scores.duplicate_risk(F.col("dup")))


def _heuristic() -> F.Column:
    x = F.col
    return scores.heuristic_score(x("crawlable"), x("relevant"), x("extractable"), x("catalog"), x("risk"), x("compatible"), x("reachable"), scores.market_alignment(x("candidate") % 5 == 0, x("candidate") % 7 == 0), x("allowed"))


_SCORED = (
    f"SELECT *, {_HEUR} AS heuristic FROM (SELECT *, crawlable * 0.30 + relevant * 0.25 + extractable * 0.35 + catalog * 0.10 - risk * 0.35 + CASE WHEN compatible THEN 10 WHEN reachable THEN -25 ELSE 0 END"
    f" + CASE WHEN candidate % 5 = 0 THEN 8 ELSE -12 END + CASE WHEN candidate % 7 = 0 THEN 4 ELSE -6 END AS h FROM (SELECT *, CASE WHEN dup = 0 THEN 0.0 ELSE least(100.0, 60.0 + (dup - 1) * 20) END AS risk FROM ({_CAND})))"
)


@query("m18_candidate_scores", f"SELECT candidate, risk, round(heuristic, 1) AS heuristic FROM ({_SCORED})")
def m18(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("candidate", "risk", F.round(_heuristic(), 1).alias("heuristic"))


@query(
    "m20_recommendations",
    f"SELECT candidate, CASE WHEN NOT allowed THEN 'do_not_accept' WHEN compatible THEN CASE WHEN strong THEN 'recommended' ELSE 'manual_review' END WHEN reachable THEN 'do_not_accept' WHEN catalog < 25 AND relevant < 25 THEN 'do_not_accept' WHEN strong THEN 'recommended' ELSE 'manual_review' END AS recommendation"
    f" FROM (SELECT *, crawlable >= 55 AND relevant >= 35 AND extractable >= 55 AND catalog >= 45 AND risk < 50 AS strong FROM ({_SCORED}))",
)
def m20(spark: SparkSession, d: str) -> DataFrame:
    x, no = F.col, F.lit(False)
    c = _candidates(spark, d).withColumn("heuristic", _heuristic())
    said = scores.recommendation(x("crawlable"), x("relevant"), x("extractable"), x("catalog"), x("risk"), x("compatible"), x("reachable"), no, x("allowed"), x("heuristic"), no, no)
    return c.select("candidate", said.alias("recommendation"))


@query(
    "m23_automation_posture",
    "SELECT source_name, CASE WHEN s < 0.6 THEN 'quarantine' WHEN s < 0.75 OR t < -0.3 THEN 'manual_review' ELSE 'auto' END AS posture FROM (SELECT source_name, round(avg(success), 4) AS s, round(arg_max(success, day) - arg_min(success, day), 4) AS t FROM"
    " (SELECT * FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY day DESC) <= 4) GROUP BY source_name)",
    "v_snapshots",
)
def m23(spark: SparkSession, d: str) -> DataFrame:
    last = tables.newest(views.snapshots(spark, d), ["source_name"], 4, F.desc("day"))
    g = last.groupBy("source_name").agg(F.round(F.avg("success"), 4).alias("s"), F.round(F.max_by("success", "day") - F.min_by("success", "day"), 4).alias("t"))
    return g.select("source_name", F.when(F.col("s") < 0.6, "quarantine").when((F.col("s") < 0.75) | (F.col("t") < -0.3), "manual_review").otherwise("auto").alias("posture"))


@query(
    "m24_source_value_and_risk",
    "SELECT source_name, round(CAST(0.40 * s + 0.20 * s + 0.15 * 50 + 0.15 * x + 0.10 * 20 AS DECIMAL(28,10)), 1) AS value_score, round(CAST((100 - s) * 0.25 + 10 * 0.20 + 5 * 0.20 + 50 * 0.10 + (100 - x) * 0.15 + e * 0.10 AS DECIMAL(28,10)), 1) AS risk_score FROM"
    " (SELECT source_name, round(count(*) FILTER (status = 'completed') / count(*) * 100, 2) AS s, round(count(*) FILTER (outcome = 'products_extracted') / count(*) * 100, 2) AS x, round(count(*) FILTER (outcome = 'no_products') / count(*) * 100, 2) AS e FROM v_logs GROUP BY source_name)",
    "v_logs",
)
def m24(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    g = views.logs(spark, d).groupBy("source_name").agg(
        scores.percent(F.count_if(F.col("status") == "completed"), n).alias("s"), scores.percent(F.count_if(F.col("outcome") == "products_extracted"), n).alias("x"),
        scores.percent(F.count_if(F.col("outcome") == "no_products"), n).alias("e"),
    )
    s, x, e, c = F.col("s"), F.col("x"), F.col("e"), F.lit
    return g.select("source_name", scores.source_value(s, s, c(50), x, c(20)).alias("value_score"), scores.source_risk(s, c(10), c(5), c(50), x, e).alias("risk_score"))


@query(
    "m25_readiness",
    "SELECT source_id, CASE WHEN n = 0 THEN 'Unassigned' WHEN NOT enabled THEN 'Blocked' WHEN n >= 500 THEN 'Ready' ELSE 'Limited' END AS readiness FROM (SELECT source_id, enabled, count(l_suppkey) AS n FROM v_sources LEFT JOIN lineitem ON l_suppkey = source_id AND l_quantity > 10 GROUP BY ALL)",
    "v_sources",
)
def m25(spark: SparkSession, d: str) -> DataFrame:
    n = views.table(spark, d, "lineitem").filter("l_quantity > 10").groupBy(F.col("l_suppkey").alias("source_id")).agg(F.count("*").alias("n"))
    s = views.sources(spark, d).join(n, "source_id", "left").fillna(0, ["n"])
    return s.select("source_id", scores.readiness(F.col("n"), F.col("enabled"), F.col("n") >= 500).alias("readiness"))


@query(
    "m27_product_summary",
    "SELECT product_id, round(count(*) / 7, 2) AS completeness, CASE WHEN round(count(*) / 7, 4) >= 0.85 THEN 'complete' WHEN round(count(*) / 7, 4) >= 0.50 THEN 'partial' ELSE 'sparse' END AS label, CAST(sum(evidence) AS BIGINT) AS evidence, count(*) FILTER (has_conflict) AS conflicts FROM v_canonical GROUP BY product_id",
    "v_canonical",
)
def m27(spark: SparkSession, d: str) -> DataFrame:
    g = views.canonical(spark, d).groupBy("product_id").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence"), F.count_if("has_conflict").alias("conflicts"))
    share = F.round(F.col("n") / len(views.DEFINITIONS), 4)
    return g.select("product_id", F.round(share, 2).alias("completeness"), scores.completeness_label(share).alias("label"), "evidence", "conflicts")


@query(
    "m28_signal_scores",
    "SELECT brand, 10 * count(DISTINCT category) + 8 * 1 + 3 * count(DISTINCT model_number) + CASE WHEN brand LIKE '%1%' THEN 5 ELSE 0 END AS score FROM v_products GROUP BY brand",
    "v_products",
)
def m28(spark: SparkSession, d: str) -> DataFrame:
    g = views.products(spark, d).groupBy("brand").agg(F.countDistinct("category").alias("c"), F.countDistinct("model_number").alias("m"))
    return g.select("brand", scores.signal_score(F.col("c"), F.lit(1), F.col("m"), F.col("brand").contains("1")).cast("long").alias("score"))


_KEYS = ["brand", "model_number", "gtin", "tax", "quantity", "size"]


@query(
    "m04_completeness",
    "SELECT p.product_id, CASE WHEN category = 'promo' THEN least(1.0, (coalesce(n, 0) + 2 + CASE WHEN gtin IS NULL THEN 0 ELSE 1 END) / 8.0) ELSE (2 + CASE WHEN gtin IS NULL THEN 0 ELSE 1 END + coalesce(tax, 0) + coalesce(quantity, 0)) / 6.0 END AS completeness"
    " FROM v_products p LEFT JOIN (SELECT product_id, count(*) AS n, count(*) FILTER (attribute = 'tax') AS tax, count(*) FILTER (attribute = 'quantity') AS quantity FROM v_canonical WHERE product_id % 3 > 0 OR attribute <> 'tax' GROUP BY 1) c USING (product_id)",
    "v_products v_canonical",
)
def m04(spark: SparkSession, d: str) -> DataFrame:
    """A category (promo) has no keys; every third product has no tax."""
    values = views.canonical(spark, d).filter("product_id % 3 > 0 or attribute <> 'tax'").groupBy("product_id").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "value"))).alias("values"))
    rows = views.products(spark, d).join(values, "product_id", "left")
    keys = F.when(F.col("category") != "promo", F.array(*map(F.lit, _KEYS)))
    held = F.coalesce("values", F.create_map().cast("map<string,string>"))
    return rows.select("product_id", scores.completeness(held, keys, F.col("brand"), F.col("model_number"), F.col("gtin")).alias("completeness"))


@query(
    "m07_existing_weight",
    "SELECT product_id, attribute, least(1.0, greatest(0.05, CASE WHEN product_id % 4 = 0 THEN 0.4 ELSE round(CAST(CASE WHEN product_id % 3 = 0 THEN 0.72 ELSE 0.8 END * (confidence_pct / 100.0) * CASE WHEN product_id % 5 = 0 THEN confidence_pct / 100.0 ELSE 0.6 END * 0.90"
    " * CASE WHEN age <= 1 THEN 1.0 WHEN age <= 7 THEN 0.96 WHEN age <= 30 THEN 0.88 WHEN age <= 90 THEN 0.76 ELSE 0.65 END AS DECIMAL(28,10)), 4) END)) AS weight FROM (SELECT *, date_diff('day', last_observed, TIMESTAMP '2001-11-10') AS age FROM v_canonical)",
    "v_canonical",
)
def m07(spark: SparkSession, d: str) -> DataFrame:
    """Parts that a value lacks are null or zero here and there."""
    n, zero = F.col("product_id"), F.lit(0.0)
    own = F.col("confidence_pct") / 100
    recency = scores.recency_factor(F.col("last_observed"), F.lit("2001-11-10").cast("timestamp"))
    w = scores.existing_weight(F.when(n % 4 == 0, 0.4).otherwise(zero), F.when(n % 3 != 0, 0.8), zero, F.when(n % 5 != 0, 0.6), F.lit(None).cast("double"), own, recency)
    return views.canonical(spark, d).select("product_id", "attribute", w.alias("weight"))


@query(
    "f23_suggestion_confidence",
    "SELECT user_id, CASE WHEN score >= 0.60 THEN least(0.99, round(CAST(score + least(0.15, days / 30 * 0.15) + least(0.10, n / 20 * 0.10) AS DECIMAL(28,10)), 2)) END AS confidence FROM"
    " (SELECT user_id, count(*) AS n, 0.5 + (user_id % 5) / 10 AS score, greatest(1.0, date_diff('microsecond', min(ts), max(ts)) / 86400000000 + 1) AS days FROM events GROUP BY user_id)",
)
def f23(spark: SparkSession, d: str) -> DataFrame:
    seen = views.table(spark, d, "events").groupBy("user_id").agg(F.min(F.col("ts").cast("timestamp")).alias("a"), F.max(F.col("ts").cast("timestamp")).alias("b"), F.count("*").alias("n"))
    return seen.select("user_id", scores.suggestion_confidence(0.5 + F.col("user_id") % 5 / 10, F.col("a"), F.col("b"), F.col("n")).alias("confidence"))
