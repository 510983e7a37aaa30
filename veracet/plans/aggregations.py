"""Queries over the aggregation and window operators (G, W) on the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracet.functions import scores
from veracet.operators import discovery, quality
from veracet.plans.catalog import query
from veracet.plans.relational import AS_OF
from veracet.sources import tables, views

_PCT = "CASE WHEN ({d}) > 0 THEN round(({n}) / ({d}) * 100, 2) ELSE 0 END"


def pct(n: str, d: str) -> str:
    return _PCT.format(n=n, d=d)


@query(
    "g01_conditional_counts",
    "SELECT count(*) AS logs, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (changed) AS changed, count(*) FILTER (outcome = 'no_products') AS empty FROM v_logs",
    "v_logs",
)
def g01(spark: SparkSession, d: str) -> DataFrame:
    return views.logs(spark, d).agg(
        F.count("*").alias("logs"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if("changed").alias("changed"), F.count_if(F.col("outcome") == "no_products").alias("empty")
    )


@query(
    "g02_average_with_default",
    "SELECT p.category, coalesce(round(avg(n), 2), 0) AS avg_attributes FROM v_products p LEFT JOIN (SELECT product_id, count(*) AS n FROM v_canonical WHERE evidence > 30 GROUP BY 1) USING (product_id) GROUP BY p.category",
    "v_products v_canonical",
)
def g02(spark: SparkSession, d: str) -> DataFrame:
    n = views.canonical(spark, d).filter("evidence > 30").groupBy("product_id").agg(F.count("*").alias("n"))
    return views.products(spark, d).join(n, "product_id", "left").groupBy("category").agg(F.coalesce(F.round(F.avg("n"), 2), F.lit(0.0)).alias("avg_attributes"))


@query("g03_positive_sums", "SELECT source_name, CAST(sum(greatest(extracted, 0)) AS BIGINT) AS extracted, CAST(sum(greatest(duration_ms - 500, 0)) AS BIGINT) AS slow_ms FROM v_logs GROUP BY source_name", "v_logs")
def g03(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    return views.logs(spark, d).groupBy("source_name").agg(F.sum(F.greatest("extracted", zero)).alias("extracted"), F.sum(F.greatest(F.col("duration_ms") - 500, zero)).alias("slow_ms"))


@query(
    "g04_spread",
    "SELECT product_id, min(CAST(value AS BIGINT)) AS low, max(CAST(value AS BIGINT)) AS high, max(observed) AS latest FROM v_evidence WHERE attribute = 'unit_price' GROUP BY product_id",
    "v_evidence",
)
def g04(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value").cast("bigint")
    return views.evidence(spark, d).filter("attribute = 'unit_price'").groupBy("product_id").agg(F.min(v).alias("low"), F.max(v).alias("high"), F.max("observed").alias("latest"))


@query("g05_distinct_counts", "SELECT category, count(DISTINCT lower(brand)) AS brands, count(DISTINCT model_number) AS models, count(DISTINCT gtin) AS gtins FROM v_products GROUP BY category", "v_products")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return views.products(spark, d).groupBy("category").agg(F.countDistinct(F.lower("brand")).alias("brands"), F.countDistinct("model_number").alias("models"), F.countDistinct("gtin").alias("gtins"))


@query(
    "g06_percentages",
    f"SELECT source_name, {pct('count(*) FILTER (status = ' + chr(39) + 'failed' + chr(39) + ')', 'count(*)')} AS failure_percent, {pct('count(*) FILTER (changed)', 'count(*) FILTER (extracted > 5)')} AS none FROM v_logs GROUP BY source_name",
    "v_logs",
)
def g06(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return views.logs(spark, d).groupBy("source_name").agg(
        scores.percent(F.count_if(F.col("status") == "failed"), n).alias("failure_percent"), scores.percent(F.count_if("changed"), F.count_if(F.col("extracted") > 5)).alias("none")
    )


@query("g08_composite_group", "SELECT source_name, url, status, count(*) AS n, CAST(max(duration_ms) AS BIGINT) AS slowest FROM v_logs GROUP BY ALL", "v_logs")
def g08(spark: SparkSession, d: str) -> DataFrame:
    return views.logs(spark, d).groupBy("source_name", "url", "status").agg(F.count("*").alias("n"), F.max("duration_ms").alias("slowest"))


_COVER = (
    "cov AS (SELECT s.category, f.attribute, f.required, coalesce(c.present, 0) AS present, s.products - coalesce(c.present, 0) AS missing, coalesce(c.conflicts, 0) AS conflicts, coalesce(c.avg_confidence, 0) AS avg_confidence,"
    " round(coalesce(c.present, 0) / s.products * 100, 2) AS coverage_percent, CASE WHEN c.present > 0 THEN round(c.conflicts / c.present * 100, 2) ELSE 0 END AS conflict_percent,"
    " CASE WHEN c.present > 0 THEN round((c.present - c.conflicts) / c.present * 100, 2) ELSE 0 END AS agreement_percent FROM (SELECT category, count(*) AS products FROM v_products GROUP BY 1) s CROSS JOIN v_definitions f"
    " LEFT JOIN (SELECT category, attribute, count(*) AS present, count(*) FILTER (has_conflict) AS conflicts, round(avg(confidence_pct), 2) AS avg_confidence FROM v_canonical GROUP BY ALL) c ON c.category = s.category AND c.attribute = f.attribute)"
)


def _cover_sql(rest: str) -> str:
    from veracet.sources.views import with_views

    return with_views(["v_products", "v_canonical", "v_definitions"], "") + f", {_COVER} {rest}"


@query("g09_attribute_coverage", _cover_sql("SELECT *, round(avg_confidence * agreement_percent / 100, 2) AS reliability FROM cov"))
def g09(spark: SparkSession, d: str) -> DataFrame:
    return quality.coverage(views.products(spark, d), views.canonical(spark, d), views.definitions(spark))


@query(
    "g10_top_missing",
    _cover_sql("SELECT category, attribute, missing, rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY missing DESC, attribute) AS rank FROM cov) WHERE rank <= 5"),
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    c = quality.coverage(views.products(spark, d), views.canonical(spark, d), views.definitions(spark))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("missing"), "attribute"))
    return c.withColumn("rank", rank).filter("rank <= 5").select("category", "attribute", "missing", "rank")


@query(
    "g11_source_quality_scores",
    "SELECT *, round(coverage_percent * 0.50 + avg_confidence * 0.25 + agreement_percent * 0.25, 2) AS quality_score FROM (SELECT source_id, products, round(mapped / products, 2) AS avg_mapped, round(mapped / (products * 7) * 100, 2) AS coverage_percent,"
    " avg_confidence, round(agreed / mapped * 100, 2) AS agreement_percent FROM (SELECT e.source_id, count(DISTINCT e.product_id) AS products, count(*) AS mapped, round(avg(e.confidence_pct), 2) AS avg_confidence,"
    " count(*) FILTER (e.value = c.value) AS agreed FROM v_evidence e JOIN v_canonical c USING (product_id, attribute) GROUP BY e.source_id))",
    "v_evidence v_canonical",
)
def g11(spark: SparkSession, d: str) -> DataFrame:
    return quality.source_quality(views.evidence(spark, d), views.canonical(spark, d), len(views.DEFINITIONS))


@query(
    "g12_global_stats",
    f"SELECT (SELECT count(*) FROM v_products) AS products, (SELECT count(*) FROM v_sources) AS sources, (SELECT count(*) FROM v_canonical WHERE has_conflict) AS conflicts,"
    f" (SELECT count(*) FROM v_products WHERE gtin IS NULL) AS missing_gtin, (SELECT count(*) FROM v_logs WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS crawls_24h, (SELECT count(*) FROM v_queue WHERE status = 'queued') AS queued",
    "v_products v_sources v_canonical v_logs v_queue",
)
def g12(spark: SparkSession, d: str) -> DataFrame:
    since = F.lit(AS_OF).cast("timestamp") - F.expr("interval 24 hours")
    sides = [
        views.products(spark, d).agg(F.count("*").alias("products"), F.count_if(F.col("gtin").isNull()).alias("missing_gtin")),
        views.sources(spark, d).agg(F.count("*").alias("sources")),
        views.canonical(spark, d).agg(F.count_if("has_conflict").alias("conflicts")),
        views.logs(spark, d).agg(F.count_if(F.col("ts") >= since).alias("crawls_24h")),
        views.queue(spark, d).agg(F.count_if(F.col("status") == "queued").alias("queued")),
    ]
    out = sides[0]
    for s in sides[1:]:  # one row each
        out = out.crossJoin(s)
    return out


@query(
    "g13_source_operations",
    f"SELECT source_name, crawls, failed, {pct('failed', 'crawls')} AS failure_rate, last_success, last_failure, CASE WHEN success_p >= 80 AND extract_p >= 60 AND empty_p <= 35 AND success_p >= 90 THEN 'Healthy'"
    " WHEN success_p >= 75 AND extract_p >= 35 AND empty_p <= 65 THEN 'Watch' ELSE 'Attention' END AS health FROM (SELECT *, round((crawls - failed) / crawls * 100, 2) AS success_p, round(extracted / crawls * 100, 2) AS extract_p, round(empty / crawls * 100, 2) AS empty_p"
    " FROM (SELECT source_name, count(*) AS crawls, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (outcome = 'products_extracted') AS extracted, count(*) FILTER (outcome = 'no_products') AS empty,"
    " max(ts) FILTER (status = 'completed') AS last_success, max(ts) FILTER (status = 'failed') AS last_failure FROM v_logs GROUP BY source_name))",
    "v_logs",
)
def g13(spark: SparkSession, d: str) -> DataFrame:
    ok, bad = F.col("status") == "completed", F.col("status") == "failed"
    g = views.logs(spark, d).groupBy("source_name").agg(
        F.count("*").alias("crawls"), F.count_if(bad).alias("failed"), F.count_if(F.col("outcome") == "products_extracted").alias("_x"), F.count_if(F.col("outcome") == "no_products").alias("_e"),
        F.max(F.when(ok, F.col("ts"))).alias("last_success"), F.max(F.when(bad, F.col("ts"))).alias("last_failure"),
    )
    n = F.col("crawls")
    success, extract, empty = scores.percent(n - F.col("failed"), n), scores.percent(F.col("_x"), n), scores.percent(F.col("_e"), n)
    return g.select("source_name", "crawls", "failed", scores.percent(F.col("failed"), n).alias("failure_rate"), "last_success", "last_failure", scores.health(success, success, extract, empty).alias("health"))


@query(
    "g14_category_operations",
    "SELECT category, coalesce(products, 0) AS products, coalesce(queued, 0) AS queued, coalesce(failed_items, 0) AS failed_items FROM (SELECT category FROM v_products UNION SELECT category FROM v_queue) LEFT JOIN"
    " (SELECT category, count(*) AS products FROM v_products GROUP BY 1) USING (category) LEFT JOIN (SELECT category, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (last_error IS NOT NULL) AS failed_items FROM v_queue GROUP BY 1) USING (category)",
    "v_products v_queue",
)
def g14(spark: SparkSession, d: str) -> DataFrame:
    a = views.products(spark, d).groupBy("category").agg(F.count("*").alias("products"))
    b = views.queue(spark, d).groupBy("category").agg(F.count_if(F.col("status") == "queued").alias("queued"), F.count_if(F.col("last_error").isNotNull()).alias("failed_items"))
    return a.join(b, "category", "full").fillna(0)


@query(
    "g15_job_metrics",
    "SELECT source_name, category, count(*) AS targets, count(*) FILTER (status = 'completed') AS done, CAST(sum(attempts) AS BIGINT) AS attempts FROM v_queue WHERE source_name < 'Customer#000000050' GROUP BY GROUPING SETS ((source_name, category), (source_name))",
    "v_queue",
)
def g15(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d).filter("source_name < 'Customer#000000050'")
    sets = q.groupingSets([[F.col("source_name"), F.col("category")], [F.col("source_name")]], F.col("source_name"), F.col("category"))
    return sets.agg(F.count("*").alias("targets"), F.count_if(F.col("status") == "completed").alias("done"), F.sum("attempts").alias("attempts"))


@query("g16_job_breakdown", "SELECT category, status, count(*) AS targets FROM v_queue GROUP BY ALL", "v_queue")
def g16(spark: SparkSession, d: str) -> DataFrame:
    return views.queue(spark, d).groupBy("category", "status").agg(F.count("*").alias("targets"))


@query(
    "g17_trust_snapshot",
    "SELECT source_name, greatest(0, least(1, round(0.20 * 0.5 + 0.15 * (1 - 0) + 0.20 * 0.5 + 0.10 * breadth + 0.05 * 0 + 0.15 * success + 0.15 * extractable + 0.05 * (1 - no_product) + 0.05 * yielded + 0.05 * (1 - 0) + 0.05 * 1 - 0, 4))) AS trust"
    " FROM (SELECT source_name, round(0.40 * least(1.0, count(*) FILTER (url = '/view') / 10) + 0.60 * least(1.0, count(*) FILTER (url = '/purchase') / 20), 4) AS breadth, round(count(*) FILTER (status = 'completed') / count(*), 4) AS success,"
    " round(count(*) FILTER (outcome = 'products_extracted') / count(*), 4) AS extractable, round(count(*) FILTER (outcome = 'no_products') / count(*), 4) AS no_product, round(least(1.0, sum(extracted) / count(*)), 4) AS yielded FROM v_logs GROUP BY source_name)",
    "v_logs",
)
def g17(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    rate = lambda c: F.round(F.count_if(c) / n, 4)
    g = views.logs(spark, d).groupBy("source_name").agg(
        scores.breadth(F.count_if(F.col("url") == "/view"), F.count_if(F.col("url") == "/purchase")).alias("breadth"), rate(F.col("status") == "completed").alias("success"),
        rate(F.col("outcome") == "products_extracted").alias("extractable"), rate(F.col("outcome") == "no_products").alias("no_product"), F.round(F.least(F.lit(1.0), F.sum("extracted") / n), 4).alias("yielded"),
    )
    x = F.lit
    score = scores.trust(x(0.5), x(0), x(0.5), F.col("breadth"), x(0), F.col("success"), F.col("extractable"), F.col("no_product"), F.col("yielded"), x(0), x(1), x(0))
    return g.select("source_name", score.alias("trust"))


@query(
    "g18_attribute_stability",
    "SELECT attribute, changes, oscillations, values, oscillations >= 2 AS suspicious, CASE WHEN oscillations >= 2 THEN least(0.40, s) ELSE s END AS stability FROM (SELECT *, greatest(0.05, round(1 - least(1.0, changes / 20 * 0.55 + oscillations / 6 * 0.30 + values / 8 * 0.15), 4)) AS s"
    " FROM (SELECT attribute, count(*) AS changes, count(*) FILTER (value = two AND value <> one) AS oscillations, count(DISTINCT value) AS values FROM (SELECT *, lag(value) OVER w AS one, lag(value, 2) OVER w AS two FROM v_changes WINDOW w AS (PARTITION BY entity, attribute ORDER BY ts, event_id)) GROUP BY attribute))",
    "v_changes",
)
def g18(spark: SparkSession, d: str) -> DataFrame:
    return quality.stability(views.changes(spark, d))


_DIS = (
    "SELECT e.source_id, e.category, e.attribute, count(*) AS comparisons, count(*) FILTER (e.value <> c.value) AS disagreed, count(*) FILTER (e.source_id = c.winner) AS won, round(count(*) FILTER (e.value <> c.value) / count(*), 4) AS disagreement_rate,"
    " round(count(*) FILTER (e.source_id = c.winner) / count(*), 4) AS win_rate FROM v_evidence e JOIN v_canonical c ON e.product_id = c.product_id AND e.attribute = c.attribute AND c.evidence > 1 GROUP BY ALL"
)


@query("g19_disagreements", _DIS, "v_evidence v_canonical")
def g19(spark: SparkSession, d: str) -> DataFrame:
    return quality.disagreements(views.evidence(spark, d), views.canonical(spark, d))


@query(
    "g20_disagreement_matrix",
    f"SELECT source_id, round(sum(disagreed) FILTER (attribute = 'tax') / sum(comparisons) FILTER (attribute = 'tax'), 4) AS tax, round(sum(disagreed) FILTER (attribute = 'returnflag') / sum(comparisons) FILTER (attribute = 'returnflag'), 4) AS returnflag FROM ({_DIS})"
    f" WHERE source_id IN (SELECT source_id FROM ({_DIS}) GROUP BY 1 ORDER BY sum(comparisons) DESC, source_id LIMIT 6) GROUP BY source_id",
    "v_evidence v_canonical",
)
def g20(spark: SparkSession, d: str) -> DataFrame:
    c = quality.disagreements(views.evidence(spark, d), views.canonical(spark, d))
    return quality.disagreement_matrix(c, 6, ["tax", "returnflag"])


@query(
    "g21_unmapped_rollup",
    "SELECT category, raw, occurrences, first_seen, last_seen, (SELECT string_agg(source, ',' ORDER BY f, source) FROM (SELECT 's' || l_suppkey AS source, min(l_shipdate) AS f FROM v_lines x WHERE x.category = g.category GROUP BY 1 ORDER BY 2, 1 LIMIT 5)) AS sources,"
    " (SELECT string_agg(value, ',' ORDER BY f, value) FROM (SELECT lower(l_linestatus) AS value, min(l_shipdate) AS f FROM v_lines x WHERE x.category = g.category GROUP BY 1 ORDER BY 2, 1 LIMIT 5)) AS values FROM"
    " (SELECT category, 'line status' AS raw, count(*) AS occurrences, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM v_lines GROUP BY category) g",
    "v_lines",
)
def g21(spark: SparkSession, d: str) -> DataFrame:
    c = views.claims(spark, d).filter("attribute = 'linestatus'")
    seen = c.select("category", F.lit("line status").alias("raw"), F.concat(F.lit("s"), F.col("source_id").cast("string")).alias("source"), "value", F.col("observed").alias("ts"))
    out = quality.unmapped_rollup(seen)
    return out.withColumns({"sources": F.array_join("sources", ","), "values": F.array_join("values", ",")})


@query(
    "g22_collapsed_candidates",
    "SELECT host AS key, count(*) AS candidates, max(score) AS score, string_agg(DISTINCT market, ',' ORDER BY market) AS markets FROM (SELECT lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host,"
    " regexp_extract(url, '^[^:]+://[^/]+/([a-z]{2})/', 1) AS market, CAST(page_id % 17 AS DOUBLE) AS score FROM pages) GROUP BY host",
)
def g22(spark: SparkSession, d: str) -> DataFrame:
    from veracet.functions import urls

    p = views.table(spark, d, "pages")
    c = p.select(
        urls.host("url").alias("key"), F.col("page_id").cast("string").alias("name"), "url", F.regexp_extract("url", "^[^:]+://[^/]+/([a-z]{2})/", 1).alias("market"),
        F.array(F.lit("page")).alias("reasons"), (F.col("page_id") % 17).cast("double").alias("score"),
    )
    return discovery.collapsed(c).select("key", "candidates", "score", F.array_join("markets", ",").alias("markets"))


@query(
    "g24_run_summary",
    f"SELECT status, count(*) AS items, round(avg(attempts), 2) AS avg_attempts, {pct('count(*) FILTER (last_error IS NOT NULL)', 'count(*)')} AS error_percent FROM v_queue GROUP BY status",
    "v_queue",
)
def g24(spark: SparkSession, d: str) -> DataFrame:
    return views.queue(spark, d).groupBy("status").agg(
        F.count("*").alias("items"), F.round(F.avg("attempts"), 2).alias("avg_attempts"), scores.percent(F.count_if(F.col("last_error").isNotNull()), F.count("*")).alias("error_percent")
    )


@query(
    "g25_blocker_histogram",
    "SELECT code, count(*) AS items FROM (SELECT unnest(list_filter([CASE WHEN attempts >= 3 THEN 'too_many_attempts' END, CASE WHEN last_error IS NOT NULL THEN 'error' END, CASE WHEN importance < 0.5 THEN 'unimportant' END], lambda x: x IS NOT NULL)) AS code FROM v_queue) GROUP BY code ORDER BY items DESC, code LIMIT 8",
    "v_queue",
)
def g25(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array_compact(F.array(F.when(F.col("attempts") >= 3, "too_many_attempts"), F.when(F.col("last_error").isNotNull(), "error"), F.when(F.col("importance") < 0.5, "unimportant")))
    return views.queue(spark, d).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("items")).orderBy(F.desc("items"), "code").limit(8)


@query(
    "g26_rates",
    "SELECT category, round(count(*) FILTER (status = 'completed') / count(*), 4) AS acceptance, round(count(*) FILTER (status = 'processing') / count(*), 4) AS review, min(enqueued) FILTER (status = 'completed') AS first_done FROM v_queue GROUP BY category",
    "v_queue",
)
def g26(spark: SparkSession, d: str) -> DataFrame:
    n, s = F.count("*"), F.col("status")
    return views.queue(spark, d).groupBy("category").agg(
        F.round(F.count_if(s == "completed") / n, 4).alias("acceptance"), F.round(F.count_if(s == "processing") / n, 4).alias("review"), F.min(F.when(s == "completed", F.col("enqueued"))).alias("first_done")
    )


@query(
    "g27_campaign_memory",
    "SELECT category, count(*) AS runs, CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (done > 0) AS runs_with_done, count(*) FILTER (done = 0) AS runs_without FROM (SELECT category, source_name, count(*) AS items, count(*) FILTER (status = 'completed') AS done FROM v_queue GROUP BY ALL) GROUP BY category",
    "v_queue",
)
def g27(spark: SparkSession, d: str) -> DataFrame:
    runs = views.queue(spark, d).groupBy("category", "source_name").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "completed").alias("done"))
    return runs.groupBy("category").agg(F.count("*").alias("runs"), F.sum("items").alias("items"), F.count_if(F.col("done") > 0).alias("runs_with_done"), F.count_if(F.col("done") == 0).alias("runs_without"))


@query(
    "g30_classification_report",
    "SELECT classifier, fp, fn, round((tp + tn) / (tp + tn + fp + fn) * 100, 2) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp) * 100, 2) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn) * 100, 2) ELSE 0 END AS recall FROM"
    " (SELECT classifier, count(*) FILTER (said AND good) AS tp, count(*) FILTER (said AND NOT good) AS fp, count(*) FILTER (NOT said AND good) AS fn, count(*) FILTER (NOT said AND NOT good) AS tn FROM"
    " (SELECT quality = 1 AS good, 'long' AS classifier, n_chars >= 1000 AS said FROM documents JOIN labels USING (doc_id) UNION ALL SELECT quality = 1, 'lines', contains(text, chr(10)) FROM documents JOIN labels USING (doc_id)) GROUP BY classifier)",
)
def g30(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id")
    return quality.classification_report(rows, F.col("quality") == 1, {"long": F.col("n_chars") >= 1000, "lines": F.col("text").contains("\n")})


@query(
    "g31_investigation_summary",
    "SELECT entity, count(*) AS events, count(DISTINCT attribute) AS attributes, count(DISTINCT value) AS values, max(ts) AS latest, CASE WHEN count(*) >= 100 THEN 'Drifting' WHEN count(*) >= 40 THEN 'Watch' ELSE 'Stable' END AS badge FROM v_changes GROUP BY entity",
    "v_changes",
)
def g31(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    return views.changes(spark, d).groupBy("entity").agg(
        n.alias("events"), F.countDistinct("attribute").alias("attributes"), F.countDistinct("value").alias("values"), F.max("ts").alias("latest"),
        scores.ladder(n, [(100, "Drifting"), (40, "Watch")], "Stable").alias("badge"),
    )


@query(
    "g32_attribute_history",
    "SELECT entity, attribute, count(*) AS events, string_agg(value, '>' ORDER BY ts, event_id) AS history FROM v_changes GROUP BY ALL",
    "v_changes",
)
def g32(spark: SparkSession, d: str) -> DataFrame:
    g = views.changes(spark, d).groupBy("entity", "attribute").agg(F.count("*").alias("events"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("h"))
    return g.select("entity", "attribute", "events", F.array_join(F.transform("h", lambda x: x["value"]), ">").alias("history"))


@query(
    "g33_conflict_groups",
    "SELECT product_id, attribute, value, count(*) AS claims, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY source_id) AS sources, bool_or(canonical = value) AS is_canonical FROM"
    " (SELECT e.*, c.value AS canonical FROM v_evidence e JOIN v_canonical c USING (product_id, attribute) WHERE c.has_conflict) GROUP BY ALL",
    "v_evidence v_canonical",
)
def g33(spark: SparkSession, d: str) -> DataFrame:
    c = views.canonical(spark, d).filter("has_conflict").select("product_id", "attribute", F.col("value").alias("_c"))
    both = views.evidence(spark, d).join(c, ["product_id", "attribute"])
    sources = F.array_join(F.transform(F.array_sort(F.collect_list("source_id")), lambda x: x.cast("string")), ",")
    return both.groupBy("product_id", "attribute", "value").agg(F.count("*").alias("claims"), sources.alias("sources"), F.bool_or(F.col("value") == F.col("_c")).alias("is_canonical"))


@query("g35_category_families", "SELECT n_regionkey AS family, string_agg(n_name, ',' ORDER BY n_name) AS members, count(*) AS n FROM nation GROUP BY 1")
def g35(spark: SparkSession, d: str) -> DataFrame:
    g = views.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("family"))
    return g.agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members"), F.count("*").alias("n"))


@query("w02_newest_three", "SELECT source_name, log_id, rank FROM (SELECT source_name, log_id, row_number() OVER (PARTITION BY source_name ORDER BY ts DESC, log_id) AS rank FROM v_logs) WHERE rank <= 3", "v_logs")
def w02(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source_name").orderBy(F.desc("ts"), "log_id"))
    return views.logs(spark, d).withColumn("rank", rank).filter("rank <= 3").select("source_name", "log_id", "rank")


@query(
    "w03_decayed_trust",
    "SELECT source_name, round(sum(success * (n - rn + 1)) / sum(n - rn + 1), 4) AS trust, count(*) AS snapshots FROM (SELECT *, max(rn) OVER (PARTITION BY source_name) AS n FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY day DESC) AS rn FROM v_snapshots) WHERE rn <= 12) GROUP BY source_name",
    "v_snapshots",
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    return quality.decayed_trust(views.snapshots(spark, d), "success")


@query(
    "w04_oscillations",
    "SELECT entity, attribute, event_id FROM (SELECT *, lag(value) OVER w AS one, lag(value, 2) OVER w AS two FROM v_changes WINDOW w AS (PARTITION BY entity, attribute ORDER BY ts, event_id)) WHERE value = two AND value <> one",
    "v_changes",
)
def w04(spark: SparkSession, d: str) -> DataFrame:
    return quality.oscillations(views.changes(spark, d)).filter("returns").select("entity", "attribute", "event_id")


@query(
    "w05_trend",
    "SELECT source_name, round(arg_max(success, day) - arg_min(success, day), 4) AS trend FROM (SELECT * FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY day DESC) <= 5) GROUP BY source_name",
    "v_snapshots",
)
def w05(spark: SparkSession, d: str) -> DataFrame:
    last = tables.newest(views.snapshots(spark, d), ["source_name"], 5, F.desc("day"))
    return last.groupBy("source_name").agg(F.round(F.max_by("success", "day") - F.min_by("success", "day"), 4).alias("trend"))


@query(
    "w06_first_and_last",
    "SELECT source_name, min(day) AS first_day, max(day) AS last_day, arg_min(crawls, day) AS first_crawls, arg_max(crawls, day) AS last_crawls FROM v_snapshots GROUP BY source_name",
    "v_snapshots",
)
def w06(spark: SparkSession, d: str) -> DataFrame:
    return views.snapshots(spark, d).groupBy("source_name").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.min_by("crawls", "day").alias("first_crawls"), F.max_by("crawls", "day").alias("last_crawls")
    )


@query("w08_conversation_roles", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def w08(spark: SparkSession, d: str) -> DataFrame:
    g = views.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("h"), F.count("*").alias("turns"))
    return g.select("conv_id", F.array_join(F.transform("h", lambda x: x["role"]), ">").alias("roles"), "turns")


@query("w10_position_ids", "SELECT event_id, 'change:' || user_id || ':' || row_number() OVER (PARTITION BY user_id ORDER BY ts) AS change_id FROM events")
def w10(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts"))
    return views.table(spark, d, "events").select("event_id", F.concat_ws(":", F.lit("change"), F.col("user_id").cast("string"), n.cast("string")).alias("change_id"))
