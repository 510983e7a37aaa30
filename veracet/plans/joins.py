"""Queries over the join operators (J) on the adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracet.functions import urls
from veracet.operators import discovery, identity
from veracet.plans.catalog import query
from veracet.sources import tables, views


@query(
    "j01_links_with_fallback",
    "SELECT product_id, source_id, coalesce(max(seq) FILTER (attribute = 'quantity' AND product_id % 2 = 0), max(seq) FILTER (attribute = 'unit_price')) AS seq, max(seq) FILTER (attribute = 'quantity' AND product_id % 2 = 0) IS NULL AS by_fallback"
    " FROM v_evidence GROUP BY product_id, source_id HAVING count(*) FILTER (attribute = 'tax') > 0",
    "v_evidence",
)
def j01(spark: SparkSession, d: str) -> DataFrame:
    e = views.evidence(spark, d)
    key = ["product_id", "source_id"]
    a = e.filter("attribute = 'quantity' and product_id % 2 = 0").select(*key, F.col("seq").alias("_a"))
    b = e.filter("attribute = 'unit_price'").select(*key, F.col("seq").alias("_b"))
    out = e.filter("attribute = 'tax'").select(*key).join(a, key, "left").join(b, key, "left")
    return out.select(*key, F.coalesce("_a", "_b").alias("seq"), F.col("_a").isNull().alias("by_fallback"))


@query(
    "j02_claim_agreement",
    "SELECT e.source_id, e.attribute, count(*) AS claims, count(*) FILTER (e.value = c.value) AS agreed FROM v_evidence e JOIN v_canonical c USING (product_id, attribute) GROUP BY ALL",
    "v_evidence v_canonical",
)
def j02(spark: SparkSession, d: str) -> DataFrame:
    w = views.canonical(spark, d).select("product_id", "attribute", F.col("value").alias("winning"))
    both = views.evidence(spark, d).join(w, ["product_id", "attribute"])
    return both.groupBy("source_id", "attribute").agg(F.count("*").alias("claims"), F.count_if(F.col("value") == F.col("winning")).alias("agreed"))


@query("j03_semi", "SELECT product_id, attribute FROM v_canonical WHERE has_conflict AND product_id IN (SELECT product_id FROM v_products WHERE category = 'promo')", "v_canonical v_products")
def j03(spark: SparkSession, d: str) -> DataFrame:
    ids = views.products(spark, d).filter("category = 'promo'").select("product_id")
    return views.canonical(spark, d).filter("has_conflict").join(ids, "product_id", "left_semi").select("product_id", "attribute")


@query(
    "j04_latest_snapshot",
    "SELECT u.source_name, s.day, s.success FROM (SELECT DISTINCT source_name FROM v_logs UNION SELECT 'nobody') u LEFT JOIN (SELECT * FROM v_snapshots QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY day DESC) = 1) s USING (source_name)",
    "v_logs v_snapshots",
)
def j04(spark: SparkSession, d: str) -> DataFrame:
    names = views.logs(spark, d).select("source_name").distinct().union(spark.createDataFrame([("nobody",)], "source_name string"))
    newest = tables.latest(views.snapshots(spark, d), ["source_name"], F.desc("day")).select("source_name", "day", "success")
    return names.join(newest, "source_name", "left")


@query(
    "j05_last_ten",
    "SELECT source_name, url, count(*) AS recent, count(*) FILTER (status = 'failed') AS failed, CAST(sum(duration_ms) AS BIGINT) AS ms FROM"
    " (SELECT * FROM v_logs QUALIFY row_number() OVER (PARTITION BY source_name, url ORDER BY ts DESC, log_id) <= 10) GROUP BY ALL",
    "v_logs",
)
def j05(spark: SparkSession, d: str) -> DataFrame:
    last = tables.newest(views.logs(spark, d), ["source_name", "url"], 10, F.desc("ts"), F.asc("log_id"))
    return last.groupBy("source_name", "url").agg(F.count("*").alias("recent"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("duration_ms").alias("ms"))


@query(
    "j06_two_step",
    "SELECT product_id, CASE WHEN claims IS NULL THEN 'unknown' WHEN wins IS NULL THEN 'claimed' ELSE 'canonical' END AS state FROM v_products LEFT JOIN (SELECT product_id, count(*) AS claims FROM v_evidence GROUP BY 1) USING (product_id)"
    " LEFT JOIN (SELECT product_id, count(*) AS wins FROM v_canonical WHERE winner % 2 = 0 GROUP BY 1) USING (product_id)",
    "v_products v_evidence v_canonical",
)
def j06(spark: SparkSession, d: str) -> DataFrame:
    claimed = views.evidence(spark, d).groupBy("product_id").agg(F.count("*").alias("claims"))
    won = views.canonical(spark, d).filter("winner % 2 = 0").groupBy("product_id").agg(F.count("*").alias("wins"))
    out = views.products(spark, d).join(claimed, "product_id", "left").join(won, "product_id", "left")
    return out.select("product_id", F.when(F.col("claims").isNull(), "unknown").when(F.col("wins").isNull(), "claimed").otherwise("canonical").alias("state"))


@query(
    "j07_logs_after_target",
    "SELECT t.log_id AS target, count(l.log_id) AS later, min(l.ts) AS first_later FROM (SELECT * FROM v_logs WHERE url = '/signup') t LEFT JOIN v_logs l ON l.source_name = t.source_name AND l.url = '/purchase' AND l.ts >= t.ts GROUP BY t.log_id",
    "v_logs",
)
def j07(spark: SparkSession, d: str) -> DataFrame:
    logs = views.logs(spark, d)
    t = logs.filter("url = '/signup'").select(F.col("log_id").alias("target"), "source_name", F.col("ts").alias("since"))
    after = logs.filter("url = '/purchase'").select("source_name", "log_id", "ts")
    out = t.join(after, (t["source_name"] == after["source_name"]) & (after["ts"] >= t["since"]), "left")
    return out.groupBy("target").agg(F.count("log_id").alias("later"), F.min("ts").alias("first_later"))


@query(
    "j08_claims_after_target",
    "SELECT o_orderkey AS item_id, count(l_orderkey) AS shipped FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate GROUP BY o_orderkey",
)
def j08(spark: SparkSession, d: str) -> DataFrame:
    o, li = views.table(spark, d, "orders"), views.table(spark, d, "lineitem")
    out = o.join(li, (o["o_orderkey"] == li["l_orderkey"]) & (li["l_shipdate"] >= o["o_orderdate"]), "left")
    return out.groupBy(F.col("o_orderkey").alias("item_id")).agg(F.count("l_orderkey").alias("shipped"))


@query(
    "j09_job_sides",
    "SELECT c.category, coalesce(q, 0) AS queued, coalesce(done, 0) AS done FROM (SELECT DISTINCT category FROM v_queue) c LEFT JOIN (SELECT category, count(*) AS q FROM v_queue WHERE status = 'queued' GROUP BY 1) USING (category)"
    " LEFT JOIN (SELECT category, count(*) AS done FROM v_queue WHERE status = 'completed' GROUP BY 1) USING (category)",
    "v_queue",
)
def j09(spark: SparkSession, d: str) -> DataFrame:
    q = views.queue(spark, d)  # one pass over the queue instead of one for each side
    s = F.col("status")
    return q.groupBy("category").agg(F.count_if(s == "queued").alias("queued"), F.count_if(s == "completed").alias("done"))


@query(
    "j10_assigned_categories",
    "SELECT DISTINCT l_suppkey AS source_id, category FROM v_lines JOIN (SELECT DISTINCT category FROM v_products WHERE category <> 'promo') USING (category)",
    "v_lines v_products",
)
def j10(spark: SparkSession, d: str) -> DataFrame:
    assigned = views.claims(spark, d).groupBy("source_id").agg(F.collect_set("category").alias("cs")).select("source_id", F.explode("cs").alias("category"))
    known = views.products(spark, d).filter("category <> 'promo'").select("category").distinct()
    return assigned.join(F.broadcast(known), "category").select("source_id", "category")


@query("j11_latest_log", "SELECT source_name, max(ts) AS last_seen, arg_max(url, ts) AS last_url FROM v_logs GROUP BY source_name", "v_logs")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return views.logs(spark, d).groupBy("source_name").agg(F.max("ts").alias("last_seen"), F.max_by("url", "ts").alias("last_url"))


def _classes_sql(rows: str, ways: dict[str, str]) -> str:
    """SQL of ``discovery.duplicate_classes``: rows is a relation with id, ways the keys as expressions."""
    keyed = " UNION ALL ".join(f"SELECT DISTINCT '{w}' AS way, id, {key} AS key FROM {rows} WHERE {key} IS NOT NULL" for w, key in ways.items())
    return f"SELECT way, min(id) OVER w AS representative, id FROM ({keyed}) WINDOW w AS (PARTITION BY way, key) QUALIFY count(*) OVER w > 1"


_PRODUCT_WAYS = {"gtin": ["gtin"], "title": ["title"], "brand_model": ["brand", "model_number"]}


# j12, j14 and j15 are over the whole tables: a class of duplicates is its members with their representative, as pairs
# would grow with the square of a class.
@query(
    "j12_any_of_three",
    ", p AS (SELECT *, product_id AS id FROM v_products) " + _classes_sql("p", {"gtin": "gtin", "title": "title", "brand_model": "brand || '|' || model_number"}),
    "v_products",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    return discovery.duplicate_classes(views.products(spark, d).withColumnRenamed("product_id", "id"), _PRODUCT_WAYS)


@query("j13_logs_of_known", "SELECT count(*) AS logs, count(DISTINCT source_name) AS sources FROM v_logs WHERE source_name IN (SELECT 'u' || (s_suppkey % 40) FROM supplier)", "v_logs")
def j13(spark: SparkSession, d: str) -> DataFrame:
    names = views.table(spark, d, "supplier").select(F.concat(F.lit("u"), (F.col("s_suppkey") % 40).cast("string")).alias("source_name")).distinct()
    return views.logs(spark, d).join(names, "source_name", "left_semi").agg(F.count("*").alias("logs"), F.countDistinct("source_name").alias("sources"))


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "pages")
    return p.select(
        F.col("page_id").alias("id"), urls.site("url").alias("host"), urls.base("url").alias("base"), F.element_at(F.split(urls.site("url"), r"\."), -2).alias("name"),
        F.array(F.coalesce(F.regexp_extract(urls.path("url"), "^/([a-z]{2})/", 1), F.lit(""))).alias("markets"),
    )


_HOSTS = (
    "h AS (SELECT page_id AS id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www\\.', '') AS host, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1))"
    " || regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS base, regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '^/([a-z]{2})/', 1) AS market FROM pages)"
)


def _page_ways() -> dict[str, list]:
    return {"host": ["host"], "base": ["base"], "name": [discovery.name_key("name"), F.col("markets")[0]]}


_NAME = "regexp_replace(split_part(host, '.', -2), '[^a-z0-9]', '', 'g') || '|' || market"


@query("j14_registered_duplicates", f"WITH {_HOSTS} " + _classes_sql("h", {"host": "host", "base": "base", "name": _NAME}))
def j14(spark: SparkSession, d: str) -> DataFrame:
    return discovery.duplicate_classes(_hosts(spark, d), _page_ways())


@query(
    "j15_self_duplicates",
    f"WITH {_HOSTS}, k AS (SELECT *, {_NAME} AS name FROM h) SELECT count(*) AS pairs FROM (SELECT DISTINCT a.id, b.id FROM k a JOIN k b ON a.id <> b.id AND (a.host = b.host OR a.base = b.base OR a.name = b.name))",
)
def j15(spark: SparkSession, d: str) -> DataFrame:
    return discovery.pair_count(_hosts(spark, d), _page_ways())


@query(
    "j16_suppressed",
    f"WITH {_HOSTS}, s AS (SELECT host, max(id) AS by_id FROM h WHERE id % 7 = 0 GROUP BY host) SELECT h.id, s.by_id FROM h JOIN s USING (host)",
)
def j16(spark: SparkSession, d: str) -> DataFrame:
    h = _hosts(spark, d)
    rules = h.filter("id % 7 = 0").groupBy("host").agg(F.max("id").alias("by_id"))
    return h.join(rules, "host").select("id", "by_id")


@query(
    "j17_identity_by_rules",
    ", i AS (SELECT product_id AS id, CASE WHEN product_id % 4 > 0 THEN gtin END AS gtin, brand, CASE WHEN product_id % 5 = 0 THEN model_number || ' mk2' WHEN product_id % 5 = 1 THEN NULL ELSE model_number END AS model, title, CASE WHEN category = 'promo' THEN 'tablet' ELSE category END AS category, size,"
    " CASE WHEN product_id % 2 = 0 THEN model_number || '-' || size END AS mpn FROM v_products), k AS (SELECT product_id, gtin, brand, model_number AS model, title, CASE WHEN category = 'promo' THEN 'tablet' ELSE category END AS category, size, model_number || '-' || size AS mpn FROM v_products WHERE product_id % 3 = 0),"
    " r1 AS (SELECT id, min(product_id) AS product_id FROM i JOIN k USING (gtin) GROUP BY id), r2 AS (SELECT id, min(product_id) AS product_id FROM i JOIN k USING (category, mpn) WHERE category = 'tablet' AND coalesce(i.brand = k.brand, true) AND coalesce(i.model = k.model, true) GROUP BY id),"
    " r3 AS (SELECT id, min(product_id) AS product_id FROM i JOIN k USING (brand, model) WHERE NOT (i.category = 'tablet' AND k.category = 'tablet' AND i.size <> k.size) GROUP BY id),"
    " r4 AS (SELECT id, arg_min(product_id, (-n, product_id)) AS product_id FROM (SELECT id, product_id, CAST(i.size = k.size AS INTEGER) + CAST(i.title = k.title AS INTEGER) + CAST(coalesce(i.mpn = k.mpn, false) AS INTEGER) AS n, i.size <> k.size OR i.title <> k.title OR coalesce(i.mpn <> k.mpn, false) AS differs FROM i JOIN k USING (category, size, title)) WHERE n >= 2 AND NOT differs GROUP BY id),"
    " m AS (SELECT id, product_id, i.model AS a, k.model AS b, i.title AS t, k.title AS u FROM i JOIN k USING (brand) WHERE (contains(i.model, k.model) OR contains(k.model, i.model)) AND NOT (i.category = 'tablet' AND k.category = 'tablet' AND i.size <> k.size)),"
    " sim AS (SELECT id, product_id, CASE WHEN a = b THEN 1.0 ELSE 0.9 END AS model_sim, CASE WHEN lower(t) = lower(u) THEN 1.0 WHEN contains(lower(t), lower(u)) OR contains(lower(u), lower(t)) THEN 0.9 ELSE round(len(list_intersect(tt, uu)) / len(list_distinct(tt || uu)), 4) END AS title_sim"
    " FROM (SELECT *, list_distinct(string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ')) AS tt, list_distinct(string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')), ' ')) AS uu FROM m)),"
    " r5 AS (SELECT id, arg_min(product_id, (-s, product_id)) AS product_id, max(s) AS s FROM (SELECT id, product_id, CASE WHEN model_sim >= 0.9 AND title_sim >= 0.45 THEN 0.91 ELSE round(0.20 + 0.45 * model_sim + 0.35 * title_sim, 4) END AS s FROM sim) WHERE s >= 0.86 GROUP BY id)"
    " SELECT i.id AS source_product_id, coalesce(r1.product_id, r2.product_id, r3.product_id, r4.product_id, r5.product_id) AS product_id, CASE WHEN r1.id IS NOT NULL THEN 'gtin' WHEN r2.id IS NOT NULL THEN 'part_number' WHEN r3.id IS NOT NULL THEN 'brand_model' WHEN r4.id IS NOT NULL THEN 'attributes' WHEN r5.id IS NOT NULL THEN 'similarity' ELSE 'none' END AS rule,"
    " CASE WHEN r1.id IS NOT NULL THEN 1.0 WHEN r2.id IS NOT NULL THEN 0.98 WHEN r3.id IS NOT NULL THEN 0.97 WHEN r4.id IS NOT NULL THEN 0.93 WHEN r5.id IS NOT NULL THEN least(0.99, round(0.60 + 0.35 * r5.s, 4)) ELSE 0.0 END AS confidence"
    " FROM i LEFT JOIN r1 ON r1.id = i.id LEFT JOIN r2 ON r2.id = i.id LEFT JOIN r3 ON r3.id = i.id LEFT JOIN r4 ON r4.id = i.id LEFT JOIN r5 ON r5.id = i.id",
    "v_products",
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    """Every product as a source states it (without a gtin, with another or no model number here and there) against a third of them."""
    p, n = views.products(spark, d), F.col("product_id")
    category = F.when(F.col("category") == "promo", "tablet").otherwise(F.col("category")).alias("category")
    part_number = F.concat(F.col("model_number"), F.lit("-"), F.col("size").cast("string"))
    model = F.when(n % 5 == 0, F.concat("model_number", F.lit(" mk2"))).when(n % 5 > 1, F.col("model_number"))
    shared = [category, F.col("brand"), F.col("title"), F.col("size").cast("string").alias("size")]
    incoming = p.select(n.alias("source_product_id"), *shared, F.when(n % 4 > 0, F.col("gtin")).alias("gtin"), model.alias("model_number"), F.when(n % 2 == 0, part_number).alias("manufacturer_part_number"))
    known = p.filter(n % 3 == 0).select("product_id", *shared, "gtin", "model_number", part_number.alias("manufacturer_part_number"))
    return identity.match(incoming, known, variant_keys=("size",), identity_keys=("size", "title", "manufacturer_part_number"))


@query(
    "j18_source_star",
    "SELECT s.source_id, coalesce(claims, 0) AS claims, coalesce(won, 0) AS won, last_observed FROM v_sources s LEFT JOIN (SELECT source_id, count(*) AS claims, max(observed) AS last_observed FROM v_evidence GROUP BY 1) USING (source_id)"
    " LEFT JOIN (SELECT winner AS source_id, count(*) AS won FROM v_canonical GROUP BY 1) USING (source_id)",
    "v_sources v_evidence v_canonical",
)
def j18(spark: SparkSession, d: str) -> DataFrame:
    claims = views.evidence(spark, d).groupBy("source_id").agg(F.count("*").alias("claims"), F.max("observed").alias("last_observed"))
    won = views.canonical(spark, d).groupBy(F.col("winner").alias("source_id")).agg(F.count("*").alias("won"))
    return views.sources(spark, d).select("source_id").join(claims, "source_id", "left").join(won, "source_id", "left").fillna(0, ["claims", "won"]).select("source_id", "claims", "won", "last_observed")


@query(
    "j19_support_matrix",
    "SELECT source_id, c.category, EXISTS (SELECT 1 FROM v_lines WHERE l_suppkey = source_id AND v_lines.category = c.category) AS supported FROM v_sources, (SELECT DISTINCT category FROM v_products) c",
    "v_sources v_lines v_products",
)
def j19(spark: SparkSession, d: str) -> DataFrame:
    have = views.claims(spark, d).groupBy("source_id").agg(F.collect_set("category").alias("cs"))
    cats = views.products(spark, d).select("category").distinct()  # a dimension of a few rows
    spine = views.sources(spark, d).select("source_id").crossJoin(F.broadcast(cats))
    out = spine.join(have, "source_id", "left")
    return out.select("source_id", "category", F.coalesce(F.array_contains("cs", F.col("category")), F.lit(False)).alias("supported"))


@query("j20_first_wins", "SELECT brand, min(product_id) AS product_id, arg_min(model_number, product_id) AS model_number FROM v_products GROUP BY brand", "v_products")
def j20(spark: SparkSession, d: str) -> DataFrame:
    return tables.latest(views.products(spark, d), ["brand"], F.asc("product_id")).select("brand", "product_id", "model_number")


@query("j21_known_targets", "SELECT product_id, source_id FROM (SELECT DISTINCT product_id, source_id FROM v_evidence) WHERE product_id IN (1, 2, 3, 5, 8, 13)", "v_evidence")
def j21(spark: SparkSession, d: str) -> DataFrame:
    linked = views.evidence(spark, d).filter(F.col("product_id").isin(1, 2, 3, 5, 8, 13)).groupBy("product_id").agg(F.collect_set("source_id").alias("ids"))
    return linked.select("product_id", F.explode("ids").alias("source_id"))


@query(
    "w09_ordered_neighbours",
    "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = prev) AS repeats FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) GROUP BY conv_id",
)
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = views.table(spark, d, "conversations").withColumn("prev", F.lag("role").over(w))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == F.col("prev")).alias("repeats"))
