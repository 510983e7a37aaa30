"""Queries over the scalar functions (F): text, URLs, HTML, measures, ladders and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracet.functions import measures, scores, text, urls
from veracet.operators import discovery, extraction, products, quality
from veracet.plans.catalog import query
from veracet.sources import views

_RAW = "p_brand || '_' || p_name || ' /(' || p_type || ')'"


@query(
    "f01_attribute_names",
    f"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({_RAW})), '[\\s_\\-/\\\\|]+', ' ', 'g'), '[^\\p{{L}}\\p{{Nd}} ]', '', 'g'), ' +', ' ', 'g')) AS name,"
    f" replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({_RAW})), '[\\s_\\-/\\\\|]+', ' ', 'g'), '[^\\p{{L}}\\p{{Nd}} ]', '', 'g'), ' +', ' ', 'g')), ' ', '_') AS key FROM part",
)
def f01(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("p_brand"), F.lit("_"), F.col("p_name"), F.lit(" /("), F.col("p_type"), F.lit(")"))
    return views.table(spark, d, "part").select("p_partkey", text.attribute_name(raw).alias("name"), text.attribute_key(raw).alias("key"))


@query(
    "f02_aliases",
    "SELECT p_partkey, coalesce(a.key, lower(p_name)) AS key FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS p_name FROM part) LEFT JOIN (VALUES ('small_ring', 'ring'), ('red_widget', 'widget')) a(alias, key) ON lower(p_name) = alias",
)
def f02(spark: SparkSession, d: str) -> DataFrame:
    aliases = spark.createDataFrame([("small ring", "ring"), ("red widget", "widget")], "alias string, key string")
    named = views.table(spark, d, "part").select("p_partkey", text.attribute_name("p_name").alias("alias"))
    return named.join(F.broadcast(aliases), "alias", "left").select("p_partkey", F.coalesce("key", text.attribute_key("alias")).alias("key"))


@query(
    "f03_value_mapping",
    "SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN 'Budget' WHEN 'promo' THEN 'Offer' ELSE p_type END AS value, lower(p_type) IN ('economy', 'promo') AS mapped FROM part",
)
def f03(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([("economy", "Budget"), ("promo", "Offer")], "k string, to string")
    rows = views.table(spark, d, "part").select("p_partkey", "p_type", text.value_key(F.concat(F.lit(" "), F.col("p_type"), F.lit("! "))).alias("k"))
    return rows.join(F.broadcast(table), "k", "left").select("p_partkey", F.coalesce("to", "p_type").alias("value"), F.col("to").isNotNull().alias("mapped"))


@query(
    "f04_fingerprint_tokens",
    "SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' - ' || p_name), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS fingerprint, len(list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_brand || ' - ' || p_name || ' ' || p_name), '[^\\p{L}\\p{Nd}]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS tokens FROM part",
)
def f04(spark: SparkSession, d: str) -> DataFrame:
    both = F.concat_ws(" - ", "p_brand", "p_name")
    return views.table(spark, d, "part").select("p_partkey", text.fingerprint_text(both).alias("fingerprint"), F.size(text.tokens(both, "p_name")).alias("tokens"))


@query(
    "f08_text_similarity",
    "SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 1.0 WHEN contains(p_name, 'small ring') THEN 0.9 ELSE round(len(list_intersect(string_split(p_name, ' '), ['small', 'ring'])) / len(list_distinct(string_split(p_name, ' ') || ['small', 'ring'])), 4) END AS similarity FROM part",
)
def f08(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "part").select("p_partkey", text.text_similarity("p_name", F.lit("Small  Ring")).alias("similarity"))


@query(
    "f09_labels",
    "SELECT DISTINCT p_type, lower(p_type) AS name_key, upper(p_type[1]) || lower(p_type[2:]) AS title, upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || lower(split_part(p_name, ' ', 2)[2:]) AS label,"
    " CASE WHEN p_type LIKE '%Y' THEN lower(p_type[:-2]) || 'ies' ELSE lower(p_type) || 's' END AS plural FROM part WHERE p_type NOT LIKE '%S'",
)
def f09(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part").filter("p_type not like '%S'")
    return p.select(
        "p_type", text.name_key("p_type").alias("name_key"), text.title_case("p_type").alias("title"), text.label(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("label"),
        text.plural(F.lower("p_type")).alias("plural"),
    ).distinct()


@query(
    "f12_preferred_and_shown",
    "SELECT product_id, coalesce(nullif(trim(gtin), ''), brand) AS preferred, CASE WHEN gtin IS NULL THEN '-' ELSE gtin || ' pcs' END AS shown, CASE WHEN gtin IS NULL THEN 'gtin set to ' || brand ELSE 'gtin changed from ' || gtin || ' to ' || brand END AS change FROM v_products",
    "v_products",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    return views.products(spark, d).select(
        "product_id", text.first_present("gtin", "brand").alias("preferred"), text.shown("gtin", F.lit("pcs")).alias("shown"), text.change_summary(F.lit("gtin"), "gtin", "brand").alias("change")
    )


@query(
    "f15_paths_and_scopes",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'unknown-source' END AS source, 'market:uk|locale:|categories:a,b|brands:' || lower(s_name) AS scope FROM supplier",
)
def f15(spark: SparkSession, d: str) -> DataFrame:
    s = views.table(spark, d, "supplier")
    path = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("source:"), F.col("s_name"), F.lit("|spec.weight"))).otherwise(F.lit("spec.weight"))
    scope = text.scope_fingerprint(F.lit(" UK "), F.lit(None).cast("string"), F.array(F.lit("B "), F.lit("a"), F.lit("A"), F.lit("")), F.array(F.col("s_name")))
    return s.select("s_suppkey", text.path_source(path).alias("source"), scope.alias("scope"))


@query(
    "f20_value_types",
    "SELECT attribute, CASE WHEN attribute IN ('returnflag', 'linestatus') THEN 'string' ELSE 'integer' END AS value_type, count(*) AS n FROM v_claims GROUP BY ALL UNION ALL SELECT 'events.value', CASE WHEN value = floor(value) THEN 'integer' ELSE 'decimal' END, count(*) FROM (SELECT round(value, 1) AS value FROM events) GROUP BY ALL",
    "v_claims",
)
def f20(spark: SparkSession, d: str) -> DataFrame:
    a = views.claims(spark, d).select("attribute", text.value_type("value").alias("value_type"))
    v = F.round("value", 1)
    shown = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("decimal(18,1)").cast("string"))
    b = views.table(spark, d, "events").select(F.lit("events.value").alias("attribute"), text.value_type(shown).alias("value_type"))
    return a.unionByName(b).groupBy("attribute", "value_type").agg(F.count("*").alias("n"))


@query("f21_category_keys", "SELECT DISTINCT lower(replace(o_orderpriority, ' ', '_')).replace('-', '_') AS key FROM orders")
def f21(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select(text.category_key("o_orderpriority").alias("key")).distinct()


@query(
    "f22_attribute_suggestions",
    "SELECT raw, attribute, score FROM (SELECT raw, attribute, round(len(list_intersect(t, k)) / len(list_distinct(t || k)), 4) AS score, row_number() OVER (PARTITION BY raw ORDER BY len(list_intersect(t, k)) / len(list_distinct(t || k)) DESC, attribute) AS rn FROM"
    " (VALUES ('unit price', ['unit', 'price']), ('model', ['model']), ('total price', ['total', 'price']), ('weight', ['weight'])) r(raw, t), (SELECT attribute, string_split(attribute, '_') AS k FROM v_definitions) WHERE len(list_intersect(t, k)) > 0) WHERE rn = 1",
    "v_definitions",
)
def f22(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.createDataFrame([("unit price",), ("model",), ("total price",), ("weight",)], "raw string")
    return quality.attribute_suggestions(raw, views.definitions(spark))


_H = "lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1))"
_P = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
_Q = "regexp_extract(url, '\\?([^#]*)', 1)"


@query(
    "f30_normalised_urls",
    f"SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || {_H} || CASE WHEN regexp_replace({_P}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_P}, '/+$', '') END"
    f" || CASE WHEN q = '' THEN '' ELSE '?' || q END AS normalised FROM (SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split({_Q}, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(ref|utm_[a-z]+)='))), '&'), '') AS q FROM pages)",
)
def f30(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", urls.normalise("url").alias("normalised"))


@query(
    "f31_url_parts",
    f"SELECT page_id, 'product:s:tv:' || sha256(lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || {_H} || {_P})[:16] AS frontier, regexp_replace({_H}, '^www\\.', '') AS site,"
    f" lower(regexp_extract(url, '^([^:]+)://', 1)) || '://' || {_H} || regexp_replace({_P}, '/+$', '') AS base, {_P} LIKE '%sitemap%.xml' AS is_sitemap, CASE WHEN regexp_extract({_P}, '^/([^/]+)', 1) <> '' THEN '/' || lower(regexp_extract({_P}, '^/([^/]+)', 1)) || '/' END AS pattern FROM pages",
)
def f31(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select(
        "page_id", urls.frontier_id(F.lit("product"), F.lit("s"), F.lit("tv"), "url").alias("frontier"), urls.site("url").alias("site"), urls.base("url").alias("base"),
        urls.is_sitemap("url").alias("is_sitemap"), urls.url_pattern("url").alias("pattern"),
    )


@query(
    "f34_resolved_links",
    f"SELECT page_id, root || '/a/b' AS plain, root || '/x' AS up, root || '/top' AS rooted, scheme || '://cdn.example.org/i' AS other FROM (SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS root, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme FROM pages)",
)
def f34(spark: SparkSession, d: str) -> DataFrame:
    at = F.concat(F.regexp_extract("url", "^([^:]+://[^/?#]*)", 1), F.lit("/a/page"))
    p = views.table(spark, d, "pages").withColumn("at", at)
    return p.select("page_id", *[urls.resolved(F.lit(h), "at").alias(n) for n, h in (("plain", "b"), ("up", "../x"), ("rooted", "/top"), ("other", "//cdn.example.org/i"))])


@query("f35_locales", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'en-gb' END AS locale, CASE WHEN page_id % 3 = 0 THEN 'UK' END AS market FROM pages")
def f35(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "pages")
    segment = F.when(F.col("page_id") % 2 == 0, "EN_gb").otherwise("engb")
    address = F.concat(F.lit("https://"), urls.host("url"), F.when(F.col("page_id") % 3 == 0, "/en-gb/x").otherwise("/x"))
    return p.select("page_id", urls.locale(segment).alias("locale"), urls.inferred_market(address).alias("market"))


@query(
    "f40_json_ld_products",
    "SELECT page_id, url, 'P' || page_id AS name, 'B' AS brand, CAST(page_id AS VARCHAR) AS gtin, 'm ' || (page_id % 7) AS model, page_id + 0.5 AS price, 'GBP' AS currency, '5 mm' AS width, 'json-ld' AS origin FROM pages",
)
def f40(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the table with JSON-LD put in, as they have none: nested graphs, types by address, offers by reference, a second
    description of the same product, bad scripts."""
    p = views.table(spark, d, "pages").select("page_id", "url")
    body = F.format_string(
        '<script type="application/ld+json">{"@graph": [[{"@type": ["Thing", "http://schema.org/Product"], "name": "P%1$d", "brand": [{"name": "B"}], "gtin13": "%1$d", "offers": {"@id": "#o"}, "additionalProperty": [{"name": "width", "value": "5 mm"}]},'
        ' {"@graph": [{"@type": "http://schema.org/Offer", "@id": "#o", "price": "%1$d.5", "priceCurrency": "GBP"}]}]]}</script><script type="application/ld+json">{bad</script>'
        '<div itemscope itemtype="https://schema.org/Product"><b itemprop="gtin">%1$d</b><i itemprop="name">other</i><span itemprop="model">m %2$d</span></div>', F.col("page_id"), F.col("page_id") % 7,
    )
    found = products.extract_products(p.withColumn("html", body))
    return found.select("page_id", "url", "name", "brand", "gtin", "model", F.col("offers")[0]["price"].alias("price"), F.col("offers")[0]["currency"].alias("currency"), F.element_at("attributes", "width").alias("width"), "origin")


@query(
    "f46_specification_products",
    "SELECT page_id, 'P ' || page_id AS name, page_id || ' mm' AS width, 'black & red' AS colour, 'X' || page_id AS model, 19.5 AS price, 'specification' AS origin FROM pages WHERE page_id % 2 = 0",
)
def f46(spark: SparkSession, d: str) -> DataFrame:
    """Every second page says that it is for sale; the others have no product."""
    p = views.table(spark, d, "pages").select("page_id", "url")
    body = F.concat(
        F.format_string('<h1>P %1$d</h1><table><tr><th>Width:</th><td>%1$d mm<tr><td>only one</table><dl><dt>Colour<dd>black &amp; red</dl><ul class="tech-list"><li>Model No: X%1$d<li>no pair</ul>', F.col("page_id")),
        F.when(F.col("page_id") % 2 == 0, "<p>Buy now for £19.50</p>").otherwise("<p>A review</p>"),
    )
    body = F.when(F.col("page_id") % 2 == 0, body).otherwise(F.replace(body, F.lit("Model No"), F.lit("Kind")))
    found = products.extract_products(p.withColumn("html", body))
    return found.select("page_id", "name", F.element_at("attributes", "Width").alias("width"), F.element_at("attributes", "Colour").alias("colour"), "model", F.col("offers")[0]["price"].alias("price"), "origin")


@query("f46_table_attributes", "SELECT page_id, kind, key, CASE kind WHEN 'table' THEN page_id || ' mm' ELSE 'black & red' END AS value FROM pages, (VALUES ('table', 'Width'), ('list', 'Colour')) k(kind, key)")
def f46_attributes(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "pages").select("page_id", F.concat(F.lit("<table><tr><th>Width:</th><td>"), F.col("page_id").cast("string"), F.lit(" mm</td></tr></table><dl><dt>Colour</dt><dd>black &amp; red</dd></dl>")).alias("html"))
    return extraction.table_attributes(p)


@query(
    "f47_prices",
    "SELECT o_orderkey, floor(o_totalprice * 100) / 100.0 AS amount, 'GBP' AS currency FROM orders",
)
def f47(spark: SparkSession, d: str) -> DataFrame:
    cents = F.floor(F.col("o_totalprice") * 100)
    whole = F.floor(cents / 100)
    shown = F.concat(F.lit("£"), F.format_number(whole, 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return views.table(spark, d, "orders").select("o_orderkey", extraction.price(shown).alias("p")).select("o_orderkey", "p.amount", "p.currency")


@query(
    "f49_plain_text",
    "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages",
)
def f49(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", extraction.plain_text("html").alias("text"))


@query(
    "f51_page_links",
    "SELECT page_id, count(DISTINCT h) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a href=\"(/[^\"]*)\"', 1)) AS h FROM pages) GROUP BY page_id",
)
def f51(spark: SparkSession, d: str) -> DataFrame:
    pages = views.table(spark, d, "pages").withColumn("url", F.concat(F.regexp_extract("url", "^([^:]+://[^/?#]*)", 1), F.lit("/from/here")))
    return discovery.links(pages).groupBy("page_id").agg(F.count("*").alias("links"))


@query(
    "f53_page_scores",
    "SELECT page_id, round(CASE WHEN regexp_matches(html, '(?i)og:type[\"''=\\s:>]+product|itemtype=[\"''][^\"'']*Product|data-product') THEN 0.30 ELSE 0 END + CASE WHEN regexp_matches(html, '(?i)add[- ]to[- ](cart|basket)|buy[- ]now|sku|mpn|gtin|model') THEN 0.20 ELSE 0 END"
    " + CASE WHEN regexp_matches(html, '(?i)price|priceCurrency|availability|InStock|Offer') THEN 0.15 ELSE 0 END, 2) AS score FROM pages",
)
def f53(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", discovery.product_score("url", "html").alias("score"))


@query(
    "f60_measures",
    "SELECT l_orderkey, l_linenumber, l_quantity AS qty, round(l_quantity / 2.54, 2) AS inches, CAST(round(l_quantity / 2.54, 2) + 0.5 AS BIGINT) - CASE WHEN round(l_quantity / 2.54, 2) + 0.5 < CAST(round(l_quantity / 2.54, 2) + 0.5 AS BIGINT) THEN 1 ELSE 0 END AS screen, round(l_quantity * 10, 2) AS mm FROM lineitem",
)
def f60(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" cm wide"))
    li = views.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", measures.number(raw).alias("qty"), measures.measured(raw, "inch").alias("inches"), measures.screen_inches(raw).cast("long").alias("screen"), measures.measured(raw, "mm").alias("mm"))


@query(
    "f65_typed_values",
    "SELECT DISTINCT l_returnflag, l_linestatus, CAST(NULL AS INTEGER) AS whole, CASE l_linestatus WHEN 'O' THEN true WHEN 'F' THEN false END AS truth, 'IP6' || l_returnflag AS rating, 'Bluetooth 5.3' AS bluetooth, 5.3 AS loose FROM lineitem",
)
def f65(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("l_linestatus") == "O", " Yes").otherwise("no ")
    li = views.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()
    return li.select(
        "l_returnflag", "l_linestatus", measures.whole("l_returnflag").alias("whole"), measures.truth(said).alias("truth"), measures.ip_rating(F.concat(F.lit("rated ip 6-"), F.lower("l_returnflag"))).alias("rating"),
        measures.bluetooth(F.lit("v5.3")).alias("bluetooth"), measures.loose_number(F.lit("about 5,3 or so")).alias("loose"),
    )


@query(
    "f71_normalised_attributes",
    "SELECT p_partkey, CAST(round(p_size / 2.54, 2) + 0.5 AS BIGINT) - CASE WHEN round(p_size / 2.54, 2) + 0.5 < CAST(round(p_size / 2.54, 2) + 0.5 AS BIGINT) THEN 1 ELSE 0 END AS screen, 0.96 AS screen_confidence, CASE WHEN p_type = 'PROMO' THEN 'Offer' ELSE p_type END AS kind,"
    " CASE WHEN p_type = 'PROMO' THEN 0.98 ELSE 0.80 END AS kind_confidence, 0.35 AS unknown_confidence FROM part",
)
def f71(spark: SparkSession, d: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    p = views.table(spark, d, "part").withColumn("raw", F.concat(F.col("p_size").cast("string"), F.lit("cm")))
    screen = measures.normalised("raw", F.lit("screen"), F.lit("inch"), nothing)
    kind = measures.normalised("p_type", F.lit("text"), nothing, F.when(F.col("p_type") == "PROMO", "Offer"))
    unknown = measures.normalised("p_name", nothing, nothing, nothing)
    return p.select("p_partkey", screen.alias("s"), kind.alias("k"), unknown.alias("u")).select(
        "p_partkey", F.col("s.value").cast("long").alias("screen"), F.col("s.confidence").alias("screen_confidence"), F.col("k.value").alias("kind"), F.col("k.confidence").alias("kind_confidence"),
        F.col("u.confidence").alias("unknown_confidence"),
    )


@query("f73_plausible", "SELECT p_partkey, p_size BETWEEN 10 AND 60 AS plausible FROM part")
def f73(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "part").select("p_partkey", measures.plausible(F.lit("monitor"), F.lit("screen_size_inch"), F.col("p_size").cast("double")).alias("plausible"))


@query(
    "f74_age_ladders",
    "SELECT item_id, CASE WHEN age <= 0 THEN 1.0 WHEN age <= 1 THEN 1.0 WHEN age <= 7 THEN 0.96 WHEN age <= 30 THEN 0.88 WHEN age <= 90 THEN 0.76 ELSE 0.65 END AS recency, CASE WHEN age >= 30 THEN 1.0 WHEN age >= 14 THEN 0.85 WHEN age >= 7 THEN 0.70 WHEN age >= 1 THEN 0.45 ELSE 0.20 END AS staleness,"
    " CASE WHEN age <= 7 THEN 'fresh' WHEN age <= 30 THEN 'aging' ELSE 'stale' END AS freshness FROM (SELECT item_id, date_diff('day', enqueued, TIMESTAMP '1999-06-01') AS age FROM v_queue)",
    "v_queue",
)
def f74(spark: SparkSession, d: str) -> DataFrame:
    now, at = F.lit("1999-06-01").cast("timestamp"), F.col("enqueued")
    return views.queue(spark, d).select("item_id", scores.recency_factor(at, now).alias("recency"), scores.staleness(at, now).alias("staleness"), scores.freshness(at, now).alias("freshness"))


@query("f79_hashes", "SELECT doc_id, upper(sha256(text)) AS hash, 'src:' || upper(sha256(source || '|' || lang))[:16] AS short FROM documents")
def f79(spark: SparkSession, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.content_hash("text").alias("hash"), text.short_id(F.lit("src"), "source", "lang").alias("short"))


@query(
    "f81_operations",
    "SELECT item_id, greatest(enqueued, coalesce(next_attempt, enqueued)) AS latest, least(3600.0, 30 * pow(2, greatest(attempts, 1) - 1)) AS backoff_s, least(3000, greatest(1000, 60000 // (10 + attempts))) AS throttle_ms FROM v_queue",
    "v_queue",
)
def f81(spark: SparkSession, d: str) -> DataFrame:
    return views.queue(spark, d).select(
        "item_id", F.greatest("enqueued", "next_attempt").alias("latest"), scores.backoff(F.col("attempts"), 30, 3600).alias("backoff_s"),
        scores.throttle(F.col("attempts") + 10, F.lit(1000).cast("long"), F.lit(3000).cast("long")).alias("throttle_ms"),
    )
