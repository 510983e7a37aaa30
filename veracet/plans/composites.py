"""Queries over the composite operators: merge, conflicts, deltas, discovery traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracet.operators import discovery, merging
from veracet.plans.catalog import query
from veracet.sources import views


# w09 has no SQL: the recursion over all products is too slow; a test holds it against a plain fold.
@query("w09_merge_fold")
def fold(spark: SparkSession, d: str) -> DataFrame:
    # times are days here: a claim of the same day counts as newer in its order, so each gets its own second
    n = F.row_number().over(Window.partitionBy("product_id", "attribute").orderBy("observed", "source_id", "seq", "value"))
    c = views.evidence(spark, d).withColumn("observed", F.timestamp_seconds(n)).withColumn("weight", F.col("confidence_pct") / 100).withColumn("confidence", F.col("weight"))
    m = merging.merged(c.select("product_id", "attribute", "value", "weight", "confidence", "observed", "source_id", "seq"))
    return m.select("product_id", "attribute", "value", F.round("weight", 4).alias("weight"), F.round("confidence", 4).alias("confidence"), "conflict", "evidence")


@query(
    "g_conflicts",
    "SELECT product_id, attribute, CASE WHEN spread THEN 'numeric spread' WHEN texts THEN 'different values' ELSE 'flagged' END AS reason, CASE WHEN flagged THEN 0.90 ELSE 0.75 END AS severity, n_values, suggested, suggested_source, suggested_confidence FROM"
    " (SELECT *, attribute IN ('unit_price', 'quantity', 'tax') AND numbers >= 2 AND hi - lo > greatest(0.5, abs(hi) * 0.03) AS spread, attribute IN ('returnflag', 'linestatus') AND n_values > 1 AS texts FROM"
    " (SELECT product_id, attribute, count(DISTINCT lower(value)) AS n_values, count(*) AS claims, count(try_cast(value AS DOUBLE)) AS numbers, max(try_cast(value AS DOUBLE)) AS hi, min(try_cast(value AS DOUBLE)) AS lo FROM v_evidence GROUP BY ALL)"
    " JOIN (SELECT product_id, attribute, value AS suggested, winner AS suggested_source, confidence_pct AS suggested_confidence, has_conflict AND product_id % 3 <> 0 AS flagged FROM v_canonical) USING (product_id, attribute)) WHERE (claims >= 2 OR flagged) AND (spread OR texts OR flagged)",
    "v_evidence v_canonical",
)
def conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The flags of every third product are cleared, as after a review, so that conflicts that the merge hasn't flagged occur."""
    extra = spark.createDataFrame([("returnflag", "string", False, "low"), ("linestatus", "string", False, "low")], views.definitions(spark).schema)
    held = views.canonical(spark, d).withColumns({"has_conflict": F.col("has_conflict") & (F.col("product_id") % 3 != 0), "confidence": F.col("confidence_pct")})
    return merging.conflicts(views.evidence(spark, d), views.definitions(spark).unionByName(extra), held)


@query(
    "t10_semantic_delta",
    "SELECT product_id, attribute, old_value, new_value, CASE WHEN old_value IS NULL THEN 'added' WHEN new_value IS NULL THEN 'removed' ELSE 'changed' END AS kind, row_number() OVER (PARTITION BY product_id ORDER BY attribute) AS change_no FROM (SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.attribute, b.attribute) AS attribute, a.value AS old_value, b.value AS new_value FROM"
    " (SELECT product_id, attribute, arg_max(value, (observed, seq, line, value)) AS value FROM v_claims WHERE observed < TIMESTAMP '1998-01-01' GROUP BY ALL) a FULL JOIN (SELECT product_id, attribute, arg_max(value, (observed, seq, line, value)) AS value FROM v_claims WHERE product_id % 9 <> 0 GROUP BY ALL) b"
    " ON a.product_id = b.product_id AND a.attribute = b.attribute) WHERE lower(old_value) IS DISTINCT FROM lower(new_value)",
    "v_claims",
)
def semantic_delta(spark: SparkSession, d: str) -> DataFrame:
    c = views.claims(spark, d)
    last = F.max_by("value", F.struct("observed", "seq", "line", "value")).alias("value")
    old = c.filter(F.col("observed") < F.lit("1998-01-01").cast("timestamp")).groupBy("product_id", "attribute").agg(last)
    new = c.filter("product_id % 9 <> 0").groupBy("product_id", "attribute").agg(last)
    return merging.delta(old, new, ["product_id"])


@query(
    "w07_version_changes",
    "SELECT entity, attribute, event_id, old_value, value AS new_value FROM (SELECT *, lag(value) OVER (PARTITION BY entity, attribute ORDER BY ts, event_id) AS old_value FROM v_changes) WHERE old_value IS DISTINCT FROM value",
    "v_changes",
)
def versions(spark: SparkSession, d: str) -> DataFrame:
    out = merging.version_changes(views.changes(spark, d), ["entity", "attribute"], ["ts", "event_id"])
    return out.select("entity", "attribute", "event_id", "old_value", "new_value")


@query(
    "t02_content_delta",
    "SELECT doc_id, upper(sha256(text)) AS content_hash, coalesce(lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) = sha256(text), false) AS unchanged FROM documents",
)
def content_delta(spark: SparkSession, d: str) -> DataFrame:
    out = merging.content_changes(views.table(spark, d, "documents"), ["source"], ["doc_id"], "text")
    return out.select("doc_id", "content_hash", "unchanged")


@query(
    "t15_link_traversal",
    "WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS source, (p_partkey * 7 + 1) % 2000 AS target FROM part UNION SELECT DISTINCT p_partkey, (p_partkey * 3 + 2) % 2000 FROM part), r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT target, depth + 1 FROM r JOIN e ON source = node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node",
)
def traversal(spark: SparkSession, d: str) -> DataFrame:
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("source"))
    edges = p.select("source", ((F.col("source") * 7 + 1) % 2000).alias("target")).union(p.select("source", ((F.col("source") * 3 + 2) % 2000).alias("target"))).distinct()
    seeds = spark.range(1, 2).select(F.col("id").alias("node"))
    return discovery.reached(edges, seeds, 3)


@query(
    "t04_frontier_upsert",
    "SELECT lower(regexp_replace(url, '/+$', '')) AS key, min(depth) AS depth, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS seen FROM (SELECT 'http://h' || user_id || '.example.com/' || event_type AS url, CAST(event_id % 4 AS INTEGER) AS depth, ts FROM events) GROUP BY 1",
)
def frontier(spark: SparkSession, d: str) -> DataFrame:
    e = views.table(spark, d, "events")
    address = F.concat(F.lit("HTTP://h"), F.col("user_id").cast("string"), F.lit(".Example.com/"), F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "/?ref=x#top").otherwise(""))
    seen = e.select(
        F.lit("s").alias("source"), F.lit("c").alias("category"), address.alias("url"), (F.col("event_id") % 4).cast("int").alias("depth"), F.lit("queued").alias("state"), "ts", F.lit(None).cast("string").alias("parent")
    )
    return discovery.frontier(seen).select("key", "depth", "first_seen", "last_seen", "seen")
