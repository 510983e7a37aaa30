"""Adapter views: the driver's tables in the shape of sources, claims, products, logs and queues.

Each view is a DataFrame function of (spark, sf_dir), and a common table expression of the same name for the SQL
that the queries are held against.  The two are written apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracet.sources.tables import latest

# Attribute definitions of the adapted category schema: key, type, required, sensitivity.
DEFINITIONS = (
    ("brand", "string", True, "critical"), ("model_number", "string", True, "critical"), ("gtin", "string", False, "critical"), ("size", "integer", False, "high"),
    ("unit_price", "decimal", False, "medium"), ("quantity", "integer", False, "low"), ("tax", "decimal", False, "low"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, source_name, market, region, enabled."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), F.col("n_name").alias("market"), F.col("r_name").alias("region"), (F.col("s_acctbal") >= 0).alias("enabled"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, brand, model_number, gtin (null for every tenth), title, category, size."""
    gtin = F.when(F.col("p_partkey") % 10 != 0, F.col("p_partkey").cast("string"))
    title = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model_number"), gtin.alias("gtin"), title.alias("title"),
        F.lower("p_type").alias("category"), F.col("p_size").alias("size"),
    )


# Attributes that every line states, with its column of ``_lines``.
STATED = ("unit_price", "quantity", "tax", "returnflag", "linestatus")
_LINE = ["product_id", "source_id", "category", "confidence_pct", "observed", "seq", "line"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per line: its keys and order, and what it states of each attribute.

    Numbers are in cents, as text, so that equal values have equal texts.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("category"))

    def cents(value: str) -> F.Column:
        return F.expr(f"cast(cast(floor({value} * 100 + 0.5) as bigint) as string)")

    return table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("source_id"), "category", F.expr("cast(round(100 - l_discount * 100) as int)").alias("confidence_pct"),
        F.col("l_shipdate").alias("observed"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), cents("l_extendedprice / l_quantity").alias("unit_price"),
        cents("l_quantity").alias("quantity"), cents("l_tax").alias("tax"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
    )


def _stated(lines: DataFrame) -> DataFrame:
    """A row per attribute that a line states."""
    facts = ", ".join(f"'{a}', {a}" for a in STATED)
    return lines.select(*_LINE[:3], F.expr(f"stack({len(STATED)}, {facts}) as (attribute, value)"), *_LINE[3:])


def _newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest line of each (product, source): as a line states all attributes, it has the newest claim of each."""
    return latest(_lines(spark, sf_dir), ["product_id", "source_id"], F.desc("observed"), F.asc("seq"), F.asc("line"), *[F.asc(a) for a in STATED], F.asc("confidence_pct"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per statement: product_id, source_id, category, attribute, value, confidence, observed, and the order columns seq and line."""
    return _stated(_lines(spark, sf_dir))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest claim of each (product, source, attribute)."""
    return _stated(_newest(spark, sf_dir))


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, category, attribute, value, confidence_pct, evidence, n_values, has_conflict: the most confident claim wins.

    The newest line with the highest confidence wins all attributes of its product; how many values an attribute has is
    counted by (product, attribute, value), combined before the shuffle.
    """
    lines = _newest(spark, sf_dir)
    best = F.max(F.struct("confidence_pct", "observed", "source_id", *STATED))
    won = lines.groupBy("product_id", "category").agg(best.alias("w"), F.count("*").alias("evidence"), F.max("observed").alias("last_observed"))
    facts = ", ".join(f"'{a}', w.{a}" for a in STATED)
    won = won.select("product_id", "category", F.expr(f"stack({len(STATED)}, {facts}) as (attribute, value)"), F.col("w.confidence_pct").alias("confidence_pct"), F.col("w.source_id").alias("winner"), "evidence", "last_observed")
    values = _stated(lines).groupBy("product_id", "category", "attribute").agg(F.countDistinct("value").alias("n_values"))
    out = won.join(values, ["product_id", "category", "attribute"])
    return out.select("product_id", "category", "attribute", "value", "confidence_pct", "winner", "evidence", "n_values", (F.col("n_values") > 1).alias("has_conflict"), "last_observed")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl logs: source_name, url, status, outcome, extracted, changed, duration_ms, ts, log_id."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("log_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"), F.concat(F.lit("/"), kind).alias("url"),
        F.when(kind == "error", "failed").otherwise("completed").alias("status"),
        F.when(kind == "purchase", "products_extracted").when(kind == "view", "no_products").otherwise("not_attempted").alias("outcome"),
        F.when(kind == "purchase", 1).otherwise(0).alias("extracted"), kind.isin("purchase", "signup").alias("changed"), F.floor(F.col("value") * 10).cast("long").alias("duration_ms"), "ts",
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl queue: item_id, source_name, category, status, importance, attempts, enqueued, next_attempt, last_error."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "completed").otherwise("processing")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    joined = o.join(c, o["o_custkey"] == c["c_custkey"])
    return joined.select(
        F.col("o_orderkey").alias("item_id"), F.col("c_name").alias("source_name"), F.lower("c_mktsegment").alias("category"), status.alias("status"),
        F.round((6 - level) / 5.0, 2).alias("importance"), (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.col("o_orderdate").alias("enqueued"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("interval 30 days")).alias("next_attempt"), F.when(F.col("o_orderkey") % 5 == 0, "timeout").alias("last_error"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates of each source: source_name, day, crawls, success, extractable, no_product."""
    g = logs(spark, sf_dir).groupBy("source_name", F.to_date("ts").alias("day"))
    return g.agg(
        F.count("*").alias("crawls"), F.round(F.count_if(F.col("status") == "completed") / F.count("*"), 4).alias("success"),
        F.round(F.count_if(F.col("outcome") == "products_extracted") / F.count("*"), 4).alias("extractable"),
        F.round(F.count_if(F.col("outcome") == "no_products") / F.count("*"), 4).alias("no_product"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events: user by user, each event type's value where it differs from the one before."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entity"), F.col("event_type").alias("attribute"), F.expr("cast(cast(floor(value) as bigint) % 4 as string)").alias("value"), "ts", "event_id"
    )


def definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFINITIONS), "attribute string, value_type string, required boolean, sensitivity string")


# The same views in DuckDB's SQL.
CTES: dict[str, str] = {
    "v_sources": "SELECT s_suppkey AS source_id, s_name AS source_name, n_name AS market, r_name AS region, s_acctbal >= 0 AS enabled FROM supplier, nation, region"
    " WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
    "v_products": "SELECT p_partkey AS product_id, p_brand AS brand, p_name AS model_number, CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS gtin,"
    " p_brand || ' ' || p_name || ' ' || p_type AS title, lower(p_type) AS category, p_size AS size FROM part",
    "v_lines": "SELECT l.*, lower(p_type) AS category FROM lineitem l JOIN part ON l_partkey = p_partkey",
    "v_claims": " UNION ALL ".join(
        f"SELECT l_partkey AS product_id, l_suppkey AS source_id, category, '{a}' AS attribute, {v} AS value, CAST(round(100 - l_discount * 100) AS INTEGER) AS confidence_pct,"
        " l_shipdate AS observed, l_orderkey AS seq, l_linenumber AS line FROM v_lines"
        for a, v in (
            ("unit_price", "CAST(CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) AS VARCHAR)"), ("quantity", "CAST(CAST(floor(l_quantity * 100 + 0.5) AS BIGINT) AS VARCHAR)"),
            ("tax", "CAST(CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS VARCHAR)"), ("returnflag", "l_returnflag"), ("linestatus", "l_linestatus"),
        )
    ),
    "v_evidence": "SELECT * FROM v_claims QUALIFY row_number() OVER (PARTITION BY product_id, source_id, attribute ORDER BY observed DESC, seq, line, value, confidence_pct) = 1",
    "v_canonical": "SELECT product_id, category, attribute, value, confidence_pct, source_id AS winner, evidence, n_values, n_values > 1 AS has_conflict, last_observed FROM (SELECT *,"
    " count(*) OVER w AS evidence, len(list_distinct(list(value) OVER w)) AS n_values, max(observed) OVER w AS last_observed,"
    " row_number() OVER (PARTITION BY product_id, category, attribute ORDER BY confidence_pct DESC, observed DESC, source_id DESC, value DESC) AS rn FROM v_evidence"
    " WINDOW w AS (PARTITION BY product_id, category, attribute)) WHERE rn = 1",
    "v_logs": "SELECT event_id AS log_id, 'u' || user_id AS source_name, '/' || event_type AS url, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,"
    " CASE event_type WHEN 'purchase' THEN 'products_extracted' WHEN 'view' THEN 'no_products' ELSE 'not_attempted' END AS outcome,"
    " CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS extracted, event_type IN ('purchase', 'signup') AS changed, CAST(floor(value * 10) AS BIGINT) AS duration_ms, ts FROM events",
    "v_queue": "SELECT o_orderkey AS item_id, c_name AS source_name, lower(c_mktsegment) AS category,"
    " CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'completed' ELSE 'processing' END AS status, round((6 - CAST(o_orderpriority[1] AS INTEGER)) / 5.0, 2) AS importance,"
    " CAST(o_orderkey % 4 AS INTEGER) AS attempts, o_orderdate AS enqueued, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS next_attempt,"
    " CASE WHEN o_orderkey % 5 = 0 THEN 'timeout' END AS last_error FROM orders JOIN customer ON o_custkey = c_custkey",
    "v_snapshots": "SELECT source_name, CAST(ts AS DATE) AS day, count(*) AS crawls, round(count(*) FILTER (status = 'completed') / count(*), 4) AS success,"
    " round(count(*) FILTER (outcome = 'products_extracted') / count(*), 4) AS extractable, round(count(*) FILTER (outcome = 'no_products') / count(*), 4) AS no_product"
    " FROM v_logs GROUP BY ALL",
    "v_changes": "SELECT user_id AS entity, event_type AS attribute, CAST(CAST(floor(value) AS BIGINT) % 4 AS VARCHAR) AS value, ts, event_id FROM events",
    "v_definitions": "SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{t}', {str(r).lower()}, '{s}')" for a, t, r, s in DEFINITIONS)
    + ") AS d(attribute, value_type, required, sensitivity)",
}
_NEEDS = {"v_claims": ["v_lines"], "v_evidence": ["v_claims"], "v_canonical": ["v_evidence"], "v_snapshots": ["v_logs"]}


def with_views(names: list[str], sql: str) -> str:
    order: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in order)} {sql}" if order else sql
