"""Composite operators on small tables whose results are known."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from veracet.operators import discovery, extraction, identity, merging, products
from veracet.sources import tables


def test_identity_rules_in_order(spark):
    names = "category gtin brand model_number title size manufacturer_part_number colour grip"
    fields = "source_product_id int, " + ", ".join(f"{c} string" for c in names.split())
    incoming = spark.createDataFrame(
        [
            (1, "tv", "77", "A", "m1", "A m1 tv", None, None, None, None),
            (2, "tablet", None, "a ", "M2", "x", "55", None, None, None),
            (3, "tv", None, "B", "zx 9000 pro", "B zx 9000 pro big screen", None, None, None, None),
            (4, "tv", None, "C", "", "", None, None, None, None),
            (5, "tablet", None, "A", "m2", "x", "65", None, None, None),  # another variant of 11, but 13 is in another category
            (6, "tablet", None, "A", None, "x", "65", " pn-1", None, None),
            (7, "tablet", None, "Q", None, "x", None, "PN-1", None, None),  # the part number's brand contradicts
            (8, "tv", None, "D", None, "", None, "PN-1", None, None),  # part numbers say nothing of a tv
            (9, "bike", None, "E", "m9", "", "5", None, "red", "cork"),
            (10, "bike", None, "E", "m9", "", "5", None, "red", "foam"),  # one of three differs
        ], fields,
    )
    known = spark.createDataFrame(
        [
            (10, "tv", "77", "Z", "q", "other", None, None, None, None), (11, "tablet", None, "A", "m2", "x", "55", None, None, None),
            (12, "tv", None, "B", "zx 9000", "B zx 9000 pro big screen", None, None, None, None), (13, "radio", None, "A", "m2", "x", None, None, None, None),
            (14, "tablet", None, "A", "m3", "y", None, "PN-1", None, None), (15, "bike", None, "F", "k1", "", "5", None, "RED", None), (16, "bike", None, "F", "k1", "", "5", None, "red", "cork"),
        ], fields.replace("source_product_id", "product_id"),
    )
    got = {r["source_product_id"]: (r["product_id"], r["rule"], r["confidence"]) for r in identity.match(incoming, known, ("size",), ("size", "colour", "grip")).collect()}
    assert got == {
        1: (10, "gtin", 1.0), 2: (11, "brand_model", 0.97), 3: (12, "similarity", 0.9185), 4: (None, "none", 0.0), 5: (13, "brand_model", 0.97), 6: (14, "part_number", 0.98), 7: (None, "none", 0.0),
        8: (None, "none", 0.0), 9: (16, "attributes", 0.93), 10: (15, "attributes", 0.93),
    }


def test_conflicts_by_flag_and_spread(spark):
    said = [(1, "size", "50"), (1, "size", "52"), (2, "size", "50"), (2, "size", "50.4"), (3, "colour", "Red"), (3, "colour", "red "), (4, "colour", "red"), (4, "colour", "blue"), (5, "note", "a"), (6, "size", "9")]
    evidence = spark.createDataFrame(said, "product_id int, attribute string, value string")
    held = [(1, "size", "52", 7, False, 0.8, 2), (2, "size", "50", 7, False, 0.8, 2), (3, "colour", "red", 7, False, 0.8, 2), (4, "colour", "blue", 8, True, 0.9, 2), (5, "note", "a", 9, True, 0.5, 1), (6, "size", "9", 9, False, 0.5, 1)]
    canonical = spark.createDataFrame(held, "product_id int, attribute string, value string, winner int, has_conflict boolean, confidence double, evidence int")
    kinds = spark.createDataFrame([("size", "integer"), ("colour", "string")], "attribute string, value_type string")
    got = {r["product_id"]: (r["reason"], r["severity"], r["suggested"], r["suggested_source"], r["suggested_confidence"]) for r in merging.conflicts(evidence, kinds, canonical).collect()}
    assert got == {1: ("numeric spread", 0.75, "52", 7, 0.8), 4: ("different values", 0.90, "blue", 8, 0.9), 5: ("flagged", 0.90, "a", 9, 0.5)}


def test_ranks_over_ranges(spark):
    rows = [(i, (i * 37) % 101, i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b int")
    got = {r["id"]: r["rank"] for r in tables.ranked(df, [F.desc("a"), F.asc("b"), F.asc("id")]).collect()}
    assert got == {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[2], r[0])), 1)}
    assert tables.ranked(df.limit(0), [F.asc("id")]).collect() == []


def test_merge_fold_by_weight_and_time(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    rows = [(1, "size", "55", 0.5, 0.8, day(1), 1, 1), (1, "size", "55.3", 0.4, 0.7, day(2), 2, 2), (1, "size", "65", 0.9, 0.6, day(3), 3, 3), (1, "size", "40", 0.1, 0.9, day(4), 4, 4), (2, "size", "a", 0.5, 0.5, day(1), 1, 5)]
    claims = spark.createDataFrame(rows, "product_id int, attribute string, value string, weight double, confidence double, observed timestamp, source_id bigint, seq bigint")
    got = {r["product_id"]: r for r in merging.merged(claims).collect()}
    assert (got[1]["value"], got[1]["weight"], got[1]["conflict"], got[1]["evidence"], got[1]["source_id"]) == ("65", 0.9, True, 4, 3)
    assert (got[2]["value"], got[2]["conflict"], got[2]["evidence"]) == ("a", False, 1)


def test_delta_of_versions(spark):
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "Y"), (1, "c", "z")], "id int, attribute string, value string")
    new = spark.createDataFrame([(1, "a", "x2"), (1, "b", " y "), (1, "d", "w")], "id int, attribute string, value string")
    got = [(r["attribute"], r["kind"], r["change_no"]) for r in merging.delta(old, new, ["id"]).orderBy("change_no").collect()]
    assert got == [("a", "changed", 1), ("c", "removed", 2), ("d", "added", 3)]


def test_json_ld_with_graph_reference_and_bad_script(spark):
    html = (
        '<script type="application/ld+json">[{"@type": ["Thing", "Product"], "name": "N"}, {"@graph": {"@graph": [{"@type": "https://schema.org/Product", "title": "P", "brand": {"name": "B"}, "sku": "s1", "offers": [{"@id": "#1"}, {"@id": "#2"}],'
        ' "additionalProperty": [{"propertyID": "w", "value": 5}, {"name": "", "value": "x"}]}]}}, {"@type": "Offer", "@id": "#1", "price": "1,009.50", "priceCurrency": "EUR"}]</script><script type="application/ld+json">{oops</script>'
    )
    pages = spark.createDataFrame([(1, "u", html), (2, "v", None), (3, "w", "<p>no data</p>"), (4, "x", "")], "page_id int, url string, html string").withColumn("name", F.lit(1))
    got = products.extract_products(pages).collect()
    assert [(r["page_id"], r["product_no"], r["name"], r["brand"], r["model"]) for r in got] == [(1, 1, "N", None, None), (1, 2, "P", "B", "s1")]
    assert got[1]["attributes"] == {"sku": "s1", "w": "5"}
    assert [tuple(o) for o in got[1]["offers"]] == [(1009.5, "EUR", None)]


def test_microdata_is_nested_and_merged():
    html = """<div itemscope itemtype="http://schema.org/Product"><h1 itemprop="name">TV <b>X</b></h1><div itemprop="brand" itemscope itemtype="http://schema.org/Brand"><span itemprop="name">Acme</span></div>
      <meta itemprop="gtin13" content="77"><span itemprop="color">red</span><div itemprop="additionalProperty" itemscope><i itemprop="name">Width</i><i itemprop="value">5 mm</i></div>
      <div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><span itemprop="price" content="9.5">9,50</span><meta itemprop="priceCurrency" content="EUR"></div></div>
      <script type="application/ld+json">{"@type": "Product", "gtin": "77", "name": "json name", "additionalProperty": {"name": "color", "value": "blue"}}</script>
      <script type="application/ld+json">{"@type": "Product", "brand": "acme", "name": "tv x", "model": "m1"}</script>"""
    got = products.page_products(html)
    assert [(p["name"], p["brand"], p["gtin"], p["model"]) for p in got] == [("json name", "Acme", "77", ""), ("tv x", "acme", "", "m1")]
    assert got[0]["attributes"] == {"color": "red", "Width": "5 mm"}
    assert got[0]["offers"] == [{"price": 9.5, "currency": "EUR", "availability": None}]


def test_specifications_need_a_sale_and_two_properties(spark):
    rows = "<table><tr><th>Width<td>5<tr><td>Depth</td><td>6</td></tr></table>"
    assert products.page_products(f"<h1>T</h1>{rows}<p>price</p>")[0]["attributes"] == {"Width": "5", "Depth": "6"}
    assert products.page_products(f"<h1>T</h1>{rows}<p>story</p>") == []
    assert products.page_products(f"{rows}<p>price</p>") == []
    assert products.page_products("<h1>T</h1><dl><dt>EAN<dd>12</dl><p>price</p>")[0]["gtin"] == "12"
    assert products.page_products("<h1>T</h1><dl><dt>Hue<dd>12</dl><p>price</p>") == []
    assert products.page_products("<div>" * 5000 + "x") == []
    pages = spark.createDataFrame([(1, "u", f"<h1>T</h1>{rows}<p>price 5 GBP</p>")], "page_id int, url string, html string")
    schema = spark.createDataFrame([("width",)], "attribute string")
    got = products.source_products(products.extract_products(pages), "s", "tv", schema).first()
    assert (got["mapped"], got["unmapped"], got["offers"][0]["price"], len(got["source_product_id"])) == ({"width": "5"}, {"Depth": "6"}, 5.0, 19)


def test_table_attributes(spark):
    html = '<div itemscope itemtype="http://schema.org/Product"><span itemprop="color">red</span></div><table><tr><th>Width:</th><td>5 mm</td></tr><tr><td>only one</td></tr></table>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert sorted((r["kind"], r["key"], r["value"]) for r in extraction.table_attributes(pages).collect()) == [("microdata", "color", "red"), ("table", "Width", "5 mm")]


def test_links_are_classified_and_distinct(spark):
    html = '<a href="/product/1">a</a><a href="/product/1#x">b</a><a href="?page=2">c</a><a href="/category/tv">d</a><a href="#top">e</a><a href="mailto:x@y">f</a><a href="/about">g</a>'
    pages = spark.createDataFrame([(1, "https://e.org/list", html)], "page_id int, url string, html string")
    got = [(r["link"], r["kind"]) for r in discovery.links(pages).orderBy("position").collect()]
    assert got == [("https://e.org/product/1", "product"), ("https://e.org/list?page=2", "pagination"), ("https://e.org/category/tv", "category"), ("https://e.org/about", "related")]


def test_traversal_keeps_least_depth(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (4, 5)], "source int, target int")
    got = {r["node"]: r["depth"] for r in discovery.reached(edges, spark.createDataFrame([(1,)], "node int"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_compare_and_set(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id int, v string, revision int")
    changes = spark.createDataFrame([(1, "a2", 1), (2, "b2", 4)], "id int, v string, revision int")
    after, judged = tables.compare_and_set(current, changes, ["id"])
    assert {r["id"]: (r["v"], r["revision"]) for r in after.collect()} == {1: ("a2", 2), 2: ("b", 5)}
    assert {r["id"]: r["applied"] for r in judged.collect()} == {1: True, 2: False}


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", then'), (2, "two\nlines"), (3, "plain")]
    df = spark.createDataFrame(rows, "id int, t string")
    tables.write_csv(df, str(tmp_path / "x"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "x"))
    assert sorted((int(r["id"]), r["t"]) for r in back.collect()) == rows
    assert df.select(tables.csv_field(F.col("t")).alias("f")).first()["f"] == '"say ""hi"", then"'


def test_a_classifier_of_pages_is_a_slot(spark):
    pages = spark.createDataFrame([(1, "http://x/product/1", "add to cart, price"), (2, "http://x/a", "news"), (3, "http://x/b", None)], "page_id int, url string, html string")
    assert {r["page_id"]: (r["answer"], r["confidence"]) for r in discovery.product_pages(pages).collect()} == {1: ("yes", 0.8), 2: ("no", 0.2), 3: ("no", 0.2)}
    model = lambda url, html: F.when(html.contains("news"), " YES ")
    assert {r["page_id"]: (r["answer"], r["confidence"]) for r in discovery.product_pages(pages, model).collect()} == {1: (None, 0.5), 2: ("yes", 0.8), 3: (None, 0.5)}
