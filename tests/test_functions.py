"""Functions on single values, with the results that the formulas ask for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veracet.functions import measures, scores, text, urls


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize(
    ("raw", "want"),
    [(" Screen-Size (cm) ", "screen size cm"), ("a|b\\c/d", "a b c d"), ("__x__", "x"), ("", ""), ("É Ü", "é ü"), (None, None)],
)
def test_attribute_name(spark, raw, want):
    assert value(spark, text.attribute_name(lit(raw))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"), [("Red Ring", "red ring", 1.0), ("big red ring", "red ring", 0.9), ("a b c", "a c d", 0.5), ("", "x", 0.0), (None, "x", 0.0)]
)
def test_text_similarity(spark, a, b, want):
    assert value(spark, text.text_similarity(lit(a), lit(b))) == want


@pytest.mark.parametrize(
    ("raw", "unit", "want"),
    [("139.7 cm", "inch", 55.0), ("1 TB", "gb", 1024.0), ("1250 g", "kg", 1.25), ("14", "inch", 14.0), ("2,5 cm", "mm", 25.0), ("none", "mm", None), ("5000mAh", "mp", None), (None, "mm", None)],
)
def test_measured(spark, raw, unit, want):
    got = value(spark, measures.measured(lit(raw), unit))
    assert got == (None if want is None else pytest.approx(want))


def test_rating_and_bluetooth(spark):
    assert value(spark, measures.ip_rating(F.lit("IP 68"))) == "IP68"
    assert value(spark, measures.bluetooth(F.lit("v5.3"))) == "Bluetooth 5.3"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://Www.Example.com:80/a/?utm_source=x&b=2&A=1#top", "http://www.example.com/a?A=1&b=2"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com:8443/x/", "https://example.com:8443/x"),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalised_url(spark, raw, want):
    assert value(spark, urls.normalise(lit(raw))) == want


@pytest.mark.parametrize(
    ("href", "want"),
    [("b", "https://e.org/a/b"), ("../b?q=1", "https://e.org/b?q=1"), ("/b", "https://e.org/b"), ("//c.org/d", "https://c.org/d"), ("#x", None), ("mailto:a@b", None), ("https://x.org/y", "https://x.org/y"), ("./../../z", "https://e.org/z")],
)
def test_resolved(spark, href, want):
    assert value(spark, urls.resolved(F.lit(href), F.lit("https://e.org/a/page"))) == want


def test_scores_round_away_from_zero(spark):
    assert value(spark, scores.rounded(F.lit(0.85145), 4)) == 0.8515
    assert value(spark, scores.clamp(F.lit(1.4), 0.05, 0.99)) == 0.99
    assert value(spark, scores.percent(F.lit(1), F.lit(0))) == 0.0


def test_robots(spark):
    from veracet.sources.tables import robots_blocks, robots_rules

    rules = robots_rules(F.lit("User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/y\n\nUser-agent: b\nDisallow: /\n"))
    for path, want in (("/x/1", True), ("/x/y/1", False), ("/z", False)):
        assert value(spark, robots_blocks(rules, F.lit(path))) is want
    assert value(spark, robots_blocks(robots_rules(lit(None)), F.lit("/x"))) is False
