"""The duplicate queries over whole tables, against all pairs by brute force."""

from __future__ import annotations

import collections
import os

import pytest

from veracet.operators import discovery
from veracet.plans import joins
from veracet.plans.registry import queries

DATA = os.environ.get("VERACET_TESTDATA", "/root/testdata/sf0.001")


def pairs_of(rows) -> set:
    classes = collections.defaultdict(set)
    for r in rows:
        classes[r["way"], r["representative"]].add(r["id"])
    return {(a, b) for members in classes.values() for a in members for b in members if a != b}


def test_whole_duplicates_equal_brute_force(spark):
    rows = [(i, f"h{i % 7}.org", f"b{i // 3}", f"n{i % 5}", [["en"], ["de"]][i % 2]) for i in range(150)]
    rows += [(200, None, "b1", None, ["en"]), (201, "h1.org", None, "n1", ["fr"]), rows[3]]
    df = spark.createDataFrame(rows, "id long, host string, base string, name string, markets array<string>")
    want = {(a, b) for a, b in map(tuple, discovery.potential_duplicates(df, df).collect()) if a != b}
    assert any(a >= 120 and b >= 120 for a, b in want)
    classes = discovery.duplicate_classes(df, joins._page_ways()).collect()
    assert pairs_of(classes) == want
    assert all(r["representative"] <= r["id"] for r in classes)
    assert discovery.pair_count(df, joins._page_ways()).first()["pairs"] == len(want)
    assert discovery.pair_count(df.limit(0), joins._page_ways()).first()["pairs"] == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_whole_duplicates_of_the_tables(spark):
    h = joins._hosts(spark, DATA)
    want = {(r["a_id"], r["b_id"]) for r in discovery.potential_duplicates(h, h).filter("a_id <> b_id").collect()}
    assert pairs_of(queries()["j14_registered_duplicates"](spark, DATA).collect()) == want
    assert queries()["j15_self_duplicates"](spark, DATA).first()["pairs"] == len(want)
    p = joins.views.products(spark, DATA).collect()
    want = {(a[0], b[0]) for a in p for b in p if a[0] != b[0] and (a["gtin"] and a["gtin"] == b["gtin"] or a["title"] == b["title"] or (a["brand"], a["model_number"]) == (b["brand"], b["model_number"]))}
    assert pairs_of(queries()["j12_any_of_three"](spark, DATA).collect()) == want
