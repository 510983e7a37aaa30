"""Every query that has SQL gives the rows that DuckDB gives for it on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
import pytest

from veracet.plans.registry import oracle_sql, queries

DATA = os.environ.get("VERACET_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float):
        return "nan" if math.isnan(v) else repr(round(float(v), 8) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    result = duck.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert queries()[name](spark, DATA).count() > 0


def test_merge_fold_over_all_products(spark):
    """w09 against a plain fold of the same evidence, over all products and attributes."""
    from veracet.sources import views

    claims = {}
    for r in views.evidence(spark, DATA).collect():
        claims.setdefault((r["product_id"], r["attribute"]), []).append((r["observed"], r["source_id"], r["seq"], r["value"], r["confidence_pct"] / 100))

    def number(x):
        try:
            return float(x)
        except ValueError:
            return None

    def bounded(x):
        return min(max(round(x, 4), 0.05), 0.99)

    want, disagreed = {}, 0
    for key, rows in claims.items():
        state = None
        for *_, value, weight in sorted(rows):
            if state is None:
                state = [value, weight, weight, False, 1]
                continue
            old, w, c, conflict, n = state
            bonus = min(0.14, n * 0.07)
            x, y = number(old), number(value)
            same = abs(x - y) <= max(0.5, abs(x) * 0.02) if x is not None and y is not None else old.lower() == value.lower()
            if same:
                state = [old, max(w, weight), bounded(max(c, weight) + 0.05 + bonus), conflict, n + 1]
            elif weight >= 0.98 * w:  # each claim is newer than those before it
                state = [value, weight, bounded(weight + bonus - 0.20), True, n + 1]
            else:
                state = [old, w, bounded(c + bonus - 0.20), True, n + 1]
        want[key] = state
        disagreed += state[3]
    got = {(r["product_id"], r["attribute"]): [r["value"], r["weight"], r["confidence"], r["conflict"], r["evidence"]] for r in queries()["w09_merge_fold"](spark, DATA).collect()}
    assert got.keys() == want.keys()
    for key, (value, weight, confidence, conflict, n) in want.items():
        assert got[key][0::3] == [value, conflict] and got[key][4] == n, key
        assert got[key][1:3] == pytest.approx([weight, confidence], abs=2e-4)
    assert disagreed
