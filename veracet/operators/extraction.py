"""Attributes, prices and plain text of pages; ``products`` has the products that they describe."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S)
_CELL = re.compile(r"<t[hd]\b[^>]*>(.*?)</t[hd]>", re.I | re.S)
_TERM = re.compile(r"<dt\b[^>]*>(.*?)</dt>\s*<dd\b[^>]*>(.*?)</dd>", re.I | re.S)
_ITEM = re.compile(r"<(\w+)\b[^>]*\bitemprop\s*=\s*[\"']([^\"']+)[\"'][^>]*?(?:\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*)?>([^<]*)", re.I | re.S)
_TAG = re.compile(r"<[^>]+>")


def _plain(x: str) -> str:
    return " ".join(unescape(_TAG.sub(" ", x)).split())


def page_attributes(html: str | None) -> list[tuple[str, str, str]]:
    """(kind, key, value) of microdata properties, table rows and definition lists; keys up to 80 and values up to 250 characters."""
    if not html:
        return []
    out = []
    if re.search(r"itemtype\s*=\s*[\"'][^\"']*Product", html, re.I):
        out += [("microdata", name, _plain(content or text)) for _, names, content, text in _ITEM.findall(html) for name in names.split()]
    for row in _ROW.findall(html):
        cells = [_plain(c) for c in _CELL.findall(row)]
        if len(cells) == 2:
            out.append(("table", *cells))
    out += [("list", _plain(k), _plain(v)) for k, v in _TERM.findall(html)]
    return [(kind, k.rstrip(": "), v) for kind, k, v in out if 0 < len(k) <= 80 and 0 < len(v) <= 250]


def _attributes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *a) for i, h in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True) for a in page_attributes(h)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["page_id", "kind", "key", "value"])


def table_attributes(pages: DataFrame) -> DataFrame:
    """page_id, kind, key, value; for pages without JSON-LD this is the fallback."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").filter(F.col("html").rlike("(?i)<t[hd]|<dt|itemprop"))
    return rows.mapInArrow(_attributes, "page_id long, kind string, key string, value string")


def price(x: F.Column | str) -> F.Column:
    """struct(amount, currency) of a price text: a sign or code and digits with thousands commas."""
    t = F.col(x) if isinstance(x, str) else x
    amount = F.replace(F.regexp_extract(t, "(\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)", 1), F.lit(",")).try_cast("double")
    code = F.upper(F.regexp_extract(t, "(?i)\\b(GBP|USD|EUR)\\b", 1))
    currency = F.when(code != "", code).when(t.contains("£"), "GBP").when(t.contains("€"), "EUR").when(t.contains("$"), "USD")
    return F.struct(amount.alias("amount"), currency.alias("currency"))


def plain_text(html: F.Column | str) -> F.Column:
    """Tags dropped, the common references decoded, white space as one space."""
    t = F.regexp_replace(F.col(html) if isinstance(html, str) else html, "(?is)<(script|style)\\b.*?</\\1>|<[^>]+>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, "\\s+", " "))
