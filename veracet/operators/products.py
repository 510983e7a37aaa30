"""Products that pages describe: JSON-LD and microdata at any depth, else the page's own specification lists.

A page is parsed once, to a tree, by the standard library; pages come in Arrow batches, and each stands alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of properties and words of commerce.
_GTIN = ("gtin", "gtin13", "gtin14", "gtin12", "gtin8")
_MODEL = ("model", "mpn", "sku")
_RESERVED = frozenset("name title brand model mpn sku gtin gtin8 gtin12 gtin13 gtin14 price pricecurrency availability offers".split())
_COMMERCE = re.compile(r"add\s+to\s+(cart|basket)|buy\s+now|in\s+stock|price|sku|mpn|gtin|model", re.I)
_PRICE = re.compile(r"(GBP|EUR|USD|£|€|\$)\s*(\d[\d,]*(?:\.\d{1,2})?)|(\d[\d,]*(?:\.\d{1,2})?)\s*(GBP|EUR|USD)", re.I)
_SIGNS = {"£": "GBP", "€": "EUR", "$": "USD"}
_SPEC_BLOCK = re.compile(r"spec|tech|attribute|detail", re.I)
_BUY_CLASS = re.compile(r"price|add-to-cart|buy-now")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
MOST_KEY, MOST_VALUE = 80, 250


class _Element:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[_Element | str] = []

    def walk(self) -> Iterator[_Element]:
        """The elements within, in document order."""
        stack = [c for c in reversed(self.children) if not isinstance(c, str)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if not isinstance(c, str)]

    def text(self) -> str:
        out: list[str] = []
        stack: list[_Element | str] = [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif e.tag not in ("script", "style"):
                stack += reversed(e.children)
                out.append(" ")
        return " ".join("".join(out).split())


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.open[-1].tag in _ENDS.get(tag, ()):
            self.open.pop()
        e = _Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _said(value) -> str:
    """A JSON value as text: of a list its first that says something, of an object its name or value."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str | int | float):
        return str(value).strip()
    if isinstance(value, list):
        return next((x for v in value if (x := _said(v))), "")
    if isinstance(value, dict):
        return next((x for k in ("name", "value", "@value") if (x := _said(value.get(k)))), "")
    return ""


def _first(get, keys: tuple[str, ...]) -> str:
    return next((x for k in keys if (x := get(k))), "")


def _is_a(types, name: str) -> bool:
    """Whether any of the types, each given by a name or an address, is of this name."""
    types = types if isinstance(types, list) else [types]
    return any(isinstance(t, str) and re.split(r"[/#]", t.strip())[-1].lower() == name for t in types)


def _objects(value) -> Iterator[dict]:
    """All objects of a document, arrays and @graph opened to any depth, in order."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            yield v
            if "@graph" in v:
                stack.append(v["@graph"])


def _number(text: str) -> float | None:
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


def _offer(get) -> dict:
    return {"price": _number(get("price")), "currency": get("priceCurrency") or None, "availability": get("availability") or None}


def _product(get, origin: str) -> dict:
    attributes = {k: v for k in ("sku", "mpn", "model") if (v := get(k))}
    return {"origin": origin, "name": _first(get, ("name", "title")), "brand": get("brand"), "gtin": _first(get, _GTIN), "model": _first(get, _MODEL), "attributes": attributes, "offers": []}


def _listed(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def from_json(document) -> list[dict]:
    """The products of one JSON-LD document; offers given by @id are looked up in it."""
    objects = list(_objects(document))
    by_id = {o["@id"]: o for o in objects if _is_a(o.get("@type"), "offer") and isinstance(o.get("@id"), str)}
    out = []
    for o in objects:
        if not _is_a(o.get("@type"), "product"):
            continue
        p = _product(lambda k, o=o: _said(o.get(k)), "json-ld")
        for extra in _listed(o.get("additionalProperty")):
            if isinstance(extra, dict):
                key, value = _said(extra.get("name")) or _said(extra.get("propertyID")), _said(extra.get("value"))
                if key and value:
                    p["attributes"][key] = value
        for offer in _listed(o.get("offers")):
            if isinstance(offer, dict) and not _is_a(offer.get("@type"), "offer"):
                offer = by_id.get(offer.get("@id"))
            if isinstance(offer, dict):
                p["offers"].append(_offer(lambda k, offer=offer: _said(offer.get(k))))
        out.append(p)
    return out


def _properties(scope: _Element) -> list[tuple[str, _Element]]:
    """(property, element) of an item; those of items within it are theirs."""
    out = []
    stack = [c for c in reversed(scope.children) if not isinstance(c, str)]
    while stack:
        e = stack.pop()
        out += [(name.lower(), e) for name in e.attrs.get("itemprop", "").split()]
        if "itemscope" not in e.attrs:
            stack += [c for c in reversed(e.children) if not isinstance(c, str)]
    return out


def _value(e: _Element) -> str:
    if "itemscope" in e.attrs:
        return next((x for k in ("name", "value") for n, inner in _properties(e) if n == k and (x := _value(inner))), "")
    return " ".join(e.attrs["content"].split()) if e.attrs.get("content") else e.text() or e.attrs.get("href", "")


def from_microdata(root: _Element) -> list[dict]:
    out = []
    for item in root.walk():
        if "itemscope" not in item.attrs or not _is_a(item.attrs.get("itemtype", "").split(), "product"):
            continue
        found = _properties(item)
        get = lambda k, found=found: next((x for n, e in found if n == k.lower() and (x := _value(e))), "")
        p = _product(get, "microdata")
        for name, e in found:
            if name == "additionalproperty" and "itemscope" in e.attrs:
                inner = {n: _value(x) for n, x in reversed(_properties(e))}
                key, value = inner.get("name") or inner.get("propertyid"), inner.get("value")
            else:
                key, value = name, "" if name in _RESERVED or "itemscope" in e.attrs else _value(e)
            if key and value:
                p["attributes"][key] = value
        for name, e in found:
            if name == "offers":
                inner = _properties(e)
                p["offers"].append(_offer(lambda k, inner=inner: next((x for n, v in inner if n == k.lower() and (x := _value(v))), "")))
        if not p["offers"] and get("price"):
            p["offers"].append(_offer(get))
        out.append(p)
    return out


def specifications(root: _Element) -> dict[str, str]:
    """Keys and values of table rows, definition lists, and lines 'key: value' in blocks that are named for them."""
    pairs: list[tuple[str, str]] = []
    for e in root.walk():
        inner = [c for c in e.children if not isinstance(c, str)]
        if e.tag == "tr":
            cells = [c for c in inner if c.tag in ("td", "th")]
            if len(cells) > 1:
                pairs.append((cells[0].text(), cells[1].text()))
        elif e.tag == "dl":
            pairs += [(a.text(), b.text()) for a, b in zip(inner, inner[1:], strict=False) if (a.tag, b.tag) == ("dt", "dd")]
        if _SPEC_BLOCK.search(f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"):
            for line in e.walk():
                if line.tag in ("li", "p", "div", "span"):
                    key, colon, value = line.text().partition(":")
                    if colon:
                        pairs.append((key, value))
    out: dict[str, str] = {}
    for key, value in pairs:
        key, value = key.strip().rstrip(":").strip(), value.strip()
        if 0 < len(key) <= MOST_KEY and 0 < len(value) <= MOST_VALUE:
            out[next((k for k in out if k.lower() == key.lower()), key)] = value
    return out


def from_specifications(root: _Element) -> list[dict]:
    """The one product of a page that says it is for sale and lists two properties at least, or a model or gtin."""
    title = next((t for e in root.walk() if e.tag == "h1" and (t := e.text())), "") or next(
        (e.attrs.get("content", "").strip() for e in root.walk() if e.tag == "meta" and "og:title" in (e.attrs.get("property"), e.attrs.get("name"))), ""
    )
    attributes = specifications(root)
    low = {k.lower(): v for k, v in attributes.items()}
    get = lambda *keys: next((low[k] for k in keys if low.get(k)), "")
    model, gtin = get("model", "model number", "model no", "mpn", "sku"), get("gtin", "ean", "upc")
    if not title or len(attributes) < 2 and not model and not gtin:
        return []
    text = root.text()
    if not _COMMERCE.search(text) and not any(e.attrs.get("itemprop") in ("price", "offers") or _BUY_CLASS.search(e.attrs.get("class", "")) for e in root.walk()):
        return []
    offers = []
    if m := _PRICE.search(text):
        sign = (m[1] or m[4]).upper()
        offers.append({"price": _number(m[2] or m[3]), "currency": _SIGNS.get(sign, sign), "availability": None})
    return [{"origin": "specification", "name": title, "brand": get("brand", "manufacturer"), "gtin": gtin, "model": model, "attributes": attributes, "offers": offers}]


def _one(a: dict, b: dict) -> bool:
    same = lambda k: bool(a[k]) and a[k].lower() == b[k].lower()
    return same("gtin") or same("brand") and (same("model") or same("name"))


def merged(found: list[dict]) -> list[dict]:
    """Products that are one, by gtin, or brand with model or name: the first text there is of each field, the last value of
    each attribute, and each different offer."""
    out: list[dict] = []
    for p in found:
        if not (p["name"] or p["gtin"] or p["model"] or p["attributes"]):
            continue
        into = next((o for o in out if _one(o, p)), None)
        if into is None:
            out.append(p)
            continue
        for field in ("name", "brand", "gtin", "model"):
            into[field] = into[field] or p[field]
        into["attributes"] |= p["attributes"]
        into["offers"] += [o for o in p["offers"] if o not in into["offers"]]
    return out


def page_products(html: str | None) -> list[dict]:
    if not html:
        return []
    root = _Tree(html).root
    found: list[dict] = []
    for e in root.walk():
        if e.tag == "script" and e.attrs.get("type", "").strip().lower() == "application/ld+json":
            body = "".join(c for c in e.children if isinstance(c, str))
            for text in (body, unescape(body)):
                try:
                    found += from_json(json.loads(text))
                    break
                except (ValueError, RecursionError):
                    continue
    return merged(found + from_microdata(root)) or from_specifications(root)


_FIELDS = ("name", "brand", "gtin", "model")
_TYPE = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("product_no", pa.int32()), ("origin", pa.string()), *[(f, pa.string()) for f in _FIELDS], ("attributes", pa.map_(pa.string(), pa.string())),
     ("offers", pa.list_(pa.struct([("price", pa.float64()), ("currency", pa.string()), ("availability", pa.string())])))]
)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            for n, p in enumerate(page_products(html), 1):
                rows.append({"page_id": page_id, "url": url, "product_no": n, **p, **{f: p[f] or None for f in _FIELDS}, "attributes": list(p["attributes"].items())})
        yield pa.RecordBatch.from_pylist(rows, schema=_TYPE)


def extract_products(pages: DataFrame) -> DataFrame:
    """page_id, url, product_no, origin, name, brand, gtin, model, attributes (map) and offers of each product of each page.

    Microdata and JSON-LD products that are one are merged; a page with neither may have one by its specification
    lists.  Null and empty html, and broken JSON, have no products.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    columns = "page_id long, url string, product_no int, origin string, name string, brand string, gtin string, model string"
    return rows.mapInArrow(_extracted, f"{columns}, attributes map<string,string>, offers array<struct<price: double, currency: string, availability: string>>")


def source_products(extracted: DataFrame, source: str, category: str, definitions: DataFrame) -> DataFrame:
    """Extracted products as a source's: an id from source, address and number, and attributes split into those that the schema
    knows (mapped; keys compared without case, blanks as _) and the rest (unmapped).

    definitions: attribute (the schema's keys).
    """
    known = definitions.agg(F.collect_set(F.lower("attribute")).alias("_known"))  # a category's schema: tens of rows
    key = lambda k: F.regexp_replace(F.lower(F.trim(k)), "[\\s-]+", "_")
    rows = extracted.crossJoin(F.broadcast(known))
    identity = F.concat_ws("|", F.lit(source), F.lit(category), F.col("url"), F.col("product_no").cast("string"))
    return rows.select(
        F.concat(F.lit("sp_"), F.substring(F.sha2(identity, 256), 1, 16)).alias("source_product_id"), F.lit(source).alias("source"), F.lit(category).alias("category"), "url", "name", "brand", "gtin", "model",
        F.transform_keys(F.map_filter("attributes", lambda k, v: F.array_contains("_known", key(k))), lambda k, v: key(k)).alias("mapped"),
        F.map_filter("attributes", lambda k, v: ~F.array_contains("_known", key(k))).alias("unmapped"), "offers",
    )
