"""URL functions over columns.  A text without scheme and host gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracet.functions.text import Name, col

# Query parameters that only track a visitor, neutral and known market tokens.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "ref", "ref_src", "referrer", "source", "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_source", "utm_term")
MARKETS = {"uk": ("uk", "gb"), "gb": ("gb", "uk"), "us": ("us",), "ie": ("ie",), "eu": ("eu",)}
NEUTRAL = ("global", "intl", "international", "row")
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?"


def part(url: Name, which: int) -> Column:
    return F.regexp_extract(F.coalesce(col(url), F.lit("")), _URL, which)


def scheme(url: Name) -> Column:
    return F.lower(part(url, 1))


def host(url: Name) -> Column:
    return F.lower(part(url, 2))


def path(url: Name) -> Column:
    return part(url, 4)


def query(url: Name) -> Column:
    return F.regexp_replace(part(url, 5), r"^\?", "")


def site(url: Name) -> Column:
    """The host without www. and a last dot."""
    return F.regexp_replace(F.regexp_replace(host(url), r"\.$", ""), r"^www\.", "")


def normalise(url: Name, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case scheme and host, no default port, no last slash, no fragment, no tracking, parameters sorted."""
    port = part(url, 3)
    plain = (port == "") | ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    trimmed = F.regexp_replace(path(url), "/+$", "")
    where = F.concat(scheme(url), F.lit("://"), host(url), F.when(plain, "").otherwise(F.concat(F.lit(":"), port)), F.when(trimmed == "", "/").otherwise(trimmed))
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*tracking))
    keyed = F.array_sort(F.transform(pairs, lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("k"), p.alias("p"))))
    rest = F.array_join(F.transform(keyed, lambda p: p["p"]), "&")
    return F.when(host(url) != "", F.when(rest == "", where).otherwise(F.concat(where, F.lit("?"), rest)))


def frontier_id(kind: Name, source: Name, category: Name, url: Name) -> Column:
    """A queue item's id: the url counts without query and fragment."""
    bare = F.concat(scheme(url), F.lit("://"), host(url), path(url))
    return F.concat_ws(":", col(kind), col(source), col(category), F.substring(F.sha2(bare, 256), 1, 16))


def base(url: Name) -> Column:
    """scheme://host[:port]/path without a last slash; the trimmed lower-case text if that can't be read."""
    port = part(url, 3)
    at = F.concat(scheme(url), F.lit("://"), host(url), F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)), F.regexp_replace(path(url), "/+$", ""))
    return F.when(host(url) != "", at).otherwise(F.lower(F.trim(col(url))))


def resolved(href: Name, page: Name) -> Column:
    """A link's address seen from a page; null for fragments, mail and scripts.  ``.`` and ``..`` are resolved."""
    h, p = F.trim(col(href)), col(page)
    root = F.concat(scheme(p), F.lit("://"), part(p, 2), F.when(part(p, 3) == "", "").otherwise(F.concat(F.lit(":"), part(p, 3))))
    folder = F.regexp_replace(path(p), "[^/]*$", "")
    at = (
        F.when(F.lower(h).rlike(r"^(#|mailto:|javascript:|tel:|data:)") | (h == ""), F.lit(None).cast("string"))
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme(p), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, path(p), h))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), h))
    )
    segments = F.slice(F.split(F.regexp_extract(at, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/"), 2, 1 << 20)
    start = F.array().cast("array<string>")
    walked = F.aggregate(
        segments, start,
        lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))),
    )
    dotted = at.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/\.\.?(/|$|\?|#)")
    head, tail = F.regexp_extract(at, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1), F.regexp_extract(at, r"([?#].*)$", 1)
    return F.when(dotted, F.concat(head, F.lit("/"), F.array_join(walked, "/"), tail)).otherwise(at)


def locale(segment: Name) -> Column:
    """xx-yy of a text that is a language and a region, else null."""
    s = F.lower(col(segment))
    return F.when(s.rlike("^[a-z]{2}[-_][a-z]{2}$"), F.replace(s, F.lit("_"), F.lit("-")))


def market_tokens(url: Name) -> Column:
    """Host labels and path segments that name a market or locale, without neutral ones."""
    known = sorted({m for ms in MARKETS.values() for m in ms})
    words = F.array_union(F.split(host(url), r"\."), F.filter(F.split(F.lower(path(url)), "/"), lambda s: s != ""))
    kept = F.filter(words, lambda w: w.isin(*known) | w.rlike("^[a-z]{2}[-_][a-z]{2}$"))
    return F.array_sort(F.array_distinct(F.filter(kept, lambda w: ~w.isin(*NEUTRAL))))


def contradicts_market(url: Name, allowed: list[str]) -> Column:
    """Whether the url names markets, and none that is allowed."""
    ok = sorted({m for a in allowed for m in MARKETS.get(a.lower(), (a.lower(),))})
    found = F.transform(market_tokens(url), lambda t: F.when(F.length(t) == 5, F.substring(t, 4, 2)).otherwise(t))
    return (F.size(found) > 0) & ~F.arrays_overlap(found, F.array(*map(F.lit, ok)))


def is_sitemap(url: Name) -> Column:
    p = F.lower(path(url))
    return p.endswith(".xml") & p.contains("sitemap")


def is_product(url: Name) -> Column:
    return F.lower(path(url)).rlike("/(product|products|p|item)/")


def is_listing(url: Name) -> Column:
    return F.lower(path(url)).rlike("/(category|categories|collections|browse)/|/search")


def url_pattern(url: Name) -> Column:
    """The first segment of the path as a pattern: /segment/."""
    first = F.regexp_extract(path(url), "^/([^/]+)", 1)
    return F.when(first != "", F.concat(F.lit("/"), F.lower(first), F.lit("/")))


def inferred_market(url: Name) -> Column:
    """Market of an address, by its suffix or first segment."""
    h, p = host(url), F.lower(path(url))
    return (
        F.when(h.endswith(".co.uk") | h.endswith(".uk") | p.rlike("^/(uk|en-gb)(/|$)"), "UK")
        .when(h.endswith(".ie") | p.rlike("^/(ie|en-ie)(/|$)"), "IE")
        .when(h.endswith(".us") | p.rlike("^/(us|en-us)(/|$)"), "US")
    )


def robots_blocked(url_path: Name, disallow: list[str], allow: list[str]) -> Column:
    """Whether the longest fitting disallow prefix is longer than the longest fitting allow prefix."""
    p = F.lower(col(url_path))

    def longest(prefixes: list[str]) -> Column:
        return F.greatest(F.lit(0), F.lit(0), *[F.when(p.startswith(x.lower()), len(x)).otherwise(0) for x in prefixes if x])

    return longest(disallow) > longest(allow)


def host_in(url: Name, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    out = F.lit(False)
    for d in domains:
        out = out | (host(url) == d.lower()) | host(url).endswith(f".{d.lower()}")
    return out


def is_private(address: Name) -> Column:
    """Loopback, private and link-local addresses and names."""
    h = F.lower(col(address))
    return (h == "localhost") | h.endswith(".local") | h.rlike(r"^(10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$|^172\.(1[6-9]|2\d|3[01])\.\d+\.\d+$")


def link_allowed(
    url: Name, depth: Column, hosts: list[str], max_depth: int = 3, excluded: tuple[str, ...] = (), entry_pages: tuple[str, ...] = (), allowed_prefixes: tuple[str, ...] = (),
    markets: list[str] | None = None, product_patterns: tuple[str, ...] = (), listing_patterns: tuple[str, ...] = (),
) -> Column:
    """The rules in order: scheme, depth and host; excluded prefixes; explicit pages; market; patterns; else open only
    without prefixes and entry pages."""
    p, u = F.lower(path(url)), F.lower(col(url))
    starts = lambda xs: [p.startswith(x.lower()) for x in xs]
    any_of = lambda xs: F.exists(F.array(F.lit(False), *xs), lambda x: x)
    holds = [u.contains(x.lower()) for x in (*product_patterns, *listing_patterns)]
    return (
        F.when(~scheme(url).isin("http", "https") | (depth > max_depth) | ~host_in(url, hosts), False)
        .when(any_of(starts(excluded)), False)
        .when(any_of([normalise(url) == x for x in entry_pages] + starts(allowed_prefixes)), True)
        .when(contradicts_market(url, markets) if markets else F.lit(False), False)
        .when(is_sitemap(url) | any_of(holds), True)
        .otherwise(F.lit(not allowed_prefixes and not entry_pages))
    )
