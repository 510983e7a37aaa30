"""Text functions over columns: names, values, tokens and labels.  Blank text counts as missing everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str | Column


def col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(x: Name) -> Column:
    """The trimmed text, null if blank."""
    t = F.trim(col(x))
    return F.when(t != "", t)


def is_blank(x: Name) -> Column:
    return present(x).isNull()


def attribute_name(x: Name) -> Column:
    """Lower case; white space and ``_ - / \\ |`` part words, other signs vanish, words are one space apart."""
    parted = F.regexp_replace(F.lower(F.trim(col(x))), r"[\s_\-/\\|]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(parted, r"[^\p{L}\p{Nd} ]", ""), " +", " "))


def attribute_key(x: Name) -> Column:
    """The key an attribute has that no alias names."""
    return F.replace(attribute_name(x), F.lit(" "), F.lit("_"))


def value_key(x: Name) -> Column:
    """The form in which values are looked up: as attribute names, but the backslash and bar vanish too."""
    parted = F.regexp_replace(F.lower(F.trim(col(x))), r"[\s_\-/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(parted, r"[^\p{L}\p{Nd} ]", ""), " +", " "))


def fingerprint_text(x: Name) -> Column:
    """Lower case with each run of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col(x))), r"[^\p{L}\p{Nd}]+", " "))


def tokens(*xs: Name) -> Column:
    """The distinct tokens of the fingerprint texts."""
    joined = F.concat_ws(" ", *[fingerprint_text(x) for x in xs])
    return F.array_distinct(F.filter(F.split(joined, " "), lambda t: t != ""))


def key_tokens(x: Name) -> Column:
    """The distinct words of an attribute key."""
    return F.array_distinct(F.filter(F.split(F.lower(F.translate(col(x), "_-", "  ")), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens, to 4 places; 0 if a side has none."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / union, 4))


def text_similarity(a: Name, b: Name) -> Column:
    """1 if equal, 0.9 if one holds the other, else token similarity; 0 if a side is empty."""
    x, y = F.coalesce(fingerprint_text(a), F.lit("")), F.coalesce(fingerprint_text(b), F.lit(""))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.9)
        .otherwise(jaccard(tokens(a), tokens(b)))
    )


def name_key(x: Name) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(col(x)), r"[^\p{L}\p{Nd}]", "")


def title_case(x: Name) -> Column:
    return F.initcap(F.lower(F.translate(F.trim(col(x)), "_-", "  ")))


def label(key: Name) -> Column:
    return F.initcap(F.replace(col(key), F.lit("_"), F.lit(" ")))


def first_present(*xs: Name) -> Column:
    return F.coalesce(*[present(x) for x in xs], F.lit(""))


def shown(value: Name, unit: Name | None = None) -> Column:
    """A value with its unit, ``-`` if missing."""
    text = present(value)
    if unit is not None:
        text = F.concat_ws(" ", text, F.when(text.isNotNull(), present(unit)))
    return F.when(present(value).isNull(), "-").otherwise(text)


def change_summary(attribute: Name, old: Name, new: Name) -> Column:
    """What a change is, in words, by which of its values are there."""
    a, o, n = col(attribute), present(old), present(new)
    return (
        F.when(o.isNull() & n.isNull(), F.concat(a, F.lit(" is unset")))
        .when(o.isNull(), F.concat(a, F.lit(" set to "), n))
        .when(n.isNull(), F.concat(a, F.lit(" cleared from "), o))
        .otherwise(F.concat(a, F.lit(" changed from "), o, F.lit(" to "), n))
    )


def path_source(path: Name) -> Column:
    """NAME of ``source:NAME|path``, else unknown-source."""
    return F.coalesce(present(F.regexp_extract(F.coalesce(col(path), F.lit("")), r"^source:([^|]*)\|", 1)), F.lit("unknown-source"))


def plural(slug: Name) -> Column:
    s = col(slug)
    return F.when(s.endswith("y"), F.concat(F.regexp_replace(s, "y$", ""), F.lit("ies"))).when(s.endswith("s"), s).otherwise(F.concat(s, F.lit("s")))


def slug(x: Name) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(col(x))), r"[^a-z0-9]+", "-"), F.lit("-"))


def value_list(xs: Name) -> Column:
    """Trimmed, without blanks and repeats of any case, sorted; in lower case."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(col(xs), lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def scope_fingerprint(market: Name, locale: Name, categories: Name, brands: Name) -> Column:
    def one(x: Name) -> Column:
        return F.lower(F.coalesce(present(x), F.lit("")))

    def many(x: Name) -> Column:
        return F.array_join(value_list(x), ",")

    parts = [("market:", one(market)), ("locale:", one(locale)), ("categories:", many(categories)), ("brands:", many(brands))]
    return F.concat_ws("|", *[F.concat(F.lit(k), v) for k, v in parts])


def value_type(x: Name) -> Column:
    """boolean, integer, decimal or string, by what the text reads as."""
    t = F.lower(F.trim(col(x)))
    return (
        F.when(t.isin("true", "false"), "boolean")
        .when(t.rlike(r"^[+-]?\d{1,9}$"), "integer")
        .when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), "decimal")
        .otherwise("string")
    )


def category_key(x: Name) -> Column:
    return F.lower(F.translate(F.trim(col(x)), "- ", "__"))


def evidence_strength(x: Name) -> Column:
    s = F.lower(F.trim(col(x)))
    return F.when(s == "explicit", 3).when(s == "request_hint", 2).when(s == "ambiguous", 1).otherwise(0)


def suggestion_score(raw: Name, key: Name, unit: Name) -> Column:
    """How well a raw attribute name fits a schema attribute, at most 0.99."""
    r, k = key_tokens(raw), key_tokens(key)
    base = jaccard(r, k)
    base += F.when((F.size(r) > 0) & (F.size(F.array_except(r, k)) == 0), 0.20).otherwise(0.0)
    base += F.when(F.arrays_overlap(r, F.array(F.lit("inch"), F.lit("inches"))) & (col(unit) == "inch"), 0.20).otherwise(0.0)
    base += F.when(F.array_contains(r, "screen") & F.array_contains(k, "screen"), 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(0.99), base), 2)


def content_hash(x: Name) -> Column:
    return F.upper(F.sha2(col(x), 256))


def short_id(prefix: Name, *parts: Name) -> Column:
    """``prefix:`` and the first 16 hex digits of the parts' hash."""
    return F.concat(col(prefix), F.lit(":"), F.substring(content_hash(F.concat_ws("|", *[F.coalesce(col(p), F.lit("")) for p in parts])), 1, 16))
