"""Measurements and typed values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracet.functions.text import Name, col, present

# The units that are read, their spellings, conversions (factor, places) and confidences.
_MEASURE = r"(?i)(\d+(?:[.,]\d+)?)\s*(inches|inch|in|cm|mm|hz|tb|gb|kg|g|hours|hour|hrs|hr)?\b"
UNITS = {"in": "inch", "inch": "inch", "inches": "inch", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour"}
CONVERSIONS = {
    ("cm", "inch"): (1 / 2.54, 2), ("inch", "mm"): (25.4, 2), ("cm", "mm"): (10.0, 2), ("mm", "inch"): (1 / 25.4, 2), ("tb", "gb"): (1024.0, 2), ("g", "kg"): (0.001, 3),
}
CONFIDENCE = {"mapped": 0.98, "integer": 0.97, "boolean": 0.97, "screen": 0.96, "integer_measure": 0.95, "decimal_measure": 0.94, "rating": 0.94, "loose_integer": 0.92,
              "loose_decimal": 0.91, "text": 0.80, "unmapped": 0.35, "raw": 0.30, "malformed": 0.25}
TRUE_WORDS = ("yes", "true", "1")
FALSE_WORDS = ("no", "false", "0")
RETAIL_TRUE = ("yes", "true", "1", "y", "supported", "included", "with")
RETAIL_FALSE = ("no", "false", "0", "n", "not supported", "not included", "without")
PLAUSIBLE = {("tv", "refresh_rate_hz"): (24, 240), ("tv", "screen_size_inch"): (10, 120), ("tv", "hdmi_port_count"): (0, 12), ("monitor", "refresh_rate_hz"): (24, 500),
             ("monitor", "screen_size_inch"): (10, 60), ("monitor", "displayport_port_count"): (0, 6), ("laptop", "ram_gb"): (2, 512),
             ("laptop", "storage_capacity_gb"): (32, 8000), ("laptop", "display_size_inch"): (10, 20), ("laptop", "weight_kg"): (0.5, 10),
             ("refrigerator", "total_capacity_litre"): (40, 1500), ("refrigerator", "fridge_capacity_litre"): (20, 1200),
             ("refrigerator", "freezer_capacity_litre"): (0, 800), ("refrigerator", "width_mm"): (300, 2500), ("refrigerator", "height_mm"): (600, 2500),
             ("refrigerator", "depth_mm"): (300, 1500)}


def number(x: Name) -> Column:
    """The first number of a text whose unit, if any, ends at a word's end; null if there is none."""
    return F.replace(F.regexp_extract(F.trim(col(x)), _MEASURE, 1), F.lit(","), F.lit(".")).try_cast("double")


def unit(x: Name) -> Column:
    u = F.lower(F.regexp_extract(F.trim(col(x)), _MEASURE, 2))
    spelled = F.element_at(F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv]), u)
    return F.when(u != "", F.coalesce(spelled, u))


def converted(value: Column, from_unit: Column, to_unit: Column) -> Column:
    """value in another unit; the same if the units are equal, null if they don't convert."""
    out = F.when(from_unit == to_unit, value)
    for (a, b), (factor, places) in CONVERSIONS.items():
        out = out.when((from_unit == a) & (to_unit == b), F.round(value * factor, places))
    return out


def measured(x: Name, to_unit: str) -> Column:
    """The text's measure in a unit; a number without a known unit counts as being in it."""
    u = unit(x)
    return converted(number(x), F.coalesce(u, F.lit(to_unit)), F.lit(to_unit))


def screen_inches(x: Name) -> Column:
    return F.round(measured(x, "inch"), 0)


def whole(x: Name) -> Column:
    return F.when(F.trim(col(x)).rlike(r"^[+-]?\d{1,9}$"), F.trim(col(x)).try_cast("int"))


def truth(x: Name, yes: tuple[str, ...] = TRUE_WORDS, no: tuple[str, ...] = FALSE_WORDS) -> Column:
    t = F.lower(F.trim(col(x)))
    return F.when(t.isin(*yes), True).when(t.isin(*no), False)


def loose_number(x: Name) -> Column:
    """The first number anywhere."""
    return F.replace(F.regexp_extract(col(x), r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def ip_rating(x: Name) -> Column:
    code = F.regexp_extract(F.lower(F.regexp_replace(col(x), "[ _-]", "")), "ip([a-z0-9]{2,4})", 1)
    return F.when(code != "", F.concat(F.lit("IP"), F.upper(code)))


def bluetooth(x: Name) -> Column:
    v = F.regexp_extract(col(x), r"(\d+(?:\.\d+)?)", 1)
    return F.when(v != "", F.concat(F.lit("Bluetooth "), v))


def plausible(category: Column, attribute: Column, value: Column) -> Column:
    """Whether a value lies in its bounds; without bounds or a value it does."""
    out = F.when(value.isNull(), True)
    for (c, a), (low, high) in PLAUSIBLE.items():
        out = out.when((category == c) & (attribute == a), value.between(low, high))
    return out.otherwise(True)


def normalised(raw: Name, parser: Column, to_unit: Column, mapped: Column) -> Column:
    """struct(value, value_type, confidence, notes) of a raw text by its attribute's parser.

    mapped: what the value table says of it, null if nothing.  parser: screen, integer_measure, decimal_measure,
    integer, boolean, text, or null for an attribute that no schema has.
    """
    x = col(raw)
    n = converted(number(x), F.coalesce(unit(x), to_unit), to_unit)

    def out(value: Column, kind: str, confidence: str, notes: str = "") -> Column:
        return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("value_type"), F.lit(CONFIDENCE[confidence]).alias("confidence"), F.lit(notes).alias("notes"))

    def shown(value: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(value.cast("decimal(28,4)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")

    bad = out(x, "string", "malformed", "not a measure")
    return (
        F.when(parser.isNull(), out(x, "string", "unmapped", "not in the schema"))
        .when(mapped.isNotNull(), out(mapped, "string", "mapped"))
        .when(parser == "screen", F.when(n.isNull(), bad).otherwise(out(F.round(n, 0).cast("long"), "decimal", "screen")))
        .when(parser == "integer_measure", F.when(n.isNull(), bad).otherwise(out(F.round(n, 0).cast("long"), "integer", "integer_measure")))
        .when(parser == "decimal_measure", F.when(n.isNull(), bad).otherwise(out(shown(n), "decimal", "decimal_measure")))
        .when(parser == "integer", F.when(whole(x).isNull(), out(x, "string", "raw")).otherwise(out(whole(x), "integer", "integer")))
        .when(parser == "boolean", F.when(truth(x).isNull(), out(x, "string", "raw")).otherwise(out(truth(x), "boolean", "boolean")))
        .otherwise(out(present(x), "string", "text"))
    )


