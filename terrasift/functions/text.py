"""Column functions on names, ids, tags and numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what is left of them. Spark has no
#: Unicode decomposition; other scripts keep their letters and are then dropped.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
_COMBINING = "[\\u0300-\\u036f]"


def area_key(name: Column) -> Column:
    """The key of an area's name: lower case without marks, cut at the first comma,
    without brackets, "city of" and "city", with santo and santa written out."""
    x = F.lower(F.coalesce(name.cast("string"), F.lit("")))
    x = F.translate(F.regexp_replace(x, _COMBINING, ""), MARKED, PLAIN)
    x = F.substring_index(x, ",", 1)
    for pattern, put in (
        (r"\([^)]*\)", " "),
        (r"^city\s+of\s+", ""),
        (r"\bcity\b", " "),
        (r"\bsto\.?\b", "santo"),
        (r"\bsta\.?\b", "santa"),
        (r"[^a-z0-9]+", " "),
    ):
        x = F.regexp_replace(x, pattern, put)
    return F.trim(x)


def property_type(value: Column) -> Column:
    """Runs of a-z and 0-9 joined by underscores; null gives the empty string."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)), "_")


def number(value: Column) -> Column:
    """The number in a text with currency signs, units and separators, or null."""
    return F.nullif(F.regexp_replace(value.cast("string"), r"[^0-9.\-]", ""), F.lit("")).try_cast("double")


def finite(value: Column) -> Column:
    """A double whose NaN and infinities are null."""
    x = value.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def timestamp(value: Column) -> Column:
    return F.try_to_timestamp(value.cast("string"))


def unit_price(price: Column, total: Column, area: Column) -> Column:
    """The price per area that is given, else the total over a non-zero area."""
    return F.coalesce(price, F.try_divide(total, F.nullif(area, F.lit(0.0))))


def osm_id(value: Column) -> Column:
    """See config.normalise_osm_id; null where the text is no id."""
    named = r"(?i)(node|way|relation)[\s/:]*(\d+)"
    short = r"^\s*([NWRnwr]?)\s*(\d+)\s*$"
    part = lambda p, i: F.nullif(F.regexp_extract(value, p, i), F.lit(""))
    long = F.concat(F.upper(F.substring(part(named, 1), 1, 1)), part(named, 2))
    bare = F.concat(F.upper(F.coalesce(part(short, 1), F.lit("R"))), part(short, 2))
    return F.coalesce(long, bare)


def slug(place: Column) -> Column:
    return F.replace(F.lower(F.trim(F.substring_index(place, ",", 1))), F.lit(" "), F.lit("_"))


def place_norm(place: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(place, F.lit(","), F.lit(" "))), r"\s+", " "))


def matches_tags(tags: Column, wanted: dict[str, object]) -> Column:
    """Whether a map of tag to list of values has one of the wanted values; True asks for any."""
    out = F.lit(False)
    for key, values in wanted.items():
        own = tags[key]
        if values is True:
            hit = own.isNotNull()
        else:
            hit = F.arrays_overlap(own, F.array(*(F.lit(str(v)) for v in (values if isinstance(values, list) else [values]))))
        out = out | F.coalesce(hit, F.lit(False))
    return out


def first_tag(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def contains_all(text: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & text.contains(t)
    return out


def filled(value: Column) -> Column:
    """Whether a text is there and not blank."""
    return F.coalesce(F.trim(value) != "", F.lit(False))


def cell_status(connector: Column, in_metro: Column) -> Column:
    return F.when(connector, "connector").when(in_metro, "in metro").otherwise("outside metro")
