"""Names, keys and attribute wordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONDITION_WORDS, ROD_ACTION, ROD_POWER, VARIANT_ATTRIBUTES
from .basics import blank_to_null, group, lookup


def _key(text: Column, mark: str) -> Column:
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", mark)
    return F.regexp_replace(joined, f"^{mark}+|{mark}+$", "")


def slugify(text: Column) -> Column:
    """URL name of a title; ``item`` where nothing is left."""
    slug = _key(F.coalesce(text, F.lit("")), "-")
    return F.when(slug == "", F.lit("item")).otherwise(slug)


def brand_key(text: Column) -> Column:
    return F.nullif(_key(text, "_"), F.lit(""))


def canonical_brand(text: Column, aliases: dict[str, str]) -> Column:
    """The alias table's name of a brand, else the trimmed text."""
    return F.coalesce(lookup(aliases, brand_key(text)) if aliases else F.lit(None).cast("string"), F.trim(text))


def color_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", "_")


def pack_count(text: Column) -> Column:
    return group(text, r"(?i)(\d+)[- ]?(pack|pk|ct|count)\b").try_cast("int")


def rod_length_in(text: Column) -> Column:
    """Inches of a length such as 7'6"."""
    pattern = r"(\d+)\s*'\s*(\d+)?"
    feet = group(text, pattern).try_cast("int")
    return feet * 12 + F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(0))


def _half(text: Column, number: int) -> Column:
    parts = F.split(text, " - ")
    return F.when(F.size(parts) == 2, F.lower(F.trim(F.get(parts, F.lit(number)))))


def rod_power(text: Column) -> Column:
    return lookup(ROD_POWER, _half(text, 0))


def rod_action(text: Column) -> Column:
    return lookup(ROD_ACTION, _half(text, 1))


def condition_of(wording: Column, default_new: bool = True) -> Column:
    """Condition of a page's wording: blank is new (or null), an unknown wording null."""
    plain = F.lower(F.trim(wording))
    blank = F.coalesce(plain, F.lit("")) == ""
    return F.when(blank, F.lit("NEW" if default_new else None).cast("string")).otherwise(lookup(CONDITION_WORDS, plain))


def variant_key(category: Column, attributes: Column) -> Column:
    """``k=v|k=v`` of a category's attributes (a string map); null if one is missing or empty."""
    out = F.lit(None).cast("string")
    for name, keys in VARIANT_ATTRIBUTES.items():
        parts = [F.concat(F.lit(f"{k}="), F.nullif(F.try_element_at(attributes, F.lit(k)), F.lit(""))) for k in keys]
        joined = parts[0]
        for p in parts[1:]:
            joined = F.concat(joined, F.lit("|"), p)
        out = F.when(category == name, joined).otherwise(out)
    return out


def rod_attributes(style: Column) -> Column:
    """Attribute map of a rod from its raw style map: names are matched by what they contain, the
    last one that gives a value wins, and "casting" in any value fixes the type."""
    entries = F.map_entries(style)

    def last(words: tuple[str, ...], value) -> Column:
        hits = F.filter(entries, lambda e: F.lower(e["key"]).rlike("|".join(words)) & value(e["value"]).isNotNull())
        return F.when(F.size(hits) > 0, value(F.element_at(hits, -1)["value"]))

    kinds = F.exists(entries, lambda e: F.lower(e["value"]).contains("casting"))
    made = F.create_map(
        F.lit("rod_type"), F.when(kinds, F.lit("casting")).otherwise(last(("type",), lambda v: F.lower(blank_to_null(v)))),
        F.lit("length_in"), last(("length",), lambda v: rod_length_in(v).cast("string")),
        F.lit("power"), last(("power",), rod_power),
        F.lit("action"), last(("power", "taper", "action"), rod_action),
        F.lit("pieces"), last(("piece",), lambda v: group(v, r"(\d+)")),
    )
    return F.map_filter(made, lambda k, v: v.isNotNull())


def bait_attributes(color: Column, title: Column) -> Column:
    made = F.create_map(F.lit("color_key"), F.nullif(color_key(color), F.lit("")), F.lit("unit_count"), pack_count(title).cast("string"))
    return F.map_filter(made, lambda k, v: v.isNotNull())
