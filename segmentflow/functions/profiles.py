"""Profile names: public names of legacy ones, display order, families, slugs and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display order, legacy names, families and market prefixes.
PROFILE_ORDER = [
    "Champions",
    "High-Value Regulars",
    "Loyalists",
    "Valuable Customers at Risk",
    "Mid-Tier Occasionals",
    "Occasional Buyers at Risk",
    "Light Buyers",
    "Light Buyers at Risk",
    "Hibernating / Lost",
]
LEGACY_NAMES = {
    "Champions at Risk": "Valuable Customers at Risk",
    "Loyalist at Risk": "Valuable Customers at Risk",
    "Mid-Tier Occasional": "Mid-Tier Occasionals",
    "Occasional at Risk": "Occasional Buyers at Risk",
    "Developing": "Light Buyers",
    "Developing at Risk": "Light Buyers at Risk",
}
FAMILIES = {
    "High-Value Regulars": "Champions",
    "Valuable Customers at Risk": "Loyalists",
    "Mid-Tier Occasional": "Mid-Tier Occasionals",
    "Occasional Buyers at Risk": "Mid-Tier Occasionals",
    "Light Buyers": "Developing",
    "Light Buyers at Risk": "Developing",
}
SEPARATOR = " · "


def _mapped(c: Column, names: dict[str, str]) -> Column:
    chain = None
    for old, new in names.items():
        chain = F.when(c == old, new) if chain is None else chain.when(c == old, new)
    return chain.otherwise(c)


def public_name(name: Column) -> Column:
    text = F.coalesce(name, F.lit(""))
    head = F.substring_index(text, SEPARATOR, 1)
    tail = F.when(text.contains(SEPARATOR), F.substring(text, F.length(head) + 1, F.length(text))).otherwise(F.lit(""))
    return F.when(text.startswith("Champions" + SEPARATOR), "High-Value Regulars").otherwise(
        F.concat(_mapped(head, LEGACY_NAMES), tail)
    )


def base_name(name: Column) -> Column:
    return F.substring_index(public_name(name), SEPARATOR, 1)


def family(name: Column) -> Column:
    return _mapped(base_name(name), FAMILIES)


def display_rank(name: Column) -> Column:
    """Place in the display order, unknown names last."""
    place = F.array_position(F.array(*[F.lit(n) for n in PROFILE_ORDER]), base_name(name))
    return F.when(place == 0, len(PROFILE_ORDER)).otherwise(place - 1).cast("int")


def value_band(revenue: Column) -> Column:
    return F.when(revenue < 250, "<250").when(revenue < 750, "250-750").when(revenue < 2000, "750-2000").otherwise("2000+")


def confidence_band(score: Column, is_baseline: Column) -> Column:
    return (
        F.when(is_baseline, "Baseline").when(score < 0.55, "<0.55").when(score < 0.75, "0.55-0.75").otherwise("0.75+")
    )


def firmographic_label(market: Column, segment: Column) -> Column:
    return F.concat(market, F.lit(" / "), segment)
