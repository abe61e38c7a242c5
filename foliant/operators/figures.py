"""What makes a figure unfit for use, what it is of, and the technology and class of a link."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .quantities import occurrences, performance

__all__ = ["occurrences", "performance", "power_guard", "rate_guard", "power_scope", "technology_family", "link_class"]

# What makes a power or a rate no exact operating point, in the order in which it is looked for.
BOUND = r"(?i)(?:<|>|≤|≥|sub[- ]?|under\s+|below\s+|above\s+|up\s+to\s+|less\s+than\s+|more\s+than\s+|at\s+most\s+|at\s+least\s+)\s*(?:about|approximately|approx\.?|~)?\s*[-+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*"
POWER_GUARDS = (
    ("bounded_power", BOUND + r"(?:[µμu]?w|mw)\b"),
    ("already_normalized_power_per_rate", r"(?i)\b(?:[µμu]?w|mw)\s*/\s*(?:g(?:b|bps|bit(?:/s)?)|gb/s)\b"),
    ("inactive_state_power", r"(?i)\b(?:off[- ]?state|standby|sleep[- ]mode|idle[- ]mode)\b"),
    ("per_channel_power_scope", r"(?i)\b(?:[µμu]?w|mw)\s*/\s*(?:ch(?:annel)?|lane)\b|\b(?:[µμu]?w|mw)\b.{0,25}\bper\s+channel\b"),
    ("non_consumption_power", r"(?i)\boma\b|optical\s+modulation\s+amplitude|optical\s+(?:output\s+)?power|laser\s+(?:output\s+)?power|\bpout\b|radiated\s+power|eirp"),
    ("subblock_power", r"(?i)wavelength[- ]stabili[sz]ation|thermal\s+tuning|heater\s+power|auxiliary\s+power|front[- ]end\s+only|equalizer\s+only|clock(?:ing)?\s+only|excluding\s+(?:the\s+)?(?:cdr|pll|driver|tia|frontend|front[- ]end)"),
)
RATE_GUARDS = (
    ("bounded_rate", BOUND + r"(?:[tg]b\s*/\s*s|[tg]bps|[tg]bit\s*/\s*s)\b"),
    ("rate_range_without_operating_point", r"(?i)(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(?:(?:-|–)\s*to\s*(?:-|–)|to|[-–])\s*(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(?:[tg]b\s*/\s*s|[tg]bps|[tg]bit\s*/\s*s)\b"),
)
LANE_POWER = r"(?i)\b(?:per|each)\s+lane\b|\blane[- ]power\b"
WHOLE_POWER = r"(?i)\b(?:total|aggregate|overall|entire|full[- ]link)\b|\b(?:transceiver|receiver|transmitter|chip|design)\s+(?:core\s+)?(?:consumes?|dissipates?)\b"
FAMILIES = (("BiCMOS", r"(?i)\b(?:bi[\s-]?cmos|si[\s-]*ge)\b"), ("CMOS", r"(?i)\b(?:cmos|finfet|fd[\s-]?soi|soi)\b"))
LINK_CLASSES = (
    ("die_to_die", "(?i)die[- ]to[- ]die|chiplet|ucie"),
    ("chip_to_chip", "(?i)chip[- ]to[- ]chip"),
    ("backplane", "(?i)backplane"),
    ("cable", "(?i)cable|copper"),
    ("memory", "(?i)ddr|gddr|hbm|memory interface"),
    ("optical", "(?i)optical|vcsel|silicon photonic|photodiode"),
)


def first_rule(text: Column, rules: Sequence[tuple[str, str]], other: str | None = None) -> Column:
    """The label of the first pattern that ``text``, white space as one space, matches; ``other`` for none and for null."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    out = F
    for label, pattern in rules:
        out = out.when(text.rlike(pattern), label)
    return out.otherwise(F.lit(other).cast("string"))


def power_guard(text: Column) -> Column:
    """Why a power in ``text`` is not an exact electrical consumption; null if nothing says so."""
    return first_rule(text, POWER_GUARDS)


def rate_guard(text: Column) -> Column:
    """Why a rate in ``text`` is no operating point; null if nothing says so."""
    return first_rule(text, RATE_GUARDS)


def power_scope(text: Column, stored: Column) -> Column:
    """lane, aggregate or unknown: by what is stored, then by the text."""
    name = F.regexp_replace(F.lower(stored), "[- ]", "_")
    known = F.when(name.isin("lane", "per_lane", "each_lane"), "lane").when(name.isin("aggregate", "total", "system", "link", "full_link", "chip"), "aggregate")
    return F.coalesce(known, first_rule(text, (("lane", LANE_POWER), ("aggregate", WHOLE_POWER)), "unknown"))


def technology_family(text: Column) -> Column:
    """BiCMOS before CMOS, by explicit words only and never by the size of a node."""
    return first_rule(text, FAMILIES, "Other / unspecified")


def link_class(text: Column) -> Column:
    return first_rule(text, LINK_CLASSES)
