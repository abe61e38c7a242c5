"""Typed values from text, classifiers as ladders, and figures of merit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(text: Column, unit: str) -> Column:
    """The numbers before a unit, in order, as doubles."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?) ?(?:%s)\b" % unit), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def unambiguous(values: Column) -> Column:
    """The value if there is exactly one different one, else null: never the least or the first of several."""
    return F.when(F.size(F.array_distinct(values)) == 1, values[0])


def ladder(text: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The label of the first pattern that the lower-cased text matches."""
    out = F
    for label, pattern in rules:
        out = out.when(F.lower(text).rlike(pattern), label)
    return out.otherwise(other)


def labels(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """All labels whose pattern matches, in the rules' order."""
    return F.filter(F.array(*[F.when(F.lower(text).rlike(p), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull())


def band_score(label: Column, raw: Column, bands: dict[str, tuple[float, float]]) -> Column:
    """A raw score of 0..100 mapped into the band of its class."""
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))
    out = F
    for name, (low, high) in bands.items():
        out = out.when(label == name, F.lit(low) + (F.lit(high) - F.lit(low)) * raw / 100)
    return F.round(out, 3)


def evidence_tier(review: Column, source: Column, refused: Sequence[str], verified: Sequence[str], trusted: Sequence[str]) -> Column:
    """needs_review for refused reviews, verified for checked ones or trusted sources, else the source."""
    return F.when(review.isin(list(refused)), "needs_review").when(review.isin(list(verified)) | source.isin(list(trusted)), "verified").otherwise(F.lower(source))


def merit(power: Column, rate: Column) -> Column:
    """Energy per unit: power over rate in decimals; null unless both are positive."""
    p, r = power.cast("decimal(18,6)"), rate.cast("decimal(18,6)")
    return F.when((p > 0) & (r > 0), (p.cast("double") / r.cast("double")))


def merit_action(reported: Column, computed: Column, stale: Column, absolute: float = 0.01, relative: float = 0.02) -> Column:
    """What to do with a computed figure beside a reported one; reported figures are never overwritten."""
    same = F.abs(reported - computed) <= F.greatest(F.lit(absolute), F.abs(reported) * relative)
    return (
        F.when(computed.isNull() & reported.isNull(), "skip").when(computed.isNull() & stale, "clear_stale").when(computed.isNull(), "skip")
        .when(reported.isNull(), "derive").when(stale, "refresh_derived").when(same, "audit_match").otherwise("audit_conflict"))


def markup_to_text(markup: Column) -> Column:
    """Tags, scripts and styles out, the common character references decoded, white space folded."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n\x0B\f]+", " "))


def error_rate(text: Column) -> Column:
    """A bit error rate written as 1e-12, 3x10^-6 or 10^-9."""
    plain = F.regexp_extract(text, r"([0-9.]+[eE]-[0-9]+)", 1).try_cast("double")
    times = F.regexp_extract(text, r"([0-9.]+)\s*[x×*]\s*10\^?\s*-\s*[0-9]+", 1).try_cast("double")
    power = F.regexp_extract(text, r"10\^?\s*-\s*([0-9]+)", 1).try_cast("int")
    return F.coalesce(plain, F.coalesce(times, F.lit(1.0)) * F.pow(F.lit(10.0), -power))


def in_unit(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """``value`` in the base unit; null for a unit that ``factors`` lacks."""
    out = F
    for name, factor in factors.items():
        out = out.when(unit == name, value * factor)
    return out


def one_label(text: Column, rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The label if exactly one pattern matches."""
    found = labels(text, rules)
    return F.when(F.size(found) == 1, found[0]).otherwise(other)
