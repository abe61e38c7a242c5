"""Terms and keys of titles, names of authors: one column expression for each way the catalogue compares them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .plain import compatible

# Dashes, and what a word of a title and of a graph is.
DASHES = "[\u2010-\u2015\u2212]"
TITLE_WORD = "[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*"
GRAPH_WORD = "[a-z][a-z0-9]*|[\uac00-\ud7a3]{2,}"

# Words that say nothing about a title's subject.
STOP = (
    "a an the of in on at to for and or with using based via from into towards toward by is are be this that these those its their new "
    "novel high low performance design analysis study approach method system systems model models paper review under over between as we "
    "propose proposed present presented results result effect effects case characterization fabrication implementation application "
    "applications improved improving efficient publisher author correction editorial erratum per").split()
# What says nothing in a graph of papers besides; units are among it.
GRAPH_STOP = STOP + (
    "all seasons part comments demonstrates demonstrate achieves achieved measured measurement measurements experimental experiments experiment "
    "first second third also can has have been was were which such than through each used use uses both shown show shows respectively compared "
    "conventional previous prior work works technique techniques et al fig figure table well total maximum minimum wide small large various different "
    "development developed includes include including provides provide two three four five one recent existing article "
    "gbps gb gbits mbps mhz ghz khz nm db ps fs ns uw mw pj fj ms us").split()
# Generic terms that identify no subject.
GENERIC = "cmos power bit circuit circuits integrated frequency voltage data digital analog nm ghz mhz khz db gbps".split()
# Spellings of one concept. The orders of modulation stay apart.
CONCEPTS = {
    "dfe": r"decision[ -]+feedback equaliz(?:er|ation|ers)|dfe",
    "ffe": r"feed[ -]?forward equaliz(?:er|ation|ers)|ffe",
    "cdr": r"clock[ -]+(?:and[ -]+)?data recovery|cdr",
    "tia": r"transimpedance amplifier(?:s)?|tia",
    "pll": r"phase[ -]+locked loop(?:s)?|pll",
    "hbm": r"high[ -]+bandwidth memor(?:y|ies)|hbm",
    "wdm": r"wavelength[ -]+division multiplex(?:ing|ed|er|ers)?|wdm",
    "nrz": r"non[ -]+return[ -]+to[ -]+zero|nrz",
    "serdes": r"serializer[ /-]+deserializer|serdes",
    "d2d": r"die[ -]+to[ -]+die|d2d",
    "microring": r"micro[ -]?ring(?:s)?",
    "pam2": r"pam[ -]?2",
    "pam3": r"pam[ -]?3",
    "pam4": r"pam[ -]?4",
    "pam8": r"pam[ -]?8",
}
# What marks a title as a notice about another one.
NOTICE = r"^\s*(?:(?:publisher|author)\s+correction|correction(?:\s+to)?|erratum|addendum|retraction\s+note|expression\s+of\s+concern)\s*[:\-]?\s*"


def _without(terms: Column, words: Sequence[str]) -> Column:
    return F.array_except(terms, F.array(*[F.lit(w) for w in words]))


def title_terms(title: Column) -> Column:
    """Different words and hyphenated words of three signs or more, stop words out; every order of PAM counts as ``pam``."""
    found = F.regexp_extract_all(F.regexp_replace(title, DASHES, "-"), F.lit(TITLE_WORD), F.lit(0))
    found = F.transform(found, lambda w: F.regexp_replace(F.lower(w), "^pam-?[234]$", "pam"))
    return _without(F.filter(found, lambda w: F.length(w) >= 3), STOP)


def graph_terms(text: Column, stop: Sequence[str] = GRAPH_STOP) -> Column:
    """Different words of three signs or more, Hangul too, hyphens parting words; stop words out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(GRAPH_WORD), F.lit(0))
    return _without(F.filter(found, lambda w: F.length(w) >= 3), stop)


def technical_text(title: Column) -> Column:
    """Compatibility form in lower case, dashes folded, every spelling of a concept replaced by its short name."""
    text = F.regexp_replace(F.lower(compatible(title)), DASHES, "-")
    for name, spellings in CONCEPTS.items():
        text = F.regexp_replace(text, rf"\b(?:{spellings})\b", name)
    return text


def technical_terms(title: Column) -> Column:
    """The terms of the technical text without generic ones. PAM2, PAM3, PAM4 and PAM8 are terms of their own."""
    text = technical_text(title)
    orders = F.regexp_extract_all(text, F.lit(r"\bpam[2348]\b"), F.lit(0))
    terms = _without(title_terms(text), GENERIC)
    return F.when(F.size(orders) > 0, F.array_union(_without(terms, ["pam"]), orders)).otherwise(terms)


def notice_free_key(title: Column) -> Column:
    """Words and numbers in lower case, without a correction's prefix."""
    text = F.lower(F.trim(F.regexp_replace(title, DASHES, "-")))
    return F.trim(F.regexp_replace(F.regexp_replace(text, NOTICE, ""), "[^a-z0-9]+", " "))


def article_free_key(title: Column) -> Column:
    """Words and numbers in lower case, without a, an and the."""
    return F.array_join(F.filter(F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin("a", "an", "the")), " ")


def author_names(authors: Column) -> Column:
    """Names in lower case: parted by semicolons where there are any, by commas and ``and`` otherwise."""
    lines = F.regexp_replace(authors, "\r?\n", ";")
    parts = F.when(lines.contains(";"), F.split(lines, ";")).otherwise(F.split(F.regexp_replace(lines, r"(?i),?\s+and\s+", ","), ","))
    names = F.transform(parts, lambda n: F.array_join(F.regexp_extract_all(F.lower(n), F.lit("[a-z]+"), F.lit(0)), " "))
    return F.filter(names, lambda n: n != "")


def surnames(authors: Column) -> Column:
    """The last word of each name, in order; the first author's stands first."""
    return F.transform(author_names(authors), lambda n: F.substring_index(n, " ", -1))
