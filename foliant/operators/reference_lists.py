"""Entries of reference lists from several readings: defects, entries that belong together, fields that the source bears out, and a vote."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import sequence_ratio

# What is wrong with an entry's text, in order of name.
DEFECTS = (
    ("collapsed_reference_labels", r"\[\s*\d+\s*\].*\[\s*\d+\s*\]"),
    ("damaged_reference_text", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\x{FFFD}\\x{FDD0}-\\x{FDEF}\\x{FFFE}\\x{FFFF}]"),
    ("non_bibliographic_tail", r"(?i)\b(?:Fig(?:ure)?\.?\s*\d|received the|was born (?:in|on)|has been with|Authorized licensed use)\b"),
)
BROKEN_LABEL = r"(?:\(\s*\d{1,3}\s*\]|\[\s*\d{1,3}\s*\))\s*[A-Z]\s*\."
SEQUENCE, LOST_POWER = r"(?i)PRBS|Pseudorandom|Sequence Generator", r"\b2(?:\d{2,4}|[*°'’]{1,3})\s*[-−]1\b"
LOST_NOTATION = r"(?i:\b0\.\d+\s*-?\s*m\s+CMOS\b)|\b\d+(?:\.\d+)?\s*-?\s*/\d{1,3}m\b|/(?:Omega|Delta|times|mu)(?=\d|\s|m\b)"
LONGEST = 5000
URL_ONLY = r"""(?i)^\s*(?:\[Online\]\.?\s*)?(?:Available\s*:\s*)?((?:https?://|www\.)[^\s<>"“”]+)\s*$"""
DOI = r"^10\.[0-9]{4,9}/\S+$"
SHORT_VENUE = (
    r"(?i)^(?:IEEE\s+)?(?:ISSCC(?:\s+Dig\.\s*Tech\.\s*Papers)?|CICC|VLSI(?:\s+Circuits|\s+Symp\.?\s*(?:Circuits)?)?|JSSC)\s*[,;]\s*"
    r"(?:pp?\.\s*\d|vol\.?\s*\d|in\s+press\b|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b)")
CORPORATE = r"(?i)\b(?:Report|Roadmap|Standard Specification)\b"
FIELDS = ("title", "journal", "author", "year", "doi")
#: Two readings of an entry agree if their texts, or the first PREFIX signs of long ones, are so alike.
ALIKE, PREFIX_ALIKE, PREFIX, LONG_ENOUGH = 0.82, 0.94, 180, 100


def key(text: Column) -> Column:
    """Letters and digits of a text's compatibility form, case folded; empty for null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        from .reference_titles import source_key

        return pa.array([source_key(t) for t in texts.to_pylist()], pa.string())

    return run(text.cast("string"))


def defects(raw: Column, source: Column | None = None) -> Column:
    """Names of what is wrong with an entry, sorted; ``source`` is its text before repairs, the same if not given."""
    raw = F.coalesce(raw, F.lit(""))
    literal = raw if source is None else F.coalesce(source, raw)
    named = {n: raw.rlike(p) for n, p in DEFECTS}
    named["collapsed_reference_labels"] = named["collapsed_reference_labels"] | literal.rlike(BROKEN_LABEL)
    named["source_at_truncation_bound"] = F.length(raw) >= LONGEST
    named["uncertain_scientific_notation"] = (raw.rlike(SEQUENCE) & raw.rlike(LOST_POWER)) | raw.rlike(LOST_NOTATION)
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in sorted(named.items()))), lambda d: d.isNotNull())


def alike(a: Column, b: Column) -> Column:
    """Whether two readings are of one entry."""
    a, b = F.lower(a), F.lower(b)
    long = F.least(F.length(a), F.length(b)) >= LONG_ENOUGH
    near = sequence_ratio(F.substring(a, 1, LONGEST), F.substring(b, 1, LONGEST), ALIKE) >= ALIKE
    start = sequence_ratio(F.when(long, F.substring(a, 1, PREFIX)), F.when(long, F.substring(b, 1, PREFIX)), PREFIX_ALIKE) >= PREFIX_ALIKE
    return F.coalesce((a == b) | near | (long & start), F.lit(False))


def aligned(entries: DataFrame, source: DataFrame) -> DataFrame:
    """Rows ``paper, number, raw`` of ``source(paper, number, raw, ocr_review)`` that may stand in for the entry of that number in
    ``entries(paper, number, raw, ocr_review, native)``.

    A number alone moves nothing: the texts must be alike. A reading with a defect doesn't replace one without, nor does one whose
    recognition must be reviewed replace a readable one. One equi-join on (paper, number); texts are compared within its rows. Null flags are false; entries without a
    number or text align with nothing.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    s = source.select("paper", "number", F.col("raw").alias("other"), flag("ocr_review").alias("other_review"))
    met = entries.select("paper", "number", "raw", flag("ocr_review").alias("review"), flag("native").alias("native")).join(s, ["paper", "number"])
    own, new = F.size(defects(F.col("raw"))) > 0, F.size(defects(F.col("other"))) > 0
    worse = new & ~own
    unread = F.col("other_review") & ~F.col("review") & (F.col("native") | ~own)
    return met.where(~worse & ~unread).where(alike(F.col("raw"), F.col("other"))).select("paper", "number", F.col("other").alias("raw"))


def chosen_lists(primary: DataFrame, source: DataFrame) -> DataFrame:
    """Rows ``paper, use, warnings``: whether a paper's list is the ``primary`` reading or an independent one.

    Both are ``(paper, number, raw)``. The independent one is used if the primary has no or fewer entries, or has defects and the other
    is less damaged (numbers with gaps and defects weigh 10,000 each, a lost notation 10, a damaged sign 1). Lists of different length that aren't
    replaced are warned of. Papers are compared by one aggregate of each reading.
    """
    def summed(lists: DataFrame, mark: str) -> DataFrame:
        found = defects(F.col("raw"))
        hard = F.array_except(found, F.array(F.lit("damaged_reference_text"), F.lit("uncertain_scientific_notation")))
        signs = F.length("raw") - F.length(F.regexp_replace("raw", DEFECTS[1][1], ""))
        lost = F.array_contains(found, "uncertain_scientific_notation").cast("int")
        n, low, high, kinds = F.count("*"), F.min("number"), F.max("number"), F.count_distinct("number")
        whole = (low == 1) & (high == n) & (kinds == n)
        names = F.array_distinct(F.flatten(F.collect_set(found)))
        each = lists.select("paper", "number", "raw").groupBy("paper").agg(n.alias("n"), names.alias("names"), F.array_distinct(F.flatten(F.collect_set(hard))).alias("hard"), F.sum(signs + 10 * lost).alias("soft"), whole.alias("whole"))
        gap = F.when(F.col("whole"), F.array().cast("array<string>")).otherwise(F.array(F.lit("noncontiguous_labels")))
        rank = (F.size("hard") + F.size(gap)) * 10_000 + F.col("soft")
        return each.select("paper", F.col("n").alias(f"{mark}_n"), F.array_sort(F.concat("names", gap)).alias(f"{mark}_names"), rank.alias(f"{mark}_rank"))

    both = summed(primary, "p").join(summed(source, "s"), "paper", "full_outer")
    none = F.array().cast("array<string>")
    p_names, s_names = (F.coalesce(f"{m}_names", none) for m in "ps")
    other = F.col("s_n").isNotNull() & (F.col("p_n").isNull() | (F.col("p_n") < F.col("s_n")) | ((F.size(p_names) > 0) & (F.col("s_rank") < F.col("p_rank"))))
    healed = F.when(other & ~F.array_contains(s_names, "damaged_reference_text"), F.array(F.lit("damaged_reference_text"))).otherwise(none)
    differ = F.when(~other & F.col("s_n").isNotNull() & (F.col("s_n") != F.col("p_n")), F.array(F.lit("independent_bibliography_count_disagreement"))).otherwise(none)
    return both.select("paper", F.when(other, "source").otherwise("primary").alias("use"), F.array_sort(F.concat(F.array_except(p_names, healed), differ)).alias("warnings"))


def grounded(rows: DataFrame, fields: Sequence[str] = FIELDS, raw: str = "raw") -> DataFrame:
    """``rows`` whose ``fields`` are null where their reference, ``raw``, doesn't have them, and ``warnings``, the names of those with _not_in_source."""
    whole = rows.withColumn("_raw", key(F.col(raw)))
    kept, bad = {}, []
    for f in fields:
        value = F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
        if f == "doi":
            value = F.regexp_replace(F.regexp_replace(F.lower(value), r"^(?:https://doi\.org/|doi:)", ""), r"[.,;]+$", "")
        inside = F.contains("_raw", key(value)) & (key(value) != "")
        good = F.contains(raw, value) & value.cast("int").between(1800, 2100) if f == "year" else inside & value.rlike(DOI) if f == "doi" else inside
        good = F.coalesce(good, F.lit(False))
        kept[f] = F.when(good, value.cast("int") if f == "year" else value)
        bad.append(F.when(value.isNotNull() & ~good, F.lit(f"{f}_not_in_source")))
    rest = [c for c in rows.columns if c not in (*fields, "warnings")]
    return whole.select(*rest, *(v.alias(f) for f, v in kept.items()), F.filter(F.array(*bad), lambda w: w.isNotNull()).alias("warnings"))


def consensus(readings: DataFrame) -> DataFrame:
    """One row per row of ``readings(paper, number, raw, rules, crf, checked)``, structs of FIELDS and ``warnings`` by rules, by a sequence
    model and, where there is one, by a later check: the FIELDS, ``needs_check``, ``url`` and ``warnings``.

    Rules come before the model. An entry must be checked if its title isn't quoted (rules have none), if authors or years differ, or if a reading
    was not borne out by the source; not if both agree on a short conference entry that has no title. A check may change what is not a quoted title, a DOI of the rules,
    or an author or year that both have. A title that equals its journal goes, as does the author of a report without a quoted title, and one that the readings
    disagree on. An entry that is a url alone has the url and nothing else.
    """
    r, m, c = F.col("rules"), F.col("crf"), F.col("checked")
    keys = {f: (key(r[f]), key(m[f])) for f in ("author", "year")}
    rows = readings.select("*", *(F.struct(a.alias("a"), b.alias("b")).alias(f"_{f}") for f, (a, b) in keys.items()))
    same = {f: F.col(f"_{f}.a") == F.col(f"_{f}.b") for f in keys}
    quoted = r["title"].isNotNull()
    agreed = same["author"] & (F.col("_author.a") != "")
    doubted = (F.size(F.coalesce(r["warnings"], F.array())) > 0) | (F.size(F.coalesce(m["warnings"], F.array())) > 0)
    first_tail = F.regexp_extract("raw", r"(?is)^.*?,\s*(?:et\s+al\.?\s*,?\s*)?(.*)$", 1)
    short = ~quoted & m["title"].isNull() & (F.length("raw") < 260) & first_tail.rlike(SHORT_VENUE) & agreed & (r["year"] == m["year"]) & ~doubted
    short = F.coalesce(short, F.lit(False))
    needs = (~quoted | ~same["author"] | ~same["year"] | doubted) & ~short
    use = needs & c.isNotNull()
    value = {f: F.coalesce(r[f], m[f]) for f in FIELDS}
    value["author"] = F.when(quoted | agreed | F.col("raw").rlike(r"^\s*[A-Z]\s*\."), value["author"])
    kept = {"title": quoted, "doi": r["doi"].isNotNull(), "author": agreed, "year": same["year"] & r["year"].isNotNull(), "journal": F.lit(False)}
    value = {f: F.when(use & ~kept[f], c[f]).otherwise(v) for f, v in value.items()}
    url = F.nullif(F.regexp_replace(F.regexp_extract("raw", URL_ONLY, 1), r"[.,;]+$", ""), F.lit(""))
    say = lambda condition, text: F.when(condition, F.lit(text))
    notes = F.filter(F.array(say(~quoted, "unquoted_or_missing_title"), say(~same["author"], "author_disagreement"), say(~same["year"], "year_disagreement"), say(short, "title_absent_in_short_reference")), lambda w: w.isNotNull())
    notes = F.array_distinct(F.concat(notes, F.when(use, F.coalesce(c["warnings"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))
    voted = rows.select("paper", "number", "raw", *(value[f].alias(f) for f in FIELDS), needs.alias("needs_check"), notes.alias("warnings"), quoted.alias("_quoted"), url.alias("url"))
    venue = F.coalesce(~F.col("_quoted") & (key(F.col("title")) != "") & (key(F.col("title")) == key(F.col("journal"))), F.lit(False))
    report = ~F.col("_quoted") & F.substring_index("raw", ",", 1).rlike(CORPORATE)
    out = voted.select(
        "paper", "number", "raw", F.when(~venue, F.col("title")).alias("title"), "journal", F.when(~report, F.col("author")).alias("author"), "year", "doi", "needs_check",
        F.when(venue, F.concat("warnings", F.array(F.lit("title_equals_venue_rejected")))).otherwise(F.col("warnings")).alias("warnings"), "url")
    bare = F.col("url").isNotNull()
    return out.select("paper", "number", "raw", *(F.when(~bare, F.col(f)).alias(f) for f in FIELDS), (F.col("needs_check") & ~bare).alias("needs_check"), F.when(bare, F.array().cast("array<string>")).otherwise(F.col("warnings")).alias("warnings"), "url")
