"""Works that describe one implementation: what their figures say about a pair, and what must hold of stored families."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.plain import plain_text
from ..functions.terms import article_free_key, surnames, technical_terms
from ..sources.tables import cut
from .matching import ORDER_SHARE, WORD_SHARE
from .resolve import encoded, listed, met, overlap
from .text import ratios


def agree(a: Column, b: Column, relative: float, absolute: float = 0.0) -> Column:
    """match, conflict or missing: two figures agree within an absolute or a relative gap of the larger one."""
    gap = F.abs(a - b)
    size = F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))
    return F.when(a.isNull() | b.isNull(), "missing").when((gap <= absolute) | (gap / size <= relative), "match").otherwise("conflict")


def spans_agree(low_a: Column, high_a: Column, low_b: Column, high_b: Column, overlap: float = 1.02, ends: float = 0.05) -> Column:
    """Two ranges (a single figure is a range of no width) agree if they overlap within 2 % or an end is within 5 %."""
    missing = low_a.isNull() | high_a.isNull() | low_b.isNull() | high_b.isNull()
    near = lambda x, y: F.abs(x - y) / F.greatest(x, y) <= ends
    met = (F.greatest(low_a, low_b) <= F.least(high_a, high_b) * overlap) | near(low_a, low_b) | near(high_a, high_b)
    return F.when(missing, "missing").when(met, "match").otherwise("conflict")


def sets_agree(a: Column, b: Column) -> Column:
    """Arrays agree if they share a member; null or empty ones say nothing."""
    missing = F.coalesce(F.size(a) < 1, F.lit(True)) | F.coalesce(F.size(b) < 1, F.lit(True))
    return F.when(missing, "missing").when(F.arrays_overlap(a, b), "match").otherwise("conflict")


def blocks_agree(a: Column, b: Column) -> Column:
    """A transmitter alone and a receiver alone conflict; other blocks match if they share one and say nothing else."""
    only = lambda x, yes, no: F.array_contains(x, yes) & ~F.array_contains(x, no)
    apart = (only(a, "TX", "RX") & only(b, "RX", "TX")) | (only(a, "RX", "TX") & only(b, "TX", "RX"))
    return F.when(apart, "conflict").when(F.arrays_overlap(a, b), "match").otherwise("missing")


def fingerprint(verdicts: dict[str, Column]) -> Column:
    """A struct of the names that match and of those that conflict, in order of name."""
    pick = lambda what: F.filter(F.array(*[F.when(verdicts[n] == what, F.lit(n)) for n in sorted(verdicts)]), lambda x: x.isNotNull())
    return F.struct(pick("match").alias("matches"), pick("conflict").alias("conflicts"))


def violations(families: DataFrame, members: DataFrame, candidates: DataFrame, eligible: Sequence[str]) -> DataFrame:
    """Rows ``rule, id`` of what is broken; none if all holds. Rules are anti joins and aggregates.

    ``families(family_id, active, canonical)``, ``members(family_id, paper_id, is_canonical)``, ``candidates(candidate_id,
    family_id, status, conference_id, journal_id)``. Rows whose keys are null break nothing but a member's missing family.
    """
    rule = lambda df, name, ident: df.select(F.lit(name).alias("rule"), F.col(ident).cast("long").alias("id"))
    known = families.select("family_id", "active", "canonical")
    lost = rule(members.join(known, "family_id", "left_anti"), "member_without_family", "paper_id").distinct()
    twice = rule(members.groupBy("paper_id").agg(F.min("family_id").alias("a"), F.max("family_id").alias("b")).where("a <> b"), "paper_in_several_families", "paper_id")
    held = candidates.where(F.col("family_id").isNotNull())
    fit = F.coalesce(F.col("status").isin(list(eligible)), F.lit(False))
    refused = rule(held.where(~fit), "ineligible_candidate_in_family", "candidate_id")
    eligible_ = held.where(fit).select("candidate_id", "family_id", "journal_id")
    with_family = eligible_.join(known.withColumn("_there", F.lit(True)), "family_id", "left").withColumn("_other", F.coalesce(F.col("journal_id") != F.col("canonical"), F.lit(False)))
    # what the family alone tells is told where it is met; only journals that are its canonical paper are looked up among its members
    told = [F.when(F.col("_there").isNull(), "candidate_without_family"), F.when(F.col("_there") & ~F.col("active"), "candidate_of_inactive_family"), F.when(F.col("_there") & F.col("_other"), "inconsistent_journal_member")]
    broken = with_family.select(F.explode(F.array_compact(F.array(*told))).alias("rule"), F.col("candidate_id").cast("long").alias("id"))
    own = members.where("is_canonical").select("family_id", F.col("paper_id").alias("journal_id"))
    journal = rule(with_family.where("_there and not _other").join(own, ["family_id", "journal_id"], "left_anti"), "inconsistent_journal_member", "candidate_id")
    # families and members are folded by one aggregate, which sends sums on, and never sorted
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    per = known.where("active").select("family_id", one.alias("f"), zero.alias("n"), zero.alias("size")).unionByName(
        members.where("family_id IS NOT NULL").select("family_id", zero.alias("f"), F.when(F.col("is_canonical"), one).otherwise(zero).alias("n"), one.alias("size")))
    per = per.groupBy("family_id").agg(*(F.sum(c).alias(c) for c in ("f", "n", "size")))
    lone = per.where("f > 0 AND (n <> 1 OR size < 2)").select(F.explode(F.array_repeat("family_id", F.col("f").cast("int"))).alias("family_id"))
    out = lost
    for part in (twice, refused, broken, journal, rule(lone, "active_family_without_one_canonical", "family_id")):
        out = out.unionByName(part)
    return out


def table_cells(markup: Column) -> Column:
    """The cells of a table's markup as text, row by row."""
    cell = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    rows = F.regexp_extract_all(markup, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.filter(F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), cell)), lambda r: F.size(r) > 0)


# Cells that name the work itself and those that name others; units that are passed on to bare numbers.
THIS_WORK = r"(?i)\b(?:this\s*(?:work|paper|design)|proposed(?:\s+work)?)\b"
PRIOR_WORK = r"(?i)\b(?:previous|prior|earlier|reported\s+in|compared\s+with)\b|\[\s*[0-9]+(?:\s*[-,]\s*[0-9]+)*\s*\]"
UNITS = r"(?i)([pf]J\s*/\s*(?:bit|b)(?:\s*/\s*dB)?|Gb/s|Gbps|Gbit/s|GBaud|mW|[µμu]W|nm|dB|GHz)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often and in whatever lambdas ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def own_figures(markup: Column) -> Column:
    """A struct ``status, figures``: the cells of the one row or column that is headed "this work", each after its label.

    ok, or why nothing is read: no_cells, spans (merged cells), ragged (rows of several lengths), no_unique_label (none or
    several cells), ambiguous_place (neither in the first row nor in the first column). A bare number gets the label's unit
    if the label has exactly one.
    """
    marks = lambda rows: F.flatten(F.transform(rows, lambda r, i: F.filter(F.transform(r, lambda c, j: F.when(c.rlike(THIS_WORK) & ~c.rlike(PRIOR_WORK), F.struct(i.alias("r"), j.alias("c")))), lambda x: x.isNotNull())))
    return _once(table_cells(markup), lambda rows: _once(marks(rows), lambda found: _own_figures(markup, rows, found)))


def _own_figures(markup: Column, rows: Column, marks: Column) -> Column:
    at = marks[0]
    status = (
        F.when(F.coalesce(F.size(rows), F.lit(0)) < 1, "no_cells").when(markup.rlike(r"(?i)(?:row|col)span\s*=\s*[\"']?(?:[02-9]|1[0-9])"), "spans")
        .when(F.exists(rows, lambda r: F.size(r) != F.size(rows[0])), "ragged").when(F.size(marks) != 1, "no_unique_label")
        .when((at["r"] == 0) == (at["c"] == 0), "ambiguous_place").otherwise("ok"))

    def figure(label: Column, value: Column) -> Column:
        units = F.regexp_extract_all(label, F.lit(UNITS), F.lit(1))
        return F.concat(label, F.lit(": "), F.when(value.rlike(r"^[0-9]+(?:\.[0-9]+)?$") & (F.size(units) == 1), F.concat(value, F.lit(" "), F.get(units, F.lit(0)))).otherwise(value))

    down = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: figure(F.get(r, F.lit(0)), F.get(r, at["c"])))
    head, own = F.get(rows, F.lit(0)), F.get(rows, at["r"])
    across = F.transform(F.slice(head, 2, F.greatest(F.size(head) - 1, F.lit(0))), lambda h, i: figure(h, F.get(own, i + 1)))
    return F.struct(status.alias("status"), F.when(status == "ok", F.when(at["r"] == 0, down).otherwise(across)).alias("figures"))


# Weights of a pair's score and the gates of strict and doubtful pairs.
SCORE = (("similarity", 0.55), ("authors", 0.15), ("author_jaccard", 0.12), ("token_jaccard", 0.12), ("first_author", 0.06))
CONFLICT_COST, LEAST_SHARED, LEAST_TOKENS, LATEST = 0.20, 2, 0.25, 3
MOST_SHARED, MOST_NAMES, REVIEW_SIMILARITY, REVIEW_TOKENS = 4, 0.60, 0.65, 0.40
ELIGIBLE = ("auto_grouped", "approved")


def family_title(title: Column, session_numbers: Column) -> Column:
    """The key of a title with words and numbers parted (112Gb/s is 112 Gb/s); where ``session_numbers`` holds, "6.1 A ..." loses its number."""
    text = plain_text(title)
    text = F.when(session_numbers, F.regexp_replace(text, r"(?i)^\s*\d+(?:\.\d+)?\s+(?=(?:a|an)\b)", "")).otherwise(text)
    return article_free_key(F.regexp_replace(F.regexp_replace(text, r"(?<=\d)(?=[A-Za-zµμ])", " "), r"(?<=[A-Za-z])(?=\d)", " "))


#: Rows of a cell's conference papers that are compared with its journal papers at a time, and pairs whose titles wait to be compared together.
AT_ONCE, WAITING = 256, 65_536


def _cell(columns: Sequence[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Compare a cell's conference papers with its journal papers: those that may be one work, figures aside."""

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.combine_chunks(), b.combine_chunks()
        sizes = len(a), len(b)
        years = [x["year"].to_numpy() for x in (a, b)]
        many = {c: [pc.list_value_length(x[c]).to_numpy() for x in (a, b)] for c in ("names", "terms", "words")}
        (key_a, key_b), keys = encoded(a["key"], b["key"])
        keys = keys.to_pylist()
        some = np.array([k != "" for k in keys], dtype=bool)
        lead_a, lead_b = encoded(a["lead"], b["lead"])[0]
        lists = {c: listed(a[c], b[c]) for c in many}
        found, waiting = [], []
        if all(sizes):
            one, two = a["one"][0].as_py(), a["two"][0].as_py()
            # a name in common that comes before the cell's, so another cell has the pair
            sooner = np.array([n < two and n != one for n in lists["names"][1].to_pylist()], dtype=bool)
        for first in range(0, sizes[0] if sizes[1] else 0, AT_ONCE):
            rows = slice(first, min(first + AT_ONCE, sizes[0]))

            def shared(c: str, use: np.ndarray | None = None) -> np.ndarray:
                (at, codes), (other_at, other) = lists[c][0]
                mine, yours = (at >= rows.start) & (at < rows.stop), np.ones(len(other), dtype=bool)
                if use is not None:
                    mine, yours = mine & use[codes], use[other]
                return overlap(rows.stop - rows.start, at[mine] - rows.start, codes[mine], sizes[1], other_at[yours], other[yours])

            def jaccard(c: str, both: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
                return both / np.maximum(1, many[c][0][i] + many[c][1][j] - both)

            gap = years[1].astype(np.int64) - years[0][rows, None]
            same = (key_a[rows, None] == key_b) & some[key_a[rows], None]
            led = lead_a[rows, None] == lead_b
            names, terms = shared("names"), shared("terms")
            able = (gap >= 0) & (gap <= LATEST) & (names >= LEAST_SHARED) & (led | (names >= MOST_SHARED)) & (led == a["led"][0].as_py())
            # the least share of terms that any pair needs, in single precision and with room for it
            able &= terms >= (LEAST_TOKENS - 1e-3) * (many["terms"][0][rows, None] + many["terms"][1] - terms)
            if sooner.any():
                able &= shared("names", sooner) == 0
            i, j = np.nonzero(able)
            names, terms, same, led, gap = (x[i, j] for x in (names.astype(np.float64), terms.astype(np.float64), same, led, gap))
            at = i + first
            tokens, people = jaccard("terms", terms, at, j), jaccard("names", names, at, j)
            keep = (led | (people >= MOST_NAMES)) & ((tokens >= REVIEW_TOKENS) | (same & (tokens >= LEAST_TOKENS)))
            if keep.any():
                words = jaccard("words", shared("words")[i, j].astype(np.float64), at, j)
                waiting.append([v[keep] for v in (at, j, gap, words, tokens, names, people, led, same)])
            if waiting and (rows.stop == sizes[0] or sum(len(v[0]) for v in waiting) >= WAITING):
                at, j, gap, words, *rest = (np.concatenate(v) for v in zip(*waiting))
                waiting.clear()
                x, y = key_a[at], key_b[j]
                similarity = np.where(some[x] & some[y] & (x == y), 1.0, 0.0)
                ask = np.flatnonzero(some[x] & some[y] & (x != y) & (ORDER_SHARE + WORD_SHARE * words >= REVIEW_SIMILARITY))
                order = ratios([keys[k] for k in x[ask]], [keys[k] for k in y[ask]], np.maximum(0.0, (REVIEW_SIMILARITY - WORD_SHARE * words[ask]) / ORDER_SHARE))
                similarity[ask] = ORDER_SHARE * order + WORD_SHARE * words[ask]
                keep = rest[-1] | (similarity >= REVIEW_SIMILARITY)
                found.append([v[keep] for v in (at, j, gap, similarity, *rest)])
        at, j, gap, similarity, tokens, names, people, led, same = (np.concatenate(v) for v in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 9
        figures = (gap.astype(np.int32), similarity.astype(float), tokens.astype(float), names.astype(np.int32), people.astype(float), led.astype(bool), same.astype(bool))
        return pa.table([a["p"].take(at), b["p"].take(j), *map(pa.array, figures)], names=["l", "r", *columns])

    return run


def scored_pairs(papers: DataFrame, venues: dict[str, Sequence[str]], verdicts: Callable[[Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """Pairs of a conference paper and a later journal paper that may be one implementation: ``conference, journal, year_gap, similarity,
    token_jaccard, shared_authors, author_jaccard, first_author, exact_title, matches, conflicts, score, strict``.

    ``papers(id, title, authors, year, venue, ...)``; ``venues`` says which journals a conference's papers go to; ``verdicts`` compares the
    technical figures of two papers, given as structs of all columns. Pairs lie 0 to 3 years apart, share two surnames and a quarter of their
    technical terms. Strict ones have no conflict, the first author or most authors in common, and the same title or a close one with a technical
    match; others stay for review if they are near. Papers meet on the first author and another surname (of four surnames or more also on any two)
    within their venues, so a frequent surname alone is no key. They meet in cells of bounded size, where products of matrices count what all
    pairs share and only titles of what is left are compared, so pairs are never shuffled. Null years, venues, titles and authors pair with nothing.
    """
    spark = papers.sparkSession
    allowed = spark.createDataFrame([(c, j) for c, js in venues.items() for j in js], "venue string, journal_venue string")
    rows = papers.select(F.struct("*").alias("p")).where(F.col("p.title").isNotNull())
    rows = rows.select(
        F.col("p.id").alias("id"), F.col("p.year").cast("int").alias("year"), F.col("p.venue").alias("venue"), family_title(F.col("p.title"), F.col("p.venue").isin(list(venues))).alias("key"),
        F.array_distinct(surnames(F.col("p.authors"))).alias("names"), F.array_distinct(technical_terms(F.col("p.title"))).alias("terms"), "p")
    rows = rows.withColumn("lead", F.get("names", F.lit(0))).where("year IS NOT NULL AND venue IS NOT NULL AND size(names) > 1").withColumn("words", F.array_distinct(F.split("key", " ")))
    # first author and another name in common, or, for MOST_SHARED names and more, any two names
    ordered = F.array_sort("names")
    key = lambda one, two, led: F.struct(one.alias("one"), two.alias("two"), F.lit(led).alias("led"))
    two = F.flatten(F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda i: F.transform(F.slice(ordered, i + 1, F.size("names")), lambda b: key(F.element_at(ordered, i), b, False))))
    led = F.transform(F.array_remove("names", F.col("lead")), lambda b: key(F.col("lead"), b, True))
    keyed = rows.withColumn("_met", F.explode(F.when(F.size("names") >= MOST_SHARED, F.concat(led, two)).otherwise(led))).select("*", "_met.*").drop("_met")
    a = keyed.join(F.broadcast(allowed), "venue").drop("venue")
    b = keyed.where(F.col("venue").isin([j for js in venues.values() for j in js])).withColumnRenamed("venue", "journal_venue")
    columns = ("year_gap", "similarity", "token_jaccard", "shared_authors", "author_jaccard", "first_author", "exact_title")
    kind = StructType([StructField(c, papers.select(F.struct("*").alias("p")).schema["p"].dataType) for c in "lr"])
    for c, t in zip(columns, ("integer", "double", "double", "integer", "double", "boolean", "boolean")):
        kind = kind.add(c, t)
    fields = ["one", "two", "led", "journal_venue", "id", "year", "key", "lead", "names", "terms", "words", "p"]
    found = met((a.select(fields), b.select(fields)), fields[:4], _cell(columns), kind, cut)
    figures = fingerprint(verdicts(F.col("l"), F.col("r"))) if verdicts else F.struct(F.array().cast("array<string>").alias("matches"), F.array().cast("array<string>").alias("conflicts"))
    pairs = found.select(F.col("l.id").alias("conference"), F.col("r.id").alias("journal"), *columns, figures.alias("f")).select("*", "f.*").drop("f")
    known = F.col("first_author") | ((F.col("shared_authors") >= MOST_SHARED) & (F.col("author_jaccard") >= MOST_NAMES))
    near = (F.col("year_gap") <= 2) & (F.col("similarity") >= 0.82) & (F.col("token_jaccard") >= 0.60) & ((F.size("matches") > 0) | (F.col("similarity") >= 0.93))
    strict = (F.size("conflicts") == 0) & known & (F.col("exact_title") | near)
    review = known & (F.col("similarity") >= REVIEW_SIMILARITY) & (F.col("token_jaccard") >= REVIEW_TOKENS)
    value = {"authors": F.least(F.lit(1.0), F.col("shared_authors") / 3), "first_author": F.col("first_author").cast("int")}
    score = sum((weight * value.get(n, F.col(n)) for n, weight in SCORE), F.lit(0.0)) - F.when(F.size("conflicts") > 0, CONFLICT_COST).otherwise(0.0)
    return pairs.withColumn("strict", strict).where(F.col("strict") | review).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 9))


def selected(candidates: DataFrame, ident: str, conference: str, status: str, score: str, eligible: Sequence[str] = ELIGIBLE) -> DataFrame:
    """Eligible ``candidates`` with ``selected``: one family a conference paper, approved ones first, then by score and id; the others conflict with it."""
    order = F.row_number().over(Window.partitionBy(conference).orderBy((F.col(status) != "approved").cast("int"), F.coalesce(score, F.lit(0.0)).desc(), ident))
    return candidates.where(F.col(status).isin(list(eligible))).withColumn("selected", order == 1)
