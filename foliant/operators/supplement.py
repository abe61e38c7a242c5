"""Reference edges of papers from several sources, in order of trust, with the source and the evidence of each edge."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import normal_doi
from ..functions.terms import surnames
from .matching import title_key


def _identity(df: DataFrame) -> DataFrame:
    """``df(title, author, year, doi)`` with ``key``, ``name`` (first surname) and ``own``, the DOI as it is compared; empty ones are null."""
    blank = lambda c: F.nullif(c, F.lit(""))
    return df.withColumns({"key": blank(title_key(F.col("title"))), "name": blank(F.get(surnames(F.col("author")), F.lit(0))), "own": blank(normal_doi(F.col("doi")))})


def supplemented(papers: DataFrame, works: DataFrame, stages: Sequence[tuple[str, DataFrame]], slack: int = 1) -> DataFrame:
    """Rows ``paper, number, stage, work, how``: the references of ``papers(paper, doi)`` in ``works(work, doi, title, author, year)``.

    ``stages`` are (name, entries), most trusted first; entries are ``(paper, number, doi, title, author, year)``. A paper takes its entries from the
    first stage that gives it one with a DOI or a title, and none from later ones, so that no list is mixed from two sources. An entry is a work by
    its DOI (``how`` is doi), whatever its title says, or, if it has none that is known, by title, first surname and a year within ``slack``
    (identity) if that is one work alone. A paper is no reference of its own, nor is its DOI. Entries that resolve to nothing have a null work and ``how`` unresolved. Of
    entries of one paper that resolve to one work the first counts.

    Choosing the stage is one map-side combined minimum by paper. Works are met by equi-joins on the DOI, then, for what is left, on title and
    surname. Entries and what they meet are folded by hash aggregates of fixed-width buffers, so a task holds few sorters at a time. Works that share
    a DOI are one, the least. Null years match no identity.
    """
    names = [n for n, _ in stages]
    if len(set(names)) < len(names):
        raise ValueError("stages need names of their own")
    fields = ("paper", "number", "doi", "title", "author", "year")
    given = [df.select(*fields, F.lit(i).alias("rank")) for i, (_, df) in enumerate(stages)]
    entries = reduce(DataFrame.unionByName, given).where("paper IS NOT NULL")
    text = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    # a minimum by paper needs no join; only entries with some text are read
    said = _identity(entries.where(text("doi") | text("title"))).where(F.col("own").isNotNull() | F.col("key").isNotNull())
    first = said.groupBy("paper").agg(F.min("rank").alias("rank"))
    held = papers.select("paper", normal_doi(F.col("doi")).alias("paper_doi")).dropDuplicates(["paper"])
    entries = _identity(entries.join(first.join(held, "paper"), ["paper", "rank"]))
    known = _identity(works.select("work", "doi", "title", "author", "year"))
    doi_of = known.select("work", F.col("own").alias("work_doi")).dropDuplicates(["work"])
    at = ["paper", "rank", "number"]
    own_one = F.coalesce((F.col("work") == F.col("paper")) | (F.col("work_doi") == F.col("paper_doi")), F.lit(False)).alias("self")
    by_doi = known.where("own IS NOT NULL").groupBy("own").agg(F.min("work").alias("work")).join(doi_of, "work", "left")
    # a DOI holds no space, so entries without one meet nothing, each in a place of its own
    nowhere = F.concat(F.lit(" "), F.xxhash64(*at).cast("string"))
    met = entries.withColumn("meet", F.coalesce("own", nowhere)).join(by_doi.withColumnRenamed("own", "meet"), "meet", "left")
    sure = F.when(F.col("number").isNotNull(), F.col("work"))
    named = "key IS NOT NULL AND name IS NOT NULL AND year IS NOT NULL AND number IS NOT NULL"
    left = met.where(named).where("work IS NULL").select(*at, "paper_doi", "key", "name", "year")
    # copies of a work with one DOI are one candidate
    titled = known.where("key IS NOT NULL AND name IS NOT NULL").groupBy("key", "name", "year", F.coalesce("own", F.col("work").cast("string")).alias("same")).agg(F.min("work").alias("work"))
    titled = titled.join(doi_of, "work", "left").withColumnRenamed("year", "near")
    years = left.withColumn("near", F.explode(F.sequence(F.col("year") - slack, F.col("year") + slack))).drop("year")
    likely = years.join(titled, ["key", "name", "near"]).groupBy(*at).agg(F.min("work").alias("work"), F.min_by(own_one, "work").alias("self"), F.min("same").alias("a"), F.max("same").alias("z")).where("a = z")
    # an entry's rows are folded by hash: what its DOI and what its title says, the DOI first
    nothing = lambda names: [F.lit(None).cast(t).alias(n) for n, t in zip(names, (works.schema["work"].dataType, "boolean"))]
    rows = met.select(*at, sure.alias("sure"), own_one.alias("sure_self"), *nothing(("likely", "likely_self")))
    rows = rows.unionByName(likely.select(*at, *nothing(("sure", "sure_self")), F.col("work").alias("likely"), F.col("self").alias("likely_self")))
    one = rows.groupBy(*at).agg(F.min("sure").alias("sure"), F.min_by("sure_self", "sure").alias("sure_self"), F.min("likely").alias("likely"), F.min_by("likely_self", "likely").alias("likely_self"))
    told = F.col("sure").isNotNull()
    work = F.when(told & ~F.col("sure_self"), F.col("sure")).when(~told & ~F.col("likely_self"), F.col("likely"))
    out = one.select(*at, work.alias("work"), told.alias("by_doi"))
    # of entries that are one work the first; those that are none stay, each by its number
    out = out.groupBy("paper", "rank", "work", F.when(F.col("work").isNull(), F.col("number")).alias("_n")).agg(F.min("number").alias("number"), F.min_by("by_doi", "number").alias("by_doi"))
    out = out.withColumn("how", F.when(F.col("work").isNull(), "unresolved").when(F.col("by_doi"), "doi").otherwise("identity"))
    return out.select("paper", "number", F.element_at(F.array(*map(F.lit, names)), F.col("rank") + 1).alias("stage"), "work", "how")
