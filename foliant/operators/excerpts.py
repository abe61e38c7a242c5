"""Excerpts of papers for questions: the best piece of each paper first, then more, within a budget of signs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Signs of a chunk, and from one chunk's start to the next.
CHUNK, STEP = 1800, 1640
TITLE_HIT = 0.2
# What a term is.
TERM = r"[a-z0-9]+(?:[.][0-9]+)?|[가-힣]+"
#: Different terms of all questions up to which they are broadcast.
BROADCAST_TERMS = 100_000


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def chunks(pages: DataFrame) -> DataFrame:
    """``pages(paper, page, title, text)`` as rows with ``start`` and ``chunk``: CHUNK signs from each STEP on; blank ones left out."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(STEP))
    cut = pages.where("text IS NOT NULL").select("paper", "page", "title", F.explode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr("text", s + 1, F.lit(CHUNK)).alias("chunk")))).alias("c"))
    return cut.select("paper", "page", "title", "c.*").where(F.trim(F.regexp_replace("chunk", r"\s+", " ")) != "")


def excerpts(pages: DataFrame, questions: DataFrame, limit: int = 6, budget: int = 14_000) -> DataFrame:
    """Rows ``question, place, paper, page, start, score, excerpt``: at most ``limit`` excerpts a question of ``budget`` signs together.

    ``questions(question, text)``. A chunk scores 1 + ln(1 + n) for each different term that it has n times, and 0.2 for each term of the page's
    title. The best chunk of each paper comes first, in order of score, then other chunks if there is room; of equal ones those of smaller papers, pages
    and starts. The excerpt that would pass the budget is cut, and nothing follows it. A paper of which only the first title has a term gives its first chunk; chunks of papers without any term are never given.

    Chunks are counted where they are read: only (question, chunk) pairs that share a term are shuffled, without their texts, which are joined
    to the chosen ones at the end. Terms are broadcast if few, joined otherwise. Null texts have no chunks; null questions no terms.
    """
    if not 1 <= limit <= 20 or not 200 <= budget <= 64_000:
        raise ValueError("limit is 1 to 20, budget 200 to 64,000")
    asked = questions.select("question", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    asked = F.broadcast(asked) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else asked
    parts = chunks(pages)
    place = ["paper", "page", "start"]
    counted = parts.select(*place, F.explode(terms_of(F.col("chunk"))).alias("term")).join(asked, "term").groupBy("question", *place, "term").agg(F.count("*").alias("n"))
    hits = counted.groupBy("question", *place).agg(F.sum(1 + F.log(1 + F.col("n").cast("double"))).alias("hits"))
    named = pages.select("paper", "page", F.explode(F.array_distinct(terms_of(F.col("title")))).alias("term")).distinct().join(asked, "term").groupBy("question", "paper", "page").agg((F.count("*") * TITLE_HIT).alias("bonus"))
    firsts = parts.groupBy("paper").agg(F.min(F.struct("page", "start")).alias("f")).select("paper", "f.*")
    bare = named.join(firsts, ["paper", "page"]).join(hits.select("question", "paper").distinct(), ["question", "paper"], "left_anti")
    scored = hits.join(named, ["question", "paper", "page"], "left").select("question", *place, (F.col("hits") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    scored = scored.unionByName(bare.select("question", *place, F.col("bonus").alias("score"))).withColumn("score", F.round("score", 9))
    order = [F.desc("score"), *place]
    own = F.row_number().over(Window.partitionBy("question", "paper").orderBy(*order))
    # a paper's chunks beyond the limit can't be chosen
    scored = scored.withColumn("own", own).where(F.col("own") <= limit).withColumn("later", (F.col("own") > 1).cast("int"))
    chosen = scored.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy("later", *order))).where(F.col("place") <= limit)
    shown = chosen.join(parts.select(*place, "chunk"), place)
    before = F.coalesce(F.sum(F.length("chunk")).over(Window.partitionBy("question").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = shown.withColumn("room", budget - before).where("room > 0")
    return room.select("question", "place", *place, F.round("score", 4).alias("score"), F.substr("chunk", F.lit(1), F.col("room").cast("int")).alias("excerpt"))
