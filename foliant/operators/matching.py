"""Records matched to papers in passes: each pass sees only what the earlier ones left."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.plain import plain_text
from ..functions.terms import article_free_key
from .text import sequence_ratio

# What order and words of a title count for, and the score of an exact title of a neighbouring year.
ORDER_SHARE, WORD_SHARE, OFFSET_SCORE = 0.62, 0.38, 0.99


def title_key(title: Column) -> Column:
    """Words and numbers of a title's plain text in lower case, without articles."""
    return article_free_key(plain_text(title))


def word_bits(words: Column) -> Column:
    """A bitmap of 64 bits with one for each word's hash."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))


def most_shared(n: Column, bits: Column, m: Column, other: Column) -> Column:
    """How many words two sets of ``n`` and ``m`` share at most: each bit that one alone has is a word that it alone has."""
    return F.least(n - F.bit_count(bits.bitwiseAND(F.bitwise_not(other))), m - F.bit_count(other.bitwiseAND(F.bitwise_not(bits))))


def key_similarity(a: Column, b: Column, floor: float = 0.0) -> Column:
    """0.62 of the sequence ratio of two keys and 0.38 of the Jaccard of their words; 1 for equal keys, 0 for an empty one.

    Pairs that can't reach ``floor`` may get less than their score, so only what reaches it is exact. The more words two keys
    share, the less their order must add: each pair's ratio has a floor of its own.
    """
    words = [F.array_distinct(F.split(x, " ")) for x in (a, b)]
    jaccard = F.size(F.array_intersect(*words)) / F.size(F.array_union(*words))
    able = (a != b) & (ORDER_SHARE + WORD_SHARE * jaccard >= floor)
    ratio = sequence_ratio(F.when(able, a), F.when(able, b), F.greatest(F.lit(0.0), (floor - WORD_SHARE * jaccard) / ORDER_SHARE))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(F.when(able, ORDER_SHARE * ratio + WORD_SHARE * jaccard).otherwise(0.0))


def _near(wanted: DataFrame, kept: DataFrame, floor: float) -> DataFrame:
    """Pairs ``wanted.key, kept.key`` of a block (year, venue) whose keys may score ``floor`` or more.

    Such keys share a Jaccard of (floor - 0.62) / 0.38 of their words, so they meet in one of their rarest words: of n words the
    n - ceil(share n) + 1 that the fewest kept keys have. Bitmaps of the words rule most others out where they meet, before pairs are shuffled.
    """
    share = (floor - ORDER_SHARE) / WORD_SHARE
    if share <= 0:
        raise ValueError(f"a floor of {floor} does not bound the shared words")
    often = kept.select(F.explode(F.array_distinct(F.split("key", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("often"))

    def rare(keys: DataFrame) -> DataFrame:
        every = F.array_distinct(F.split("key", " "))
        words = keys.withColumn("n", F.size(every)).withColumn("sketch", word_bits(every)).withColumn("word", F.explode(every))
        placed = words.join(often, "word", "left").withColumn("place", F.row_number().over(Window.partitionBy("year", "venue", "key").orderBy(F.coalesce("often", F.lit(0)), "word")))
        return placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("year", "venue", "key", "word", "n", "sketch")

    a, b = rare(wanted), rare(kept).withColumnsRenamed({"key": "other", "n": "m", "sketch": "bits"})
    most = most_shared(F.col("n"), F.col("sketch"), F.col("m"), F.col("bits"))
    able = most >= (F.col("n") + F.col("m") - most) * share - 1e-9
    return a.join(b, ["year", "venue", "word"]).where(able).select("year", "venue", "key", "other").distinct()


def staged(
    records: DataFrame, papers: DataFrame, aliases: Mapping[str, Sequence[str]], threshold: float = 0.94, margin: float = 0.025, slack: int = 1, floor: float = 0.9,
) -> DataFrame:
    """Rows ``record, paper, method, score, margin``, one per row of ``records(record, title, year, venue)``, against ``papers(paper, ...)`` alike.

    Passes: one paper of the record's year and venue (or an alias of it) with its key; one paper with its key within ``slack`` years; the
    most similar key of the year and venue, if it scores ``threshold`` and leads by ``margin``. Beyond them the method is ambiguous
    (a score without the lead) or unmatched; ``paper`` is then the best candidate, for review, if it scores ``floor``. Methods:
    exact_title_year_venue, exact_title_venue_year_offset, fuzzy_title_year_venue.

    Records and papers are folded to their different (year, venue, key) first, so copies cost one comparison; keys meet in a block by rare
    words, never all with all. Venues are compared in upper case. Null years and venues match nothing; empty keys only exactly. Repeated
    records have a row each. Of equal scores the smaller paper counts.
    """
    spark = records.sparkSession
    upper = lambda c: F.upper(F.trim(c))
    rec = records.select("record", title_key(F.col("title")).alias("key"), F.col("year").cast("int").alias("year"), upper(F.col("venue")).alias("said"))
    pap = papers.select("paper", title_key(F.col("title")).alias("key"), F.col("year").cast("int").alias("year"), upper(F.col("venue")).alias("venue"))
    held = pap.where("year IS NOT NULL AND venue IS NOT NULL").groupBy("year", "venue", "key").agg(F.count("*").alias("n"), F.min("paper").alias("paper"))
    asked = rec.where("year IS NOT NULL AND said IS NOT NULL").select("key", "year", "said").distinct()
    known = [(k.upper(), v.upper()) for k, vs in aliases.items() for v in vs]
    if known:
        names = spark.createDataFrame(known, "said string, alias string")
        asked_in = asked.join(F.broadcast(names), "said", "left").withColumn("venue", F.coalesce("alias", "said")).drop("alias")
    else:
        asked_in = asked.withColumn("venue", F.col("said"))
    ident = ["key", "year", "said"]
    result = lambda method, score, lead: [F.lit(method).alias("method"), score.alias("score"), lead.alias("margin")]
    one = F.lit(1.0)

    same = asked_in.join(held, ["year", "venue", "key"]).groupBy(*ident).agg(F.sum("n").alias("n"), F.min("paper").alias("paper")).where("n = 1")
    first = same.select(*ident, "paper", *result("exact_title_year_venue", one, one))
    left = asked_in.join(first, ident, "left_anti")

    years = held.withColumnRenamed("year", "held_year")
    around = left.withColumn("held_year", F.explode(F.sequence(F.col("year") - slack, F.col("year") + slack))).join(years, ["held_year", "venue", "key"])
    around = around.groupBy(*ident).agg(F.sum("n").alias("n"), F.min("paper").alias("paper")).where("n = 1")
    second = around.select(*ident, "paper", *result("exact_title_venue_year_offset", F.lit(OFFSET_SCORE), one))
    left = left.join(second, ident, "left_anti")

    met = _near(left.where("key <> ''").select("year", "venue", "key").distinct(), held.where("key <> ''").select("year", "venue", "key"), floor)
    scored = met.withColumn("score", key_similarity(F.col("key"), F.col("other"), floor)).where(F.col("score") >= floor)
    scored = scored.join(held.withColumnRenamed("key", "other"), ["year", "venue", "other"])
    scored = left.join(scored, ["year", "venue", "key"]).select(*ident, "score", "n", "paper")
    order = F.row_number().over(Window.partitionBy(*ident).orderBy(F.desc("score"), "paper"))
    top = scored.withColumn("place", order).where("place <= 2").groupBy(*ident).agg(
        F.max_by(F.struct("paper", "score", "n"), -F.col("place")).alias("best"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("next"))
    b = F.col("best")
    lead = b["score"] - F.when(b["n"] > 1, b["score"]).otherwise(F.coalesce("next", F.lit(0.0)))
    sure = b["score"] >= threshold
    method = F.when(sure & (lead >= margin), "fuzzy_title_year_venue").when(sure, "ambiguous").otherwise("unmatched")
    third = top.select(*ident, b["paper"].alias("paper"), method.alias("method"), b["score"].alias("score"), lead.alias("margin"))

    found = first.unionByName(second).unionByName(third)
    out = rec.join(found, ident, "left")
    return out.select("record", "paper", F.coalesce("method", F.lit("unmatched")).alias("method"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"), F.round(F.coalesce("margin", F.lit(0.0)), 6).alias("margin"))
