"""Reference lists in page text: segments, simple fields, repeated authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"(?im)^\s*(?:references|bibliography)\s*$"
STOP = r"(?im)^\s*(?:appendix|acknowledge?ments?|biograph(?:y|ies))\b"


def body(text: Column) -> Column:
    """What follows the last heading of a reference list, up to the next section."""
    parts = F.split(text, HEADING, -1)
    after = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    return F.split(after, STOP, 2)[0]


def segments(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``ident, number, entry`` of lists labelled [1]..[n] without a gap; other lists give no rows."""
    label = r"(?m)^\s*\[([0-9]{1,3})\]\s*"
    own = docs.select(ident, body(F.col(text)).alias("_b")).where("_b is not null")
    own = own.select(ident, F.regexp_extract_all("_b", F.lit(label), F.lit(1)).alias("_n"), F.slice(F.split("_b", label, -1), 2, 2147483647).alias("_e"))
    whole = own.where((F.size("_n") > 0) & (F.transform("_n", lambda n: n.cast("int")) == F.sequence(F.lit(1), F.size("_n"))))
    rows = whole.select(ident, F.posexplode("_e").alias("_i", "entry"))
    return rows.select(ident, (F.col("_i") + 1).alias("number"), F.trim(F.regexp_replace("entry", r"\s+", " ")).alias("entry"))


def fields(entry: Column) -> dict[str, Column]:
    """Quoted title, four-digit year and DOI of an entry, null where absent; authors are what stands before the title."""
    blank = lambda c: F.nullif(c, F.lit(""))
    title = blank(F.regexp_extract(entry, "[\"“]([^\"”]+?)[,.]?[\"”]", 1))
    return {
        "title": title,
        "year": blank(F.regexp_extract(entry, r"\b((?:19|20)[0-9]{2})\b", 1)).cast("int"),
        "doi": blank(F.regexp_extract(F.lower(entry), r"\b(10\.[0-9]{4,9}/[^\s,;]+)", 1)),
        "authors": F.when(title.isNotNull(), F.regexp_replace(F.trim(F.regexp_extract(entry, "^([^\"“]*)", 1)), r"[,.]$", "")),
    }


def repeated_authors(rows: DataFrame, ident: str, number: str, authors: str) -> DataFrame:
    """Dashes in place of authors mean those of the entry before."""
    dashes = F.col(authors).rlike(r"^\s*[-–—_]{2,}\s*[.,]?\s*$")
    w = Window.partitionBy(ident).orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(authors, F.last(F.when(~dashes, F.col(authors)), ignorenulls=True).over(w))


def rebuilt(index: Column) -> Column:
    """The text of an inverted index (word to positions); null if positions clash or leave gaps."""
    pairs = F.array_sort(F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))))
    places = F.transform(pairs, lambda x: x["p"].cast("int"))
    return F.when(places == F.sequence(F.lit(0), F.size(places) - 1), F.array_join(F.transform(pairs, lambda x: x["w"]), " "))
