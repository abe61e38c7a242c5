"""Titles of references as text, and excerpts for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import excerpts as X
from ..operators import reference_lists, reference_titles, supplement
from ..sources.tables import table
from .register import registry
from .screening_queries import PAPERS_SQL, papers

QUERIES, ORACLES, query = registry()

# How a title ends, and how that is shown; # stands for a number of the row. Without a text: the warning.
ENDINGS = (
    ("", "", None), (" of $# \\mathrm { ~ V } _ { \\mathtt { p p } }$", " of # V_pp", None), (" at $\\mu_{#}^2$", " at μ_#^2", None), (" within $\\pm #\\%$", " within ± #%", None),
    (" with $x", "", "math_unclosed_span"), (" with $\\foo #$", "", "math_unknown_command"), (" from $# to $#", "", "math_ambiguous_currency"), ("[J]", "", None), (" of \\(\\bf A + B\\)", " of A + B", None),
    (" in ${#$", "", "math_unbalanced_group"))
_N = "CAST(p_size AS STRING)"


def _written(i: int) -> str:
    return "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN replace('{e[i] or ''}', '#', {_N})" for k, e in enumerate(ENDINGS)) + " END"


_NAME = "upper(p_name)"
_TITLE, _SHOWN = f"concat({_NAME}, {_written(0)})", f"concat({_NAME}, {_written(1)})"
_WARNING = "CASE p_partkey % 10 " + " ".join(f"WHEN {k} THEN '{w}'" for k, (_, _, w) in enumerate(ENDINGS) if w) + " END"


@query(f"""SELECT p_partkey, CASE WHEN w IS NULL THEN shown END AS display, CASE WHEN w IS NULL THEN lower(shown) END AS match_key, CASE WHEN p_partkey % 10 = 7 THEN 'J' END AS reference_type, coalesce(w, '') AS warnings,
CASE WHEN w IS NOT NULL THEN 'needs_review' WHEN p_partkey % 10 = 0 THEN 'clean' ELSE 'normalized' END AS status
FROM (SELECT p_partkey, {_SHOWN.replace('STRING', 'VARCHAR')} AS shown, {_WARNING.replace('STRING', 'VARCHAR')} AS w FROM part)""")
def reference_display(spark: SparkSession, d: str) -> DataFrame:
    """Titles of references for display and matching; formulas without a sure text are left for review."""
    title = F.expr(_TITLE.replace("\\", "\\\\"))
    rows = table(spark, d, "part").select("p_partkey", title.alias("title")).withColumn("raw", F.concat(F.lit("A. Author, "), "title", F.lit(", IEEE J. Solid-State Circuits, 2018.")))
    n = F.col("n")
    found = rows.select("p_partkey", reference_titles.normalized_title(F.col("title"), F.col("raw")).alias("n"))
    return found.select("p_partkey", n["display"].alias("display"), n["match_key"].alias("match_key"), n["reference_type"].alias("reference_type"), F.array_join(n["warnings"], ",").alias("warnings"), n["status"].alias("status"))


#: What is asked: words that texts of each language have, and words of titles.
QUESTIONS = ((1, "tion est receiver"), (2, "Der nicht, VCSEL link and 28"), (3, "the of"), (4, "nothingthatis"), (5, None))
_TERMS_SQL = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+(?:[.][0-9]+)?'))"


@query(f"""WITH q(question, text) AS (VALUES {", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in QUESTIONS)}), a AS (SELECT question, unnest({_TERMS_SQL.format('text')}) AS term FROM q),
p AS (SELECT doc_id AS paper, title, text FROM ({PAPERS_SQL.replace(' FROM documents', ', text FROM documents')})),
c AS (SELECT paper, s.start, substr(text, (s.start + 1)::INT, {X.CHUNK}) AS chunk FROM p, unnest(range(0, greatest(length(text), 1), {X.STEP})) AS s(start) WHERE text IS NOT NULL), d AS (SELECT * FROM c WHERE trim(regexp_replace(chunk, '\\s+', ' ', 'g')) <> ''),
w AS (SELECT paper, start, unnest(regexp_extract_all(lower(chunk), '[a-z0-9]+(?:[.][0-9]+)?')) AS term FROM d), n AS (SELECT question, paper, start, term, count(*) AS n FROM w JOIN a USING (term) GROUP BY ALL),
h AS (SELECT question, paper, start, sum(1 + ln(1 + n)) AS hits FROM n GROUP BY ALL), t AS (SELECT paper, unnest({_TERMS_SQL.format('title')}) AS term FROM p), b AS (SELECT question, paper, count(*) * {X.TITLE_HIT} AS bonus FROM t JOIN a USING (term) GROUP BY ALL),
s AS (SELECT question, paper, start, round((hits + coalesce(bonus, 0))::DOUBLE, 9) AS score FROM h LEFT JOIN b USING (question, paper) UNION ALL
  SELECT question, paper, min(start), round(max(bonus)::DOUBLE, 9) FROM b JOIN d USING (paper) WHERE (question, paper) NOT IN (SELECT (question, paper) FROM h) GROUP BY question, paper),
o AS (SELECT *, row_number() OVER (PARTITION BY question, paper ORDER BY score DESC, start) AS own FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY (own > 1)::INT, score DESC, paper, start) AS place FROM o),
m AS (SELECT r.*, chunk, 9000 - coalesce(sum(length(chunk)) OVER (PARTITION BY question ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM r JOIN d USING (paper, start) WHERE place <= 12)
SELECT question, place::INT AS place, paper, start::INT AS start, round(score, 4) AS score, left(chunk, room::INT) AS excerpt FROM m WHERE room > 0""")
def chunk_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of whole documents for a few questions, within a budget."""
    pages = papers(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("paper"), F.lit(1).alias("page"), "title", "text")
    return X.excerpts(pages, spark.createDataFrame(QUESTIONS, "question int, text string"), 12, 9000).drop("page")


_READING = "struct<title:string,journal:string,author:string,year:int,doi:string,warnings:array<string>>"


def _reading(title: str = "NULL", journal: str = "NULL", author: str = "NULL", year: str = "NULL", doi: str = "NULL", said: str = "array()") -> str:
    return f"CAST(named_struct('title', {title}, 'journal', {journal}, 'author', {author}, 'year', {year}, 'doi', {doi}, 'warnings', {said}) AS {_READING})"


#: Kinds of entries: text, what rules, the sequence model and a check read, and what the vote must give (title, journal, author, year, doi, check, warnings, url).
_KINDS = (
    ("concat('K. Kim, “', p_name, ',” JSSC, 2018.')", _reading("p_name", author="'Kim'", year="2018", doi="'10.1109/1'"), _reading("concat(p_name, 'x')", "'JSSC'", "'Kim'", "2018", "'10.1109/2'"), "NULL", ("p_name", "'JSSC'", "'Kim'", "2018", "'10.1109/1'", "false", "''", "NULL")),
    ("concat('K. Kim, ', p_name, ', JSSC, 2018.')", _reading(author="'Kim'", year="2018"), _reading("p_name", "'JSSC'", "'Lee'", "2017"), _reading("p_name", "'JSSC'", "'Kim'", "2018", said="array('checked')"), ("p_name", "'JSSC'", "'Kim'", "2018", "NULL", "true", "'unquoted_or_missing_title,author_disagreement,year_disagreement,checked'", "NULL")),
    ("'K. Kim et al., ISSCC, pp. 12-13, 2018.'", _reading(author="'Kim'", year="2018"), _reading(journal="'ISSCC'", author="'Kim'", year="2018"), "NULL", ("NULL", "'ISSCC'", "'Kim'", "2018", "NULL", "false", "'unquoted_or_missing_title,title_absent_in_short_reference'", "NULL")),
    ("concat('https://example.org/', p_partkey, '.')", _reading(), _reading("'T'", "'J'", "'A'", "1"), "NULL", ("NULL", "NULL", "NULL", "NULL", "NULL", "false", "''", "concat('https://example.org/', p_partkey)")),
    ("concat('Roadmap Report ', p_partkey, ', 2018.')", _reading(year="2018"), _reading("'Roadmap'", "'Roadmap'", "'Report'", "2018"), "NULL", ("NULL", "'Roadmap'", "NULL", "2018", "NULL", "true", "'unquoted_or_missing_title,author_disagreement,title_equals_venue_rejected'", "NULL")),
    ("concat('A. ', p_name, ', ', p_type, ', 2019')", _reading(author="'A'", year="2019", said="array('title_not_in_source')"), _reading("p_name", "p_type", "p_name", "2019"), "NULL", ("p_name", "p_type", "'A'", "2019", "NULL", "true", "'unquoted_or_missing_title,author_disagreement'", "NULL")),
)
_VOTED = ("title VARCHAR", "journal VARCHAR", "author VARCHAR", "year DOUBLE", "doi VARCHAR", "needs_check BOOLEAN", "warnings VARCHAR", "url VARCHAR")


def _kind(texts: list[str]) -> str:
    return f"CASE p_partkey % {len(texts)} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(texts)) + " END"


@query("SELECT p_partkey, " + ", ".join(f"({_kind([k[4][i] for k in _KINDS])})::{c.split()[1]} AS {c.split()[0]}" for i, c in enumerate(_VOTED)) + " FROM part")
def reference_votes(spark: SparkSession, d: str) -> DataFrame:
    """Fields of references that several readings give, voted on."""
    columns = [f"{_kind([k[i] for k in _KINDS])} AS {n}" for i, n in ((0, "raw"), (1, "rules"), (2, "crf"), (3, "checked"))]
    rows = table(spark, d, "part").selectExpr("p_size AS paper", "p_partkey AS number", *columns)
    return reference_lists.consensus(rows).select(F.col("number").alias("p_partkey"), *reference_lists.FIELDS, "needs_check", F.array_join("warnings", ",").alias("warnings"), "url").withColumn("year", F.col("year").cast("double"))


@query()
def reference_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Which second readings of passages may stand in for the first (texts are compared by ratio, so no SQL)."""
    b = table(spark, d, "benchmark").select((F.col("item_id") % 10).alias("paper"), F.col("item_id").alias("number"), "text")
    first = b.select("paper", "number", F.col("text").alias("raw"), (F.col("number") % 5 == 0).alias("ocr_review"), (F.col("number") % 3 == 0).alias("native"))
    slip = F.when(F.col("number") % 4 == 1, F.reverse("text")).when(F.col("number") % 4 == 2, F.concat(F.lit("�"), "text")).otherwise(F.regexp_replace("text", "ing", "lng"))
    second = b.select("paper", "number", slip.alias("raw"), (F.col("number") % 7 == 0).alias("ocr_review"))
    return reference_lists.aligned(first, second)


@query("""WITH e AS (SELECT o_orderkey AS paper, l_linenumber AS number, l_partkey, l_suppkey, l_quantity, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
m AS (SELECT paper, number, CASE WHEN l_returnflag = 'A' THEN 'registry' ELSE 'file' END AS stage, min(l_partkey) AS work FROM e GROUP BY ALL),
f AS (SELECT paper, CASE WHEN bool_or(stage = 'registry') THEN 'registry' ELSE 'file' END AS stage FROM m GROUP BY paper),
r AS (SELECT m.*, row_number() OVER (PARTITION BY paper, work ORDER BY number) AS n FROM m JOIN f USING (paper, stage)) SELECT paper, number::INT AS number, stage, work, 'doi' AS how FROM r WHERE n = 1""")
def reference_supplement(spark: SparkSession, d: str) -> DataFrame:
    """References of orders (their parts) from a registry, or from files where the registry has none."""
    entries = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("number"), (F.col("l_returnflag") == "A").alias("registry")).agg(F.min("l_partkey").alias("part"))
    entries = entries.withColumn("doi", F.concat(F.lit("HTTPS://doi.org/10.1109/P"), F.col("part").cast("string"))).withColumns({c: F.lit(None).cast("string") for c in ("title", "author")}).withColumn("year", F.lit(None).cast("int"))
    works = table(spark, d, "part").select((F.col("p_partkey")).alias("work"), F.concat(F.lit("10.1109/p"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_name").alias("title"), F.lit("Kim").alias("author"), F.lit(2018).alias("year"))
    papers_ = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper"), F.lit(None).cast("string").alias("doi"))
    found = supplement.supplemented(papers_, works.withColumn("work", F.col("work") + 1_000_000_000), [("registry", entries.where("registry")), ("file", entries.where("NOT registry"))])
    return found.withColumn("work", F.col("work") - 1_000_000_000)
