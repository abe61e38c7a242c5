"""Record queries: fallbacks, overlays, patches, rank variants, orders of lists, graph edges, mirrors and import checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..sources.tables import table
from .register import registry

QUERIES, ORACLES, query = registry()


@query("""SELECT o_custkey, arg_min(o_orderpriority, struct_pack(a := CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END, b := o_orderkey)) AS o_orderpriority
FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def first_by_source_order(spark: SparkSession, d: str) -> DataFrame:
    """A customer's first priority, finished orders before pending and open ones."""
    return records.first_filled(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", [records.rank_of(F.col("o_orderstatus"), ["F", "P", "O"]), F.col("o_orderkey")])


@query("SELECT o_orderkey, c.c_name FROM orders LEFT JOIN (SELECT 'd' || (c_custkey * 2) AS doi, c_name FROM customer) c ON lower('D' || o_custkey) = c.doi")
def doi_overlay(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" D"), F.col("o_custkey").cast("string")).alias("doi"))
    rows = table(spark, d, "customer").select(F.concat(F.lit("d"), (F.col("c_custkey") * 2).cast("string")).alias("doi"), "c_name")
    return records.overlay(nodes, rows, "doi").select("o_orderkey", "c_name")


@query("""WITH f AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b FROM f x JOIN f y USING (o_custkey) WHERE x.n <= 5 AND y.n <= 5 AND x.o_orderkey < y.o_orderkey""")
def selection_pairs(spark: SparkSession, d: str) -> DataFrame:
    return records.pairs_of_selection(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 5)


@query("""SELECT c_custkey, c_name, c_nationkey, coalesce(p.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment
FROM customer c LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS c_acctbal, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS c_mktsegment FROM orders GROUP BY 1) p ON o_custkey = c_custkey""")
def bulk_patch(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("c_mktsegment"))
    return records.patch(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), changes, "c_custkey", ["c_acctbal", "c_mktsegment"])


@query("SELECT o_custkey, coalesce(min(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END), min(o_orderkey)) AS representative FROM orders GROUP BY 1")
def nested_representative(spark: SparkSession, d: str) -> DataFrame:
    return records.representative(table(spark, d, "orders"), ["o_custkey"], F.col("o_orderstatus") == "P", "o_orderkey")


@query("""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 40""")
def profile_terms_plain(spark: SparkSession, d: str) -> DataFrame:
    """The forty terms that a set of texts has most often, twice at least, each occurrence counting once."""
    terms = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).where("n >= 2").orderBy(F.desc("n"), "term").limit(40)


_LINE = "l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_returnflag, l_linestatus"
_REVIEW_SQL = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*_LINE.split(", "), "l_quantity", "l_discount", "l_tax")


@query(f"SELECT {_LINE} FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_REVIEW_SQL}, l_linestatus = 'O', l_extendedprice, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def energy_rank(spark: SparkSession, d: str) -> DataFrame:
    """The least value a key within the same review rank, reported ones before calculated ones."""
    order = [records.rank_of(F.col("l_returnflag"), ["A", "N"]), F.col("l_linestatus") == "O", F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return records.best(_lines(spark, d), ["l_partkey"], order).select(*_LINE.split(", "))


@query(f"SELECT {_LINE} FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_REVIEW_SQL}, l_linestatus = 'O', l_discount > 0.05, l_tax DESC, l_quantity DESC, l_extendedprice, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def review_rank(spark: SparkSession, d: str) -> DataFrame:
    """The row a key to review first, by eight keys: rank, reported before calculated, and so on down to the id."""
    order = [records.rank_of(F.col("l_returnflag"), ["A", "N"]), F.col("l_linestatus") == "O", F.col("l_discount") > 0.05, -F.col("l_tax"), -F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return records.best(_lines(spark, d), ["l_partkey"], order).select(*_LINE.split(", "))


@query(f"""SELECT {_LINE} FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_REVIEW_SQL}, (l_discount > 0)::INT + (l_tax > 0)::INT + (l_quantity > 25)::INT DESC, l_linestatus = 'O', l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def snapshot_rank(spark: SparkSession, d: str) -> DataFrame:
    """The row a key that a snapshot shows: by review rank, then by how many of its fields are filled."""
    rows = _lines(spark, d).withColumns({"a": F.when(F.col("l_discount") > 0, 1), "b": F.when(F.col("l_tax") > 0, 1), "c": F.when(F.col("l_quantity") > 25, 1)})
    order = [records.rank_of(F.col("l_returnflag"), ["A", "N"]), -records.populated("a", "b", "c"), F.col("l_linestatus") == "O", -F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return records.best(rows, ["l_partkey"], order).select(*_LINE.split(", "))


@query("""WITH p AS (SELECT l_partkey, l_suppkey, max(1 - l_discount) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, l_suppkey) AS n FROM p)
SELECT a.l_partkey, a.l_suppkey, a.score, CASE WHEN a.score < 0.94 THEN 'unmatched' WHEN a.score - coalesce(b.score, 0) < 0.025 THEN 'ambiguous' ELSE 'matched' END AS verdict
FROM r a LEFT JOIN r b ON b.l_partkey = a.l_partkey AND b.n = 2 WHERE a.n = 1""")
def fuzzy_best_margin(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max(1 - F.col("l_discount")).alias("score"))
    return records.best_with_margin(pairs, "l_partkey", "l_suppkey", "score")


@query("SELECT user_id, max(ts) AS last FROM events GROUP BY 1 ORDER BY last DESC, user_id LIMIT 50")
def last_recommended(spark: SparkSession, d: str) -> DataFrame:
    """The first page of items by the last time each was picked."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).orderBy(F.desc("last"), "user_id").limit(50)


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_orderkey LIMIT 100""")
def case_priority_sort(spark: SparkSession, d: str) -> DataFrame:
    order = [records.rank_of(F.col("o_orderstatus"), ["P", "O"]), records.rank_of(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), F.col("o_orderkey")]
    return table(spark, d, "orders").orderBy(*order).select("o_orderkey", "o_orderstatus", "o_orderpriority").limit(100)


@query("""SELECT c_custkey, best FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS best FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY best DESC NULLS LAST, c_custkey LIMIT 100""")
def sort_by_best(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return table(spark, d, "customer").select("c_custkey").join(best, "c_custkey", "left").orderBy(F.desc_nulls_last("best"), "c_custkey").limit(100)


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, o_totalprice FROM orders ORDER BY coalesce(year(o_orderdate), 0), coalesce(o_totalprice, 0), o_orderkey LIMIT 200")
def chart_point_order(spark: SparkSession, d: str) -> DataFrame:
    year = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", year.alias("year"), "o_totalprice").orderBy(F.coalesce("year", F.lit(0)), F.coalesce("o_totalprice", F.lit(0.0)), "o_orderkey").limit(200)


@query("""SELECT doc_id, (text IS NULL)::INT + (lang IS NULL)::INT + (source IS NULL)::INT + (n_chars < 100)::INT AS gaps FROM documents
ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, gaps DESC, n_chars DESC, doc_id LIMIT 100""")
def gap_list_order(spark: SparkSession, d: str) -> DataFrame:
    gaps = sum((F.col(c).isNull().cast("int") for c in ("text", "lang", "source")), (F.col("n_chars") < 100).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars", gaps.alias("gaps"))
    return rows.orderBy(records.rank_of(F.col("lang"), ["en", "de"]), F.desc("gaps"), F.desc("n_chars"), "doc_id").select("doc_id", "gaps").limit(100)


@query("""SELECT k, string_agg(name, '+' ORDER BY name) AS found_in FROM (SELECT DISTINCT o_custkey AS k, 'orders' AS name FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT c_custkey, 'balance' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT DISTINCT user_id, 'events' FROM events WHERE event_type = 'view') GROUP BY 1""")
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    own = lambda t, c, where: table(spark, d, t).where(where).select(F.col(c).alias("k"))
    sets = {"orders": own("orders", "o_custkey", "o_orderstatus = 'P'"), "balance": own("customer", "c_custkey", "c_acctbal < 0"), "events": own("events", "user_id", "event_type = 'view'")}
    return records.merge_candidates(sets, "k")


_WEIGHT_SQL = "SELECT l_suppkey AS seed, l_partkey AS node, count(*) - 1 AS weight FROM lineitem GROUP BY 1, 2"


@query(f"SELECT seed, node, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, node)::INT AS place FROM ({_WEIGHT_SQL}) WHERE weight > 0) WHERE place < 5")
def neighbour_ranking(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("seed"), F.col("l_partkey").alias("node")).agg((F.count("*") - 1).alias("weight"))
    return records.neighbours(edges, "seed", "node", "weight", 5)


@query("""WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT DISTINCT o_custkey AS start, user_id AS "end" FROM orders JOIN events ON event_id = o_orderkey
WHERE o_custkey IN (SELECT k FROM s) AND user_id IN (SELECT k FROM s) AND o_custkey <> user_id""")
def directed_citations(spark: SparkSession, d: str) -> DataFrame:
    references = table(spark, d, "orders").join(table(spark, d, "events"), F.col("event_id") == F.col("o_orderkey")).select(F.col("user_id").alias("citing"), F.col("o_custkey").alias("cited"))
    shown = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node"))
    return records.directed_edges(references, shown, "citing", "cited", "node")


@query("""SELECT source, (count(*) - count_if(coalesce(n_chars < 50 OR trim(text) = '', false)))::BIGINT AS kept, count_if(coalesce(n_chars < 50 OR trim(text) = '', false))::BIGINT AS aside FROM documents GROUP BY 1""")
def quarantine_summary(spark: SparkSession, d: str) -> DataFrame:
    kept, aside = records.quarantine(table(spark, d, "documents"), (F.col("n_chars") < 50) | (F.trim("text") == ""))
    both = kept.select("source", F.lit(0).alias("bad")).unionByName(aside.select("source", F.lit(1).alias("bad")))
    return both.groupBy("source").agg(F.count_if(F.col("bad") == 0).alias("kept"), F.count_if(F.col("bad") == 1).alias("aside"))


@query("""SELECT coalesce(a, b) AS k, CASE WHEN b IS NULL THEN 'add' WHEN a IS NULL THEN 'remove' ELSE 'keep' END AS action FROM (SELECT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT user_id AS b FROM events) ON a = b""")
def mirror_plan(spark: SparkSession, d: str) -> DataFrame:
    return records.mirror_plan(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query("""SELECT o_orderstatus AS run, count(*) AS expected, count(*) - count(l.k) AS missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O') l ON l.k = o_orderkey GROUP BY 1""")
def import_verification(spark: SparkSession, d: str) -> DataFrame:
    """For each run, how many of its expected keys the store lacks."""
    there = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("there")).distinct()
    both = table(spark, d, "orders").join(there, "o_orderkey", "left")
    return both.groupBy(F.col("o_orderstatus").alias("run")).agg(F.count("*").alias("expected"), (F.count("*") - F.count("there")).alias("missing"))


@query("""WITH t AS (SELECT source, md5(text) AS t, count(*) AS n FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1, 2), a AS (SELECT source, count(*) AS rows FROM documents GROUP BY 1)
SELECT source, rows, coalesce(sum(n), 0)::BIGINT AS covered, count(t) AS texts, coalesce(sum(CASE WHEN n > 1 THEN n END), 0)::BIGINT AS repeated FROM a LEFT JOIN t USING (source) GROUP BY 1, 2""")
def abstract_coverage(spark: SparkSession, d: str) -> DataFrame:
    """By source: rows, rows with a text, different texts, and rows whose text occurs again."""
    each = table(spark, d, "documents").groupBy("source", F.when(F.trim("text") != "", F.md5("text")).alias("t")).agg(F.count("*").alias("n"))
    has = F.col("t").isNotNull()
    return each.groupBy("source").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("covered"), F.count("t").alias("texts"), F.coalesce(F.sum(F.when(has & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("repeated"))


@query("""SELECT status, cause, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'unresolved' WHEN n_chars <> length(text) THEN 'confirmed' ELSE 'rejected' END AS status,
CASE WHEN text IS NULL THEN 'no_text' WHEN n_chars > length(text) THEN 'too_long' WHEN n_chars < length(text) THEN 'too_short' ELSE 'none' END AS cause FROM documents) GROUP BY 1, 2""")
def finding_adjudication(spark: SparkSession, d: str) -> DataFrame:
    """Findings against the evidence: a stated length is confirmed as wrong, rejected, or has nothing to be held against."""
    size = F.length("text")
    status = F.when(F.col("text").isNull(), "unresolved").when(F.col("n_chars") != size, "confirmed").otherwise("rejected")
    cause = F.when(F.col("text").isNull(), "no_text").when(F.col("n_chars") > size, "too_long").when(F.col("n_chars") < size, "too_short").otherwise("none")
    return table(spark, d, "documents").groupBy(status.alias("status"), cause.alias("cause")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN year(o_orderdate) <= 2022 THEN 'MWCL' ELSE 'MWTL' END AS name, count(*) AS n FROM orders GROUP BY 1")
def source_name_by_year(spark: SparkSession, d: str) -> DataFrame:
    """A journal's name before and after it was renamed."""
    return table(spark, d, "orders").groupBy(F.when(F.year("o_orderdate") <= 2022, "MWCL").otherwise("MWTL").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def whitelisted_filters(spark: SparkSession, d: str) -> DataFrame:
    asked = {"c_mktsegment": None, "c_nationkey": 3, "c_name": ""}
    return table(spark, d, "customer").where(records.checked_filters(asked, ["c_mktsegment", "c_nationkey", "c_name"])).select("c_custkey")
