"""Queries of lists, references, checks and states that the other modules leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import extract, references, select
from ..sources.tables import table
from .register import registry

QUERIES, ORACLES, query = registry()


@query("""SELECT count(*) FILTER (WHERE l_quantity <= 0) AS not_positive, count(*) FILTER (WHERE l_discount < 0 OR l_discount > 0.08) AS loss, count(*) FILTER (WHERE NOT (l_tax > 0 AND l_tax < 0.08)) AS rate,
count(*) FILTER (WHERE l_quantity > 0 AND l_discount BETWEEN 0 AND 0.08 AND l_tax > 0 AND l_tax < 0.08) AS good FROM lineitem""")
def physical_checks(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("l_quantity") > 0, F.col("l_discount").between(0, 0.08), (F.col("l_tax") > 0) & (F.col("l_tax") < 0.08)
    return table(spark, d, "lineitem").agg(F.count_if(~a).alias("not_positive"), F.count_if(~b).alias("loss"), F.count_if(~c).alias("rate"), F.count_if(a & b & c).alias("good"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END), ''), n_name) AS authors, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE (c_custkey % 2)::INT END AS cites
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def bibliography_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Blank authors come from the fallback, counts only where unknown: 0 is known."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    authors, cites = F.when(k % 3 == 0, "  ").otherwise(F.col("c_name")), F.when(k % 4 != 0, (k % 2).cast("int"))
    return c.select("c_custkey", F.coalesce(S.blank_to_null(authors), "n_name").alias("authors"), F.coalesce(cites, "c_nationkey").alias("cites"))


@query("""WITH g AS (SELECT o_custkey, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey, y, n FROM (SELECT *, max(y) OVER (PARTITION BY o_custkey) AS m FROM g) WHERE y = m""")
def latest_year_count(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.max(F.struct("y", "n")).alias("x")).select("o_custkey", "x.y", "x.n")


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ' ' ORDER BY l_returnflag || l_linestatus) AS evidence FROM lineitem WHERE l_discount > 0.02 GROUP BY 1")
def filtered_concat(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("l_discount") > 0.02, F.concat("l_returnflag", "l_linestatus"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(flag)).alias("x"))
    return g.where(F.size("x") > 0).select("l_orderkey", F.array_join("x", " ").alias("evidence"))


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(100 * (1 - n / max(n) OVER ()::DOUBLE), 6) AS novelty FROM c")
def topic_novelty(spark: SparkSession, d: str) -> DataFrame:
    return select.novelty(table(spark, d, "events"), "event_type")


@query("SELECT source, count(*) AS rows, count(*) FILTER (WHERE quality = 0) AS errors, count(*) FILTER (WHERE quality = 0) / count(*)::DOUBLE AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def evaluation_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    wrong = F.count_if(F.col("quality") == 0)
    return rows.groupBy("source").agg(F.count("*").alias("rows"), wrong.alias("errors"), (wrong / F.count("*")).alias("rate"))


@query("""SELECT a.o_orderkey AS conference, b.o_orderkey AS journal, (year(b.o_orderdate) - year(a.o_orderdate))::INT AS gap FROM orders a JOIN (VALUES ('1-URGENT', '2-HIGH'), ('3-MEDIUM', '5-LOW')) AS v(c, j) ON a.o_orderpriority = v.c
JOIN orders b ON b.o_orderpriority = v.j AND a.o_custkey = b.o_custkey WHERE year(b.o_orderdate) - year(a.o_orderdate) BETWEEN 0 AND 3""")
def venue_pair_gap(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of allowed venue pairs with a year gap of 0..3; the map of venues has two rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y"))
    venues = spark.createDataFrame([("1-URGENT", "2-HIGH"), ("3-MEDIUM", "5-LOW")], "c string, j string")
    a = o.join(F.broadcast(venues), F.col("o_orderpriority") == F.col("c")).select(F.col("o_orderkey").alias("conference"), "o_custkey", F.col("y").alias("_a"), F.col("j").alias("o_orderpriority"))
    pairs = a.join(o.withColumnRenamed("o_orderkey", "journal"), ["o_custkey", "o_orderpriority"])
    return pairs.withColumn("gap", F.col("y") - F.col("_a")).where("gap BETWEEN 0 AND 3").select("conference", "journal", "gap")


@query("""SELECT s_suppkey, min(c_custkey) AS c_custkey FROM supplier JOIN customer ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) <= 100 GROUP BY 1 HAVING count(*) = 1""")
def unique_identity_match(spark: SparkSession, d: str) -> DataFrame:
    # balances within 100 lie in the same or in neighbouring bins of 100, so the join has a fine key besides the nation
    s = table(spark, d, "supplier").withColumn("near", F.explode(F.array(*[F.floor(F.col("s_acctbal") / 100) + i for i in (-1, 0, 1)])))
    c = table(spark, d, "customer")
    met = s.join(c, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.floor(F.col("c_acctbal") / 100) == F.col("near"))).where(F.abs(F.col("c_acctbal") - F.col("s_acctbal")) <= 100)
    return met.groupBy("s_suppkey").agg(F.min("c_custkey").alias("c_custkey"), F.count("*").alias("n")).where("n = 1").select("s_suppkey", "c_custkey")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ('1e-' || p_size)::DOUBLE WHEN 1 THEN 3.0::DOUBLE * pow(10.0, -p_size) ELSE pow(10.0, -p_size) END > 1e-12 AS high, CASE p_type WHEN 'SMALL' THEN p_retailprice / 1000 WHEN 'LARGE' THEN p_retailprice * 1000 WHEN 'ECONOMY' THEN p_retailprice END AS rate FROM part""")
def parse_rates_and_units(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    written = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("BER < 1e-"), n)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("BER of 3x10^-"), n)).otherwise(F.concat(F.lit("at 10^-"), n))
    rate = extract.in_unit(F.col("p_retailprice"), F.col("p_type"), {"SMALL": 0.001, "LARGE": 1000.0, "ECONOMY": 1.0})
    exact = F.when(F.col("p_type") == "SMALL", F.col("p_retailprice") / 1000).otherwise(rate)
    return table(spark, d, "part").select("p_partkey", (extract.error_rate(written) > 1e-12).alias("high"), exact.alias("rate"))


@query("SELECT item_id, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) AS text FROM benchmark")
def inverted_index_text(spark: SparkSession, d: str) -> DataFrame:
    """Passages to inverted indexes and back."""
    words = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", "[ \n]+", " ")), " ")).alias("p", "w"))
    index = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("item_id", references.rebuilt(F.col("index")).alias("text"))


_RULES = [("modulator", "tion"), ("receiver", "apache|cc by"), ("driver", "[#$%&*]{3}")]
_ONE_SQL = "[x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in _RULES) + "] IF x IS NOT NULL]"


@query(f"SELECT doc_id, CASE WHEN len({_ONE_SQL}) = 1 THEN ({_ONE_SQL})[1] ELSE 'other' END AS subtype FROM documents")
def subtype_exactly_one(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", extract.one_label(F.col("text"), _RULES, "other").alias("subtype"))


@query("""WITH s AS (SELECT doc_id, (n_chars % 100)::DOUBLE AS m, (doc_id * 7 % 100)::DOUBLE AS nov, 100 * greatest(0, 1 - 0.08::DOUBLE * (doc_id % 15)) AS fresh FROM documents)
SELECT doc_id, round(0.65::DOUBLE * m + 0.35::DOUBLE * nov, 6) AS explore, round(0.55::DOUBLE * m + 0.45::DOUBLE * fresh, 6) AS recent, m AS match FROM s""")
def mode_scores(spark: SparkSession, d: str) -> DataFrame:
    m, nov = (F.col("n_chars") % 100).cast("double"), (F.col("doc_id") * 7 % 100).cast("double")
    fresh = 100 * select.recency(F.col("doc_id") % 15)
    return table(spark, d, "documents").select("doc_id", *[select.mode_score(x, m, nov, fresh).alias(x) for x in ("explore", "recent", "match")])


@query()
def diverse_greedy(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") % 1000 / 10.0).alias("score"), F.col("lang").alias("topic"), F.col("source").alias("venue"), F.array_distinct(S.words(F.col("text"))).alias("terms"))
    return select.diverse(docs, 60)


@query()
def greedy_batches(spark: SparkSession, d: str) -> DataFrame:
    return select.bounded_batches(table(spark, d, "documents"), "source", ["doc_id"], "doc_id", "n_chars")


@query("SELECT user_id, last FROM (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'view' GROUP BY 1) WHERE last < TIMESTAMP '2024-01-30 00:00:00'")
def freshness_targets(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "events").where("event_type = 'view'").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.where(F.col("last") < F.lit("2024-01-30 00:00:00").cast("timestamp"))


@query("""SELECT user_id, count(*) AS attempts, arg_max(event_type, (ts, event_id)) AS latest, count(*) FILTER (WHERE event_type = 'error') >= 20 AS terminal FROM events GROUP BY 1""")
def retry_state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"), (F.count_if(F.col("event_type") == "error") >= 20).alias("terminal"))


@query("""WITH n AS (SELECT item_id, item_id % 6 AS paper, row_number() OVER (PARTITION BY item_id % 6 ORDER BY item_id)::INT AS number, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS entry FROM benchmark)
SELECT paper, number, entry FROM n WHERE paper <> 5""")
def reference_segments(spark: SparkSession, d: str) -> DataFrame:
    """Passages written as reference lists and cut again; a list with a gap (paper 5) is unresolved."""
    w = Window.partitionBy("paper").orderBy("item_id")
    items = table(spark, d, "benchmark").withColumn("paper", F.col("item_id") % 6).withColumn("n", F.row_number().over(w) + F.when(F.col("paper") == 5, 1).otherwise(0))
    line = F.struct("n", F.concat(F.lit("["), F.col("n"), F.lit("] "), F.regexp_replace("text", "\n", " ")).alias("line"))
    pages = items.groupBy("paper").agg(F.array_sort(F.collect_list(line)).alias("l"))
    pages = pages.select("paper", F.concat(F.lit("Body [1] of text.\nReferences\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\nAppendix\n[9] no")).alias("text"))
    return references.segments(pages, "paper", "text")


@query("""SELECT conv_id, turn, last_value(CASE WHEN turn % 3 <> 1 THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS authors FROM conversations""")
def repeated_authors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "---").otherwise(F.col("role")).alias("authors"))
    return references.repeated_authors(rows, "conv_id", "turn", "authors")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000)
SELECT (SELECT count(*) FROM b WHERE k NOT IN (FROM a)) AS added, (SELECT count(*) FROM a WHERE k NOT IN (FROM b)) AS removed, (SELECT count(*) FROM a JOIN b USING (k)) AS kept""")
def favourite_delta(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.lit(True).alias("a")).distinct()
    b = o.where("o_orderstatus = 'P' AND o_totalprice > 300000").select(F.col("o_custkey").alias("k"), F.lit(True).alias("b")).distinct()
    both = a.join(b, "k", "full_outer")
    return both.agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))
