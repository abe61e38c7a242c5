"""Search, filter, join and ranking queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import catalog, ranking, relate
from ..sources.tables import table
from .register import registry

QUERIES, ORACLES, query = registry()

#: A whole line of lineitem in a fixed order: the table has no smaller key.
LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")


@query("""SELECT doc_id, source, n_chars FROM documents
WHERE contains(lower(text), 'the 5') OR contains(lower(source), 'src1') ORDER BY n_chars DESC, doc_id LIMIT 50""")
def catalog_search_page(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    found = docs.where(S.any_contains([F.col("text"), F.col("source")], "the 5") | S.contains(F.col("source"), "SRC1"))
    return catalog.page(found, [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source", "n_chars")


@query("""SELECT doc_id, n_chars FROM documents WHERE (contains(lower(text), 'tion') OR contains(lower(lang), 'tion'))
AND (contains(lower(text), 'en') OR contains(lower(lang), 'en')) AND (contains(lower(text), '%') OR contains(lower(lang), '%'))""")
def search_token_and(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(S.all_tokens([F.col("text"), F.col("lang")], "tion EN %")).select("doc_id", "n_chars")


@query("""SELECT c_custkey, c_name, (c_name = 'Customer#000000012') AS exact FROM customer
WHERE starts_with(c_name, 'Customer#0000000') ORDER BY exact DESC, c_name LIMIT 51""")
def search_identifier_first(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").where(F.col("c_name").startswith("Customer#0000000"))
    c = c.withColumn("exact", F.col("c_name") == "Customer#000000012")
    return c.orderBy(F.desc("exact"), "c_name").limit(51).select("c_custkey", "c_name", "exact")


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL""")
def catalog_facets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facets(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""SELECT v AS o_orderstatus, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) AS t(v)
LEFT JOIN orders ON o_orderstatus = v GROUP BY v""")
def catalog_facets_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return catalog.zero_filled(table(spark, d, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


@query("""SELECT count(*) FILTER (WHERE o_totalprice > 200000) AS large, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE year(o_orderdate) >= 1999) AS late,
count(*) FILTER (WHERE o_custkey % 2 = 0) AS even, count(*) FILTER (WHERE o_totalprice IS NULL) AS unknown FROM orders""")
def catalog_conditional_counts(spark: SparkSession, d: str) -> DataFrame:
    return catalog.conditional_counts(table(spark, d, "orders"), {
        "large": F.col("o_totalprice") > 200000, "done": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT",
        "late": F.year("o_orderdate") >= 1999, "even": F.col("o_custkey") % 2 == 0, "unknown": F.col("o_totalprice").isNull()})


@query("""SELECT count(DISTINCT l_orderkey) AS keys, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned,
count(DISTINCT CASE WHEN l_discount >= 0.05 THEN l_orderkey END) AS discounted, count(DISTINCT CASE WHEN l_quantity > 45 THEN l_orderkey END) AS bulky FROM lineitem""")
def catalog_distinct_conditional(spark: SparkSession, d: str) -> DataFrame:
    return catalog.conditional_distinct(table(spark, d, "lineitem"), "l_orderkey", {
        "returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") >= 0.05, "bulky": F.col("l_quantity") > 45})


@query("""SELECT doc_id, regexp_matches(lower(concat_ws(' ', source, lang, text)), 'idiot|scum|trash') AS harsh,
regexp_matches(lower(concat_ws(' ', source, lang, text)), 'licen[sc]e|creative commons|cc by') AS licensed FROM documents
WHERE regexp_matches(lower(concat_ws(' ', source, lang, text)), 'idiot|scum|trash|licen[sc]e|creative commons|cc by')""")
def filter_regex_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "source", "lang", "text"))
    docs = table(spark, d, "documents").withColumn("harsh", text.rlike("idiot|scum|trash")).withColumn("licensed", text.rlike("licen[sc]e|creative commons|cc by"))
    return docs.where(F.col("harsh") | F.col("licensed")).select("doc_id", "harsh", "licensed")


@query("""SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1998""")
def filter_year_range(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("y", S.year_number(F.date_format("o_orderdate", "yyyy-MM")))
    return o.where(catalog.in_range(F.col("y"), 1997, 1998, 1900, 2030)).select("o_orderkey", "y")


@query("""SELECT d.doc_id, coalesce(toxic = 1, false) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE NOT coalesce(toxic = 1, false)""")
def filter_tri_state(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("flag")), "doc_id", "left")
    return docs.where(catalog.tri_state(F.col("flag"), False)).select("doc_id", F.coalesce("flag", F.lit(False)).alias("toxic"))


@query("""SELECT o_orderkey, o_totalprice FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l
WHERE l.l_orderkey = o.o_orderkey AND l_quantity >= 40 AND l_discount <= 0.02 AND l_returnflag = 'N')""")
def filter_same_row_exists(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    met = relate.same_row(table(spark, d, "orders"), points, "o_orderkey", F.col("l_quantity") >= 40, F.col("l_discount") <= 0.02, F.col("l_returnflag") == "N")
    return met.select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, c_name, n_name, coalesce(CASE WHEN s_acctbal > 5000 THEN s_name END, n_name, 'unknown') AS medium
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON s_suppkey = o_custkey""")
def join_star_override(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    base = base.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("medium", F.col("n_name")).withColumn("s_suppkey", F.col("o_custkey"))
    override = table(spark, d, "supplier").withColumnRenamed("s_name", "medium")
    return relate.with_override(base, override, "s_suppkey", "medium", F.col("s_acctbal") > 5000, "unknown").select("o_orderkey", "c_name", "n_name", "medium")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def join_semi_scope(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(large, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def join_anti_feedback(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(pending, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders
WHERE o_orderstatus = 'F' GROUP BY o_custkey) USING (o_custkey, o_orderkey)""")
def join_latest_run(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    last = relate.latest(o, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F")
    return o.join(last, ["o_custkey", "o_orderkey"], "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
CASE lang WHEN 'en' THEN 100 WHEN 'de' THEN 80 WHEN 'fr' THEN 60 WHEN 'es' THEN 40 ELSE 20 END DESC, doc_id DESC) AS n FROM documents) WHERE n = 1""")
def current_abstract_view(spark: SparkSession, d: str) -> DataFrame:
    rank = S.priority(F.col("lang"), {"en": 100, "de": 80, "fr": 60, "es": 40}, 20)
    return ranking.best(table(spark, d, "documents"), ["source"], [rank, F.col("doc_id")], ["doc_id", "lang"])


@query("""SELECT l_orderkey, l_partkey, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey) AS n FROM lineitem) WHERE n = 1""")
def join_first_evidence(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("l_shipdate", "l_partkey")
    return relate.first_by(table(spark, d, "lineitem"), ["l_orderkey"], order, l_partkey="l_partkey", l_shipdate="l_shipdate")


@query("""SELECT o_orderkey, coalesce(n, 0) AS evidence FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def join_evidence_count(spark: SparkSession, d: str) -> DataFrame:
    n = catalog.facets(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
    return table(spark, d, "orders").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("evidence"))


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT s_suppkey * 3 AS k, s_nationkey AS v FROM supplier)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_left' WHEN a.k IS NULL THEN 'only_right' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'equal' ELSE 'changed' END AS status
FROM a FULL JOIN b ON a.k = b.k""")
def join_full_outer_reconcile(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    b = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_nationkey").alias("v"))
    return relate.reconcile(a, b, "k", ["v"])


@query("""SELECT s.s_suppkey, a.n_name AS home, b.n_name AS next FROM supplier s JOIN nation a ON s_nationkey = a.n_nationkey
JOIN nation b ON (s_nationkey + 1) % 25 = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey""")
def join_two_role(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b, s = n.alias("a"), n.alias("b"), table(spark, d, "supplier")
    j = s.join(a, F.col("s_nationkey") == F.col("a.n_nationkey")).join(b, (F.col("s_nationkey") + 1) % 25 == F.col("b.n_nationkey"))
    return j.where("a.n_regionkey <> b.n_regionkey").select("s_suppkey", F.col("a.n_name").alias("home"), F.col("b.n_name").alias("next"))


@query("""SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) AS n FROM orders GROUP BY 1
HAVING NOT (bool_or(o_orderpriority = '1-URGENT') AND bool_or(o_orderpriority = '5-LOW'))""")
def having_missing_flags(spark: SparkSession, d: str) -> DataFrame:
    flag = lambda v: F.bool_or(F.col("o_orderpriority") == v)
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("n"), flag("1-URGENT").alias("a"), flag("5-LOW").alias("b"))
    return g.where(~(F.col("a") & F.col("b"))).select("o_custkey", "done", "n")


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders
ORDER BY coalesce(list_position(['1-URGENT', '2-HIGH'], o_orderpriority), 0), CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey LIMIT 60""")
def sort_enum_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return catalog.page(o, [S.enum_rank(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]), price.desc_nulls_last(), F.col("o_orderkey")], 1, 60).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 60""")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page(table(spark, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 30, 100).select("o_orderkey", "o_totalprice")


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS of FROM documents)
SELECT doc_id, source, (n - 1) / of::DOUBLE AS turn FROM g ORDER BY (n - 1) / of::DOUBLE, n_chars DESC, source LIMIT 100""")
def weighted_interleave(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ranking.weighted_interleave(docs, "source", [F.desc("n_chars"), F.col("doc_id")], F.col("n_chars"), 100).select("doc_id", "source", "turn")


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS of FROM documents)
SELECT doc_id, source, n::INT AS turn FROM g ORDER BY n, of DESC, source LIMIT 80""")
def balanced_round_robin(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return ranking.round_robin(docs, "source", [F.desc("n_chars"), F.col("doc_id")], 80).select("doc_id", "source", "turn")


@query("""SELECT doc_id, source, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents)
WHERE n <= 20 ORDER BY n_chars DESC, doc_id LIMIT 180""")
def per_source_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranking.capped(table(spark, d, "documents"), "source", [F.desc("n_chars"), F.col("doc_id")], 20, 180).select("doc_id", "source", "n_chars")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, 100 * n / (SELECT sum(n) FROM c)::DOUBLE AS x FROM c),
r AS (SELECT *, floor(x) AS f, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS k FROM e)
SELECT source, n, (f + CASE WHEN k <= 100 - (SELECT sum(f) FROM r) THEN 1 ELSE 0 END)::BIGINT AS quota FROM r""")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    return ranking.largest_remainder(catalog.facets(table(spark, d, "documents"), "source"), "source", "n", 100)


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('s7|' || doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 7""")
def stratified_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return ranking.hash_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 7, "s7")


@query("""WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY lang, source, n_chars DESC, doc_id) AS sequence FROM documents)
SELECT doc_id, sequence, ((sequence - 1) // 25 + 1)::BIGINT AS batch, ((sequence - 1) % 25 + 1)::BIGINT AS item FROM s""")
def batch_numbering(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return ranking.batches(ranking.sequence(docs, ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")]), 25).select("doc_id", "sequence", "batch", "item")


@query("""SELECT o_custkey, o_orderkey, n::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, rank="place").select("o_custkey", "o_orderkey", "place")
