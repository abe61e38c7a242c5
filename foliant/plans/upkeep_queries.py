"""Upkeep queries: snapshots after batches, gates, audits, sessions and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import ingest, measure, state
from ..sources.tables import inventory_check, table
from .register import registry

QUERIES, ORACLES, query = registry()

_OLD_SQL = "SELECT c_custkey AS k, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS doi, c_mktsegment AS title, c_acctbal AS pdf FROM customer"
_NEW_SQL = "SELECT o_custkey AS k, min(o_orderpriority) AS doi, CASE max(o_orderstatus) WHEN 'O' THEN 'N/A' ELSE max(o_orderstatus) END AS title, max(o_totalprice) AS pdf FROM orders GROUP BY 1"


def _old(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("doi"), F.col("c_mktsegment").alias("title"), F.col("c_acctbal").alias("pdf"))


def _new(spark: SparkSession, d: str) -> DataFrame:
    status = F.max("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.min("o_orderpriority").alias("doi"), F.when(status == "O", "N/A").otherwise(status).alias("title"), F.max("o_totalprice").alias("pdf"))


@query(f"""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.title IS NULL OR b.title IN ('', 'N/A') THEN a.title ELSE b.title END AS title,
CASE WHEN a.doi IS NULL OR a.doi IN ('', 'N/A') THEN b.doi ELSE a.doi END AS doi, greatest(a.pdf, b.pdf) AS pdf FROM ({_OLD_SQL}) a FULL JOIN ({_NEW_SQL}) b ON a.k = b.k""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return ingest.upsert(_old(spark, d), _new(spark, d), "k", replace=["title"], keep=["doi"], most=["pdf"])


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    """Customers of the catalogue that a run, the large orders, no longer has."""
    new = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    return ingest.missing(new, table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k")


@query("""WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY m DESC) AS k FROM m),
u AS (SELECT o_custkey, avg(n) AS usual, count(*) AS runs FROM r WHERE k BETWEEN 2 AND 6 GROUP BY 1)
SELECT o_custkey, n, round(coalesce(usual, 0), 6) AS usual, (n > 0 AND n >= 0.7 * coalesce(usual, 0)) AS ok FROM r LEFT JOIN u USING (o_custkey) WHERE k = 1""")
def count_drop_gate(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's last month against the mean of up to five months before it."""
    months = table(spark, d, "orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    last = months.groupBy("o_custkey").agg(F.max_by("n", "m").alias("n"), F.max("m").alias("_m"))
    before = months.join(last.select("o_custkey", "_m"), "o_custkey").where("m < _m")
    usual = measure.recent_mean(before, "o_custkey", F.desc("m"), "n")
    return measure.drop_gate(last.join(usual, "o_custkey", "left"), "o_custkey", "n", "usual").select("o_custkey", "n", F.round(F.coalesce("usual", F.lit(0.0)), 6).alias("usual"), "ok")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, min(l_suppkey) AS first, max(l_suppkey) AS last FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def ownership_conflict(spark: SparkSession, d: str) -> DataFrame:
    return ingest.contested(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("SELECT p_name, min(p_brand) AS p_brand FROM part WHERE p_size < 3 GROUP BY 1 HAVING count(DISTINCT p_brand) = 1")
def unique_target_map(spark: SparkSession, d: str) -> DataFrame:
    return ingest.unique_only(table(spark, d, "part").where("p_size < 3"), "p_name", "p_brand")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'd' || c_custkey END AS doi FROM customer),
p AS (SELECT o_custkey * 2 AS k, CASE WHEN o_orderkey % 6 = 0 THEN 'd' || (o_custkey * 2) WHEN o_orderkey % 6 = 1 THEN NULL ELSE CASE WHEN (o_custkey * 2) % 4 = 0 THEN NULL ELSE 'd' || (o_custkey * 2) END END AS expected,
CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'd' || (o_custkey * 2) ELSE 'x' || (o_orderkey % 5000) END AS proposed FROM orders),
s AS (SELECT proposed FROM p GROUP BY 1 HAVING count(DISTINCT k) > 1), t AS (SELECT doi AS proposed, min(k) AS o1, max(k) AS o2 FROM c WHERE doi IS NOT NULL GROUP BY 1)
SELECT p.k, p.expected, p.proposed, CASE WHEN c.k IS NULL THEN 'missing_row' WHEN c.doi IS NOT DISTINCT FROM p.proposed THEN 'already_applied' WHEN c.doi IS DISTINCT FROM p.expected THEN 'stale'
WHEN p.proposed IS NULL THEN 'preserved' WHEN p.proposed IN (SELECT proposed FROM s WHERE proposed IS NOT NULL) OR (t.o1 IS NOT NULL AND (t.o1 <> p.k OR t.o2 <> p.k)) THEN 'collision' ELSE 'accept' END AS verdict
FROM p LEFT JOIN c ON c.k = p.k LEFT JOIN t ON t.proposed = p.proposed""")
def plan_changes(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("o_custkey") * 2, F.col("o_orderkey")
    own = F.concat(F.lit("d"), k.cast("string"))
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("d"), F.col("c_custkey").cast("string"))).alias("doi"))
    proposals = table(spark, d, "orders").select(
        k.alias("k"), F.when(o % 6 == 0, own).when(o % 6 == 1, F.lit(None)).when(k % 4 != 0, own).alias("expected"),
        F.when(o % 11 == 0, F.lit(None)).when(o % 3 == 0, own).otherwise(F.concat(F.lit("x"), (o % 5000).cast("string"))).alias("proposed"))
    return ingest.plan_changes(proposals, current, "k", "doi")


@query("SELECT s_suppkey, sha256(s_name || chr(31) || s_nationkey::VARCHAR) AS digest FROM supplier")
def integrity_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return ingest.fingerprint(table(spark, d, "supplier"), "s_suppkey", ["s_name", "s_nationkey"])


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'orphan' ELSE 'present' END AS status
FROM (SELECT DISTINCT doc_id AS k FROM labels) a FULL JOIN (SELECT doc_id AS k FROM documents) b ON a.k = b.k""")
def inventory_join(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "labels").select(F.col("doc_id").alias("k")).distinct()
    return inventory_check(records, table(spark, d, "documents").select(F.col("doc_id").alias("k")), "k")


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no_title' WHEN n_chars < 20 THEN 'short' WHEN regexp_matches(lower(text), 'correction|erratum|publisher') THEN 'low_quality' ELSE 'kept' END AS reason FROM documents""")
def import_validation(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    reason = F.when(S.blank_to_null(text).isNull(), "no_title").when(F.col("n_chars") < 20, "short").when(F.lower(text).rlike("correction|erratum|publisher"), "low_quality").otherwise("kept")
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))


@query("""SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS observed, CASE WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) <= 300000000 THEN 'online'
WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) <= 86400000000 THEN 'idle' ELSE 'offline' END AS status FROM events GROUP BY 1""")
def session_rollup(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return state.rollup(table(spark, d, "events"), "user_id", "ts", now)


@query("""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e) SELECT user_id, count(*) AS n, min(ts) AS start, max(ts) AS last FROM s GROUP BY user_id, s""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return state.sessions(table(spark, d, "events"), "user_id", "ts")


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS recent FROM events""")
def rolling_24h_count(spark: SparkSession, d: str) -> DataFrame:
    return state.rolling_count(table(spark, d, "events"), "user_id", "ts").select("event_id", "user_id", "recent")


@query("""SELECT event_id, user_id, day FROM (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY md5('pick|' || ts::DATE::VARCHAR || '|' || event_id::VARCHAR), event_id) AS n FROM events) WHERE n <= 2""")
def daily_hash_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    return state.daily_pick(rows, "user_id", "day", "event_id")


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-30 12:00:00'")
def ttl_live_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("expires", F.col("ts") + F.expr("INTERVAL 6 HOURS"))
    return state.live(rows, "expires", F.lit("2024-01-30 12:00:00").cast("timestamp")).select("event_id", "user_id")


@query("""SELECT event_id, user_id AS k, (event_id % 3)::INT AS version, CASE WHEN c.k IS NULL THEN 'missing' WHEN c.version = event_id % 3 THEN 'applied' ELSE 'conflict' END AS outcome
FROM events LEFT JOIN (SELECT c_custkey AS k, c_custkey % 3 AS version FROM customer) c ON c.k = user_id""")
def optimistic_versions(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("version"))
    updates = table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), (F.col("event_id") % 3).cast("int").alias("version"))
    outcome = state.versioned_update(current, updates.select("k", "version").distinct(), "k")
    return updates.join(outcome, ["k", "version"]).select("event_id", "k", "version", "outcome")


@query("SELECT event_id, (props::JSON->>'$.k')::INT AS k FROM events WHERE (props::JSON->>'$.k')::INT >= 90")
def json_path_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.where("k >= 90")


@query("""WITH s AS (SELECT source, doc_id, n_chars FROM documents), a AS (SELECT source, count(*) AS present, count(*) FILTER (WHERE n_chars < 100) AS short, min(doc_id) AS first FROM s GROUP BY 1)
SELECT v AS source, coalesce(present, 0) AS present, coalesce(short, 0) AS short, present IS NULL AS missing FROM (SELECT 'src' || i AS v FROM range(0, 25) t(i)) LEFT JOIN a ON source = v""")
def coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    registered = spark.range(25).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"))
    found = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("present"), F.count_if(F.col("n_chars") < 100).alias("short"))
    return registered.join(found, "source", "left").select("source", F.coalesce("present", F.lit(0)).alias("present"), F.coalesce("short", F.lit(0)).alias("short"), F.col("present").isNull().alias("missing"))


@query("""SELECT s_nationkey, doi, n, k FROM (SELECT s_nationkey, '10.' || (1000 + s_suppkey % 90) || '/s.' || (s_suppkey % 40) AS doi, count(*) AS n, min(s_suppkey) AS k FROM supplier GROUP BY ALL) WHERE n >= 1""")
def normal_doi_groups(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    raw = F.concat(F.when(k % 2 == 0, "https://doi.org/").otherwise("DOI: "), F.lit("10."), (1000 + k % 90).cast("string"), F.lit("/S."), (k % 40).cast("string"))
    rows = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", S.normal_doi(raw).alias("doi"))
    return rows.groupBy("s_nationkey", "doi").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("k"))
