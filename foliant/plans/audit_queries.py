"""Queries of key reconciliation, reports between runs, concepts and markup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import evidence, ingest, ranking, relate
from ..sources.tables import table
from .register import registry

QUERIES, ORACLES, query = registry()


def _split(columns: str) -> list[str]:
    """Column texts parted at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]



@query(" UNION ALL ".join(f"""SELECT l_partkey, '{n}' AS field, arg_max({c}, (CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 3 ELSE 1 END, l_shipdate, l_orderkey, {c})) AS value
FROM lineitem WHERE {c} > {v} GROUP BY 1""" for n, c, v in (("rate", "l_quantity", 10), ("loss", "l_discount", 0), ("tax", "l_tax", 0))))
def best_per_field(spark: SparkSession, d: str) -> DataFrame:
    """Each field of a part from its best row with that field: one aggregate a part picks all, its row is unpivoted."""
    fields = {"rate": ("l_quantity", 10), "loss": ("l_discount", 0), "tax": ("l_tax", 0)}
    first = [S.priority(F.col("l_returnflag"), {"A": 4, "R": 3}, 1), F.col("l_shipdate"), F.col("l_orderkey")]
    # the value is the rank's last part, so the greatest rank holds it
    best = [F.max(F.when(F.col(c) > v, F.struct(*(x.alias(f"_{i}") for i, x in enumerate(first)), F.col(c).alias("value")))).alias(n) for n, (c, v) in fields.items()]
    found = table(spark, d, "lineitem").groupBy("l_partkey").agg(*best)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).isNotNull().alias("there"), F.col(f"{n}.value").alias("value")) for n in fields]))
    return found.select("l_partkey", each.alias("f")).where("f.there").select("l_partkey", "f.field", "f.value")


_RATES = """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS reported, CASE WHEN l_suppkey % 3 = 0 THEN l_quantity - 10 END AS lane,
CASE WHEN l_partkey % 4 = 0 THEN l_quantity * 4 END AS aggregate, CASE WHEN l_partkey % 11 = 0 THEN 1.0 END AS least, CASE WHEN l_partkey % 13 = 0 THEN 2.0 END AS greatest, l_suppkey % 5 AS lanes,
CASE l_linenumber WHEN 1 THEN ' Aggregate' WHEN 2 THEN 'lane' WHEN 3 THEN 'unknown' END AS scope, CASE WHEN l_returnflag = 'A' AND l_tax > 0.06 THEN 'user_sheet' ELSE 'pdf' END AS source,
CASE l_linestatus WHEN 'O' THEN CASE WHEN l_tax > 0.04 THEN 'lane' ELSE 'aggregate' END ELSE CASE WHEN l_tax > 0.04 THEN 'unknown' END END AS power"""
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_NO = lambda reason: f"{{'f': NULL, 'v': NULL::DOUBLE, 'r': '{reason}'}}"
_YES = lambda field, value, reason: f"{{'f': {field}, 'v': ({value})::DOUBLE, 'r': '{reason}'}}"
_LANE, _ALL = ("CASE WHEN lane IS NULL THEN 'reported_rate_gbps' ELSE 'lane_rate_gbps' END", "coalesce(nullif(lane, 0), reported)"), ("CASE WHEN aggregate IS NULL THEN 'reported_rate_gbps' ELSE 'aggregate_rate_gbps' END", "coalesce(nullif(aggregate, 0), reported)")


@query(f"""SELECT {_KEY}, c.f IS NOT NULL AS eligible, c.f AS field, c.v AS rate, c.r AS reason FROM (SELECT {_KEY}, CASE
WHEN source = 'user_sheet' THEN CASE WHEN reported IS NOT NULL THEN {_YES("'reported_rate_gbps'", 'reported', 'spreadsheet_speed_column')} WHEN lane IS NOT NULL THEN {_YES("'lane_rate_gbps'", 'lane', 'spreadsheet_speed_column')}
  WHEN aggregate IS NOT NULL THEN {_YES("'aggregate_rate_gbps'", 'aggregate', 'spreadsheet_speed_column')} ELSE {_NO('missing_fixed_bit_rate')} END
WHEN least IS NOT NULL OR greatest IS NOT NULL THEN {_NO('rate_range_without_operating_point')}
WHEN trim(lower(scope)) = 'aggregate' THEN CASE WHEN {_ALL[1]} IS NOT NULL THEN {_YES(*_ALL, 'explicit_aggregate_rate')} ELSE {_NO('missing_aggregate_rate')} END
WHEN lanes > 1 AND power = 'lane' THEN CASE WHEN {_LANE[1]} IS NOT NULL THEN {_YES(*_LANE, 'per_lane_power')} ELSE {_NO('missing_lane_rate')} END
WHEN lanes > 1 AND power = 'aggregate' THEN CASE WHEN aggregate IS NOT NULL THEN {_YES("'aggregate_rate_gbps'", 'aggregate', 'total_power_multilane')} ELSE {_NO('missing_aggregate_rate')} END
WHEN lanes > 1 THEN {_NO('multilane_power_scope_unknown')}
WHEN power = 'lane' OR scope = 'lane' THEN CASE WHEN {_LANE[1]} IS NOT NULL THEN {_YES(*_LANE, 'single_lane_rate')} ELSE {_NO('missing_lane_rate')} END
WHEN power = 'aggregate' AND aggregate IS NOT NULL THEN {_YES("'aggregate_rate_gbps'", 'aggregate', 'explicit_total_power')}
WHEN reported IS NOT NULL THEN {_YES("'reported_rate_gbps'", 'reported', 'single_reported_rate')} WHEN lane IS NOT NULL THEN {_YES("'lane_rate_gbps'", 'lane', 'single_lane_rate')}
WHEN aggregate IS NOT NULL THEN {_YES("'aggregate_rate_gbps'", 'aggregate', 'only_aggregate_rate')} ELSE {_NO('missing_fixed_bit_rate')} END AS c FROM (SELECT {_RATES} FROM lineitem))""")
def rate_denominator(spark: SparkSession, d: str) -> DataFrame:
    """The rate that each power may be divided by, or why there is none."""
    rows = table(spark, d, "lineitem").selectExpr(*_split(_RATES))
    names = "reported lane aggregate least greatest lanes scope source".split()
    c = F.col("c")
    found = rows.select(*_split(_KEY), evidence.rate_choice({n: F.col(n) for n in names}, F.col("power")).alias("c"))
    return found.select(*_split(_KEY), c["eligible"].alias("eligible"), c["field"].alias("field"), c["value"].alias("rate"), c["reason"].alias("reason"))


@query("""WITH inc AS (SELECT o_orderkey AS key, 'd' || o_custkey AS doi, o_orderpriority = '1-URGENT' AS uri FROM orders), ex AS (SELECT c_custkey AS key, 'D' || (c_custkey * 2) AS doi FROM customer),
b AS (SELECT doi, key, row_number() OVER (PARTITION BY doi ORDER BY uri DESC, key) AS n FROM inc) SELECT b.doi, coalesce(ex.key, b.key) AS key, ex.key IS NOT NULL AS reused FROM b LEFT JOIN ex ON lower(ex.doi) = b.doi WHERE n = 1""")
def doi_key_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """The key of each DOI: the one it has already, else the publisher's before a fallback."""
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("doi"), (F.col("o_orderpriority") == "1-URGENT").alias("uri"))
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("_key"), F.lower(F.concat(F.lit("D"), (F.col("c_custkey") * 2).cast("string"))).alias("doi"))
    first = relate.first_by(new, ["doi"], F.struct((~F.col("uri")).alias("a"), F.col("key").alias("b")), key="key")
    return first.join(old, "doi", "left").select("doi", F.coalesce("_key", "key").alias("key"), F.col("_key").isNotNull().alias("reused"))


@query("""SELECT c_custkey, coalesce(a.s_suppkey, b.n_nationkey::BIGINT, c.r_regionkey::BIGINT, c_custkey) AS target, CASE WHEN a.s_suppkey IS NOT NULL THEN 'uri' WHEN b.n_nationkey IS NOT NULL THEN 'number' WHEN c.r_regionkey IS NOT NULL THEN 'title' ELSE 'retain' END AS action
FROM customer LEFT JOIN supplier a ON a.s_suppkey = c_custkey LEFT JOIN nation b ON b.n_nationkey = c_custkey % 200 LEFT JOIN region c ON c.r_regionkey = c_custkey % 11""")
def legacy_key_merge(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a, b, e = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(a, F.col("s_suppkey") == F.col("c_custkey"), "left").join(b, F.col("n_nationkey") == F.col("c_custkey") % 200, "left").join(e, F.col("r_regionkey") == F.col("c_custkey") % 11, "left")
    action = F.when(F.col("s_suppkey").isNotNull(), "uri").when(F.col("n_nationkey").isNotNull(), "number").when(F.col("r_regionkey").isNotNull(), "title").otherwise("retain")
    return j.select("c_custkey", F.coalesce("s_suppkey", F.col("n_nationkey").cast("long"), F.col("r_regionkey").cast("long"), "c_custkey").alias("target"), action.alias("action"))


@query("""WITH q AS (SELECT l_suppkey AS queue, l_partkey AS doc, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_partkey, l_orderkey) AS depth FROM lineitem), f AS (SELECT * FROM q WHERE depth <= 20),
a AS (SELECT doc, min((depth, queue)) AS pos FROM f GROUP BY 1), t AS (SELECT doc, p_name || p_brand AS title, pos, row_number() OVER (PARTITION BY p_name || p_brand ORDER BY pos, doc) AS n FROM a JOIN part ON p_partkey = doc)
SELECT doc, title FROM t WHERE n = 1 ORDER BY pos, doc LIMIT 150""")
def round_robin_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Queues in turn; a document keeps its first place, then a title its first document."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("queue"), F.col("l_partkey").alias("doc"), "l_extendedprice", "l_orderkey")
    f = ranking.top(rows, ["queue"], [F.desc("l_extendedprice"), F.col("doc"), F.col("l_orderkey")], 20, rank="depth")
    a = f.groupBy("doc").agg(F.min(F.struct("depth", "queue")).alias("at"))
    t = a.join(table(spark, d, "part"), F.col("p_partkey") == F.col("doc")).select("doc", F.concat("p_name", "p_brand").alias("title"), "at")
    return ranking.top(t, ["title"], [F.col("at"), F.col("doc")]).orderBy("at", "doc").limit(150).select("doc", "title")


@query("""WITH s AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.!?]+')) AS s FROM documents) SELECT doc_id, count(*) FILTER (WHERE regexp_matches(s, 'tion') AND NOT regexp_matches(s, 'not |without|compared')) AS tion,
count(*) FILTER (WHERE regexp_matches(s, 'ere') AND NOT regexp_matches(s, 'not |without|compared')) AS ere FROM s GROUP BY 1""")
def sentence_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a concept, but for negations and comparisons."""
    s = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[.!?]+")).alias("s"))
    fine = ~F.col("s").rlike("not |without|compared")
    return s.groupBy("doc_id").agg(*[F.count_if(F.col("s").rlike(c) & fine).alias(c) for c in ("tion", "ere")])


@query("""WITH a(term, alias) AS (VALUES ('red', 'crimson'), ('blue', 'azure'), ('widget', 'gadget'), ('small', 'tiny')), t AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part)
SELECT p_partkey, term FROM t UNION SELECT p_partkey, alias FROM t JOIN a USING (term)""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    alias = spark.createDataFrame([("red", "crimson"), ("blue", "azure"), ("widget", "gadget"), ("small", "tiny")], "term string, alias string")
    t = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return t.unionByName(t.join(F.broadcast(alias), "term").select("p_partkey", F.col("alias").alias("term"))).distinct()


@query("""SELECT lang, count(*) AS rows, count(DISTINCT md5(text)) AS contents, count(*) - count(DISTINCT md5(text)) AS copies FROM documents GROUP BY 1""")
def corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Rows and different contents a language. Copies are folded by digest first, so a large group of copies is one row a task."""
    each = table(spark, d, "documents").groupBy("lang", F.md5("text").alias("m")).agg(F.count("*").alias("n"))
    return each.groupBy("lang").agg(F.sum("n").alias("rows"), F.count("m").alias("contents"), (F.sum("n") - F.count("m")).alias("copies"))


@query("""WITH a AS (SELECT l_orderkey AS k, bool_or(l_discount > 0.09) AS e FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey AS k, bool_or(l_tax > 0.07) AS e FROM lineitem GROUP BY 1)
SELECT CASE WHEN coalesce(a.e, false) AND coalesce(b.e, false) THEN 'remaining' WHEN coalesce(a.e, false) THEN 'fixed' WHEN coalesce(b.e, false) THEN 'new' ELSE 'clean' END AS change, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def backtest_report(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.bool_or(F.col("l_discount") > 0.09).alias("a"))
    b = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.bool_or(F.col("l_tax") > 0.07).alias("b"))
    x, y = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return a.join(b, "k", "full_outer").groupBy(F.when(x & y, "remaining").when(x, "fixed").when(y, "new").otherwise("clean").alias("change")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*) AS rows, count(DISTINCT turn) AS pages, max(turn) + 1 AS expected, count(DISTINCT turn) = max(turn) + 1 AND count(*) = count(DISTINCT turn) AS whole FROM conversations GROUP BY 1""")
def page_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Whether all pages of a listing came, each once."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("rows"), F.count_distinct("turn").alias("pages"), (F.max("turn") + 1).alias("expected"))
    return g.withColumn("whole", (F.col("pages") == F.col("expected")) & (F.col("rows") == F.col("pages")))


@query("""SELECT page_id, len(regexp_extract_all(html, '<li')) AS items, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""")
def markup_structure(spark: SparkSession, d: str) -> DataFrame:
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return table(spark, d, "pages").select("page_id", n("<li").alias("items"), n("<p[ >]").alias("paragraphs"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND NOT o_orderstatus = 'F' THEN 0.94 WHEN o_orderpriority = '3-MEDIUM' THEN 0.84 WHEN o_orderstatus = 'P' THEN 0.70 ELSE 0.45 END::DOUBLE AS confidence,
least(CASE o_orderstatus WHEN 'O' THEN 0.76 WHEN 'P' THEN 0.64 ELSE 0.99 END, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0.84 ELSE 0.9 END)::DOUBLE AS capped FROM orders""")
def confidence_caps(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    confidence = F.when(p.isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") > 100000) & (s != "F"), 0.94).when(p == "3-MEDIUM", 0.84).when(s == "P", 0.7).otherwise(0.45)
    cap = F.least(F.when(s == "O", 0.76).when(s == "P", 0.64).otherwise(0.99), F.when(p == "3-MEDIUM", 0.84).otherwise(0.9))
    return table(spark, d, "orders").select("o_orderkey", confidence.alias("confidence"), cap.alias("capped"))


_SOURCE = "CASE WHEN conv_id % 2 = 0 THEN 'abstract' ELSE 'pdf' END"
_STATED = f"""conv_id AS measurement, conv_id * 1000 + turn AS id, CASE role WHEN 'user' THEN 'power_mw' WHEN 'assistant' THEN 'reported_rate_gbps' ELSE 'ber' END AS field,
CASE WHEN turn = 5 THEN 'figure' ELSE {_SOURCE} END AS source, CASE WHEN turn > 3 THEN 'p. ' || CAST(turn % 2 AS STRING) END AS locator, CASE WHEN conv_id % 4 = 0 THEN CASE WHEN turn = 2 THEN -1 ELSE conv_id END END AS abstract,
CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'rejected' END AS review, CASE WHEN turn <> 3 THEN (turn % 3) / 2.0 END AS confidence, text || CASE WHEN conv_id % 3 = 0 THEN '  The LINK runs at 112 Gb/s from a supply of 0.9 V' ELSE '' END AS text"""


@query(f"""WITH RECURSIVE e AS (SELECT measurement, id, field, source, coalesce(locator, '') AS place, abstract, coalesce(confidence, 0) AS sure, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM (SELECT {_STATED} FROM conversations) WHERE review IS NULL),
own AS (SELECT e.* FROM e JOIN (SELECT DISTINCT conv_id, {_SOURCE} AS s FROM conversations) c ON e.measurement = c.conv_id AND e.source = c.s),
met AS (SELECT p.measurement, p.id AS p, r.id AS r, p.sure, p.text AS a, r.text AS b FROM own p JOIN own r ON p.measurement = r.measurement AND p.place = r.place AND p.abstract IS NOT DISTINCT FROM r.abstract WHERE p.field = 'power_mw' AND r.field = 'reported_rate_gbps'),
walk AS (SELECT p, r, 0 AS n FROM met UNION ALL SELECT w.p, w.r, w.n + 1 FROM walk w JOIN met USING (p, r) WHERE len(list_filter(range(1, length(a) - n + 1), lambda i: contains(b, substr(a, i::INT, n + 1)))) > 0),
shared AS (SELECT p, r, max(n) AS n FROM walk GROUP BY 1, 2),
best AS (SELECT measurement, p, r, n, row_number() OVER (PARTITION BY measurement ORDER BY n DESC, sure DESC, p, r) AS k FROM met JOIN shared USING (p, r)),
has AS (SELECT measurement, bool_or(field = 'power_mw') AS hp, bool_or(field = 'reported_rate_gbps') AS hr FROM own GROUP BY 1),
o AS (SELECT c.conv_id AS measurement, CASE WHEN NOT coalesce(hp, false) THEN 'missing_power_evidence' WHEN NOT coalesce(hr, false) THEN 'missing_rate_evidence' WHEN n IS NULL THEN 'cross_source_or_locator'
WHEN s = 'abstract' AND n < 40 THEN 'abstract_context_not_shared' ELSE 'same_source_locator' END AS reason, n AS shared, p AS power_id, r AS rate_id FROM (SELECT DISTINCT conv_id, {_SOURCE} AS s FROM conversations) c LEFT JOIN has ON has.measurement = c.conv_id LEFT JOIN best ON best.measurement = c.conv_id AND k = 1)
SELECT measurement, reason = 'same_source_locator' AS eligible, reason, shared::DOUBLE AS shared, power_id::DOUBLE AS power_id, rate_id::DOUBLE AS rate_id FROM o""".replace("AS STRING", "AS VARCHAR"))
def evidence_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The statements of a power and a rate, made in one place, that share the longest run of signs."""
    convs = table(spark, d, "conversations")
    measurements = convs.selectExpr("conv_id AS measurement", f"{_SOURCE} AS source").distinct()
    found = evidence.pairs(measurements, convs.selectExpr(*_split(_STATED)), ["power_mw"], evidence.RATE_FIELDS["reported_rate_gbps"])
    return found.withColumns({c: F.col(c).cast("double") for c in ("shared", "power_id", "rate_id")})


@query("""SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS negative, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1 HAVING count(*) > 1""")
def venue_audit(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_distinct("c_nationkey").alias("nations"))
    return g.where("n > 1")


@query("""SELECT a.k, a.digest = b.digest AS same FROM (SELECT p_partkey AS k, sha256(p_name || chr(31) || p_brand) AS digest FROM part) a JOIN (SELECT p_partkey AS k, sha256(p_name || chr(31) || CASE WHEN p_size = 9 THEN 'x' ELSE p_brand END) AS digest FROM part) b USING (k)""")
def protected_fields(spark: SparkSession, d: str) -> DataFrame:
    """Digests of protected fields before and after a batch."""
    part = table(spark, d, "part").withColumnRenamed("p_partkey", "k")
    before = ingest.fingerprint(part, "k", ["p_name", "p_brand"])
    after = ingest.fingerprint(part.withColumn("p_brand", F.when(F.col("p_size") == 9, "x").otherwise(F.col("p_brand"))), "k", ["p_name", "p_brand"]).withColumnRenamed("digest", "after")
    return before.join(after, "k").select("k", (F.col("digest") == F.col("after")).alias("same"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'tion') AND regexp_matches(lower(text), 'ere') AND NOT regexp_matches(lower(text), 'ing') THEN true ELSE false END AS excluded FROM documents""")
def topic_exclusion(spark: SparkSession, d: str) -> DataFrame:
    has = lambda p: F.lower("text").rlike(p)
    return table(spark, d, "documents").select("doc_id", (has("tion") & has("ere") & ~has("ing")).alias("excluded"))
