"""Measurement queries: best points, frontiers, figures, outliers, reviews, graphs of orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import extract, graph, lineage, measure, ranking
from ..sources.tables import stored, table
from .catalog_queries import LINE
from .register import registry

QUERIES, ORACLES, query = registry()

_RANK_SQL = "CASE l_returnflag WHEN 'A' THEN 4 WHEN 'R' THEN 3 ELSE 1 END DESC, CASE l_linestatus WHEN 'O' THEN 60 ELSE 40 END DESC"
_BEST_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_RANK_SQL}, l_quantity DESC, l_extendedprice DESC,
l_orderkey DESC, l_suppkey DESC, l_linenumber DESC, l_shipdate DESC) AS n FROM lineitem WHERE l_quantity > 5) WHERE n = 1"""


def _rank():
    review = S.priority(F.col("l_returnflag"), {"A": 4, "R": 3}, 1)
    source = S.priority(F.col("l_linestatus"), {"O": 60}, 40)
    return [review, source, F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_shipdate")]


def _best(spark: SparkSession, d: str) -> DataFrame:
    """Each part's best point among those with a rate over 5."""
    return ranking.best(table(spark, d, "lineitem"), ["l_partkey"], _rank(), ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"], F.col("l_quantity") > 5)


def _energy():
    return F.col("l_extendedprice") / F.col("l_quantity")


@query(f"""WITH p AS (SELECT l_partkey, p_brand, p_type, l_quantity AS rate, l_extendedprice / l_quantity AS energy FROM ({_BEST_SQL}) JOIN part ON p_partkey = l_partkey),
g AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type) AS size FROM p)
SELECT l_partkey, p_brand, p_type, rate, energy FROM g a WHERE size >= 3 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.p_brand = a.p_brand AND b.p_type = a.p_type
AND b.rate >= a.rate AND b.energy <= a.energy AND (b.rate > a.rate OR b.energy < a.energy))""")
def pareto_best_point(spark: SparkSession, d: str) -> DataFrame:
    """Best operating point per part, then the frontier (high rate, low energy) of each brand and type."""
    points = _best(spark, d).join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    points = points.select("l_partkey", "p_brand", "p_type", F.col("l_quantity").alias("rate"), _energy().alias("energy"))
    return measure.pareto(points, ["p_brand", "p_type"], "rate", "energy")


@query(f"SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM ({_BEST_SQL})")
def best_measurement_rank(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d)


@query("""WITH s AS (SELECT l_partkey, max(CASE WHEN l_quantity > 30 THEN CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END ELSE 0 END)::INT AS rate,
max(CASE WHEN l_discount < 0.01 THEN CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END ELSE 0 END)::INT AS energy,
max(CASE WHEN l_tax > 0.07 THEN CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END ELSE 0 END)::INT AS loss FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN least(rate, energy, loss) = 2 THEN 'complete' WHEN least(rate, energy, loss) = 1 THEN 'inferred' WHEN greatest(rate, energy, loss) > 0 THEN 'partial' ELSE 'metadata_only' END AS status FROM s""")
def completeness_ladder(spark: SparkSession, d: str) -> DataFrame:
    return measure.completeness(table(spark, d, "lineitem"), "l_partkey", {"rate": F.col("l_quantity") > 30, "energy": F.col("l_discount") < 0.01, "loss": F.col("l_tax") > 0.07}, F.col("l_returnflag") == "N")


_SETS = {"rate": "l_quantity IS NOT NULL", "high_rate": "l_quantity >= 25", "energy": "l_discount > 0", "low_loss": "l_tax <= 0.02", "reported": "l_returnflag <> 'N'"}


@query(" UNION ALL ".join(f"""SELECT '{n}' AS chart, l_partkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_RANK_SQL}, l_quantity DESC,
l_extendedprice DESC, l_orderkey DESC, l_suppkey DESC, l_linenumber DESC, l_shipdate DESC) AS n FROM lineitem WHERE {c}) WHERE n = 1""" for n, c in _SETS.items()))
def chart_sets_union(spark: SparkSession, d: str) -> DataFrame:
    """Five selections of best rows, each by its own predicate: one aggregate over lineitem, unpivoted."""
    rows = table(spark, d, "lineitem")
    rank = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(_rank())])
    picks = [F.max_by(F.struct("l_orderkey", "l_quantity"), F.when(F.expr(c), rank)).alias(n) for n, c in _SETS.items()]
    some = [F.bool_or(F.expr(c)).alias(f"has_{n}") for n, c in _SETS.items()]
    found = rows.groupBy("l_partkey").agg(*picks, *some)
    charts = F.explode(F.array(*[F.struct(F.lit(n).alias("chart"), F.col(f"has_{n}").alias("has"), F.col(n).alias("p")) for n in _SETS]))
    return found.select("l_partkey", charts.alias("c")).where("c.has").select("c.chart", "l_partkey", "c.p.l_orderkey", "c.p.l_quantity")


@query("""SELECT p_brand, p_type, count(l_extendedprice) AS n, min(l_extendedprice) AS low, median(l_extendedprice) AS median, max(l_extendedprice) AS high FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""")
def group_stats_median(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return measure.group_figures(rows, ["p_brand", "p_type"], "l_extendedprice")


@query("""WITH v AS (SELECT event_id, event_type, log10(value) AS v FROM events WHERE value > 0), m AS (SELECT event_type, median(v) AS med, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 8),
s AS (SELECT event_type, median(abs(v - med)) AS mad FROM v JOIN m USING (event_type) GROUP BY 1 HAVING median(abs(v - med)) > 0)
SELECT event_id, event_type, round(0.6745 * (v - med) / mad, 6) AS z FROM v JOIN m USING (event_type) JOIN s USING (event_type) WHERE abs(0.6745 * (v - med) / mad) > 3.5""")
def robust_outlier_mad(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").where("value > 0")
    return measure.robust_outliers(rows, ["event_type"], F.log10("value")).select("event_id", "event_type", F.round("z", 6).alias("z"))


_RULES = {"RATE_OUT_OF_RANGE": ("P0", "l_quantity > 49"), "LOSS_CONFLICT": ("P1", "l_discount > 0.09 AND l_tax > 0.07"), "UNREVIEWED": ("P2", "l_returnflag = 'N' AND l_quantity > 48"), "LOW_PRICE": ("P1", "l_extendedprice / l_quantity < 25")}
_FLAGS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS flag, '{p}' AS priority, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate FROM lineitem WHERE {c}" for n, (p, c) in _RULES.items())


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """All rules in one pass over the rows: a row gives as many flags as rules it breaks."""
    hits = F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("flag"), F.lit(p).alias("priority"))) for n, (p, c) in _RULES.items()]), lambda x: x.isNotNull())
    return table(spark, d, "lineitem").withColumn("_f", F.explode(hits)).select("_f.flag", "_f.priority", *LINE)


@query(_FLAGS_SQL)
def review_flags_union(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


@query(f"""SELECT l_partkey, min(priority) AS priority, array_to_string(list_sort(list(DISTINCT flag)), ',') AS flags, count(*) AS n, max(l_quantity) AS extreme FROM ({_FLAGS_SQL}) GROUP BY 1""")
def review_queue_fold(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d).groupBy("l_partkey").agg(F.min("priority").alias("priority"), F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.count("*").alias("n"), F.max("l_quantity").alias("extreme"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate, l_extendedprice::DECIMAL(18,6)::DOUBLE / l_quantity::DECIMAL(18,6)::DOUBLE AS merit,
CASE WHEN l_returnflag = 'N' THEN 'derive' WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'refresh_derived' WHEN abs(l_quantity * 60 - l_extendedprice / l_quantity) <= greatest(0.01, abs(l_quantity * 60) * 0.02) THEN 'audit_match' ELSE 'audit_conflict' END AS action
FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0""")
def fom_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where("l_quantity > 0 AND l_extendedprice > 0")
    computed = extract.merit(F.col("l_extendedprice"), F.col("l_quantity"))
    reported = F.when(F.col("l_returnflag") != "N", F.col("l_quantity") * 60)
    stale = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    return rows.select(*LINE, computed.alias("merit"), extract.merit_action(reported, F.col("l_extendedprice") / F.col("l_quantity"), stale).alias("action"))


@query("""SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE abs(l_discount - l_tax) <= greatest(0.01, abs(l_tax) * 0.02)) AS agree FROM lineitem GROUP BY 1""")
def tolerance_compare(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(S.within(F.col("l_discount"), F.col("l_tax"), 0.01, 0.02)).alias("agree"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_shipdate,
CASE WHEN l_returnflag = 'R' THEN 'needs_review' WHEN l_returnflag = 'A' OR l_linestatus = 'X' THEN 'verified' ELSE lower(l_linestatus) END AS tier FROM lineitem""")
def evidence_tier(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE, extract.evidence_tier(F.col("l_returnflag"), F.col("l_linestatus"), ["R"], ["A"], ["X"]).alias("tier"))


# --- graphs: orders cite parts

_REFS_SQL = "SELECT DISTINCT l_orderkey AS citing, l_partkey + 1000000000 AS cited FROM lineitem UNION SELECT DISTINCT l_partkey + 1000000000, l_suppkey + 2000000000 FROM lineitem"
_WEIGHT_SQL = f"""refs AS ({_REFS_SQL}), seeds AS (SELECT p_partkey + 1000000000 AS seed FROM part WHERE p_size = 7),
o AS (SELECT citing AS node, count(*) AS n FROM refs GROUP BY 1), i AS (SELECT cited AS node, count(*) AS n FROM refs GROUP BY 1),
sh AS (SELECT s.seed, b.citing AS node, count(*) AS shared FROM seeds s JOIN refs a ON a.citing = s.seed JOIN refs b ON a.cited = b.cited AND b.citing <> s.seed GROUP BY 1, 2),
co AS (SELECT s.seed, b.cited AS node, count(*) AS co FROM seeds s JOIN refs a ON a.cited = s.seed JOIN refs b ON a.citing = b.citing AND b.cited <> s.seed GROUP BY 1, 2),
di AS (SELECT seed, cited AS node, 1 AS direct FROM seeds JOIN refs ON citing = seed UNION SELECT seed, citing, 1 FROM seeds JOIN refs ON cited = seed),
p AS (SELECT seed, node, coalesce(shared, 0) AS shared, coalesce(co, 0) AS co, coalesce(direct, 0) AS direct FROM sh FULL JOIN co USING (seed, node) FULL JOIN di USING (seed, node) WHERE seed <> node),
w AS (SELECT p.*, round(least(1.0::DOUBLE, 0.65::DOUBLE * CASE WHEN shared > 0 THEN shared / sqrt(so.n * oo.n) ELSE 0 END + 0.35::DOUBLE * CASE WHEN co > 0 THEN co / sqrt(si.n * ii.n) * co / (co + 2) ELSE 0 END + 0.12::DOUBLE * direct), 9) AS weight
FROM p LEFT JOIN o so ON so.node = seed LEFT JOIN o oo ON oo.node = p.node LEFT JOIN i si ON si.node = seed LEFT JOIN i ii ON ii.node = p.node)"""


def _refs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    part = F.col("l_partkey") + 1000000000
    return li.select(F.col("l_orderkey").alias("citing"), part.alias("cited")).unionByName(li.select(part.alias("citing"), (F.col("l_suppkey") + 2000000000).alias("cited"))).distinct()


def _seeds(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, "part").where("p_size = 7").select((F.col("p_partkey") + 1000000000).alias(name))


@query(f"WITH {_WEIGHT_SQL} SELECT seed, node, shared, co, direct::INT AS direct, weight FROM w")
def citation_weight(spark: SparkSession, d: str) -> DataFrame:
    return graph.weights(_refs(spark, d), _seeds(spark, d, "seed"))


@query(f"""WITH {_WEIGHT_SQL}, e AS (SELECT seed AS a, node AS b, weight FROM w WHERE weight > 0.02), x AS (SELECT a, b, weight, a AS e, b AS other FROM e UNION ALL SELECT a, b, weight, b, a FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY weight DESC, other) AS n FROM x) SELECT DISTINCT a, b, weight FROM r WHERE n <= 3""")
def edge_top3(spark: SparkSession, d: str) -> DataFrame:
    e = graph.weights(_refs(spark, d), _seeds(spark, d, "seed")).where("weight > 0.02").select(F.col("seed").alias("a"), F.col("node").alias("b"), "weight")
    return graph.strongest(e)


@query(f"""WITH refs AS ({_REFS_SQL}), s AS (SELECT p_partkey + 1000000000 AS node FROM part WHERE p_size = 7),
x AS (SELECT cited AS node, 'prior' AS kind, count(*) AS n FROM refs WHERE citing IN (FROM s) GROUP BY 1 UNION ALL SELECT citing, 'derivative', count(*) FROM refs WHERE cited IN (FROM s) GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, node)::INT AS rank FROM x WHERE node NOT IN (FROM s)) SELECT node, n, kind, rank FROM r WHERE rank <= 60""")
def prior_derivative(spark: SparkSession, d: str) -> DataFrame:
    return graph.prior_and_derivative(_refs(spark, d), _seeds(spark, d, "node"))


@query(f"""WITH refs AS ({_REFS_SQL}), l0 AS (SELECT o_orderkey AS node FROM orders WHERE o_totalprice > 495000),
l1 AS (SELECT DISTINCT cited AS node FROM refs WHERE citing IN (FROM l0)), l2 AS (SELECT DISTINCT cited AS node FROM refs WHERE citing IN (FROM l1)),
a AS (SELECT node, 0 AS level FROM l0 UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2) SELECT node, min(level)::INT AS level FROM a GROUP BY 1""")
def lineage_khop(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "orders").where("o_totalprice > 495000").select(F.col("o_orderkey").alias("node"))
    return graph.lineage(_refs(spark, d), seeds, 2)


@query()
def lineage_selection(spark: SparkSession, d: str) -> DataFrame:
    """At most thirty prior and derivative works of each seed, by levels in turns, with the paths to them."""
    edges = stored(_refs(spark, d).select(F.col("cited").alias("source"), F.col("citing").alias("target")))
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("n")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("n")))
    return lineage.explored(edges, stored(ends.groupBy("node").agg(F.sum("n").alias("cited"))), _seeds(spark, d, "root"))
