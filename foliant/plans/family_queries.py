"""Queries on pairs and families of works and on tables in markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import families as fam
from ..sources.tables import table
from . import screening_queries
from .register import registry

QUERIES, ORACLES, query = registry()


def _agree(a: str, b: str, relative: float, absolute: float = 0.0) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'missing' WHEN abs({a} - {b}) <= {absolute}::DOUBLE OR abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-12::DOUBLE) <= {relative}::DOUBLE THEN 'match' ELSE 'conflict' END"


_WORK = """SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey % 60 AS DOUBLE) END AS node, l_quantity AS low, l_quantity + l_partkey % 9 AS high,
CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS power, CASE l_suppkey % 4 WHEN 0 THEN 'TX' WHEN 1 THEN 'RX' WHEN 2 THEN 'TX RX' ELSE 'PLL' END AS blocks, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS medium FROM lineitem"""


@query(f"""WITH w AS ({_WORK}), v AS (SELECT a.l_orderkey, {_agree('a.node', 'b.node', 0.02, 0.5)} AS process, {_agree('a.power', 'b.power', 0.1)} AS power,
CASE WHEN greatest(a.low, b.low) <= least(a.high, b.high) * 1.02::DOUBLE OR abs(a.low - b.low) / greatest(a.low, b.low) <= 0.05::DOUBLE OR abs(a.high - b.high) / greatest(a.high, b.high) <= 0.05::DOUBLE THEN 'match' ELSE 'conflict' END AS rate,
CASE WHEN (a.blocks = 'TX' AND b.blocks = 'RX') OR (a.blocks = 'RX' AND b.blocks = 'TX') THEN 'conflict' WHEN list_has_any(string_split(a.blocks, ' '), string_split(b.blocks, ' ')) THEN 'match' ELSE 'missing' END AS block,
CASE WHEN a.medium IS NULL OR b.medium IS NULL THEN 'missing' WHEN a.medium = b.medium THEN 'match' ELSE 'conflict' END AS medium FROM w a JOIN w b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2)
SELECT matches, conflicts, count(*) AS n FROM (SELECT [x[1] FOR x IN p IF x[2] = 'match'] AS m, [x[1] FOR x IN p IF x[2] = 'conflict'] AS c, array_to_string(m, ' ') AS matches, array_to_string(c, ' ') AS conflicts
FROM (SELECT l_orderkey, [['block', block], ['medium', medium], ['power', power], ['process', process], ['rate', rate]] AS p FROM v)) GROUP BY 1, 2""")
def technical_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """What the figures of two works of one key agree and disagree in."""
    works = spark.sql(_WORK.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    a = works.where("l_linenumber = 1").select("l_orderkey", F.struct(*works.columns).alias("a"))
    b = works.where("l_linenumber = 2").select("l_orderkey", F.struct(*works.columns).alias("b"))
    both = lambda n: (F.col(f"a.{n}"), F.col(f"b.{n}"))
    blocks = [F.split(x, " ") for x in both("blocks")]
    media = [F.when(x.isNotNull(), F.array(x)) for x in both("medium")]
    verdicts = {
        "process": fam.agree(*both("node"), 0.02, 0.5), "power": fam.agree(*both("power"), 0.1), "block": fam.blocks_agree(*blocks), "medium": fam.sets_agree(*media),
        "rate": fam.spans_agree(F.col("a.low"), F.col("a.high"), F.col("b.low"), F.col("b.high"))}
    met = a.join(b, "l_orderkey").select(fam.fingerprint(verdicts).alias("p"))
    return met.groupBy(F.array_join("p.matches", " ").alias("matches"), F.array_join("p.conflicts", " ").alias("conflicts")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT o_orderkey AS family_id, o_orderstatus = 'F' AS active, o_custkey AS canonical FROM orders), m AS (SELECT l_orderkey * 2 AS family_id, l_partkey AS paper_id, l_linenumber = 1 AS is_canonical FROM lineitem),
c AS (SELECT event_id AS candidate_id, CASE WHEN event_id % 3 > 0 THEN event_id END AS family_id, event_type AS status, user_id AS journal_id FROM events), h AS (SELECT c.*, f.active, f.canonical, f.family_id IS NOT NULL AS there FROM c LEFT JOIN f USING (family_id) WHERE c.family_id IS NOT NULL AND status = 'view')
SELECT rule, count(*) AS n, min(id) AS least FROM (
SELECT DISTINCT 'member_without_family' AS rule, paper_id AS id FROM m WHERE family_id NOT IN (SELECT family_id FROM f)
UNION ALL SELECT 'paper_in_several_families', paper_id FROM m GROUP BY 2 HAVING count(DISTINCT family_id) > 1
UNION ALL SELECT 'ineligible_candidate_in_family', candidate_id FROM c WHERE family_id IS NOT NULL AND status IS DISTINCT FROM 'view'
UNION ALL SELECT 'candidate_without_family', candidate_id FROM h WHERE NOT there
UNION ALL SELECT 'candidate_of_inactive_family', candidate_id FROM h WHERE there AND NOT active
UNION ALL SELECT 'inconsistent_journal_member', candidate_id FROM h WHERE there AND (journal_id <> canonical OR NOT EXISTS (SELECT 1 FROM m WHERE m.family_id = h.family_id AND m.paper_id = h.journal_id AND m.is_canonical))
UNION ALL SELECT 'active_family_without_one_canonical', f.family_id FROM f LEFT JOIN (SELECT family_id, count_if(is_canonical) AS n, count(*) AS size FROM m GROUP BY 1) p USING (family_id) WHERE active AND (coalesce(n, 0) <> 1 OR coalesce(size, 0) < 2)) GROUP BY 1""")
def family_violations(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule of stored families is broken."""
    families = table(spark, d, "orders").select(F.col("o_orderkey").alias("family_id"), (F.col("o_orderstatus") == "F").alias("active"), F.col("o_custkey").alias("canonical"))
    members = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("family_id"), F.col("l_partkey").alias("paper_id"), (F.col("l_linenumber") == 1).alias("is_canonical"))
    e = F.col("event_id")
    candidates = table(spark, d, "events").select(
        e.alias("candidate_id"), F.when(e % 3 > 0, e).alias("family_id"), F.col("event_type").alias("status"), F.lit(None).cast("long").alias("conference_id"), F.col("user_id").alias("journal_id"))
    return fam.violations(families, members, candidates, ["view"]).groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("least"))


_TABLE = """CASE p_partkey % 5 WHEN 0 THEN '<table><tr><th>Item<th></th>' WHEN 1 THEN '<table><tr><th>Item</th><th>[1]</th><th><b>This</b> work</th></tr><tr><td>Power (mW)</td><td>9</td><td>' || p_size || '</td></tr><tr><td>Name</td><td>x</td><td>' || p_name || '</td></tr></table>'
WHEN 2 THEN '<table><TR><td></td><td>Rate Gb/s</td><td>Area</td></TR><tr><td>[2]</td><td>1</td><td>2</td></tr><tr><td>This work</td><td>' || p_size || '</td><td>3</td></tr></table>'
WHEN 3 THEN '<tr><td colspan="2">This work</td></tr>' ELSE '<tr><td>a</td><td>b</td></tr><tr><td>c</td><td>This work</td></tr>' END"""


@query(f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'no_cells' WHEN 3 THEN 'spans' WHEN 4 THEN 'ambiguous_place' ELSE 'ok' END AS status,
CASE p_partkey % 5 WHEN 1 THEN 'Power (mW): ' || p_size || ' mW | Name: ' || p_name WHEN 2 THEN 'Rate Gb/s: ' || p_size || ' Gb/s | Area: 3' END AS figures FROM part""")
def own_table_figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a comparison table's own row or column. The SQL writes what the tables were made from."""
    rows = table(spark, d, "part").select("p_partkey", fam.own_figures(F.expr(_TABLE)).alias("f"))
    return rows.select("p_partkey", "f.status", F.array_join("f.figures", " | ").alias("figures"))


_STATUS = "CASE event_type WHEN 'click' THEN 'auto_grouped' WHEN 'view' THEN 'approved' ELSE 'rejected' END"


@query(f"""SELECT event_id, user_id, status, value, row_number() OVER (PARTITION BY user_id ORDER BY (status <> 'approved')::INT, value DESC, event_id) = 1 AS selected
FROM (SELECT event_id, user_id, {_STATUS} AS status, value FROM events) WHERE status IN ('auto_grouped', 'approved')""")
def family_selection(spark: SparkSession, d: str) -> DataFrame:
    """One family a conference paper: approved ones first, then by score."""
    rows = table(spark, d, "events").selectExpr("event_id", "user_id", f"{_STATUS} AS status", "value")
    return fam.selected(rows, "event_id", "user_id", "status", "value")


NAMES = (
    ("Kim", "Lee", "Park", "Choi", "Jung", "Kang", "Cho", "Yoon", "Jang", "Lim", "Han", "Oh", "Seo", "Shin", "Kwon", "Hwang", "Ahn", "Song", "Yoo"),
    ("Smith", "Jones", "Brown", "Miller", "Davis", "Garcia", "Wilson", "Moore", "Taylor", "Thomas", "White", "Harris", "Clark", "Lewis", "Young", "King", "Hall"),
    ("Chen", "Wang", "Zhang", "Liu", "Yang", "Huang", "Zhao", "Wu", "Zhou", "Xu", "Sun", "Ma", "Zhu"),
)


@query()
def family_scores(spark: SparkSession, d: str) -> DataFrame:
    """Conference papers and the journal papers that may be the same work (titles are compared by ratio, so no SQL)."""
    rows = screening_queries.papers(spark, d).select("doc_id", "title", F.concat_ws(", ", *(F.get(F.array(*map(F.lit, n)), (F.col("doc_id") % len(n)).cast("int")) for n in NAMES)).alias("authors"), (F.col("doc_id") % 5).cast("double").alias("node"))
    early = rows.select(F.col("doc_id").alias("id"), F.concat(F.lit("6.1 "), "title").alias("title"), "authors", F.lit(2019).alias("year"), F.lit("ISSCC").alias("venue"), "node")
    late = rows.select((F.col("doc_id") + 1_000_000_000).alias("id"), F.regexp_replace("title", "With", "with a").alias("title"), "authors", (2018 + F.col("doc_id") % 6).cast("int").alias("year"), F.lit("JSSC").alias("venue"), (F.col("node") + (F.col("doc_id") % 3 == 0).cast("int")).alias("node"))
    found = fam.scored_pairs(early.unionByName(late), {"ISSCC": ["JSSC"]}, lambda a, b: {"process_nm": fam.agree(a["node"], b["node"], 0.02)})
    return found.withColumns({c: F.array_join(c, ",") for c in ("matches", "conflicts")})
