"""Queries on figures, guards, terms, keys and names. Their texts are written from numbers of the tables, alike in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import figures as P
from ..operators import text as T
from ..sources.tables import spread, table
from .register import registry
from .screening_queries import SENTENCES, papers

QUERIES, ORACLES, query = registry()

_Q, _N = "CAST(CAST(l_quantity AS INT) AS STRING)", "CAST(l_suppkey % 60 + 2 AS STRING)"
_TEXT = f"""CASE l_linenumber WHEN 1 THEN 'A 4 x ' || {_Q} || ' Gb/s transceiver in ' || {_N} || '-nm CMOS at 1.5 pJ/bit'
WHEN 2 THEN 'From 10 to ' || {_Q} || ' Gb/s, total power ' || {_N} || ' mW' WHEN 3 THEN 'An aggregate ' || {_Q} || '-Gb/s link, ' || {_N} || ' mW/Gb/s and 30 dB channel loss'
WHEN 4 THEN {_Q} || ' Gb/s/lane, 28 GBaud, BER below 1e-' || {_N} WHEN 5 THEN '25 Gb/s and ' || {_Q} || ' Tb/s with 500 fJ/bit/dB, ' || {_N} || ' uW standby, then 3 W'
WHEN 6 THEN 'A 1550 nm laser and ' || {_N} || ' um SiGe at less than ' || {_Q} || ' mW per channel' ELSE 'An optical output power of ' || {_Q} || ' W, bi-CMOS chiplet' END"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_TEXT).alias("x"))


def _ladder(rules: tuple, text: str, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE {other} END"


#: Sentences with figures of a row (q and n, whole numbers) and what must be read from them, as SQL; the patterns take no part.
_FIGURES: list[tuple[str, dict[str, str]]] = [
    ("'A 4 x ' || q || ' Gb/s transceiver in ' || n || '-nm CMOS at 1.5 pJ/bit'", {"rate_gbps": "q", "rate_scope": "'lane'", "lane_count": "4", "lane_rate_gbps": "q", "aggregate_rate_gbps": "4 * q", "energy_pj_bit": "1.5", "process_nm": "n"}),
    ("'From 10 to ' || q || ' Gb/s, total power ' || n || ' mW'", {"rate_min_gbps": "least(10, q)", "rate_max_gbps": "greatest(10, q)", "rate_scope": "'unknown'", "power_mw": "n"}),
    ("'An aggregate ' || q || '-Gb/s link, ' || n || ' mW/Gb/s and 30 dB channel loss'", {"rate_gbps": "q", "rate_scope": "'aggregate'", "aggregate_rate_gbps": "q", "energy_pj_bit": "n", "channel_loss_db": "30"}),
    ("q || ' Gb/s/lane, 28 GBaud, BER below 1e-' || n", {"rate_gbps": "q", "rate_scope": "'lane'", "lane_rate_gbps": "q", "symbol_rate_gbaud": "28", "ber": "CAST('1e-' || n AS DOUBLE)"}),
    ("'25 Gb/s and ' || q || ' Tb/s with 500 fJ/bit/dB, ' || n || ' uW standby, then 3 W'", {"energy_pj_bit_db": "0.5", "rate_unclear": "true", "power_unclear": "true"}),
    ("'A 1550 nm laser and ' || n || ' um SiGe at less than ' || q || ' mW per channel'", {"power_mw": "q"}),
    ("'An optical output power of ' || q || ' W, bi-CMOS chiplet'", {"power_mw": "1000 * q"}),
    ("'A receiver in ' || n || ' nm'", {"process_nm": "n"}),
    ("'A CMOS-compatible ' || q || ' nm waveguide filter'", {}),
    ("'A 4 0nm CMOS driver of ' || q || ' mW'", {"power_mw": "q"}),
    ("'A ' || q || ' W/(Gb/s) link'", {"energy_pj_bit": "CASE WHEN q <= 10 THEN 1000 * q END"}),
    ("'PAM4mW and ' || n || '&nbsp;mW'", {"power_mw": "n"}),
    ("'Insertion  loss of ' || n || ' dB at ' || q || ' GHz'", {"channel_loss_db": "n", "loss_frequency_ghz": "q"}),
    ("q || ' Gb/s here; ' || n || '-' || q || ' Gb/s/mm and ' || q || '.5 Gbit/s'", {"rate_unclear": "true"}),
]
_KEYS = ("l_orderkey", "l_linenumber", "CAST(l_quantity AS INT) AS q", "CAST(l_suppkey % 60 + 2 AS INT) AS n", f"CAST((l_linenumber + 7 * (l_partkey % 2)) % {len(_FIGURES)} AS INT) AS k")
_ROWS = f"SELECT {', '.join(_KEYS)} FROM lineitem"


def _case(fields: dict[int, str], kind: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {v}" for k, v in fields.items()) + (" ELSE false END" if kind == "BOOLEAN" else f" ELSE CAST(NULL AS {kind}) END")


def _expected(columns: list[str]) -> str:
    kinds = {"rate_scope": "VARCHAR", "rate_unclear": "BOOLEAN", "power_unclear": "BOOLEAN"}
    shown = []
    for c in columns:
        kind = kinds.get(c, "DOUBLE")
        shown.append(f"({_case({k: f[c] for k, (_, f) in enumerate(_FIGURES) if c in f}, kind)})::{kind} AS {c}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(shown)} FROM ({_ROWS})"


def _read(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "lineitem").selectExpr(*_KEYS))
    text = F.expr("CASE k " + " ".join(f"WHEN {k} THEN {t}" for k, (t, _) in enumerate(_FIGURES)) + " END")
    return rows.select("l_orderkey", "l_linenumber", P.performance(text).alias("p")).select("l_orderkey", "l_linenumber", "p.*", F.array_contains("p.ambiguous", "rate_gbps").alias("rate_unclear"), F.array_contains("p.ambiguous", "power_mw").alias("power_unclear"))


_RATES = "rate_gbps rate_min_gbps rate_max_gbps rate_scope lane_count lane_rate_gbps aggregate_rate_gbps symbol_rate_gbaud rate_unclear".split()
_POWERS = "energy_pj_bit energy_pj_bit_db power_mw process_nm channel_loss_db loss_frequency_ghz ber power_unclear".split()


@query(_expected(_RATES))
def extract_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates as lanes times a rate, as ranges or alone; several rates give none."""
    return _read(spark, d).select("l_orderkey", "l_linenumber", *_RATES).withColumn("lane_count", F.col("lane_count").cast("double"))


@query(_expected(_POWERS))
def extract_powers(spark: SparkSession, d: str) -> DataFrame:
    """Energies, powers, nodes, losses and error rates in base units; several values give none."""
    return _read(spark, d).select("l_orderkey", "l_linenumber", *_POWERS)


#: What the sentences of papers say, by place; their documents hold no figures.
_SAID = {1: ("112", "NULL", "NULL", "7", "NULL"), 4: ("NULL", "40", "NULL", "NULL", "NULL"), 7: ("NULL", "12", "NULL", "NULL", "NULL"), 8: ("NULL", "3", "NULL", "NULL", "NULL"), 9: ("NULL", "NULL", "2", "NULL", "NULL"), 11: ("NULL", "NULL", "4", "NULL", "NULL"), 13: ("NULL", "5", "NULL", "NULL", "NULL"), 16: ("25", "NULL", "NULL", "NULL", "20")}
_SHOWN = ("rate_gbps", "power_mw", "energy_pj_bit", "process_nm", "channel_loss_db")


@query("SELECT doc_id, " + ", ".join(f"(CASE doc_id % {len(SENTENCES)} " + " ".join(f"WHEN {k} THEN {v[i]}" for k, v in _SAID.items()) + f" END)::DOUBLE AS {c}" for i, c in enumerate(_SHOWN)) + " FROM documents")
def document_figures(spark: SparkSession, d: str) -> DataFrame:
    """The figures of whole documents."""
    return papers(spark, d).select("doc_id", P.performance(F.col("abstract")).alias("p")).select("doc_id", *(f"p.{c}" for c in _SHOWN))


@query(f"""SELECT {_ladder(P.POWER_GUARDS, 'x')} AS power_guard, {_ladder(P.RATE_GUARDS, 'x')} AS rate_guard, CASE stored WHEN 'Per lane' THEN 'lane' WHEN 'chip' THEN 'aggregate' ELSE {_ladder((('lane', P.LANE_POWER), ('aggregate', P.WHOLE_POWER)), 'x', "'unknown'")} END AS scope,
count(*) AS n FROM (SELECT {_TEXT} AS x, CASE l_suppkey % 5 WHEN 0 THEN 'Per lane' WHEN 1 THEN 'chip' WHEN 2 THEN 'other' END AS stored FROM lineitem) GROUP BY 1, 2, 3""")
def semantic_guards(spark: SparkSession, d: str) -> DataFrame:
    """Why powers and rates may not be used, and what powers are of."""
    stored = F.expr("CASE l_suppkey % 5 WHEN 0 THEN 'Per lane' WHEN 1 THEN 'chip' WHEN 2 THEN 'other' END")
    rows = table(spark, d, "lineitem").select(F.expr(_TEXT).alias("x"), stored.alias("stored"))
    x = F.col("x")
    return rows.groupBy(P.power_guard(x).alias("power_guard"), P.rate_guard(x).alias("rate_guard"), P.power_scope(x, F.col("stored")).alias("scope")).agg(F.count("*").alias("n"))


@query(f"""SELECT {_ladder(P.FAMILIES, 'x', "'Other / unspecified'")} AS family, {_ladder(P.LINK_CLASSES, 'x')} AS link, count(*) AS n FROM (SELECT {_TEXT} AS x FROM lineitem) GROUP BY 1, 2""")
def families_and_links(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return _texts(spark, d).groupBy(P.technology_family(x).alias("family"), P.link_class(x).alias("link")).agg(F.count("*").alias("n"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _title_sql(text: str) -> str:
    return f"list_distinct([w FOR w IN [regexp_replace(lower(v), '^pam-?[234]$', 'pam') FOR v IN regexp_extract_all(regexp_replace({text}, '{terms.DASHES}', '-', 'g'), '{terms.TITLE_WORD}')] IF length(w) >= 3 AND NOT list_contains({_list(terms.STOP)}, w)])"


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({_title_sql('text')}) AS term FROM documents) GROUP BY 1")
def title_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """In how many texts each term is."""
    return table(spark, d, "documents").select(F.explode(terms.title_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct([w FOR w IN regexp_extract_all(lower(text), '{terms.GRAPH_WORD}') IF length(w) >= 3 AND NOT list_contains({_list(terms.STOP)}, w)])) AS term FROM documents) GROUP BY 1")
def graph_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.explode(terms.graph_terms(F.col("text"), terms.STOP)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_TITLE = """CASE p_partkey % 6 WHEN 0 THEN 'A PAM-4 Phase–Locked Loops Receiver for ' || p_name WHEN 1 THEN 'Publisher Correction: the ' || p_name || ' with decision feedback equalizers'
WHEN 2 THEN 'Serializer/Deserializer of an 8-Gb/s PAM 8 and PAM3 link, ' || p_name WHEN 3 THEN 'Erratum - Die to die ' || p_name WHEN 4 THEN 'High Bandwidth Memories over micro-rings: ' || p_name ELSE p_name END"""


def _technical_sql(text: str) -> str:
    out = f"regexp_replace(lower({text}), '{terms.DASHES}', '-', 'g')"
    for name, spellings in terms.CONCEPTS.items():
        out = rf"regexp_replace({out}, '\b(?:{spellings})\b', '{name}', 'g')"
    return out


@query(rf"""WITH t AS (SELECT p_partkey, {_technical_sql(_TITLE)} AS x FROM part), o AS (SELECT p_partkey, list_distinct(regexp_extract_all(x, '\bpam[2348]\b')) AS orders, [w FOR w IN {_title_sql('x')} IF NOT list_contains({_list(terms.GENERIC)}, w)] AS own FROM t)
SELECT p_partkey, array_to_string(list_sort(CASE WHEN len(orders) > 0 THEN list_distinct([w FOR w IN own IF w <> 'pam'] || orders) ELSE own END), ' ') AS terms FROM o""")
def technical_title_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(_TITLE).alias("x"))
    return rows.select("p_partkey", F.array_join(F.array_sort(terms.technical_terms(F.col("x"))), " ").alias("terms"))


@query(rf"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(regexp_replace(x, '{terms.DASHES}', '-', 'g'))), '{terms.NOTICE}', ''), '[^a-z0-9]+', ' ', 'g')) AS notice_free,
array_to_string([w FOR w IN regexp_extract_all(lower(x), '[a-z0-9]+') IF w NOT IN ('a', 'an', 'the')], ' ') AS article_free FROM (SELECT p_partkey, {_TITLE} AS x FROM part)""")
def title_compare_keys(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return table(spark, d, "part").select("p_partkey", F.expr(_TITLE).alias("x")).select("p_partkey", terms.notice_free_key(x).alias("notice_free"), terms.article_free_key(x).alias("article_free"))


_AUTHORS = "CASE c_custkey % 3 WHEN 0 THEN 'Y. Kim, ' || c_name || ', and R. O. Lee' WHEN 1 THEN 'Park, A.; ' || c_mktsegment || ' Smith' ELSE c_name || ' AND Bo Chen' END"


@query(rf"""WITH a AS (SELECT c_custkey, {_AUTHORS} AS x FROM customer), b AS (SELECT c_custkey, CASE WHEN contains(x, ';') THEN string_split(x, ';') ELSE string_split(regexp_replace(x, '(?i),?\s+and\s+', ',', 'g'), ',') END AS parts FROM a),
c AS (SELECT c_custkey, [n FOR n IN [array_to_string(regexp_extract_all(lower(p), '[a-z]+'), ' ') FOR p IN parts] IF n <> ''] AS names FROM b)
SELECT c_custkey, array_to_string(names, '; ') AS names, array_to_string([string_split(n, ' ')[-1] FOR n IN names], ' ') AS surnames FROM c""")
def author_lists(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    rows = table(spark, d, "customer").select("c_custkey", F.expr(_AUTHORS).alias("x"))
    return rows.select("c_custkey", F.array_join(terms.author_names(x), "; ").alias("names"), F.array_join(terms.surnames(x), " ").alias("surnames"))


_CONTEXT = [*terms.GENERIC, "receiver", "link", "widget", "micro-ring"]


@query(f"""WITH d AS (SELECT p_partkey, p_size, {_title_sql(f"{_TITLE} || ' ' || p_type || ' ' || p_brand")} AS ts FROM part), p AS (SELECT p_partkey, p_size = 1 AS seed, unnest(ts) AS term FROM d),
w AS (SELECT term, (1 + ln(((SELECT count(*) FROM part) + 1.0::DOUBLE) / (count(*) + 1))) * CASE WHEN list_contains({_list(_CONTEXT)}, term) THEN 0.3::DOUBLE ELSE 1 END AS weight FROM p GROUP BY 1),
n AS (SELECT p_partkey, sqrt(sum(weight * weight)) AS norm FROM p JOIN w USING (term) GROUP BY 1),
m AS (SELECT a.p_partkey AS seed, b.p_partkey, count(*) AS hits, count_if(NOT list_contains({_list(_CONTEXT)}, term)) AS fine, sum(weight * weight) AS dot FROM p a JOIN p b USING (term) JOIN w USING (term) WHERE a.seed AND a.p_partkey <> b.p_partkey GROUP BY 1, 2),
s AS (SELECT m.seed, m.p_partkey, hits, round(least(1.0::DOUBLE, dot / (x.norm * y.norm)), 6) AS score FROM m JOIN n x ON x.p_partkey = m.seed JOIN n y ON y.p_partkey = m.p_partkey WHERE hits >= 2 AND fine > 0)
SELECT seed, p_partkey, hits, score, place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, p_partkey)::INT AS place FROM s WHERE score >= 0.25) WHERE place <= 29""")
def similarity_graph(spark: SparkSession, d: str) -> DataFrame:
    """The nearest titles of each seed; generic words alone link nothing."""
    part = table(spark, d, "part")
    text = F.concat_ws(" ", F.expr(_TITLE), "p_type", "p_brand")
    docs = spread(part).select("p_partkey", "p_size", terms.title_terms(text).alias("ts"))
    return T.similar(docs, "p_partkey", "ts", F.col("p_size") == 1, part.count(), _CONTEXT)
