"""Screening and classification of papers. Titles are put together from parts by the remainders of doc_id, so each mixes with each
other over the table; abstracts are whole documents with a sentence of a paper. The SQL is built from the tables of patterns and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plain import plain_sql, plain_text
from ..operators import concepts, matching, media, screening
from ..sources.tables import spread, table
from .register import registry

QUERIES, ORACLES, query = registry()

LEADS = ("A", "A Low-Power", "Design Techniques for", "A 0.8-pJ/bit", "Monolithic", "Analysis of a", "An Adaptive", "A Burst-Mode", "Editorial:", "A Coherent", "A 5.4 mW/Gb/s")
RATES = ("", "112-Gb/s", "4 x 25 Gb/s", "60-GHz", "56 GBaud", "10-to-28 Gb/s", "36 GHz Bandwidth")
SUBJECTS = (
    "PAM-4 SerDes Receiver", "Optical Receiver Front-End", "VCSEL Driver", "Clock and Data Recovery Circuit", "Decision Feedback Equalizer", "HBM3 PHY", "Retimer",
    "Trans-Impedance Amplifier", "Silicon Photonic Transmitter", "QPSK Phased-Array Transceiver", "Grating Coupler", "Die-to-Die Link", "Biosensor Array", "Parallel Interface Transmitter",
    "Neural Network Equalization", "WDM Transmission", "LDO", "Serial Link", "Optical I/O Chiplet", "Electronic Bus to Optical Link Bridge", "SST Driver With a CDR", "Probing-Attack Detector",
    "AI Accelerator")
CONTEXTS = (
    "", "for Wireline Links", "for Backplane and Multimode Fiber", "Over an 80-km Fiber", "With a Temperature Sensor", "for Memory Interfaces", "Using OFDM", "in a Satellite Receiver",
    "for UCIe Chiplets", "With an Analog Front-End", "for Data-Center Optics", "Under Feasibility Study", "With Jitter Tolerance")
PROCESSES = ("", "in 28-nm CMOS", "in 0.13um SiGe BiCMOS", "at 1550 nm", "in CMOS-Compatible Technology")
SENTENCES = (
    "", "The chip is fabricated in 7-nm FinFET and measured at 112 Gb/s.", "We present an optical link.", "Optical links are common.", "The receiver consumes 40 mW.", "This work targets a backplane.",
    "A forward error correction scheme is shown.", "The front-end only dissipates 12 mW.", "The VCSEL driver consumes 3 mW.", "The transceiver needs 2 pJ/bit of energy.",
    "An implantable imager; we propose optical and electrical channels over copper or fibers.", "End-to-end energy is 4 pJ/b.", "Power consumption is low.", "Transmitters use 5 mW.", "Radar and wireless links.",
    "Tested over twinax; the circuit is implemented in BiCMOS.", "Rate: 25 Gb/s, loss 20 dB.")
CLASSES = ("", "optical", "memory", "backplane", "optical memory", "other")


def _pick(items: tuple[str, ...], shift: int = 0) -> Column:
    return F.get(F.array(*map(F.lit, items)), ((F.col("doc_id") + shift) % len(items)).cast("int"))


def _pick_sql(items: tuple[str, ...], shift: int = 0) -> str:
    return f"([{', '.join(repr(x) for x in items)}])[(doc_id + {shift}) % {len(items)} + 1]"


PARTS = (LEADS, RATES, SUBJECTS, CONTEXTS, PROCESSES)


def papers(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.array_join(F.array(*map(_pick, PARTS)), " ").alias("title"), F.concat_ws(" ", _pick(SENTENCES), F.col("text")).alias("abstract"), _pick(SENTENCES).alias("sentence"),
        _pick(CLASSES, 2).alias("measured"))


PAPERS_SQL = f"""SELECT doc_id, concat_ws(' ', {', '.join(map(_pick_sql, PARTS))}) AS title, concat_ws(' ', {_pick_sql(SENTENCES)}, text) AS abstract, {_pick_sql(SENTENCES)} AS sentence,
{_pick_sql(CLASSES, 2)} AS measured FROM documents"""
PLAIN_SQL = f"SELECT doc_id, {plain_sql('title')} AS title_text, {plain_sql('abstract')} AS abstract_text, sentence, measured FROM ({PAPERS_SQL})"


def _has(text: str, pattern: str) -> str:
    return "regexp_matches({}, '{}')".format(text, pattern.replace("'", "''"))


def _ic(text: str) -> str:
    bare = f"regexp_replace({text}, '(?i)\\b(m?)cmos[- ]compatible', '\\1c_', 'g')"
    return f"({_has(bare, screening.IC)} OR ({_has(text, screening.IC_SHORT)} AND NOT {_has(text, screening.IC_OPTICAL)}))"


def _screening_sql() -> str:
    def found(text: str, mark: str, patterns: dict[str, str]) -> list[str]:
        return [f"{_has(text, p) if p else _ic(text)} AS {mark}_{n}" for n, p in patterns.items()]

    sql = f"SELECT *, trim(title_text || '. ' || abstract_text) AS whole FROM ({PLAIN_SQL})"
    columns = found("title_text", "t", screening.EVIDENCE | screening.TITLE) + found("whole", "c", screening.EVIDENCE | screening.WHOLE)
    sql = f"SELECT doc_id, abstract_text, {', '.join(columns)} FROM ({sql})"
    for stage in screening.RULES:
        sql = f"SELECT *, {', '.join(f'({rule}) AS {name}' for name, rule in stage.items())} FROM ({sql})"
    ladder = " ".join(f"WHEN {rule} THEN '{label}'" for rule, label in screening.LADDER)
    raw = " + ".join(f"CASE WHEN {rule} THEN {points} ELSE 0 END" for rule, points in screening.POINTS)
    codes = ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule, _ in screening.REASONS)
    texts = "MAP {" + ", ".join(f"'{code}': '{text}'" for code, _, text in screening.REASONS) + "}"
    low = " ".join(f"WHEN '{c}' THEN {a}::DOUBLE + {round(b - a, 3)}::DOUBLE * (raw / 100.0::DOUBLE)" for c, (a, b) in screening.BANDS.items())
    sql = f"SELECT doc_id, CASE {ladder} ELSE 'out_of_scope' END AS relevance_class, least(100, greatest(0, {raw}))::DOUBLE AS raw, list_filter([{codes}], lambda x: x IS NOT NULL) AS codes FROM ({sql})"
    return f"""SELECT doc_id, relevance_class, round(CASE relevance_class {low} END, 3) AS relevance_score, raw AS evidence_score, relevance_class IN ('core', 'adjacent') AS include_in_survey,
array_to_string(codes, ',') AS reason_codes, CASE WHEN len(codes) = 0 THEN '{screening.NO_REASON}' ELSE array_to_string(list_transform(codes, lambda c: {texts}[c]), '; ') END AS rationale FROM ({sql})"""


@query(_screening_sql())
def screening_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Class, score, reasons and rationale of every paper."""
    found = screening.screened(papers(spark, d), "doc_id", "title", "abstract").drop("screening_source")
    return found.withColumn("reason_codes", F.array_join("reason_codes", ","))


def _own_sql(pattern: str) -> str:
    split = "string_split(regexp_replace(abstract_text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter({split}, lambda s: {_has('s', pattern)} AND {_has('s', media.OWN_WORK)})[1]"


def _answer_sql(value: str, source: str, confidence: float, reasons: str, evidence: str) -> str:
    return f"{{'v': '{value}', 's': '{source}', 'c': {confidence}::DOUBLE, 'r': '{reasons}', 'e': left({evidence}, 1000)}}"


_WIRES = ", ".join(f"'{c}'" for c in media.ELECTRICAL_CLASSES)
_MEDIUM_SQL = f"""WITH p AS (SELECT *, {_own_sql(media.OPTICAL)} AS bright, {_own_sql(media.ELECTRICAL)} AS wired, list_sort(list_filter(string_split(measured, ' '), lambda c: c <> '')) AS cs,
  doc_id % 3 = 0 AS core FROM ({PLAIN_SQL})), w AS (SELECT *, list_filter(cs, lambda c: c IN ({_WIRES})) AS ws, list_contains(cs, 'optical') AS light FROM p)
SELECT doc_id, m.v AS medium, m.s AS source, m.c AS confidence, m.r AS reasons, m.e AS evidence FROM (SELECT doc_id, CASE
WHEN {_has('title_text', media.MIXED)} THEN {_answer_sql('unspecified', 'title', 0.45, 'explicit_mixed_title,optical_title,electrical_title', 'title_text')}
WHEN {_has('title_text', media.OPTICAL)} THEN {_answer_sql('optical', 'title', 0.96, 'explicit_optical_title', 'title_text')}
WHEN light AND len(ws) > 0 THEN {_answer_sql('unspecified', 'measurement', 0.5, 'mixed_measurement_classes', "array_to_string(cs, ', ')")}
WHEN light THEN {_answer_sql('optical', 'measurement', 0.94, 'measurement_optical', "'optical'")}
WHEN {_has('title_text', media.ELECTRICAL)} THEN {_answer_sql('electrical', 'title', 0.95, 'explicit_electrical_title', 'title_text')}
WHEN len(ws) > 0 THEN {_answer_sql('electrical', 'measurement', 0.9, 'measurement_electrical_topology', "array_to_string(ws, ', ')")}
WHEN {_has('abstract_text', media.MIXED)} AND bright IS NOT NULL AND wired IS NOT NULL THEN {_answer_sql('unspecified', 'abstract', 0.42, 'explicit_mixed_abstract', 'bright')}
WHEN bright IS NOT NULL THEN {_answer_sql('optical', 'abstract', 0.84, 'optical_implementation_abstract', 'bright')}
WHEN wired IS NOT NULL THEN {_answer_sql('electrical', 'abstract', 0.82, 'electrical_implementation_abstract', 'wired')}
WHEN core AND {_has('title_text', media.BOUNDARY)} THEN {_answer_sql('unspecified', 'screening', 0.35, 'core_optical_boundary', 'title_text')}
WHEN {_has('title_text', media.DEFAULT_ELECTRICAL)} THEN {_answer_sql('electrical', 'title', 0.78, 'serdes_electrical_default', 'title_text')}
WHEN core THEN {_answer_sql('electrical', 'screening', 0.68, 'core_serdes_electrical_default', "'Core SerDes'")}
ELSE {_answer_sql('unspecified', 'none', 0, 'insufficient_medium_evidence', 'NULL::VARCHAR')} END AS m FROM w)"""


@query(_MEDIUM_SQL)
def link_medium(spark: SparkSession, d: str) -> DataFrame:
    """Optical, electrical or unspecified, with the evidence that decides."""
    rows = papers(spark, d).select("doc_id", plain_text(F.col("title")).alias("t"), plain_text(F.col("abstract")).alias("a"), F.split("measured", " ").alias("c"), F.when(F.col("doc_id") % 3 == 0, "core").alias("s"))
    m = F.col("m")
    found = rows.select("doc_id", media.link_medium(F.col("t"), F.col("a"), F.col("c"), F.col("s")).alias("m"))
    return found.select("doc_id", m["value"].alias("medium"), m["source"].alias("source"), m["confidence"].alias("confidence"), F.array_join(m["reasons"], ",").alias("reasons"), m["evidence"].alias("evidence"))


def _rungs_sql(rungs: list[tuple[str, str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{s}|{r}'" for c, s, r in rungs) + " END"


def _measured_sql(t: str) -> str:
    return _rungs_sql([
        (_has(t, media.PARTIAL), "unknown", "partial_scope_exclusion"), (_has(t, media.FULL_LINK), "full_link", "explicit_full_link"), (_has(t, media.TRX_METRIC), "trx", "metric_attributed_transceiver"),
        (_has(t, media.TAKER_METRIC), "rx", "metric_attributed_rx"), (_has(t, media.SENDER_METRIC), "tx", "metric_attributed_tx"),
        (_has(f"regexp_extract({t}, '{media.DRIVER}(.{{0,70}})', 1)", media.DRIVER_METRIC), "driver_only", "metric_attributed_driver")])


def _named_sql(t: str) -> str:
    has = lambda *patterns: " AND ".join(_has(t, p) for p in patterns)
    return _rungs_sql([
        (has(media.PARTIAL), "unknown", "partial_scope_exclusion"), (has(media.FULL_LINK), "full_link", "explicit_full_link"), (has(media.BOTH_ENDS), "trx", "explicit_transceiver"),
        (has(media.SYSTEM_HEAD), "trx", "system_transceiver_head"), (has(media.DRIVER), "driver_only", "explicit_driver_only"), (has(media.SENDER, media.TAKER), "trx", "tx_rx_primary_cooccurrence"),
        (has(media.SENDER), "tx", "explicit_tx"), (has(media.TAKER), "rx", "explicit_rx"), (has(media.LINK_HEAD), "full_link", "system_link_head"),
        (has(media.SENDER_PART, media.TAKER_PART), "trx", "tx_rx_cooccurrence"), (has(media.SENDER_PART), "tx", "explicit_tx"), (has(media.TAKER_PART), "unknown", "receiver_subblock_only")])


_STORED = ("tx_rx", "rx", None, "driver_only", "other")
_STORED_SQL = "([" + ", ".join("NULL" if s is None else f"'{s}'" for s in _STORED) + f"])[doc_id % {len(_STORED)} + 1]"
_KEPT_SQL = "CASE stored " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in media.STORED_SCOPES.items()) + " END"


@query(f"""WITH p AS (SELECT doc_id, title_text, CASE WHEN {_has('sentence', media.ENERGY_WORDS)} THEN {_measured_sql('sentence')} END AS near, {_named_sql('title_text')} AS named, sentence, {_STORED_SQL} AS stored FROM ({PLAIN_SQL})),
q AS (SELECT *, {_KEPT_SQL} AS kept FROM p)
SELECT doc_id, split_part(CASE WHEN near IS NOT NULL THEN near WHEN named IS NOT NULL THEN named WHEN kept IS NOT NULL THEN kept ELSE 'unknown' END, '|', 1) AS scope,
CASE WHEN near IS NOT NULL THEN 'evidence' WHEN named IS NOT NULL THEN 'title' WHEN kept IS NOT NULL THEN 'measurement' ELSE 'none' END AS source,
CASE WHEN near IS NOT NULL THEN 0.94 WHEN named IS NOT NULL THEN CASE WHEN split_part(named, '|', 1) IN ('full_link', 'driver_only', 'trx') THEN 0.9 ELSE 0.84 END WHEN kept IS NOT NULL THEN 0.7 ELSE 0 END::DOUBLE AS confidence,
CASE WHEN near IS NOT NULL THEN split_part(near, '|', 2) || ',metric_local_evidence' WHEN named IS NOT NULL THEN split_part(named, '|', 2) WHEN kept IS NOT NULL THEN 'stored_component_scope' ELSE 'insufficient_scope_evidence' END AS reasons,
CASE WHEN near IS NOT NULL THEN sentence WHEN named IS NOT NULL THEN title_text WHEN kept IS NOT NULL THEN stored END AS evidence FROM q""")
def energy_scope(spark: SparkSession, d: str) -> DataFrame:
    """What a paper's energy covers: by a sentence with a figure, by its title, by what is stored."""
    rows = papers(spark, d).select("doc_id", plain_text(F.col("title")).alias("t"), F.array("sentence").alias("e"), F.get(F.array(*map(F.lit, _STORED)), (F.col("doc_id") % len(_STORED)).cast("int")).alias("s"))
    m = F.col("m")
    found = rows.select("doc_id", media.energy_scope(F.col("t"), F.col("e"), F.col("s")).alias("m"))
    return found.select("doc_id", m["value"].alias("scope"), m["source"].alias("source"), m["confidence"].alias("confidence"), F.array_join(m["reasons"], ",").alias("reasons"), m["evidence"].alias("evidence"))


TAILS = ("", "With Inductive Peaking", "Using a Charge Pump", "With a Ring Oscillator", "and Phase Interpolator", "With Offset Cancellation", "for Silicon Photonics", "With Duty-Cycle Correction", "and an ADC")
PHRASES = (
    "We use inductive peaking and a charge pump.", "Unlike prior art, a phase interpolator is used.", "A ring oscillator with duty-cycle correction drives the link.", "It works without inductive peaking.",
    "Offset cancellation and an ADC follow.", "A silicon photonic chip; the design avoids a charge pump.", "Charge-pump free locking.", "A phase interpolator, an HBM interface and a photodiode.")


@query()
def abstract_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Titles that the abstracts of favourites (by label) lead to, beyond what another channel (by language) has shown."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    stars = table(spark, d, "labels").where("quality = 1 AND toxic = 1").select("doc_id", F.lit(True).alias("star")).distinct()
    rows = docs.select("doc_id", "source", "lang", F.array_join(F.array(*map(_pick, (*PARTS, TAILS))), " ").alias("title"), F.concat_ws(" ", _pick(PHRASES, 3), F.col("text")).alias("abstract"))
    rows = rows.join(stars, "doc_id", "left")
    found = concepts.expanded(rows, "doc_id", "title", "abstract", F.coalesce("star", F.lit(False)), rows.where("lang = 'de' AND star IS NULL").select("doc_id"))
    return found.select("doc_id", "place", "score", "seed", *(F.array_join(c, ",").alias(c) for c in ("added", "anchors", "context")), "support")


VENUES = ("ISSCC", "VLSI-Circuits", "JSSC", "CICC", "vlsi-tech")
SAID = ("ISSCC", "VLSI", "JSSC", "cicc", "VLSI")
CHANGES = ("", "s", " Revisited", "", " With a Longer Name of Its Own", "")


@query()
def staged_matches(spark: SparkSession, d: str) -> DataFrame:
    """Records (titles as somebody else wrote them, some a year off) matched to papers by year, venue and title, exact ones first."""
    rows = papers(spark, d).select("doc_id", "title", (2018 + F.col("doc_id") % 5).cast("int").alias("year"))
    held = rows.select(F.col("doc_id").alias("paper"), "title", "year", _pick(VENUES).alias("venue"))
    written = F.regexp_replace(F.concat("title", _pick(CHANGES)), "^A ", "The ")
    records = rows.select(F.col("doc_id").alias("record"), written.alias("title"), F.when(F.col("doc_id") % 7 == 3, F.col("year") + 1).otherwise(F.col("year")).alias("year"), _pick(SAID).alias("venue"))
    return matching.staged(records, held, {"VLSI": ["VLSI-CIRCUITS", "VLSI-TECH"], "ISSCC": ["ISSCC", "JSSC"]})
