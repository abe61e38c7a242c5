"""Link medium and energy scope of a paper: the first evidence that decides, with its source, confidence and sentence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.plain import plain_text
from .screening import NUMBER, words

# Terms of a medium.
OPTICAL = words(
    r"optical(?:\s+(?:i/?o|links?|interconnects?|channels?|interfaces?|receivers?|transmitters?|transceivers?|modules?|engines?|transport))?|"
    r"photon\w*|silicon[- ]photon\w*|si[- ]photon\w*|opto[- ]?electronic|vcsel|photodetectors?|photodiodes?|avalanche photodiodes?|apd|"
    r"laser(?: diode)?|eml|dfb|fiber[- ]?optic|multimode fibers?|single[- ]mode fibers?|microrings?|micro[- ]rings?|mach[- ]zehnder|mzms?|"
    r"modulator drivers?|driver modulators?|co[- ]packaged optics?|cpo|(?:e|g|xg|xgs|10g|25g|50g)?-?pon|dwdm|cwdm|wdm|otdm|"
    r"100gbase[- ]lr4|100gbase[- ]sr4|400gbase[- ]fr4|800gbase[- ]fr4")
ELECTRICAL = words(
    r"electrical\s+(?:i/?o|links?|interconnects?|channels?|interfaces?|signaling|transmission|backplanes?|cables?)|wire[- ]?line|"
    r"copper(?:\s+cables?)?|twinax|backplane|pcb\s+(?:channels?|traces?|links?)|die[- ]to[- ]die|chip[- ]to[- ]chip|"
    r"d2d\s+(?:links?|interfaces?|interconnects?)|chiplets?|ucie|aib(?:[- ]compatible)?|nvlink[- ]c2c|ddr\d*|lpddr\d*|gddr\d*|hbm\d*|"
    r"memory\s+(?:i/?o|interfaces?)|pcie|pci express|displayport|usb(?:\s*\d(?:\.\d)?)?|sata|xaui|sfi[- ]?\d*")
DEFAULT_ELECTRICAL = words(
    r"serdes|serializers?|deserializers?|serial[- ]links?|serial[- ]?(?:i/?o|interfaces?|data)|retimers?|high[- ]speed i/?o")
BOUNDARY = words(
    r"burst[- ]mode|coherent|trans[- ]?impedance|tia|dml|directly[- ]modulated|distributed[- ]feedback laser|dfb|sonet|tosa|rosa|"
    r"dispersion compensat\w*|chirp[- ]managed")
OWN_WORK = words(
    r"we\s+(?:present|demonstrate|propose|report)|this\s+(?:work|paper|design|receiver|transmitter|transceiver|serdes|circuit)|proposed|"
    r"presented|designed|implemented|fabricated|demonstrated|targets?|intended|used\s+(?:for|in)|for\s+use\s+in|operat(?:es|ing)|"
    r"tested\s+(?:over|with)")
_WIRES, _LIGHT, _BOTH = r"\b(?:electrical|wire[- ]?line|backplane|copper|pcb)\b", r"\b(?:optical|photon\w*|vcsel|fibers?)\b", r".{0,75}\b(?:and|or|versus|vs\.?)\b.{0,75}"
MIXED = rf"(?i){_WIRES}{_BOTH}{_LIGHT}|{_LIGHT}{_BOTH}{_WIRES}"
ELECTRICAL_CLASSES = ("backplane", "cable", "memory", "die_to_die", "chip_to_chip", "electrical")
# What a reported energy covers.
ENERGY_WORDS = rf"(?i)\b(?:energy(?: efficiency)?|power(?: consumption)?)\b|{NUMBER}\s*(?:[pf]j\s*/\s*(?:b|bit)|[µμu]?w|mw)"
FULL_LINK = words(
    r"full[- ]link|complete[- ]link|entire[- ]link|end[- ]to[- ]end|whole[- ]link|link[- ]level|total link|"
    r"both (?:the )?transmitter and (?:the )?receiver|transmitter\s*\+\s*receiver")
DRIVER = words(r"(?:vcsel|laser|modulator|mzm|eml|dml|output|line)\s+drivers?|driver\s+(?:ics?|circuits?|amplifiers?)")
BOTH_ENDS = words(r"transceivers?|tx\s*[/+&-]\s*rx|rx\s*[/+&-]\s*tx|transmitters?\s+(?:and|&)\s+receivers?")
SYSTEM_HEAD = words(r"serdes|transceivers?")
SENDER = words(r"transmitters?|serializers?|tx")
TAKER = words(r"receivers?|deserializers?|rx|trans[- ]?impedance amplifiers?|tia")
LINK_HEAD = words(r"(?:serial|wireline|electrical|optical|bidirectional)\s+links?|chip[- ]to[- ]chip\s+links?|die[- ]to[- ]die\s+links?")
SENDER_PART = words(r"transmitters?|serializers?|tx|sst\s+drivers?|source[- ]series[- ]terminated\s+drivers?")
TAKER_PART = words(
    r"receivers?|deserializers?|rx|clock(?:\s+and)?\s+data recovery|clock recovery|cdr|trans[- ]?impedance amplifiers?|tia")
PARTIAL = words(
    r"analog[- ]only|analog\s+(?:power|energy)(?:\s+(?:only|portion))?|front[- ]end\s+only|"
    r"excluding\s+(?:the\s+)?(?:dsp|cdr|clock|driver|laser|modulator)|does\s+not\s+include|without\s+(?:the\s+)?(?:dsp|cdr|driver)|"
    r"partial\s+(?:power|energy)")
_SPENDS = r"(?:consum\w*|dissipat\w*|achiev\w*|require\w*|use[sd]?)"
_TRX = r"\b(?:full\s+)?transceivers?\b"
TRX_METRIC = rf"(?i){_TRX}.{{0,70}}\b(?:consum\w*|dissipat\w*|energy|power|[pf]j\s*/)|\b(?:energy|power|[pf]j\s*/).{{0,70}}{_TRX}"
TAKER_METRIC = rf"(?i)\b(?:receivers?|rx(?:[- ]only)?)\b\s+{_SPENDS}"
SENDER_METRIC = rf"(?i)\b(?:transmitters?|tx(?:[- ]only)?)\b\s+{_SPENDS}"
DRIVER_METRIC = rf"(?i)\b(?:{_SPENDS}|energy|power|[pf]j\s*/)"
STORED_SCOPES = {"tx": "tx", "rx": "rx", "tx_rx": "trx", "trx": "trx", "full_link": "full_link", "driver_only": "driver_only"}
LONGEST = 1000


def _answer(value: str | Column, source: str, confidence: float | Column, reasons: Sequence[str | Column], evidence: Column | None = None) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    shown = F.substring(evidence, 1, LONGEST) if evidence is not None else F.lit(None).cast("string")
    return F.struct(
        as_column(value).alias("value"), F.lit(source).alias("source"), as_column(confidence).cast("double").alias("confidence"),
        F.array(*map(as_column, reasons)).alias("reasons"), shown.alias("evidence"))


def sentences(text: Column) -> Column:
    """Sentences of a plain text: they end at a full stop, question or exclamation mark or semicolon before a space."""
    return F.split(text, r"(?<=[.!?;])\s+")


def _own_sentence(text: Column, pattern: str) -> Column:
    """The first sentence that has the pattern and speaks of the paper's own work, not of the background."""
    return F.get(F.filter(sentences(text), lambda s: s.rlike(pattern) & s.rlike(OWN_WORK)), F.lit(0))


def link_medium(title: Column, abstract: Column, classes: Column, screening: Column) -> Column:
    """A struct ``value, source, confidence, reasons, evidence``: optical, electrical or unspecified, by the first evidence of the title,
    measured link classes (an array), the abstract's own-work sentences, the screening class, then the title's default.

    Both media named side by side stay unspecified; technology (CMOS, PAM, CDR) says nothing about the medium. Titles and abstracts
    are plain texts (see ``plain_text``); nulls are nothing found.
    """
    classes = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(classes, F.array().cast("array<string>")), lambda c: F.lower(F.trim(c))), lambda c: c != "")))
    title, abstract = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    core = F.coalesce(F.lower(F.trim(screening)) == "core", F.lit(False))
    wires = F.array_intersect(classes, F.array(*map(F.lit, ELECTRICAL_CLASSES)))
    light = F.array_contains(classes, "optical")
    bright, wired = _own_sentence(abstract, OPTICAL), _own_sentence(abstract, ELECTRICAL)
    rungs = (
        (title.rlike(MIXED), _answer("unspecified", "title", 0.45, ["explicit_mixed_title", "optical_title", "electrical_title"], title)),
        (title.rlike(OPTICAL), _answer("optical", "title", 0.96, ["explicit_optical_title"], title)),
        (light & (F.size(wires) > 0), _answer("unspecified", "measurement", 0.50, ["mixed_measurement_classes"], F.array_join(classes, ", "))),
        (light, _answer("optical", "measurement", 0.94, ["measurement_optical"], F.lit("optical"))),
        (title.rlike(ELECTRICAL), _answer("electrical", "title", 0.95, ["explicit_electrical_title"], title)),
        (F.size(wires) > 0, _answer("electrical", "measurement", 0.90, ["measurement_electrical_topology"], F.array_join(wires, ", "))),
        (abstract.rlike(MIXED) & bright.isNotNull() & wired.isNotNull(), _answer("unspecified", "abstract", 0.42, ["explicit_mixed_abstract"], bright)),
        (bright.isNotNull(), _answer("optical", "abstract", 0.84, ["optical_implementation_abstract"], bright)),
        (wired.isNotNull(), _answer("electrical", "abstract", 0.82, ["electrical_implementation_abstract"], wired)),
        (core & title.rlike(BOUNDARY), _answer("unspecified", "screening", 0.35, ["core_optical_boundary"], title)),
        (title.rlike(DEFAULT_ELECTRICAL), _answer("electrical", "title", 0.78, ["serdes_electrical_default"], title)),
        (core, _answer("electrical", "screening", 0.68, ["core_serdes_electrical_default"], F.lit("Core SerDes"))),
    )
    out = F
    for condition, answer in rungs:
        out = out.when(condition, answer)
    return out.otherwise(_answer("unspecified", "none", 0.0, ["insufficient_medium_evidence"]))


def _pair(scope: str, reason: str) -> Column:
    return F.struct(F.lit(scope).alias("scope"), F.lit(reason).alias("reason"))


def _first(rungs: Sequence[tuple[Column, Column]]) -> Column:
    out = F
    for condition, answer in rungs:
        out = out.when(condition, answer)
    return out.otherwise(F.lit(None))


def _measured_scope(text: Column) -> Column:
    """What a sentence with a figure says that the figure covers; null unless the figure's subject is named."""
    after_driver = F.regexp_extract(text, DRIVER + "(.{0,70})", 1)
    return _first((
        (text.rlike(PARTIAL), _pair("unknown", "partial_scope_exclusion")),
        (text.rlike(FULL_LINK), _pair("full_link", "explicit_full_link")),
        (text.rlike(TRX_METRIC), _pair("trx", "metric_attributed_transceiver")),
        (text.rlike(TAKER_METRIC), _pair("rx", "metric_attributed_rx")),
        (text.rlike(SENDER_METRIC), _pair("tx", "metric_attributed_tx")),
        (after_driver.rlike(DRIVER_METRIC), _pair("driver_only", "metric_attributed_driver")),
    ))


def _named_scope(text: Column) -> Column:
    """What a title says that its paper is about, whole systems before their parts."""
    sends, takes, sends_part, takes_part = (text.rlike(p) for p in (SENDER, TAKER, SENDER_PART, TAKER_PART))
    return _first((
        (text.rlike(PARTIAL), _pair("unknown", "partial_scope_exclusion")),
        (text.rlike(FULL_LINK), _pair("full_link", "explicit_full_link")),
        (text.rlike(BOTH_ENDS), _pair("trx", "explicit_transceiver")),
        (text.rlike(SYSTEM_HEAD), _pair("trx", "system_transceiver_head")),
        (text.rlike(DRIVER), _pair("driver_only", "explicit_driver_only")),
        (sends & takes, _pair("trx", "tx_rx_primary_cooccurrence")),
        (sends, _pair("tx", "explicit_tx")),
        (takes, _pair("rx", "explicit_rx")),
        (text.rlike(LINK_HEAD), _pair("full_link", "system_link_head")),
        (sends_part & takes_part, _pair("trx", "tx_rx_cooccurrence")),
        (sends_part, _pair("tx", "explicit_tx")),
        (takes_part, _pair("unknown", "receiver_subblock_only")),
    ))


def energy_scope(title: Column, evidence: Column, stored: Column) -> Column:
    """A struct ``value, source, confidence, reasons, evidence``: tx, rx, trx, full_link, driver_only or unknown.

    The first text of ``evidence`` (an array of plain texts) that has a figure of energy or power and names its subject decides;
    then the title; then the stored scope. Nulls are nothing found.
    """
    texts = F.filter(F.coalesce(evidence, F.array().cast("array<string>")), lambda t: t.rlike(ENERGY_WORDS))
    found = F.transform(texts, lambda t: F.struct(_measured_scope(t).alias("said"), t.alias("text")))
    local = F.get(F.filter(found, lambda x: x["said"].isNotNull()), F.lit(0))
    named = _named_scope(F.coalesce(title, F.lit("")))
    kept = F.create_map(*(F.lit(x) for kv in STORED_SCOPES.items() for x in kv))[F.coalesce(F.lower(F.trim(stored)), F.lit(""))]
    sure = F.when(named["scope"].isin("full_link", "driver_only", "trx"), 0.90).otherwise(0.84)
    return (
        F.when(local.isNotNull(), _answer(local["said"]["scope"], "evidence", 0.94, [local["said"]["reason"], "metric_local_evidence"], local["text"]))
        .when(named.isNotNull(), _answer(named["scope"], "title", sure, [named["reason"]], title))
        .when(kept.isNotNull(), _answer(kept, "measurement", 0.70, ["stored_component_scope"], F.lower(F.trim(stored))))
        .otherwise(_answer("unknown", "none", 0.0, ["insufficient_scope_evidence"])))


__all__ = ["link_medium", "energy_scope", "plain_text", "sentences"]
