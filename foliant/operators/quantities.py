"""Figures with units in text, each found once: what was measured, in base units, and only where it is unambiguous."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.plain import plain_text

# How units are written, and their factors to Gb/s, GBaud, pJ, mW, nm and GHz.
RATE_UNITS = {"tb": 1000.0, "gb": 1.0}
ENERGY_UNITS = {"pj": 1.0, "fj": 0.001}
POWER_UNITS = {"w": 1000.0, "mw": 1.0, "\u00b5w": 0.001, "\u03bcw": 0.001, "uw": 0.001}
SIZE_UNITS = {"nm": 1.0, "\u00b5m": 1000.0, "\u03bcm": 1000.0, "um": 1000.0}
FREQUENCY_UNITS = {"khz": 1e-6, "mhz": 1e-3, "ghz": 1.0, "thz": 1000.0}
NUMBER, GAP = r"\d+(?:\.\d+)?", r"\s*(?:-\s*)?"
MICRO = "[\u00b5\u03bcu]"
BITS, BAUD = r"[TtGg]b(?i:/s|ps|it/s)", r"(?i:gbaud|gbd)"
PER = r"(?i:\s*/\s*(mm(?:\^?2|²)?|pin|wire|lane))?"
# A size counts near a word for a process (or after "in", away from optics), a loss near a word for a channel.
PROCESS = re.compile(r"(?i)m?cmos(?![- ]compatible)|finfet|process|technology|fabricat|bi[- ]?cmos|sige|fd[- ]?soi|\bsoi\b|\bhbt\b|\binp\b|\bgaas\b")
OPTICS = re.compile(r"(?i)wavelength|optical|spectral|bandwidth|c[- ]band|o[- ]band|photonic|waveguide|filter")
CHANNEL = re.compile(r"(?i)loss|channel|insertion")
WHOLE = re.compile(r"(?i)\b(?:aggregate|total)\b")
LARGEST_NODE, LARGEST_BARE_NODE = 500, 300
#: A power over a rate beyond so many pJ/bit most likely lost its prefix.
DOUBTFUL = 10_000.0
RATES = re.compile(
    rf"(?P<lanes>\d{{1,3}})\s*[x×]\s*(?P<each>{NUMBER}){GAP}(?P<u1>{BITS}){PER}|(?P<low>{NUMBER})\s*(?:-|–|—|to)\s*(?P<high>{NUMBER}){GAP}(?P<u2>{BITS}|{BAUD}){PER}"
    rf"|(?P<value>{NUMBER}){GAP}(?P<u3>{BITS}|{BAUD}){PER}")
ENERGIES = re.compile(rf"(?i)(?P<energy>{NUMBER}){GAP}(?P<e>[pf]j)\s*/\s*(?:bit|b)(?P<loss1>\s*/\s*dB)?")
RATIOS = re.compile(rf"(?i)(?<![A-Za-z0-9])(?P<ratio>{NUMBER}){GAP}(?P<r>{MICRO}W|mW|W)\s*/\s*\(?\s*G(?:b(?:/s)?|bps|bit/s)\s*\)?(?P<loss2>\s*/\s*dB)?")
POWERS = re.compile(rf"(?i)(?<![A-Za-z0-9])(?P<power>{NUMBER}){GAP}(?P<p>{MICRO}W|mW|W)(?![A-Za-z0-9])")
SIZES = re.compile(rf"(?i)(?P<size>{NUMBER}){GAP}(?P<s>nm|{MICRO}m)\b")
LOSSES = re.compile(rf"(?i)(?P<loss>{NUMBER}){GAP}dB\b")
FREQUENCIES = re.compile(rf"(?i)({NUMBER})\s*([GMTK]Hz)\b")
ERRORS = re.compile(r"(?i)(?:\bBER\b|bit[- ]error rate).{0,45}?(?:(?:(?P<times>\d+(?:\.\d+)?)\s*[x×]\s*)?10\s*\^?\s*-\s*(?P<power>\d+)|(?P<plain>\d+(?:\.\d+)?e-\d+))")
@dataclass
class Figure:
    """One occurrence: its place, what it is, its value in base units, and whether it must be looked at."""

    kind: str
    start: int
    end: int
    value: float | None
    review: bool = False
    more: dict = field(default_factory=dict)


def excerpt(text: str, start: int, end: int, radius: int = 150) -> str:
    """The clause around a place, ``radius`` signs to each side at most."""
    left, right = max(0, start - radius), min(len(text), end + radius)
    stops = [p + 2 for p in (text.rfind(m, left, start) for m in (". ", "; ")) if p >= 0][:1]
    ends = [p + 1 for p in (text.find(m, end, right) for m in (". ", "; ")) if p >= 0][:1]
    return text[stops[0] if stops else left : ends[0] if ends else right].strip()


def around(text: str, f: re.Match, reach: int) -> str:
    return text[max(0, f.start() - reach) : f.end() + reach]


def rates(text: str) -> Iterator[Figure]:
    for m in RATES.finditer(text):
        unit = (m["u1"] or m["u2"] or m["u3"]).lower()
        factor = RATE_UNITS.get(unit[:2], 1.0)
        per = re.sub(r"\s", "", next((g for g in (m[4], m[8], m[11]) if g), "")).lower()
        kind = "symbol_rate" if unit.endswith(("baud", "bd")) else "density" if per.startswith("mm") else "pin_rate" if per == "pin" else "lane_rate" if per else "bit_rate"
        if m["lanes"]:
            lane = float(m["each"]) * factor
            yield Figure(kind, *m.span(), lane, more={"scope": "lane", "lanes": int(m["lanes"])})
        elif m["low"]:
            ends = sorted((float(m["low"]) * factor, float(m["high"]) * factor))
            yield Figure(f"{kind}_range", *m.span(), None, more={"ends": ends})
        else:
            scope = "lane" if kind == "lane_rate" else "aggregate" if WHOLE.search(around(text, m, 35)) else "unknown"
            yield Figure(kind, *m.span(), float(m["value"]) * factor, more={"scope": scope})


def energies(text: str) -> Iterator[Figure]:
    taken = []
    for m in ENERGIES.finditer(text):
        taken.append(m.span())
        yield Figure("energy_per_db" if m["loss1"] else "energy", *m.span(), float(m["energy"]) * ENERGY_UNITS[m["e"].lower()])
    for m in RATIOS.finditer(text):
        if not any(m.start() < b and a < m.end() for a, b in taken):
            value = float(m["ratio"]) * POWER_UNITS[m["r"].lower()]
            yield Figure("energy_per_db" if m["loss2"] else "energy", *m.span(), value, m["r"].lower() == "w" and value > DOUBTFUL)


def powers(text: str) -> Iterator[Figure]:
    ratios = [m.span() for m in RATIOS.finditer(text)]
    for m in POWERS.finditer(text):
        if not any(a <= m.start() and m.end() <= b for a, b in ratios):
            yield Figure("power", *m.span(), float(m["power"]) * POWER_UNITS[m["p"].lower()])


def sizes(text: str) -> Iterator[Figure]:
    for m in SIZES.finditer(text):
        value, near = float(m["size"]) * SIZE_UNITS[m["s"].lower()], around(text, m, 55)
        bare = value <= LARGEST_BARE_NODE and re.search(r"(?i)\bin\s*$", text[max(0, m.start() - 5) : m.start()]) and not OPTICS.search(near)
        if value <= LARGEST_NODE and (PROCESS.search(near) or bare):
            # a space inside a number ("4 0nm") leaves a fragment
            yield Figure("process", *m.span(), value, value <= 0 or bool(re.search(r"\d\s+$", text[max(0, m.start() - 12) : m.start()])))


def losses(text: str) -> Iterator[Figure]:
    for m in LOSSES.finditer(text):
        near = around(text, m, 65)
        if CHANNEL.search(near):
            at = FREQUENCIES.search(near)
            yield Figure("loss", *m.span(), float(m["loss"]), more={"ghz": float(at[1]) * FREQUENCY_UNITS[at[2].lower()] if at else None})


def errors(text: str) -> Iterator[Figure]:
    for m in ERRORS.finditer(text):
        value = float(m["plain"]) if m["plain"] else float(m["times"] or 1) * 10.0 ** -int(m["power"])
        if 0 < value <= 1:
            near = around(text, m, 30).lower()
            scope = next((s for s in ("post_fec", "pre_fec") if re.search(s.replace("_", "[- ]?"), near)), "unknown")
            yield Figure("ber", *m.span(), value, more={"scope": scope})


#: Each reader with what a text that it can read from must have: a linear-time matcher looks for it in whole batches first.
READERS: tuple[tuple[Callable[[str], Iterator[Figure]], str], ...] = (
    (rates, r"(?i)[0-9]\s*-?\s*(?:[tg]b(?:/s|ps|it/s)|gbaud|gbd)"), (energies, r"(?i)[0-9]\s*-?\s*(?:[pf]j|[µμum]?w)\s*/"), (powers, r"(?i)[0-9]\s*-?\s*[µμum]?w(?:[^a-z0-9]|$)"),
    (sizes, r"(?i)[0-9]\s*-?\s*[nµμu]m\b"), (losses, r"(?i)[0-9]\s*-?\s*db\b"), (errors, r"(?i)\bber\b|bit[- ]error rate"))
FIELDS = (
    "rate_gbps double, rate_min_gbps double, rate_max_gbps double, rate_scope string, lane_count int, lane_rate_gbps double, aggregate_rate_gbps double, symbol_rate_gbaud double, "
    "density_gbps_mm double, energy_pj_bit double, energy_pj_bit_db double, power_mw double, process_nm double, channel_loss_db double, loss_frequency_ghz double, ber double, ber_scope string, "
    "ambiguous array<string>")
FIGURE = "array<struct<kind:string,raw:string,value:double,review:boolean,excerpt:string>>"


def read(texts: pa.Array) -> Iterator[tuple[str, list[Figure]]]:
    """Each text of a batch with its figures in the readers' order."""
    import numpy as np
    import pyarrow.compute as pc

    able = np.column_stack([np.asarray(pc.match_substring_regex(texts, needs), dtype=bool) for _, needs in READERS])
    for text, row, some in zip(texts.to_pylist(), able, able.any(axis=1)):
        yield text, [f for (reader, _), has in zip(READERS, row) if has for f in reader(text)] if some else []


def settled(found: list[Figure]) -> dict:
    """The fields of one text from its figures: a value only where the text has one."""
    of = lambda *kinds: [f for f in found if f.kind in kinds]
    out: dict = {"ambiguous": []}
    bits, ranges, symbols, dense = of("bit_rate", "lane_rate"), of("bit_rate_range", "lane_rate_range"), of("symbol_rate"), of("density")
    lanes = [f for f in bits if "lanes" in f.more]
    chosen = lanes[0] if len(lanes) == 1 else bits[0] if len(bits) == 1 else None
    if chosen:
        scope, count = chosen.more["scope"], chosen.more.get("lanes")
        out |= {"rate_gbps": chosen.value, "rate_scope": scope, "lane_count": count}
        out["lane_rate_gbps"] = chosen.value if scope == "lane" else None
        out["aggregate_rate_gbps"] = chosen.value * count if count else chosen.value if scope == "aggregate" else None
    elif len(ranges) == 1:
        out |= {"rate_min_gbps": ranges[0].more["ends"][0], "rate_max_gbps": ranges[0].more["ends"][1], "rate_scope": "unknown"}
    elif len(bits) > 1 or len(ranges) > 1:
        out["ambiguous"].append("rate_gbps")
    if len(symbols) == 1:
        out["symbol_rate_gbaud"] = symbols[0].value
    elif symbols:
        out["ambiguous"].append("symbol_rate_gbaud")
    if len(dense) == 1:
        out["density_gbps_mm"] = dense[0].value
    per_db = of("energy_per_db")
    sure = [f for f in per_db if not f.review]
    if len(sure) == 1:
        out["energy_pj_bit_db"] = sure[0].value
    for name, kind, places in (("energy_pj_bit", "energy", 12), ("power_mw", "power", 9), ("process_nm", "process", 6), ("channel_loss_db", "loss", 6), ("ber", "ber", None)):
        mine = of(kind)
        usable = [f for f in mine if not f.review] if kind == "energy" else mine
        values = {f.value if places is None else round(f.value, places) for f in usable}
        doubtful = any(f.review for f in mine)
        if len(values) == 1 and not (doubtful and kind == "process"):
            out[name] = usable[0].value
            if kind == "loss":
                out["loss_frequency_ghz"] = usable[0].more["ghz"]
            if kind == "ber":
                out["ber_scope"] = usable[0].more["scope"]
        if len(values) > 1 or doubtful:
            out["ambiguous"].append(name)
    if any(f.review for f in per_db):
        out["ambiguous"].append("energy_pj_bit_db")
    return out


#: Texts of at most REMEMBERED_SIGNS signs whose fields a Python worker remembers: sentences repeat over a large table.
REMEMBERED, REMEMBERED_SIGNS = 50_000, 1_000
_known: dict[str, dict] = {}


def fields_of(texts: Sequence[str]) -> list[dict]:
    """The settled fields of each of some different texts; only those that the worker has not read before are read."""
    new = [t for t in texts if t not in _known]
    own = {t: settled(found) if found else {} for t, found in read(pa.array(new, pa.string()))}
    rows = [own[t] if t in own else _known[t] for t in texts]
    short = {t: row for t, row in own.items() if len(t) <= REMEMBERED_SIGNS}
    if len(_known) + len(short) > REMEMBERED:
        _known.clear()
    _known.update(list(short.items())[:REMEMBERED])
    return rows


def performance(text: Column) -> Column:
    """A struct of the figures that ``text`` gives and ``ambiguous``, the names of those that it gives in several ways.

    Rates are lanes times a rate, a range or alone, so no sign belongs to two; a rate must be the only one. Energies, powers, nodes,
    losses and error rates may repeat with one value. Powers over a rate are energies and no powers. What is missing, ambiguous or to be
    looked at is null; of a null text all are. The text is made plain first. Arrow batches, since places and what stands around them
    decide; a batch's equal texts are read once, and a worker remembers some.
    """
    schema = T.StructType.fromDDL(FIELDS)

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        coded = texts.fill_null("").cast(pa.string()).dictionary_encode()
        rows = fields_of(coded.dictionary.to_pylist())
        columns = [pa.array([r.get(f.name) for r in rows] if f.name != "ambiguous" else [r.get(f.name, ()) for r in rows], f.type) for f in to_arrow_type(schema)]
        return pa.StructArray.from_arrays(columns, fields=list(to_arrow_type(schema))).take(coded.indices)

    return run(plain_text(text))


def occurrences(text: Column) -> Column:
    """Every figure of ``text`` with its sign string, value in base units, whether it must be looked at, and the clause around it."""

    @F.arrow_udf(FIGURE)
    def run(texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        rows = [[{"kind": f.kind, "raw": t[f.start : f.end], "value": f.value, "review": f.review, "excerpt": excerpt(t, f.start, f.end)} for f in found] for t, found in read(texts)]
        return pa.array(rows, to_arrow_type(kind))

    kind = T.ArrayType(T.StructType.fromDDL("kind string, raw string, value double, review boolean, excerpt string"))
    return run(plain_text(text))
