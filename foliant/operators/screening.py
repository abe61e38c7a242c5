"""Relevance of a paper from its title and abstract: features once, a table of rules over them, a class, a score and reasons."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plain import plain_text

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
GHZ = rf"{NUMBER}\s*[-–]?\s*GHz"
TIA = r"trans[- ]?impedance(?:[- ]?agc)? amplifiers?|tia"
SHARED_LINK = (
    r"serial[- ]links?|serial[- ]?(?:i/?o|interface|data)|high[- ]speed links?|data links?|on[- ]chip links?|usr links?|source[- ]synchronous|"
    r"parallel interfaces?|i/?o links?|on[- ]chip bus(?:es)?|parallel bus(?:es)?|short[- ]reach interconnects?|loss channels?|intra[- ]package|"
    r"inter[- ]package|off[- ]package|backplane(?: links?| transceivers?)?|forwarded[- ]clock i/?o|displayport|hypertransport|c[- ]?phy|d[- ]?phy|"
    r"m[- ]?phy|pcie|pci express|sfi[- ]?\d*|xaui|chip[- ]to[- ]chip|die[- ]to[- ]die|d2d (?:links?|interfaces?|interconnects?)|ucie|"
    r"aib[- ]compatible|chiplet (?:links?|interconnects?|i/?o)|electrical i/?o|high[- ]speed i/?o|serdes|serializers?|deserializers?|lvds")


def words(alternatives: str) -> str:
    return rf"(?i)\b(?:{alternatives})\b"


# Terms that are looked for both in the title and in title and abstract together.
EVIDENCE = {
    "direct_serdes": words(
        r"serdes|serializer|deserializer|wire[- ]?line|serial[- ]links?|serial[- ]?(?:i/?o|interface|data)|chip[- ]to[- ]chip|die[- ]to[- ]die|"
        r"d2d (?:links?|interfaces?|interconnects?)|chiplet|ucie|electrical i/?o|high[- ]speed i/?o"),
    "circuit_block": words(
        r"transceiver|transmitter|receiver|serializer|deserializer|retimer|driver|front[- ]end|analog front[- ]end|afe|trans[- ]?impedance amplifier|tia|"
        r"clock(?:\s+and)?\s+data recovery|clock recovery|cdr|equaliz\w*|dfe|ffe|ctle|slicer|phase interpolator|eye monitor"),
    "link_endpoint": words(r"transmitters?|receivers?|transceivers?|retimers?|drivers?|serializers?|deserializers?|front[- ]?ends?|afe|tia|tx|rx"),
    "electrical_signaling": words(r"pam[- ]?[2348]|[2348][- ]?pam|nrz|duo[- ]?binary|multi[- ]level signaling"),
    "ic_evidence": "",
    "efficiency_evidence": r"(?i)(?:\b(?:energy efficiency|low[- ]power|power consumption)\b|(?:^|[^A-Za-z])(?:(?:[pf]j\s*/\s*(?:b|bit)|mW)\b))",
    "optical_io": words(
        r"optical i/?o|optical interconnect|vcsel|silicon photonic|silicon optical|photonic integrated|microring|micro[- ]ring|optical transmitter|"
        r"optical receiver|laser driver|modulator driver|driver modulator|electro[- ]optic|ge[- ]on[- ]si\s+pd|transimpedance amplifier|tia"),
    "transport_experiment": words(
        rf"transmission|fiber transmission|coherent transmission|wavelength[- ]division multiplex|wdm|ofdm|passive optical network|pon|{NUMBER}\s*km|long[- ]haul"),
    "device_physics": words(
        r"quantum[- ]dot|photonic crystal|grating coupler|waveguide|semiconductor optical amplifier|laser|photodetector|photodiode|modulator|"
        r"optical switch|filter"),
    "algorithm_system": words(
        r"machine learning|neural network|digital signal processing|dsp|equalization algorithm|forward error correction|fec|coding scheme|"
        r"maximum likelihood sequence|mlse|nonlinear compensation|mimo reconstruction|mimo equaliz\w*|polarization crosstalk cancellation|"
        r"error[- ]control scheme|fourier transformation|frequency[- ]domain equaliz\w*|training sequences?|ofdm|"
        r"(?:adaptive|blind|turbo|nonlinear|digital) equaliz\w*"),
    "sensing_application": words(
        r"sensors?|sensing (?:applications?|systems?|platforms?)|lidar|range[- ]finding|distance ranging|time[- ]of[- ]flight|tof|nirs|diagnostics?|"
        r"imaging|spectroscop\w*|biosens\w*|refractive index|single[- ]photon|spad|gyroscope|wearable|biomedical|neural recording|neural interface|"
        r"bioz|ppg|exg|ultraso\w*|implantable|medical implant|bodyid|imagers?|image sensors?|nmr|field probes?"),
    "nonwireline_link": words(
        r"radio[- ]over|free[- ]space|wireless|antenna|visible[- ]light communications?|spatial optical communications?|vlc|all[- ]optical|"
        r"phased[- ]array|radar|satellite|satcom|bluetooth|wi[- ]?fi|lte|nb[- ]?iot|internet[- ]of[- ]things|body[- ]channel|"
        r"human[- ]body communication|hbc|uwb|impulse[- ]radio"),
    "rf_carrier": words(
        r"rf front[- ]end|millimeter[- ]wave|mm[- ]?wave|sub[- ]?thz|d[- ]?band|g[- ]?band|w[- ]?band|direct[- ]conversion|beamform\w*|"
        r"[1-9]\d{1,3}(?:\.\d+)?\s*[-–]?\s*ghz(?:[- ]band)?"),
    "non_research": (
        r"(?i)^\s*(?:(?:guest\s+)?editorial\b|corrections?(?:\s+(?:to|on)\b|:)|erratum\b|retraction\b|notice of violation\b|"
        r"special (?:section|issue)\b|table of contents\b|index\b|front cover\b|back cover\b|call for papers\b|in memoriam\b|"
        r"session\s+\d+(?:\s+overview\b|\s*[-—:])|forum\b|f\d+\s*:\s*|comments? on\b)"),
    "review_article": (
        r"(?i)\b(?:review|survey|tutorial|overview|perspective|roadmap|recent advances|challenges and solutions|future prospects|"
        r"feasibility stud\w*|performance assessment|experimental assessment|performance investigation|progress and trends|impact of|effect of|"
        r"part\s+(?:i|ii|iii|iv|v))\b|^\s*(?:the\s+)?design (?:techniques|considerations|methodolog\w*)\b"),
}
_RF_SIGNS = r"transmitters?|receivers?|transceivers?|radios?|communications?"
_RANGED_GHZ = rf"{NUMBER}(?:\s*[-–/]\s*{NUMBER})?\s*[-–]?\s*GHz"
_CLOCK = r"jitter|tracking|bandwidth|clock|oscillator"
# Terms that are looked for in the title.
TITLE = {
    "wireline": words(
        r"serdes|serializers?|deserializers?|lvds|wire[- ]?line|serial[- ]links?|serial[- ]?(?:i/?o|interface|data)|displayport|hypertransport|"
        r"c[- ]?phy|d[- ]?phy|m[- ]?phy|pcie|pci express|sfi[- ]?\d*|xaui"),
    "direct_link": words(SHARED_LINK + "|wire[- ]?line"),
    "direct_impl": words(SHARED_LINK + "|nvlink[- ]c2c"),
    "cdr": words(r"clock\s*(?:(?:and|&)\s+)?data recovery|clock[- ]and[- ]data recovery|clock\s*[/&-]\s*data recovery|clock recovery|cdr"),
    "endpoint": words(r"transmitters?|receivers?|transceivers?|serializers?|deserializers?|tx|rx"),
    "equalizer": words(r"equaliz\w*|dfe|ffe|ctle"),
    "circuit_equalizer": words(r"dfe|ffe|ctle|decision[- ]feedback equaliz\w*|feed[- ]forward equaliz\w*|continuous[- ]time linear equaliz\w*"),
    "adjacent_block": words(
        r"retimers?|limiting amplifiers?|wideband amplifiers?|trans[- ]?impedance amplifiers?|tia|drivers?|front[- ]?ends?|afe|samplers?|"
        r"multiplexers?|mux|demultiplexers?|demux|phase interpolators?"),
    "generic_block": words(r"drivers?|front[- ]?ends?|afe"),
    "optical_anchor": words(
        r"optical|photon\w*|vcsel|laser(?: diode)?|photodetectors?|photodiodes?|optoelectronic|apd|mzms?|eml|microring|micro[- ]ring|"
        r"silicon photonic|si[- ]photonic|ge[- ]on[- ]si\s+pd|nanophoton\w*|optics|dfb|tfln|(?:e|g|xg|xgs|10g|25g|50g)?-?pon|dwdm|wdm|otdm|"
        r"fiber[- ]?optic|fibers?|pof|ssmf|smf|nzdsf|mmf|c[- ]band|modulator drivers?|driver modulators?|m[- ]?z(?:m)?|mach[- ]zehnder|"
        r"co[- ]packaged optics?|cpo"),
    "coherent": words("coherent"),
    "tia": words(TIA),
    "monolithic": words(r"monolithic(?:ally)?|heterogeneously integrated|electronic[- ]photonic co[- ]design\w*"),
    "optical_link": words(r"optical (?:links?|interconnects?|i/?o)|chiplet optical i/?o|co[- ]packaged optics?|cpo|mrm[- ]based"),
    "integrated_optical": words(
        r"silicon photonics? transceivers?|optical transceiver engines?|(?:monolithic(?:ally)? |fully )?integrated optical receivers?|"
        r"optical receivers? with integrated|latch[- ]type optical receivers?"),
    "optical_driver": words(r"vcsel over[- ]?driving ics?|vcsel drivers?|modulator transmitters?|modulator drivers?|driver modulators?"),
    "tia_bandwidth": rf"(?i)\b(?:{TIA})\b.{{0,45}}{GHZ}\b|\b{GHZ}\b.{{0,45}}\b(?:{TIA})\b",
    "translator_words": words(r"electronic bus to .{0,30}optical link|optical link .{0,25}(?:translator|bridge)"),
    "cdr_anchor": words(
        r"reference[- ]less|half[- ]rate|quarter[- ]rate|full[- ]rate|single[- ]loop|dual[- ]loop|phase detectors?|jitter tolerance|"
        r"frequency acquisition|dco[- ]based"),
    "cdr_circuit": (
        r"(?i)(?:clock\s*(?:(?:and|&|/)\s*)?data recovery|clock[- ](?:and[- ])?data recovery|\bcdr\b).{0,16}\bcircuits?\b"),
    "passive": words(
        r"parametric (?:devices?|gates?|amplifiers?)|photonic switch(?:es)?|optical waveguides?|grating couplers?|"
        r"wavelength\s*\(?de[- ]?\)?multiplexers?"),
    "strong_passive": words(
        r"holograms?|optical backplanes?|grating couplers?|multicore(?: multimode)? fibers?|plastic optical fibers?|optical subassemblies?|tosa|"
        r"arrayed waveguide gratings?|awg|laser arrays?|photonic devices?|silicon photonic interfaces?|cryogenic.{0,40}vcsel"),
    "photonic_platform": words(
        r"dual[- ]quantum[- ]well|balanced detection|vcsel arrays?|dfbs?|comb[- ]based|photonic coherent|mach[- ]zehnder transmitters?|"
        r"cwdm receivers?|dqpsk receivers?|inP(?:\s|$)|alumina substrates?|thick film on ceramics|lattice[- ]filter|lan[- ]wdm|photonic reservoir|"
        r"optical equalizers? based on photonic integration|hybrid(?:ly)? integrated.{0,35}optical receivers?"),
    "primary_photonic": words(
        rf"avalanche photodiodes?|guardring[- ]free .{{0,35}}photodiodes?|lattice[- ]filter[- ]based|"
        rf"optical equalizers? based on photonic integration|{NUMBER}[- ](?:gb/s|gbps).{{0,45}}\bvcsel\b"),
    "rf_word": words("rf"),
    "rf_mode": words(r"rf|qpsk|qam|mimo|direct[- ]conversion|phased[- ]array|beamform\w*|antennas?|radar|ook|fsk|gfsk|gnss|bluetooth|ble"),
    "rf_explicit": words(
        r"rf|microwave[- ]photonic|millimeter[- ]wave|mm[- ]?wave|sub[- ]?thz|d[- ]band|g[- ]band|w[- ]band|j[- ]band|radar|antennas?|wireless|"
        r"cellular|bluetooth|gnss|rfid|local oscillators?|lo generators?|vco"),
    "strong_sensing": words(
        r"nirs|psychiatric|diagnostics?|biosensors?|nmr|field probes?|ultraso\w*|endoscopic|time[- ]of[- ]flight|tof|imaging|image sensors?|"
        r"sensor data receivers?|imagers?|medical implants?|biomedical|lidar|spectroscop\w*|neural recording|neural interface"),
    "rf_application": (
        r"(?i)\b(?:d[- ]band|g[- ]band|w[- ]band|millimeter[- ]wave|mm[- ]?wave|sub[- ]?thz|j[- ]band|(?:\d+[- ]?)?fsk|gfsk|(?:\d+[- ]?)?ask|"
        r"frequency[- ]shift[- ]keying|amplitude[- ]shift[- ]keying|gnss|bluetooth|ble|cellular|5g\s*nr|6g|802\.11\w*|rfid|bodyid|contactless|"
        r"beam[- ]?steer\w*|eirp|power amplifier|radar|antennas?|local oscillators?|lo generators?|harmonic[- ]current filters?|image[- ]rejection|"
        r"blocker rejection|full[- ]band interference[- ]rejection|software[- ]defined radio|microwave[- ]photonic|rf\s*[/ -]\s*lfm|rf signals?|"
        r"photonic rf links?|rf\s*/?\s*photonic links?)\b|\b(?:terahertz|thz).{0,35}(?:transmitters?|receivers?|transceivers?|communications?)\b"),
    "carrier_title": rf"(?i)\b{_RANGED_GHZ}\b.{{0,35}}(?:{_RF_SIGNS})|\b(?:{_RF_SIGNS}).{{0,35}}{_RANGED_GHZ}\b",
    "rf_bandwidth": rf"(?i)\b{GHZ}\s*(?:BW|bandwidth|clock)\b|\b(?:BW|bandwidth|clock|PLL|VCO)\b.{{0,15}}{GHZ}\b",
    "clock_context": rf"(?i)\b{GHZ}\b.{{0,45}}(?:{_CLOCK})|(?:{_CLOCK}).{{0,45}}\b{GHZ}\b",
    "rf_band": rf"(?i)\b{NUMBER}(?:\s*[-–]\s*{NUMBER})?\s*[-–]?\s*GHz[- ]band\b",
    "rf_ook": rf"(?i)\b{GHZ}\b.{{0,80}}\bOOK\b|\bOOK\b.{{0,80}}\b{GHZ}\b",
    "rf_power": rf"(?i)\b{NUMBER}(?:\s*[-–]\s*{NUMBER})?\s*[-–]?\s*GHz\b.{{0,70}}\b(?:P(?:sat|out)|EIRP)\b|\b(?:P(?:sat|out)|EIRP)\b.{{0,70}}\b{GHZ}\b",
    "memory_io": words(r"ddr\d*|gddr\d*|lpddr\d*|hbm\d*|e?dram|nand|memory interfaces?|memory links?"),
    "memory_block": words(
        r"phy|physical layer|transceivers?|trx|rx|tx|drivers?|equaliz\w*|(?:tsv|dq)?\s*i/?o(?: interfaces?| circuitry)?|memory interfaces?|"
        r"(?:hbm\d*|e?dram|ddr\d*|gddr\d*|lpddr\d*) interfaces?"),
    "memory_test": words(
        r"tests?|testing|testability|test methods?|testers?|ate|automatic test equipment|bridges?|built[- ]in self[- ]test|bist"),
    "whole_memory": words(rf"v[- ]?nand|nand flash memor(?:y|ies)|{NUMBER}\s*(?:Gb|Tb)\s+.{{0,28}}(?:nand|dram|memory)"),
    "method_review": (
        r"(?i)\b(?:review|survey|tutorial|overview|recent advances|modeling|analysis|performance of|sensitivity of|trade[- ]?offs?|"
        r"hardware[- ]in[- ]the[- ]loop|co[- ]simulation|framework|feasibility stud\w*|performance assessment|experimental assessment|"
        r"performance investigation|progress and trends|impact of|effect of|measurement techniques?|test methods?|design methodolog\w*|"
        r"design and simulation|post[- ]layout simulation|testing serdes|signal integrity, architecture, circuits, and packaging|mimo equaliz\w*|"
        r"polarization crosstalk cancellation|control schemes?|experimental demonstration|receiver modules?|ber measurements?|"
        r"dispersion (?:pre)?compensation|using .{0,45} architectures?)\b|^\s*reconfiguration in\b|"
        r"^\s*(?:the\s+)?design (?:techniques|considerations|methodolog\w*)\b"),
    "algorithm_study": words(r"(?:experimental|simulation) stud(?:y|ies)"),
    "algorithm_method": words(
        r"algorithm|theory|experiment|feasibility stud\w*|impact of|effect of|performance assessment|experimental assessment|"
        r"performance investigation|methods?|schemes?|techniques?|estimation|equalization of|fpga[- ]based|software[- ]defined|"
        r"(?:adaptive|blind|turbo|nonlinear|digital) equaliz\w*"),
    "parallel": words(r"parallel|source[- ]synchronous|aib[- ]compatible|aer links?|on[- ]chip bus(?:es)?"),
    "platform": words(
        r"soc|processor|microprocessor|accelerator|compute (?:chip|die)|ai (?:chip|processor|accelerator|engine)|gpu|cpu|server processor"),
    "nonlink_application": words(
        r"dvd|blu[- ]?ray|optical[- ]disk|pin electronics|adc drivers?|led drivers?|gate drivers?|quantum random number generators?|qrng|"
        r"pulsed laser drivers?|network[- ]on[- ]chip|noc|seti|reservoir computing|secure proximity|spatial optical modulators?|full hdtv|"
        r"data[- ]link layer|protocol logic|optically clocked.{0,30}samplers?"),
    "security": words(r"probing[- ]attack|attack detector|security monitor|secure scan|side[- ]channel detector|tamper detector"),
    "nonlink_die": words(
        r"die[- ]to[- ]die.{0,35}within[- ]die|within[- ]die.{0,35}die[- ]to[- ]die|die[- ]to[- ]die (?:variation|error|thermal|process)"),
    "phy": words("phy|physical layer"),
    "support_block": words(r"low[- ]dropout regulators?|ldo|dc[- ]dc converters?|buck converters?|voltage regulators?"),
    "transmission_demo": r"(?i)\btransmission\b.{0,55}\b(?:analog\s+)?(?:multiplexers?|mux)\b",
    "device_demo": words(r"transferred micro[- ]?leds?|external[- ]source link"),
    "shorthand": words(
        rf"{NUMBER}\s*GT/s|10GBASE[- ]?T|(?:10|25|40|50|100|200|400|800)\s*G(?:bE)?|(?:10|25|40|50|100|200|400|800)\s*Gbit Ethernet|"
        rf"{NUMBER}\s*(?:GB/s|TB/s|Tbit/s)"),
    "rate": rf"{NUMBER}\s*(?:-\s*)?(?:[TtGg]b(?i:/s|ps|it/s)|(?i:gbaud|gbd))",
    "energy": rf"(?i){NUMBER}\s*(?:-\s*)?[pf]j\s*/\s*(?:bit|b)|(?:^|[^A-Za-z0-9]){NUMBER}\s*(?:-\s*)?(?:[µμu]W|mW|W)\s*/\s*\(?\s*G(?:b(?:/s)?|bps|bit/s)\s*\)?",
}
# Terms of the whole text beside EVIDENCE; names of TITLE mean its patterns.
WHOLE = {
    "optical_anchor": TITLE["optical_anchor"], "rf_application": TITLE["rf_application"], "shorthand": TITLE["shorthand"], "rate": TITLE["rate"], "energy": TITLE["energy"],
    "measured": words(r"fabricated|prototype|measurement results?|measured|implemented in|electrical characterization|silicon[- ]proven|test chip"),
    "long_haul": words(rf"{NUMBER}\s*km|long[- ]haul|high[- ]split[- ]ratio pon|data[- ]center interconnect|dci|multicore multimode fiber|offline digital equaliz\w*"),
}
# What shows an integrated circuit, and words that make a size near them a process node, with their lengths.
IC_NAMES = r"bi[- ]?cmos|finfet|fd[- ]?soi|asic|eics?|electronic integrated circuits?"
IC_SHORT, IC_OPTICAL = words("ICs?"), words(r"(?:photonic|optical)\s+(?:integrated circuits?|ICs?)")
NODE_WORDS = (
    ("process", 7), ("processes", 9), ("technology", 10), ("node", 4), ("fabricated", 10), ("implemented", 11), ("bicmos", 6), ("bi[- ]cmos", 7), ("sige", 4),
    ("finfet", 6), ("fdsoi", 5), ("fd[- ]soi", 6), ("soi", 3), ("hbt", 3), ("inp", 3), ("gaas", 4))
#: 0.5 to 500 nm or 0.05 to 1 micrometre, with the sign before it.
NODE = (
    r"(?:^|[^.\w]|[^0-9]\.)(?:0*(?:0\.[5-9][0-9]*|[1-9][0-9]?(?:\.[0-9]+)?|[1-4][0-9][0-9](?:\.[0-9]+)?|500(?:\.0+)?)\s*nm|0\.(?:0[5-9]|[1-9])[0-9]*\s*[µμu]m)\b")
NODE_REACH = 36


def _ic() -> str:
    near = [("cmos", 4), *NODE_WORDS]
    sides = [rf"{NODE}.{{0,{NODE_REACH - n}}}\b(?:{w})\b|\b(?:{w})\b.{{0,{NODE_REACH - n - 1}}}{NODE}" for w, n in near]
    return rf"(?i)\b(?:m?cmos|{IC_NAMES})\b|{'|'.join(sides)}"


IC = _ic()


def bitmap(text: Column, patterns: Sequence[str]) -> Column:
    """A long with a bit for each of up to 63 patterns that ``text`` has; an empty pattern stands for an integrated circuit.

    Whole Arrow batches go through a linear-time matcher: a tenth of the time of the JVM's backtracking one on long texts.
    """

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        has = lambda of, pattern: np.asarray(pc.match_substring_regex(of, pattern), dtype=bool)

        def circuit() -> np.ndarray:
            # a CMOS that something is compatible with shows no circuit
            bare = pc.replace_substring_regex(texts, r"(?i)\b(m?)cmos[- ]compatible", r"\1c_")
            return has(bare, IC) | (has(texts, IC_SHORT) & ~has(texts, IC_OPTICAL))

        out = np.zeros(len(texts), dtype=np.int64)
        for i, pattern in enumerate(patterns):
            out |= (has(texts, pattern) if pattern else circuit()).astype(np.int64) << i
        return pa.array(out)

    return run(text)


def ic_evidence(text: Column) -> Column:
    """Whether a text names an integrated circuit or a process node; a wavelength alone is none."""
    return bitmap(text, [""]) == 1


#: The rules, by stages: each flag is a condition over the features (t_ title, c_ whole text) and flags of earlier stages.
RULES: list[dict[str, str]] = [
    {
        "metric": "c_rate OR c_energy OR c_shorthand",
        "rated": "t_rate OR t_shorthand",
        "efficient": "t_energy OR t_efficiency_evidence",
    },
    {
        "tia_link": "t_tia AND (rated OR t_tia_bandwidth OR (t_rf_bandwidth AND t_ic_evidence))",
        "principal": "t_endpoint OR t_cdr OR (t_equalizer AND rated)",
        "signalled": "rated OR t_electrical_signaling",
    },
    {
        "optical_name": "t_optical_anchor OR tia_link",
        "hardware": "principal AND (signalled OR t_ic_evidence)",
        "electronic": "c_ic_evidence OR efficient OR tia_link OR t_optical_driver OR t_cdr OR t_circuit_equalizer",
    },
    {
        "radio": """(t_rf_application AND NOT (optical_name AND NOT t_rf_explicit)) OR t_rf_band OR t_rf_ook OR t_rf_power
            OR (t_carrier_title AND NOT (t_rf_bandwidth OR t_clock_context OR optical_name))""",
        "cdr_hardware": """t_cdr AND (t_wireline OR t_direct_link OR t_cdr_anchor OR (t_cdr_circuit AND rated)
            OR (rated AND (t_ic_evidence OR t_electrical_signaling)))""",
        "direct_hardware": """(t_wireline AND hardware) OR (t_direct_link AND (signalled OR efficient) AND (NOT t_platform OR principal)
            AND (principal OR t_ic_evidence OR t_circuit_block OR t_direct_impl))""",
    },
    {"optical": "c_optical_anchor OR tia_link OR (t_coherent AND NOT radio AND NOT t_direct_link)"},
    {
        "optical_endpoint": """optical AND electronic
            AND (t_endpoint OR t_link_endpoint OR tia_link OR t_optical_driver OR t_cdr OR t_equalizer
              OR (c_link_endpoint AND (t_direct_link OR t_integrated_optical OR t_translator_words)))
            AND (metric OR t_ic_evidence OR t_direct_link OR t_monolithic OR t_integrated_optical OR tia_link OR t_optical_driver
              OR (c_ic_evidence AND (c_efficiency_evidence OR c_measured)))""",
        "optical_hardware": """optical AND t_optical_link AND (metric OR (t_direct_link AND (t_ic_evidence OR t_monolithic)))
            AND (c_ic_evidence OR efficient OR tia_link OR t_optical_driver)""",
        "memory_endpoint": """t_memory_io AND NOT t_memory_test AND (t_endpoint OR t_circuit_block OR t_phy OR t_memory_block)
            AND (signalled OR efficient OR (t_ic_evidence AND t_memory_block) OR (t_endpoint AND t_parallel))""",
        "parallel_endpoint": "t_parallel AND t_direct_link AND signalled",
        "enabling": """t_adjacent_block AND signalled AND (t_ic_evidence OR c_efficiency_evidence OR optical OR t_wireline OR t_direct_link)
            AND (NOT t_generic_block OR optical OR t_direct_link OR t_electrical_signaling OR (rated AND t_ic_evidence AND NOT t_nonlink_application))""",
        "optical_block": "optical AND (t_adjacent_block OR t_optical_driver) AND (t_ic_evidence OR rated)",
        "translator": "optical AND t_translator_words AND rated AND electronic",
        "electrical_endpoint": "t_endpoint AND NOT optical AND NOT t_memory_io AND signalled",
        "equalizer_hardware": """t_equalizer AND NOT optical AND NOT t_memory_io AND rated
            AND (c_ic_evidence OR t_ic_evidence OR t_electrical_signaling OR t_endpoint OR t_wireline OR t_direct_link OR t_circuit_equalizer)""",
        "measured": """c_measured AND c_rate AND c_ic_evidence AND NOT t_platform AND NOT t_memory_test
            AND (NOT t_device_physics OR t_endpoint OR t_adjacent_block OR t_ic_evidence OR tia_link OR t_optical_driver)
            AND (t_direct_link OR t_endpoint OR t_cdr OR t_equalizer OR t_adjacent_block OR t_optical_io)""",
        "study": "t_algorithm_study AND t_algorithm_system AND NOT (t_ic_evidence OR t_direct_link)",
        "transport_noise": "optical AND c_transport_experiment AND NOT electronic AND (c_algorithm_system OR c_long_haul)",
        "photonic_only": """(optical AND t_photonic_platform AND NOT electronic) OR (t_primary_photonic
            AND NOT (t_ic_evidence OR tia_link OR t_optical_driver OR (t_adjacent_block AND efficient) OR t_cdr OR t_circuit_equalizer))""",
        "wireless": "t_nonwireline_link OR (c_nonwireline_link AND NOT t_wireline)",
        "radio_link": """(radio OR (c_rf_application AND NOT t_direct_link) OR (NOT t_memory_io AND NOT t_direct_link AND (t_rf_mode OR (t_rf_word AND NOT optical))))
            AND (t_endpoint OR t_cdr OR t_circuit_block OR t_rf_ook) AND NOT t_wireline AND (NOT optical OR radio)""",
    },
    {
        "anchored": "t_direct_link OR t_memory_io OR cdr_hardware OR electrical_endpoint OR optical_endpoint",
        "optical_any": "optical_hardware OR translator OR optical_block",
        "passive_device": """optical AND (
            (t_strong_passive AND NOT (t_integrated_optical OR (t_endpoint AND t_ic_evidence AND rated)))
            OR (t_passive AND NOT (rated AND (t_direct_impl OR t_endpoint)))
            OR (t_device_physics AND NOT (t_endpoint OR t_adjacent_block OR t_ic_evidence OR t_integrated_optical OR optical_hardware OR t_translator_words
              OR ((t_direct_link OR t_optical_link) AND c_circuit_block AND metric))))""",
    },
    {
        "link_hardware": "direct_hardware OR electrical_endpoint OR equalizer_hardware OR memory_endpoint OR optical_any",
        "sensing": """t_strong_sensing OR (t_sensing_application AND NOT anchored)
            OR (c_sensing_application AND NOT (anchored OR t_wireline OR optical_hardware))""",
    },
    {
        "refused": """sensing OR wireless OR radio_link OR t_security OR t_nonlink_application OR t_nonlink_die OR t_whole_memory OR passive_device
            OR photonic_only OR transport_noise OR study OR (t_support_block AND NOT (t_wireline OR t_direct_link OR tia_link))""",
        "related": """link_hardware OR enabling OR optical_endpoint OR t_wireline OR t_direct_link OR t_cdr OR t_equalizer OR t_electrical_signaling
            OR (t_memory_io AND (t_review_article OR t_method_review OR t_memory_block))
            OR (optical AND (t_endpoint OR t_integrated_optical OR t_translator_words OR t_optical_link))""",
        "shown": """measured OR cdr_hardware OR parallel_endpoint OR enabling OR electrical_endpoint OR equalizer_hardware OR memory_endpoint OR optical_any
            OR (t_wireline AND hardware) OR (direct_hardware AND (principal OR t_ic_evidence OR t_circuit_block))
            OR (optical_endpoint AND (t_ic_evidence OR t_direct_link OR t_adjacent_block))""",
        "transport_only": """c_transport_experiment AND optical AND NOT (link_hardware OR parallel_endpoint OR enabling
            OR (optical_endpoint AND (t_ic_evidence OR t_optical_io OR t_direct_link OR t_adjacent_block)))""",
        "algorithm_only": "c_algorithm_system AND NOT (link_hardware OR parallel_endpoint OR optical_endpoint)",
    },
    {
        "method": """t_review_article OR t_method_review OR t_transmission_demo OR t_device_demo
            OR (related AND NOT shown AND (t_algorithm_method OR t_algorithm_system))
            OR (related AND c_algorithm_system AND NOT (shown OR hardware OR (optical_endpoint AND t_optical_io)))""",
    },
]
#: The ladder: the first condition that holds gives the class.
LADDER = (
    ("t_non_research OR refused", "out_of_scope"),
    ("method AND related", "needs_review"),
    ("method", "out_of_scope"),
    ("measured AND (optical OR t_memory_io OR t_parallel OR (enabling AND NOT (t_direct_link OR t_endpoint OR t_cdr OR t_equalizer)))", "adjacent"),
    ("measured", "core"),
    ("(transport_only OR algorithm_only) AND related", "needs_review"),
    ("optical_any OR optical_endpoint OR memory_endpoint OR parallel_endpoint", "adjacent"),
    ("direct_hardware OR cdr_hardware OR electrical_endpoint OR equalizer_hardware", "core"),
    ("enabling", "adjacent"),
    ("related", "needs_review"),
)
# Points of evidence, bands of classes, labels of reasons.
POINTS = (
    ("c_direct_serdes", 40), ("c_circuit_block", 18), ("c_link_endpoint", 8), ("c_electrical_signaling", 15), ("c_ic_evidence", 16), ("c_efficiency_evidence", 9),
    ("c_optical_io", 8), ("metric", 6), ("c_transport_experiment AND transport_only", -28), ("c_device_physics AND NOT c_circuit_block AND NOT c_ic_evidence", -22),
    ("c_algorithm_system AND algorithm_only", -14), ("refused", -55), ("t_non_research", -100))
BANDS = {"core": (75.0, 100.0), "adjacent": (50.0, 74.999), "needs_review": (25.0, 49.999), "out_of_scope": (0.0, 24.999)}
REASONS = (
    ("direct_serdes", "c_direct_serdes", "direct electrical SerDes terminology"),
    ("circuit_block", "c_circuit_block", "SerDes circuit block"),
    ("link_endpoint", "c_link_endpoint", "link transmitter/receiver endpoint"),
    ("electrical_signaling", "c_electrical_signaling", "PAM/NRZ signaling"),
    ("ic_evidence", "c_ic_evidence", "IC process or technology evidence"),
    ("efficiency_evidence", "c_efficiency_evidence", "power or energy evidence"),
    ("optical_io", "c_optical_io", "optical-I/O context"),
    ("transport_experiment", "c_transport_experiment", "optical transport experiment"),
    ("device_physics", "c_device_physics", "photonic device emphasis"),
    ("algorithm_system", "c_algorithm_system", "DSP/coding/system emphasis"),
    ("sensing_application", "c_sensing_application", "sensing/ranging application"),
    ("nonwireline_link", "c_nonwireline_link", "wireless/free-space link"),
    ("rf_carrier", "c_rf_carrier", "RF/mm-wave carrier-frequency circuit"),
    ("non_research", "c_non_research", "editorial/correction/front matter"),
    ("review_article", "c_review_article", "review/tutorial/design-method article"),
    ("rate_evidence", "c_rate", "reported data rate"),
    ("energy_evidence", "c_energy", "reported energy efficiency"),
    ("title_only", "abstract_text = ''", "abstract unavailable"),
    ("strong_direct_hardware", "direct_hardware", "explicit wireline/SerDes hardware evidence"),
    ("measured_implementation", "measured", "measured IC implementation evidence"),
    ("rate_or_energy_only", "metric AND NOT (c_direct_serdes OR c_circuit_block OR c_electrical_signaling OR c_ic_evidence)", "metric-only title match"),
)
NO_REASON = "no SerDes-specific evidence found"


def features(titles: DataFrame, title: str, abstract: str) -> DataFrame:
    """``titles`` with ``title_text``, ``abstract_text`` (plain) and one boolean per feature, read from three bitmaps."""
    plain = titles.select("*", plain_text(F.col(title)).alias("title_text"), plain_text(F.col(abstract)).alias("abstract_text"))
    whole = plain.withColumn("whole_text", F.trim(F.concat(F.col("title_text"), F.lit(". "), F.col("abstract_text"))))

    bits = {"_e": ("t", "title_text", EVIDENCE), "_t": ("t", "title_text", TITLE), "_c": ("c", "whole_text", EVIDENCE | WHOLE)}
    mapped = whole.select("*", *(bitmap(F.col(text), list(patterns.values())).alias(n) for n, (_, text, patterns) in bits.items()))
    flags = [(F.getbit(n, F.lit(i)) == 1).alias(f"{mark}_{name}") for n, (mark, _, patterns) in bits.items() for i, name in enumerate(patterns)]
    return mapped.select(*titles.columns, "title_text", "abstract_text", *flags)


def screened(papers: DataFrame, ident: str, title: str, abstract: str) -> DataFrame:
    """Rows ``ident, relevance_class, relevance_score, evidence_score, include_in_survey, reason_codes, rationale, screening_source``.

    One narrow pass without a shuffle: features become columns, each stage of RULES is a projection over the one before, so
    a flag that several rules use is computed once, and the ladder is one CASE. Null titles and abstracts are empty.
    """
    rows = features(papers.select(F.col(ident), F.col(title).alias("_title"), F.col(abstract).alias("_abstract")), "_title", "_abstract")
    for stage in RULES:
        rows = rows.select("*", *(F.expr(rule).alias(name) for name, rule in stage.items()))
    ladder = F
    for rule, label in LADDER:
        ladder = ladder.when(F.expr(rule), label)
    raw = sum((F.when(F.expr(rule), points).otherwise(0) for rule, points in POINTS), F.lit(0))
    raw = F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw.cast("double")))
    codes = F.filter(F.array(*(F.when(F.expr(rule), F.lit(code)) for code, rule, _ in REASONS)), lambda c: c.isNotNull())
    graded = rows.select(ident, ladder.otherwise("out_of_scope").alias("relevance_class"), raw.alias("evidence_score"), codes.alias("reason_codes"), "abstract_text")
    score = F
    for label, (low, high) in BANDS.items():
        score = score.when(F.col("relevance_class") == label, low + (high - low) * (F.col("evidence_score") / 100.0))
    labels = F.create_map(*(F.lit(x) for code, _, text in REASONS for x in (code, text)))
    said = F.array_join(F.transform("reason_codes", lambda c: labels[c]), "; ")
    return graded.select(
        ident, "relevance_class", F.round(score, 3).alias("relevance_score"), F.round("evidence_score", 3).alias("evidence_score"),
        F.col("relevance_class").isin("core", "adjacent").alias("include_in_survey"), "reason_codes",
        F.when(F.size("reason_codes") == 0, NO_REASON).otherwise(said).alias("rationale"),
        F.when(F.col("abstract_text") == "", "title_only").otherwise("title_abstract").alias("screening_source"))
