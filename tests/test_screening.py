"""The screening ladder and the classifiers of medium and energy scope on titles whose answers are known."""

import pytest
from pyspark.sql import functions as F

from foliant.functions.plain import plain_text
from foliant.operators import media, screening

# Titles of papers and the class each must get from its title alone.
GOLD = {
    "core": [
        "A 56 Gb/s/wire, 0.75 pJ/b Transceiver for Die-to-Die Interface Using Simultaneous Bi-Directional Signaling",
        "A 4nm 32Gb/s 8Tb/s/mm Die-to-Die Chiplet Using NRZ Single-Ended Transceiver With Equalization Schemes And Training Techniques",
        "10Gb/s serial I/O receiver based on variable reference ADC",
        "A 112Gb/s DAC-Based PAM-4 Transmitter with Fast Automatic Retiming Clock Phase Optimization and 6-Tap FFE in 28nm CMOS",
        "A Reference-Less Single-Loop Half-Rate Binary CDR",
        "A Dual-Loop Clock and Data Recovery Circuit With Compact Quarter-Rate CMOS Linear Phase Detector",
        "A Decision Feed-Forward Equalizer with Error Detection and Correction for 200-400Gbps Wireline Applications",
        "A 0.29pJ/b 5.27Tb/s/mm UCIe Advanced Package Link in 3nm FinFET with 2.5D CoWoS Packaging",
        "9.3 NVLink-C2C: A Coherent Off Package Chip-to-Chip Interconnect with 40Gbps/pin Single-ended Signaling",
        "A 40Gb/s decision feedback equalizer using back-gate feedback technique",
        "A 5–8 Gb/s low-power transmitter with 2-tap pre-emphasis based on toggling serialization",
        "A single-40Gb/s dual-20Gb/s serializer IC with SFI-5.2 interface in 65nm CMOS",
    ],
    "adjacent": [
        "A 23-mW 30-Gb/s digitally programmable limiting amplifier for 100GbE optical receivers",
        "A 150-Gb/s PAM-4 Wideband Amplifier With Compact Footprint in 40-nm CMOS",
        r"A 3-nm FinFET CMOS PAM-4 Retimer for $\mathbf{8 0 0 - Gb} / \mathbf{s}$ and $\mathbf{1. 6 - T b} / \mathbf{s}$ Optical Modules",
        "A 100-Gb/s Burst-Mode Optical Receiver With 9-Tap Pipelined FFE and Amplitude/Phase Adaptation in 28-nm CMOS",
        "An 18.4Gb/s/pin Simultaneous Bidirectional Transceiver for Post HBM4 Using 4-Phase Hybrid Timing Alignment and Dual Equalization in 1b-nm DRAM Technology",
        "A 15 Gb/s Non-Return-to-Zero Transmitter With 1-Tap Pre-Emphasis Feed-Forward Equalizer for Low-Power Ground Terminated Memory Interfaces",
        "A 0.58-pJ/bit 56-Gb/s PAM-4 Optical Receiver Frontend with an Envelope Tracker for Co-Packaged Optics in 40-nm CMOS",
        "A 6.4Gb/s/pin HBM3 Digital PHY with Low-Power, Area-Efficient Techniques for Chiplet-Based AI processors in 12-nm CMOS",
        "A 120 GBd 2.8 Vpp Low-Power Differential Driver for InP Mach-Zehnder Modulator Using 55-nm SiGe HBTs",
        "Demonstration of Error-Free 32-Gb/s Operation From Monolithic CMOS Nanophotonic Transmitters",
        "A 10Gb/s photonic modulator and WDM MUX/DEMUX integrated with electronics in 0.13um SOI CMOS",
        "A 48GHz BW 225mW/ch Linear Driver IC in 130nm SiGe BiCMOS for Beyond-400Gb/s Coherent Optical Transmitters",
        "A Monolithically-Integrated Chip-to-Chip Optical Link in Bulk CMOS",
        "A 50-Gbaud Linear Burst-Mode Trans-Impedance Amplifier in 28 nm CMOS Technology",
        "A 36 GHz Bandwidth Driver Modulator in 28 nm CMOS",
        "A 4-nm 1.15 TB/s HBM3 Interface With Resistor-Tuned Offset Calibration",
        "A 10-GHz Bandwidth Transimpedance Amplifier With Input DC Photocurrent Compensation Loop",
        "A 32Gb/s On-chip Bus with Driver Pre-emphasis Signaling",
        "A 10Gb/s 342fJ/bit Micro-Ring Modulator Transmitter With a Temperature Sensor in 65nm CMOS",
    ],
    "needs_review": [
        "Design Techniques for Single-Ended Wireline Crosstalk Cancellation Receiver Up To 112 Gb/s",
        "Equalizer Design and Performance Trade-Offs in ADC-Based Serial Links",
        "Recurrent Neural Network Equalization for Wireline Communication Systems",
        "Fixed-Point Implementation Analysis of MLSE Receiver DSP for High-Speed Wireline Transceivers",
        "A Continuous-Time Linear Equalizer With Ultrafine Gain Adjustment Achieving 0.3-dB DC-Gain Step and 0.9-dB Peaking-Gain Step",
        "The Design Techniques for High-Speed PAM4 Clock and Data Recovery",
        "Critical-Timing-Relaxed pre-Decision Feedforward Equalizer for High-Speed DSP-based Wireline Receiver using Hardware-in-the-Loop Verification on RF-SoC",
        "Analysis of UCIe 48/64-GT/s Electrical Links",
        "A Lightweight 3D D2D Interface for Active Interposer Chiplet Systems",
        "An Efficient Error Control Scheme for Chip-to-Chip Optical Interconnects",
        "Progress and trends in multi-Gbps optical receivers with CMOS integrated photodetectors",
        "Far-End Crosstalk Cancellation With MIMO OFDM for >200 Gb/s ADC-Based Serial Links",
        "Packaged Monolithic Silicon 112-Gb/s Coherent Receiver",
        "160-GBd (320-Gb/s) PAM4 Transmission Using 97-GHz Bandwidth Analog Multiplexer",
        "Testing SerDes beyond 4 Gbps - changing priorities",
        "Design of 224Gb/s DSP-Based Transceiver in CMOS Technology: Signal Integrity, Architecture, Circuits, and Packaging",
    ],
    "out_of_scope": [
        "A Fully Integrated 60 GHz 10 Gb/s QPSK Transceiver with Digital Transmitter and T/R Switch in 65nm CMOS",
        "A 37-43.5-GHz Fully Integrated 16-Element Phased-Array Transceiver With 64-QAM 7.2-Gb/s Data Rates Supporting Dual-Polarized MIMO",
        "A 125 um-Pitch-Matched Transceiver ASIC With Micro-Beamforming ADC and Multi-Level Signaling for 3-D Transfontanelle Ultrasonography",
        "A Design-Oriented Soft Error Rate Variation Model Accounting for Both Die-to-Die and Within-Die Variations in Submicrometer CMOS SRAM Cells",
        "A 65nm 8GHz E-PPWM/FSK IR-UWB Transceiver Achieving 2.4Gb/s Data Rate and 8.6pJ/b Energy Efficiency",
        r"A 640-Gb/s $4\times 4$-MIMO D-Band CMOS Transceiver Chipset",
        "Editorial Special section on High-Performance Wireline Transceiver Circuits",
        "A 32-Gb/s CMOS Receiver With Analog Carrier Recovery and Synchronous QPSK Demodulation",
        "Secure Scan Architecture Using Clock and Data Recovery Technique",
        "Experimental Study of MLSE Receivers in the Presence of Narrowband Optical Filtering",
        "30-39GHz 2Gbit/s ring oscillator based OOK-modulator for chip-to-chip communications",
        "A 0.13um CMOS SoC for all-format blue and red laser DVD front-end digital signal processor",
        "Correction on ‘A 5-Gb/s/pin Transceiver With a Source-Synchronous Interface’",
        "Silver Stripe Optical Waveguide for Chip-to-Chip Optical Interconnections",
        "160-Gb/s optical clock recovery using a regeneratively mode-locked laser diode",
        "A 2 Gb/s 5.6 mW Digital LOS/NLOS Equalizer for the 60 GHz Band",
        "A 9 Gb/s 1.1 Vpp Precision Single-Ended Pin Electronics Driver in 40nm CMOS",
        "160-Gb/s Polarization-Insensitive Demultiplexer Based on a Fiber-Optical Parametric Amplifier",
        "CMOS-Compatible and Temperature Insensitive C-Band Wavelength (De-)multiplexer",
        "A 3.9ns 8.9mW 4x4 silicon photonic switch hybrid integrated with CMOS driver",
        "A Monolithically Integrated ACP-OPLL Receiver for RF/Photonic Links",
        "A 128Gb 3b/cell V-NAND flash memory with 1Gb/s I/O rate",
        "A 0.93 ps-ToF-Resolution NIRS IC for Psychiatric Disorders Diagnostics",
        "A CMOS Imager and Light-Pulse Receiver Array for Spatial Optical Communication",
        "A 60GHz TIA in a Current-Reuse LO Generator With a Harmonic VCO",
    ],
}
# Title, abstract, class and a reason that must be among its reasons.
WITH_ABSTRACT = [
    ("A 112-Gb/s PAM-4 SerDes Receiver in 7-nm CMOS", "The wireline receiver achieves 1.2 pJ/bit over a 28-dB channel.", "core", "direct_serdes"),
    ("A 100-Gb/s VCSEL Transmitter With a Low-Power Driver", "The optical-I/O endpoint reports high-speed operation.", "adjacent", "optical_io"),
    ("1-Tb/s Coherent WDM Transmission Over 80-km Fiber", "A long-haul optical transport experiment is demonstrated.", "out_of_scope", "transport_experiment"),
    ("A 300-GHz Band Sliding-IF I/Q Receiver Front-End in 130-nm SiGe Technology", "The receiver targets a sub-THz wireless link.", "out_of_scope", "rf_carrier"),
    ("A 4x4 Biosensor Array With a Low-Power Current-Sensitive Front-End", "The integrated CMOS biosensor measures molecular concentration.", "out_of_scope", "sensing_application"),
    ("Design Techniques for CMOS Wireline NRZ Receivers Up To 56 Gb/s", "This tutorial reviews energy-efficient receiver design methods.", "needs_review", "review_article"),
    ("A 5.2 Gb/s 4.7 pJ/bit Capacitively-Coupled Transceiver With CDR", "A contactless transceiver communicates across a 3 mm air gap.", "out_of_scope", "circuit_block"),
    ("DC-Coupled Stacked-Differential Optical Receiver for IM-DD", "Fabricated in a standard 180-nm CMOS process, the receiver consumes 89.1 mW.", "adjacent", "ic_evidence"),
    ("94-Gb/s 4-PAM Using an 850-nm VCSEL and Receiver Equalization", "Transmission over multimode fiber uses an offline digital equalizer.", "out_of_scope", "rate_evidence"),
    ("Guardring-Free Planar AlInAs Avalanche Photodiodes for 2.5-Gb/s Receivers", "The external receiver also contains a SiGe TIA.", "out_of_scope", "optical_io"),
]


def test_known_titles_get_their_class(spark):
    rows = [(t, None, c) for c, titles in GOLD.items() for t in titles] + [(t, a, c) for t, a, c, _ in WITH_ABSTRACT]
    df = spark.createDataFrame(rows, "title string, abstract string, wanted string")
    found = {r["title"]: r for r in screening.screened(df, "title", "title", "abstract").collect()}
    wrong = {t: (c, found[t]["relevance_class"]) for t, _, c in rows if found[t]["relevance_class"] != c}
    assert not wrong
    for title, _, label, reason in WITH_ABSTRACT:
        assert reason in found[title]["reason_codes"] and found[title]["include_in_survey"] == (label in ("core", "adjacent"))
    low, high = zip(*(screening.BANDS[c] for c in ("out_of_scope", "needs_review", "adjacent", "core")))
    assert list(low) == sorted(low) and all(a < b for a, b in zip(high, low[1:]))
    for r in found.values():
        a, b = screening.BANDS[r["relevance_class"]]
        assert a <= r["relevance_score"] <= b


def test_odd_titles(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "x " * 20000, "SerDes " * 20000), (4, "SerDes", None), (4, "SerDes", None)], "id int, title string, abstract string")
    found = screening.screened(df.withColumn("metric", F.lit(1)), "id", "title", "abstract").collect()
    assert len(found) == 5
    none = [r for r in found if r["id"] < 3]
    assert all(r["relevance_class"] == "out_of_scope" and r["reason_codes"] == ["title_only"] and r["rationale"] == "abstract unavailable" for r in none)
    assert screening.screened(df.limit(0), "id", "title", "abstract").count() == 0


@pytest.mark.parametrize("text, wanted", [
    ("in 28-nm CMOS", True), ("a 28 nm process", True), ("850 nm VCSEL", False), ("fabricated at 850 nm", False), ("0.13um SOI", True), ("photonic ICs", False),
    ("driver IC", True), ("CMOS-compatible filter", False), ("600 nm process", False), ("0.4 nm node", False), ("a node" + " " * 40 + "28 nm", False), ("BiCMOS-compatible", True)])
def test_integrated_circuits(spark, text, wanted):
    assert spark.range(1).select(screening.ic_evidence(F.lit(text)).alias("x")).first()["x"] is wanted


def test_plain_text(spark):
    cases = {
        "36 $\\mu$W": "36 µW", "ＰＡＭ４ &amp; CDR": "PAM4 & CDR", "a<b>c</b>  d\n e": "a c d e", "\\mathbf{8 0 0 - Gb} / \\mathbf{s}": "8 0 0 - Gb / s",
        "4\\times 4": "4× 4", "5 mW–5": "5 mW-5", None: "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, b string")
    for r in df.select("b", plain_text(F.col("a")).alias("x")).collect():
        assert r["x"] == r["b"]


# Title, abstract, measured classes, screening class, medium, source, first reason.
MEDIA = [
    ("A 56-Gb/s Optical Receiver in 28-nm CMOS", None, None, None, "optical", "title", "explicit_optical_title"),
    ("An Electrical IC for a 3-D Integrated Silicon Photonic Transmitter", None, None, None, "optical", "title", "explicit_optical_title"),
    ("A 56-Gb/s De-serializer With PAM-4 CDR for Chiplet Optical-I/O", None, None, None, "optical", "title", "explicit_optical_title"),
    ("A 225-mW SerDes for 100GBASE-LR4 Optical Transport", None, None, None, "optical", "title", "explicit_optical_title"),
    ("A 112-Gb/s PAM-4 SerDes Receiver in 7-nm CMOS", None, None, None, "electrical", "title", "serdes_electrical_default"),
    ("A 0.29-pJ/b UCIe Advanced Package Link", None, None, None, "electrical", "title", "explicit_electrical_title"),
    ("NVLink-C2C: A Coherent Off-Package Chip-to-Chip Interconnect", None, None, None, "electrical", "title", "explicit_electrical_title"),
    ("A Receiver Tested Over a 30-dB PCB Channel", None, None, None, "electrical", "title", "explicit_electrical_title"),
    ("A Generic 56-Gb/s PAM-4 Receiver", "This receiver targets a short-reach optical link and is fabricated in CMOS.", None, None, "optical", "abstract", "optical_implementation_abstract"),
    ("A Receiver", "Links are common. We present a backplane design.", None, None, "electrical", "abstract", "electrical_implementation_abstract"),
    ("A Receiver", "We present a backplane and optical design.", None, None, "unspecified", "abstract", "explicit_mixed_abstract"),
    ("A 150-Gb/s PAM-4 Wideband Amplifier in 40-nm CMOS", "Optical links are common in datacenters. The amplifier has 45-GHz bandwidth.", None, None, "unspecified", "none", "insufficient_medium_evidence"),
    ("A Demultiplexer for Wireline and Optical Receivers", None, None, None, "unspecified", "title", "explicit_mixed_title"),
    ("Serial Links Over Backplane and Multimode Fiber", None, None, None, "unspecified", "title", "explicit_mixed_title"),
    ("PAM-8 Electrical and PAM-4 VCSEL-Based Transmission", None, None, None, "unspecified", "title", "explicit_mixed_title"),
    ("A Receiver", None, ["optical"], None, "optical", "measurement", "measurement_optical"),
    ("An Interface", None, ["memory"], None, "electrical", "measurement", "measurement_electrical_topology"),
    ("An Interface", None, ["memory", " Optical", None], None, "unspecified", "measurement", "mixed_measurement_classes"),
    ("A Reference-Less Single-Loop Half-Rate Binary CDR", None, None, "core", "electrical", "screening", "core_serdes_electrical_default"),
    ("A Reference-Less Single-Loop Half-Rate Binary CDR", None, None, "adjacent", "unspecified", "none", "insufficient_medium_evidence"),
    ("A 25-Gb/s Burst-Mode CDR in 65-nm CMOS", None, None, "core", "unspecified", "screening", "core_optical_boundary"),
    (None, None, None, None, "unspecified", "none", "insufficient_medium_evidence"),
]
# Title, evidence, stored scope, scope, source, first reason.
SCOPES = [
    ("A 112-Gb/s Transceiver", ["The receiver consumes 40 mW and achieves 0.36 pJ/bit."], "tx_rx", "rx", "evidence", "metric_attributed_rx"),
    ("A Transceiver", ["The transmitter dissipates 40 mW."], None, "tx", "evidence", "metric_attributed_tx"),
    ("A Link", ["Nothing here.", "Full-link energy is 2 pJ/bit."], None, "full_link", "evidence", "explicit_full_link"),
    ("A Link", ["The VCSEL driver consumes 40 mW."], None, "driver_only", "evidence", "metric_attributed_driver"),
    ("A 56-Gb/s VCSEL Driver in 28-nm CMOS", None, None, "driver_only", "title", "explicit_driver_only"),
    ("A 112-Gb/s PAM-4 Transceiver in 7-nm CMOS", None, None, "trx", "title", "explicit_transceiver"),
    ("A 1.2-pJ/bit End-to-End Full-Link SerDes", None, None, "full_link", "title", "explicit_full_link"),
    ("A 64-Gb/s Serializer With 4-Tap FFE", None, None, "tx", "title", "explicit_tx"),
    ("A 56-Gb/s CDR With DFE", None, None, "unknown", "title", "receiver_subblock_only"),
    ("A 56-Gb/s Receiver", None, None, "rx", "title", "explicit_rx"),
    ("A TX With an RX", None, None, "trx", "title", "tx_rx_primary_cooccurrence"),
    ("An SST Driver With a CDR", None, None, "trx", "title", "tx_rx_cooccurrence"),
    ("A 3.8-mW/Gb/s Quad-Channel Serial Link With a 5-Tap DFE and a 4-Tap Transmit FFE", None, None, "full_link", "title", "system_link_head"),
    ("A 28-Gb/s Multi-Standard SerDes With a 14-Tap DFE", None, None, "trx", "title", "system_transceiver_head"),
    ("A 112-Gb/s Transceiver With an Analog Front-End", None, None, "trx", "title", "explicit_transceiver"),
    ("An Optical Transceiver With a VCSEL Driver", ["The VCSEL driver in the transceiver consumes 40 mW."], None, "trx", "evidence", "metric_attributed_transceiver"),
    ("A 2.29-pJ/b 112-Gb/s Wireline Transceiver With RX 4-Tap FFE", ["The RX analog FFE compensates 20.8-dB loss at a power efficiency of 2.29 pJ/b."], "tx_rx", "trx", "title", "explicit_transceiver"),
    ("A 224-Gb/s PAM-4 Transceiver", ["The optimized analog power efficiency is 2.2 pJ/bit."], "tx_rx", "unknown", "evidence", "partial_scope_exclusion"),
    ("A Wideband Amplifier", ["Energy efficiency is 0.8 pJ/bit."], "unknown", "unknown", "none", "insufficient_scope_evidence"),
    ("A Wideband Amplifier", [None], "TX_RX", "trx", "measurement", "stored_component_scope"),
    (None, None, None, "unknown", "none", "insufficient_scope_evidence"),
]


def test_link_media(spark):
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(MEDIA)], "i int, title string, abstract string, classes array<string>, screening string, v string, s string, r string")
    found = df.select("*", media.link_medium(plain_text(F.col("title")), plain_text(F.col("abstract")), F.col("classes"), F.col("screening")).alias("m")).collect()
    assert [(r["i"], r["m"]["value"], r["m"]["source"], r["m"]["reasons"][0]) for r in found] == [(r["i"], r["v"], r["s"], r["r"]) for r in found]
    assert found[8]["m"]["evidence"].startswith("This receiver targets")


def test_energy_scopes(spark):
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(SCOPES)], "i int, title string, evidence array<string>, stored string, v string, s string, r string")
    found = df.select("*", media.energy_scope(plain_text(F.col("title")), F.col("evidence"), F.col("stored")).alias("m")).collect()
    assert [(r["i"], r["m"]["value"], r["m"]["source"], r["m"]["reasons"][0]) for r in found] == [(r["i"], r["v"], r["s"], r["r"]) for r in found]
