"""Technical concepts grounded in sentences, and the retrieval of titles that a favourite's abstract, not its title, leads to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import CONCEPTS, DASHES, technical_terms
from ..sources.tables import cut
from .text import term_weights, title_identity

# Concepts beside those that titles are compared by, with all their spellings.
MORE_CONCEPTS = {
    "ctle": r"continuous[ -]+time[ -]+linear[ -]+equaliz(?:er|ation|ers)|ctle",
    "input-referred noise": r"input[ -]+referred[ -]+noise",
    "inductive peaking": r"(?:shunt[ -]+|series[ -]+)?inductive[ -]+peaking",
    "shunt peaking": r"shunt[ -]+peaking",
    "bandwidth extension": r"bandwidth[ -]+(?:extension|enhancement)",
    "offset cancellation": r"(?:dc[ -]+)?offset[ -]+(?:cancellation|compensation|calibration)",
    "common-mode feedback": r"common[ -]+mode[ -]+feedback|cmfb",
    "negative capacitance": r"negative[ -]+capacitance",
    "regulated cascode": r"regulated[ -]+cascode",
    "avalanche photodiode": r"avalanche[ -]+photodiodes?|apd",
    "photodiode": r"photo[ -]?diodes?",
    "vcsel": r"vertical[ -]+cavity[ -]+surface[ -]+emitting[ -]+lasers?|vcsel",
    "mach-zehnder modulator": r"mach[ -]+zehnder[ -]+modulators?|mzm",
    "burst-mode": r"burst[ -]+mode",
    "optical coupling": r"(?:grating|optical)[ -]+coupl(?:er|ers|ing)",
    "silicon photonics": r"silicon[ -]+photonic(?:s)?",
    "injection locking": r"injection[ -]+lock(?:ed|ing)",
    "bang-bang": r"bang[ -]+bang",
    "phase interpolator": r"phase[ -]+interpolat(?:or|ors|ion)",
    "phase detector": r"phase[ -]+detectors?",
    "time-to-digital converter": r"time[ -]+to[ -]+digital[ -]+conver(?:ter|ters|sion)|tdc",
    "digitally controlled oscillator": r"digitally[ -]+controlled[ -]+oscillators?|dco",
    "voltage controlled oscillator": r"voltage[ -]+controlled[ -]+oscillators?|vco",
    "ring oscillator": r"ring[ -]+oscillators?",
    "lc oscillator": r"lc[ -]+oscillators?",
    "fractional-n": r"fractional[ -]+n",
    "sub-sampling": r"sub[ -]?sampling",
    "clock forwarding": r"forwarded[ -]+clock|clock[ -]+forward(?:ed|ing)",
    "source synchronous": r"source[ -]+synchronous",
    "duty-cycle correction": r"duty[ -]+cycle[ -]+(?:correction|corrector)",
    "jitter tolerance": r"jitter[ -]+tolerance",
    "jitter cancellation": r"jitter[ -]+(?:cancellation|compensation)",
    "pre-emphasis": r"pre[ -]?emphasis",
    "de-emphasis": r"de[ -]?emphasis",
    "crosstalk cancellation": r"cross[ -]?talk[ -]+(?:cancellation|compensation)",
    "impedance matching": r"impedance[ -]+match(?:ed|ing)",
    "termination calibration": r"termination[ -]+calibration",
    "time-interleaved": r"time[ -]+interleav(?:ed|ing)",
    "successive approximation": r"successive[ -]+approximation|sar[ -]+adc",
    "delta-sigma": r"(?:delta[ -]+sigma|sigma[ -]+delta)",
    "analog-to-digital converter": r"analog[ -]+to[ -]+digital[ -]+conver(?:ter|ters|sion)|adc",
    "digital-to-analog converter": r"digital[ -]+to[ -]+analog[ -]+conver(?:ter|ters|sion)|dac",
    "sample-and-hold": r"(?:sample|track)[ -]+and[ -]+hold",
    "sense amplifier": r"sense[ -]+amplifiers?",
    "low-noise amplifier": r"low[ -]+noise[ -]+amplifiers?|lna",
    "power amplifier": r"power[ -]+amplifiers?",
    "low-dropout regulator": r"low[ -]+dropout[ -]+regulators?|ldo",
    "dc-dc converter": r"dc[ -]+dc[ -]+converters?",
    "switched capacitor": r"switched[ -]+capacitors?",
    "charge pump": r"charge[ -]+pumps?",
    "capacitive coupling": r"capacitiv(?:e|ely)[ -]+coupl(?:ed|ing)",
    "inductive coupling": r"inductiv(?:e|ely)[ -]+coupl(?:ed|ing)",
    "through-silicon via": r"through[ -]+silicon[ -]+vias?|tsv",
    "electrostatic discharge": r"electrostatic[ -]+discharge|esd",
}
# Fields that a title belongs to, words of absence and of comparison.
DOMAINS = {
    "optical": r"\b(?:optical|photonic\w*|photodiodes?|fiber|fibre|vcsel|wdm|microring|tia|transimpedance)\b",
    "wireline": r"\b(?:wireline|serdes|backplane|interconnect\w*|pam[ -]?[2348]|nrz|die[ -]to[ -]die|d2d|serial link|memory interface)\b",
    "clock": r"\b(?:clock|pll|cdr|oscillator\w*|phase[ -]locked|jitter)\b",
    "memory": r"\b(?:memory|hbm|gddr\d*|lpddr\d*|ddr\d*)\b",
    "converter": r"\b(?:adc|dac|analog[ -]to[ -]digital|digital[ -]to[ -]analog)\b",
    "rf": r"\b(?:rf|radio[ -]frequency|millimeter[ -]wave|mm[ -]wave|radar|wireless)\b",
}
ABSENT = re.compile(r"\b(?:without|no|eliminat\w*|avoid\w*|free of)\b[^,;:.]*$")
BACKGROUND = re.compile(r"\b(?:previous|prior|conventional|unlike|compared|comparison|versus)\b")
DISCHARGE = re.compile(r"\b(?:esd|electrostatic|human[ -]+body|\d+(?:\.\d+)?[ -]*kv|\d{3,}[ -]*v)\b")
BODY_MODEL = re.compile(r"\b(?:esd|electrostatic|human[ -]+body)\b")
#: Signs before a concept in which a word of absence undoes it.
REACH = 45
SPELLINGS = CONCEPTS | MORE_CONCEPTS
NAMES = tuple(SPELLINGS)
ANY_CONCEPT = re.compile(r"\b(?:" + "|".join(f"(?P<c{i}>{p})" for i, p in enumerate(SPELLINGS.values())) + r")\b")
FOUND = "concepts array<struct<name:string,phrase:string>>, domains array<string>"


def lowered(text: str | None) -> str:
    import html
    import unicodedata

    return re.sub(DASHES, "-", unicodedata.normalize("NFKC", html.unescape(text or "")).casefold())


def concepts_in(text: str, is_abstract: bool) -> dict[str, str]:
    """Concepts of a lowered text and the phrase of each; absent ones are none, nor are those of sentences about other work in abstracts."""
    found, discharge = {}, DISCHARGE.search(text)
    for sentence in re.split(r"[.!?;\n]", text):
        if is_abstract and BACKGROUND.search(sentence):
            continue
        for m in ANY_CONCEPT.finditer(sentence):
            name = NAMES[int(m.lastgroup[1:])]
            body_model = name == "hbm" and m[0] == "hbm" and discharge
            absent = ABSENT.search(sentence[max(0, m.start() - REACH) : m.start()]) or re.match(r"[ -]+free\b", sentence[m.end() :])
            if not body_model and not absent:
                found[name] = m[0]
    return found


def domains_of(text: str) -> set[str]:
    text = re.sub(r"\bhbm\b", "", text) if BODY_MODEL.search(text) else text
    return {name for name, pattern in DOMAINS.items() if re.search(pattern, text)}


def concepts(text: Column, is_abstract: bool = False) -> Column:
    """A struct of ``concepts`` (name, phrase), by name, and ``domains`` of a text; null is an empty text."""

    @F.arrow_udf(FOUND)
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("concepts", pa.list_(pa.struct([("name", pa.string()), ("phrase", pa.string())]))), ("domains", pa.list_(pa.string()))])
        out = []
        for t in map(lowered, texts.to_pylist()):
            out.append({"concepts": [{"name": n, "phrase": p} for n, p in sorted(concepts_in(t, is_abstract).items())], "domains": sorted(domains_of(t))})
        return pa.array(out, kind)

    return run(text)


EXTRA, NEAREST, EXTRA_WEIGHT, FLOOR, LEXICAL, MOST = 8, 8, 0.55, 0.18, 0.65, 1500
#: Titles and seeds of one task's group, and seeds that are compared with its titles at a time.
TITLES, SEEDS, AT_ONCE = 8192, 4096, 128
#: Decimals of scores that rank; what lies below is how a sum was rounded.
PLACES = 12
FIELDS = tuple(DOMAINS)


def _flags(lists: Iterable, names: tuple[str, ...], dtype: type = np.float64) -> np.ndarray:
    """A row for each list: which of ``names`` it holds."""
    place = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(lists), len(names)), dtype=dtype)
    for row, items in zip(out, lists):
        row[[place[n] for n in items]] = 1
    return out


def _near(a: tuple, b: tuple) -> bool:
    """What ``near_titles`` says of two identities (letters, part marks, numbers)."""
    size, least = len(a[0]) + len(b[0]), 0.94 - 1e-9
    if a[1:] != b[1:] or 2 * min(len(a[0]), len(b[0])) < least * size:
        return False
    if a[0] == b[0]:
        return True
    return 2 * (Counter(a[0]) & Counter(b[0])).total() >= least * size and SequenceMatcher(None, a[0], b[0], autojunk=False).ratio() >= 0.94


def _nearest(known: dict[str, float]):
    """Compare a block of seeds with a block of titles: each seed's NEAREST ones that may stand in its queue, whatever other blocks hold."""

    def run(seeds: pd.DataFrame, titles: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("seed", "id", "score", "added", "anchors", "context")}
        if not len(seeds) or not len(titles):
            return pd.DataFrame(out, dtype=object)
        square = np.array([known.get(n, 1.0) ** 2 for n in NAMES])
        held, fields = _flags(titles["names"], NAMES), _flags(titles["domains"], FIELDS)
        held_length = np.sqrt(held @ square)
        ids, length, names = titles["id"].to_numpy(), titles["length"].to_numpy(), titles["title"].to_list()
        identities = list(zip(titles["t"], titles["part"], titles["numbers"]))
        at = np.repeat(np.arange(len(titles)), titles["terms"].map(len))
        codes, _ = pd.factorize(np.concatenate([*seeds["terms"], *titles["terms"], np.zeros(0, dtype=object)]))
        own_codes, codes = codes[: len(codes) - len(at)], codes[len(codes) - len(at) :]
        own_at = np.repeat(np.arange(len(seeds)), seeds["terms"].map(len))
        own_weights, weights = (np.concatenate([*x["weights"], np.zeros(0)]) for x in (seeds, titles))
        rests: dict[tuple, set[str]] = {}
        for first in range(0, len(seeds), AT_ONCE):
            some = seeds.iloc[first : first + AT_ONCE]
            mine = (own_at >= first) & (own_at < first + AT_ONCE)
            used, columns = np.unique(own_codes[mine], return_inverse=True)
            a, b = np.zeros((len(some), len(used))), np.zeros((len(titles), len(used)))
            a[own_at[mine] - first, columns] = own_weights[mine]
            place = np.full(max(own_codes.max(initial=-1), codes.max(initial=-1)) + 1, -1)
            place[used] = np.arange(len(used))
            shared = place[codes] >= 0
            b[at[shared], place[codes[shared]]] = weights[shared]
            own, extra, domains = _flags(some["own"], NAMES), _flags(some["extra"], NAMES), _flags(some["seed_domains"], FIELDS)
            asked = np.sqrt(own @ square + EXTRA_WEIGHT**2 * (extra @ square))
            meant = ((own + EXTRA_WEIGHT * extra) * square) @ held.T
            score = LEXICAL * (a @ b.T) / np.maximum(1e-9, some["seed_length"].to_numpy()[:, None] * length) + (1 - LEXICAL) * meant / (asked[:, None] * held_length)
            bare = own @ held.T == 0
            score = np.where((extra @ held.T > 0) & (~bare | (domains @ fields.T > 0)), np.round(score, PLACES), -1.0)
            for i, s in enumerate(some.itertuples(index=False)):
                able, more, kept, looked = np.flatnonzero(score[i] >= FLOOR), set(s.extra), 0, 0
                identity, size = (s.t, s.part, s.numbers), 4 * NEAREST
                while looked < len(able) and kept < NEAREST:
                    part = able if size >= len(able) else able[score[i, able] >= np.partition(score[i, able], len(able) - size)[len(able) - size]]
                    order = part[np.lexsort((ids[part], -score[i, part]))]
                    for j in order[looked:]:
                        added, context = tuple(sorted(more.intersection(titles["names"].iat[j]))), []
                        if bare[i, j]:
                            if (j, added) not in rests:
                                rests[j, added] = domains_of(ANY_CONCEPT.sub(lambda m, added=added: " " if NAMES[int(m.lastgroup[1:])] in added else m[0], lowered(names[j])))
                            context = sorted(rests[j, added].intersection(s.seed_domains))
                        if (bare[i, j] and not context) or _near(identities[j], identity):
                            continue
                        anchors = sorted(set(s.own).intersection(titles["names"].iat[j]))
                        for c, v in zip(out, (s.seed, ids[j], score[i, j], list(added), anchors, context)):
                            out[c].append(v)
                        kept += 1
                        if kept == NEAREST:
                            break
                    looked, size = len(order), 4 * size
        return pd.DataFrame(out, dtype=object)

    return run


def expanded(papers: DataFrame, ident: str, title: str, abstract: str, is_seed: Column, shown: DataFrame, most: int = MOST) -> DataFrame:
    """Titles that the abstracts of seeds lead to: ``ident, place, score, seed, added, anchors, context, evidence, support``.

    A seed's abstract adds up to EXTRA concepts that its title lacks and that other titles have, rarest first. A candidate has
    an added concept, and beside it a concept of the seed's title (``anchors``) or a domain of it that stands without the added one
    (``context``). Its score is 0.65 of the cosine of title terms and 0.35 of that of concepts, in which added ones count 0.55.
    Each seed's NEAREST candidates are a queue; queues are drained in turns by depth, and a paper or a title comes once. Seeds, papers of ``shown(ident)``
    (what other channels gave) and titles equal or nearly equal to theirs are left out. ``evidence`` are the phrases in the abstract.

    The weights of concepts, as many as there are concepts at most, go with the plan. Seeds and titles are dealt to blocks of bounded size, and
    every block of seeds meets every block of titles in one task, which multiplies their terms and concepts as matrices and gives each seed's
    NEAREST ones; the work is that of all pairs, what is shuffled is the blocks and NEAREST rows a seed and block. Null titles match nothing.
    """
    rows = papers.select(F.col(ident).alias("id"), F.col(title).alias("title"), F.col(abstract).alias("abstract"), is_seed.alias("is_seed"))
    mine = F.col("found")
    cores = papers.sparkSession.sparkContext.defaultParallelism
    base = rows.select("id", "title", "is_seed").repartition(4 * cores)
    base = base.select("id", "title", "is_seed", concepts(F.col("title")).alias("found"), F.array_sort(technical_terms(F.col("title"))).alias("terms"))
    base = base.select("id", "title", "is_seed", F.transform(mine["concepts"], lambda c: c["name"]).alias("names"), mine["domains"].alias("domains"), F.explode_outer("terms").alias("term"))
    total = papers.count()
    weights = term_weights(base.where("term IS NOT NULL").select("term"), total).select("term", F.col("weight").alias("w"))
    base = base.join(weights, "term", "left").groupBy("id", "title", "is_seed", "names", "domains").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "w"))).alias("terms"))
    length = lambda terms: F.sqrt(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t["w"] * t["w"]))
    base = cut(base.withColumn("length", length(F.col("terms"))).withColumn("identity", title_identity(F.col("title"))))

    known = {r["term"]: r["weight"] for r in term_weights(base.select(F.explode("names").alias("term")), total).collect()}
    weight = F.create_map(*(F.lit(x) for kv in known.items() for x in kv)) if known else F.create_map().cast("map<string,double>")

    seeds = base.where("is_seed").join(rows.select("id", "abstract").where("trim(abstract) <> ''"), "id").repartition(4 * cores)
    said = concepts(F.col("abstract"), is_abstract=True)["concepts"]
    seeds = seeds.select(F.col("id").alias("seed"), F.col("names").alias("own"), F.col("domains").alias("seed_domains"), F.col("terms").alias("seed_terms"), F.col("length").alias("seed_length"), "identity", F.explode(said).alias("said"))
    seeds = seeds.select(*[c for c in seeds.columns if c != "said"], "said.name", "said.phrase", weight[F.col("said.name")].alias("w")).where(F.col("w").isNotNull() & ~F.array_contains("own", F.col("name")))
    order = Window.partitionBy("seed").orderBy(F.desc("w"), "name")
    seeds = seeds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= EXTRA)
    plain = ["seed", "own", "seed_domains", "seed_terms", "seed_length", "identity"]
    seeds = cut(seeds.groupBy(*plain).agg(F.collect_list(F.struct("name", "phrase")).alias("extra")))

    used = base.where("is_seed").select("id").unionByName(shown.select(F.col(ident).alias("id"))).distinct()
    used_keys = base.select("id", F.col("identity.t").alias("key")).join(used, "id", "left_semi").select("key").where("key <> ''").distinct()
    asked = seeds.select(F.explode("extra.name").alias("name")).agg(F.collect_set("name")).first()[0]
    able = base.where(F.arrays_overlap("names", F.array(*map(F.lit, asked)).cast("array<string>"))).withColumn("key", F.col("identity.t"))
    able = able.join(used, "id", "left_anti").join(used_keys, "key", "left_anti")
    many, most_seeds = -(-able.count() // TITLES) or 1, -(-seeds.count() // SEEDS) or 1
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    posted = able.select("id", "title", "names", "domains", F.col("terms.term").alias("terms"), F.col("terms.w").alias("weights"), "length", "identity.*", dealt("id", many).alias("block"), blocks(most_seeds).alias("seed_block"))
    asking = seeds.select(
        "seed", "own", "seed_domains", F.col("extra.name").alias("extra"), F.col("seed_terms.term").alias("terms"), F.col("seed_terms.w").alias("weights"), "seed_length", "identity.*",
        blocks(many).alias("block"), dealt("seed", most_seeds).alias("seed_block"))
    kind = papers.schema[ident].dataType.simpleString()
    wanted = f"seed {kind}, id {kind}, score double, added array<string>, anchors array<string>, context array<string>"
    parts = (x.repartition(many * most_seeds, "block", "seed_block").groupBy("block", "seed_block") for x in (asking, posted))
    scored = next(parts).cogroup(next(parts)).applyInPandas(_nearest(known), wanted)
    depth = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "id"))
    evidence = F.map_from_entries(F.transform(F.filter("extra", lambda e: F.array_contains("added", e["name"])), lambda e: F.struct(e["name"], e["phrase"])))
    queues = scored.withColumn("depth", depth).where(F.col("depth") <= NEAREST).join(seeds.select("seed", "extra"), "seed").join(able.select("id", "key"), "id")
    queues = cut(queues.select("seed", "id", "key", "score", "added", "anchors", "context", evidence.alias("evidence"), "depth"))
    best = F.max_by(F.struct("score", "seed", "added", "anchors", "context", "evidence"), F.struct("score", -F.col("seed")))
    once = queues.groupBy("id", "key").agg(F.min(F.struct("depth", "seed")).alias("turn"), best.alias("best"), F.count("*").alias("support"))
    once = once.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("turn"))).where("nth = 1")
    # the window without a partition numbers the first ``most`` rows alone
    first = once.orderBy("turn").limit(most).withColumn("place", F.row_number().over(Window.orderBy("turn")))
    b = F.col("best")
    return first.select(F.col("id").alias(ident), "place", F.round(b["score"], 4).alias("score"), b["seed"].alias("seed"), b["added"].alias("added"), b["anchors"].alias("anchors"), b["context"].alias("context"), b["evidence"].alias("evidence"), "support")
