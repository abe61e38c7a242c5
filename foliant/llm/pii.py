"""Personal data by patterns and bootstrapped contexts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone")
#: The kind of identifiers that contexts discover.
FOUND = "id"
# Each pattern finds what the plain one does, from the left and without overlaps, but in linear time: a run of signs is
# entered at its first sign only (or where the last match ended) and never given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be worth a search; it never rules out a match.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9][ ().0-9-]"}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
#: A token that may be an identifier: white space around it, a digit or @ in it.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Rounds of scoring; least share of known identifiers among a pattern's, least number of them, least score of a find.
ROUNDS, SHARE, SUPPORT, SCORE = 3, 0.8, 3, 0.8


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, size - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        return match.rlike(IP_VALID)
    if kind == "card":
        return F.when((n >= 13) & (n <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


#: Matches of a block whose places are summed up together.
PLACES = 64


def occurrences(text: Column, pattern: str) -> Column:
    """All matches in order as structs ``gap, match, start, end``: code points, end exclusive; gap is the text before.

    Splitting at the pattern gives the texts between matches, so lengths add up to places: those of whole blocks of
    PLACES matches first, then those within the own block, so that work grows with the matches and not their square.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    add = lambda s, x: s + x
    total = lambda xs: F.aggregate(xs, F.lit(0), add)
    one = F.struct(F.filter(pairs, lambda p: p["match"].isNotNull()).alias("all"))
    sized = F.transform(F.array(one), lambda x: F.struct(x["all"].alias("all"), F.transform(x["all"], lambda p: F.length(p["gap"]) + F.length(p["match"])).alias("size")))
    blocks = lambda x: F.sequence(F.lit(0), F.floor(F.size(x["all"]) / PLACES).cast("int"))
    summed = F.transform(sized, lambda x: F.struct(x["all"].alias("all"), x["size"].alias("size"), F.transform(blocks(x), lambda c: total(F.slice(x["size"], c * PLACES + 1, F.lit(PLACES)))).alias("sums")))

    def placed(x: Column, c: Column) -> Column:
        before = total(F.slice(x["sums"], F.lit(1), c))
        own = F.slice(x["size"], c * PLACES + 1, F.lit(PLACES))

        def at(p: Column, i: Column) -> Column:
            start = before + total(F.slice(own, F.lit(1), i)) + F.length(p["gap"])
            return F.struct(p["gap"].alias("gap"), p["match"].alias("match"), start.alias("start"), (start + F.length(p["match"])).alias("end"))

        return F.transform(F.slice(x["all"], c * PLACES + 1, F.lit(PLACES)), at)

    return F.flatten(F.flatten(F.transform(summed, lambda x: F.transform(blocks(x), lambda c: placed(x, c)))))


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one kind by its pattern: structs ``kind, start, end``."""
    good = F.filter(occurrences(text, PATTERNS[kind]), lambda o: is_valid(kind, o["match"]))
    spans = F.transform(good, lambda o: F.struct(F.lit(kind).alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    return F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(_SPANS))


def candidates(text: Column) -> Column:
    """Tokens with a digit or @ as structs ``core, context, start, end``; context: the two words before, in lower case,
    wherever they stand; a word that is itself such a token counts as ``#``.

    The core is the token without quotes, brackets and stops around it. A token without two words before it, such as the
    first of a text, has no context and is left out.
    """
    def shaped(found: Column, o: Column, i: Column) -> Column:
        core = F.regexp_extract(o["match"], r"^[\"'(\[<{]*(.*?)[\"')\]>},;:.!?]*$", 1)
        lead = F.length(F.regexp_extract(o["match"], r"^([\"'(\[<{]*)", 1))
        earlier = F.when(i > 0, F.concat(F.when(i > 1, F.lit("#")).otherwise(F.lit("")), F.get(found, i - 1)["gap"], F.lit("#"))).otherwise(F.lit(""))
        context = F.lower(F.regexp_extract(F.concat(earlier, o["gap"]), r"(?<!\S)(\S++\s++\S++)\s++$", 1))
        return F.struct(core.alias("core"), F.regexp_replace(context, r"\s+", " ").alias("context"), (o["start"] + lead).alias("start"), (o["start"] + lead + F.length(core)).alias("end"))

    bound = F.transform(F.array(F.struct(occurrences(text, TOKEN).alias("all"))), lambda x: F.transform(x["all"], lambda o, i: shaped(x["all"], o, i)))
    found = F.filter(F.flatten(bound), lambda c: (c["core"] != "") & (c["context"] != ""))
    return F.when(text.rlike("[0-9@]"), found).otherwise(F.array().cast("array<struct<core:string,context:string,start:int,end:int>>"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_base`` (spans by pattern, kinds in order) and ``_key``, a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_base", F.concat(*[base_spans(text, k) for k in KINDS])).withColumn("_key", F.xxhash64(text))


def discover(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Spans ``doc_id, _key, spans`` of identifiers that no pattern knows but contexts give away.

    ``rows`` has doc_id, _key, _base and ``_cand`` (see ``candidates``). Seeds are tokens that a base span covers. They
    induce lexical patterns: the two words before them. In each round a pattern's confidence is the share of known
    identifiers among the different tokens that follow it (with SUPPORT of them at least), a token's score is
    1 - prod(1 - confidence) over its confident patterns, and tokens that reach SCORE become known. Tokens and patterns
    form a graph of distinct edges; the scores are counts and sums by key, combined before the shuffle.
    """
    known = lambda c: F.exists("_base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))
    seen = rows.where(F.size("_cand") > 0).select("doc_id", "_key", F.explode(F.transform("_cand", lambda c: F.struct(c["core"].alias("core"), c["context"].alias("context"), c["start"].alias("start"), c["end"].alias("end"), known(c).alias("seed")))).alias("c")).select("doc_id", "_key", "c.*")
    seen = cut(seen)
    edges = cut(seen.groupBy("context", "core").agg(F.max("seed").alias("seed")))
    score = edges.groupBy("core").agg(F.max(F.col("seed").cast("double")).alias("score"))
    good = None
    for _ in range(rounds):
        score = cut(score)
        good = edges.join(score, "core").groupBy("context").agg(F.avg((F.col("score") >= SCORE).cast("double")).alias("confidence"), F.count_if(F.col("score") >= SCORE).alias("support"))
        good = cut(good.where((F.col("confidence") >= SHARE) & (F.col("support") >= SUPPORT)).select("context", "confidence"))
        doubt = F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))
        better = edges.join(good, "context").groupBy("core").agg((1 - F.exp(F.sum(doubt))).alias("better"))
        score = score.join(better, "core", "left").select("core", F.greatest("score", F.coalesce("better", F.lit(0.0))).alias("score"))
    found = seen.where("not seed").join(good, "context", "left_semi").join(cut(score.where(F.col("score") >= SCORE).select("core")), "core", "left_semi")
    return found.groupBy("doc_id", "_key").agg(F.collect_set(F.struct(F.lit(FOUND).alias("kind"), "start", "end")).alias("_found"))


#: Documents with a find up to which these are broadcast (100 bytes each).
BROADCAST_FINDS = 20_000


def _with_finds(scanned: DataFrame, finds: DataFrame) -> DataFrame:
    finds = cut(finds).select(F.col("doc_id").alias("of"), F.col("_key").alias("of_key"), "_found")
    if finds.count() <= BROADCAST_FINDS:
        finds = F.broadcast(finds)
    joined = scanned.join(finds, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("_key") == F.col("of_key")), "left").drop("of", "of_key")
    return joined.withColumn("_found", F.coalesce("_found", F.array().cast(_SPANS)))


def find(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, base, found`` with the spans (kind, start, end) in every row of ``docs(doc_id, text, ...)``.

    Null text counts as empty and has none. Base spans come from the patterns, by kind and start; found ones from
    contexts, by start. Rows without a doc_id, repeated rows and very long texts are treated like others; an empty table
    gives no rows.
    """
    rows = cut(scan(docs.select("doc_id", "text")).withColumn("_cand", candidates(F.coalesce("text", F.lit("")))).drop("text"))
    joined = _with_finds(rows.drop("_cand"), discover(rows))
    return joined.select("doc_id", F.col("_base").alias("base"), F.array_sort("_found").alias("found"))


#: Code points of the pieces that a text with finds is cut into.
PIECE = 1024


def replaced(text: Column, spans: Column) -> Column:
    """``text`` with each span (sorted structs ``start, end, kind``) as its kind in brackets; overlapping spans give one tag
    each for the part not yet replaced.

    The text is cut into pieces first, each with its own few spans, so that work doesn't grow with text times spans.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int,kind:string>>").alias("all"))
    # spans that begin before an earlier one ends start where that ends; those within one go
    clear = F.aggregate(spans, none, lambda s, p: F.when(p["end"] <= s["end"], s).otherwise(F.struct(
        p["end"].alias("end"), F.concat(s["all"], F.array(F.struct(F.greatest(p["start"], s["end"]).alias("start"), p["end"].alias("end"), p["kind"].alias("kind")))).alias("all"))), lambda s: s["all"])

    def piece(x: Column, i: Column, own: Column) -> Column:
        base = i * PIECE
        here = F.filter(own, lambda p: (p["start"] < base + F.length(x)) & (p["end"] > base))
        begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(s: Column, p: Column) -> Column:
            before = F.substring(x, s["at"] + 1, F.greatest(p["start"] - base - s["at"], F.lit(0)))
            tag = F.when(p["start"] >= base, F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]"))).otherwise(F.lit(""))
            return F.struct(F.concat(s["out"], before, tag).alias("out"), (p["end"] - base).alias("at"))

        return F.aggregate(here, begin, step, lambda s: F.concat(s["out"], F.substring(x, s["at"] + 1, F.lit(PIECE))))

    bound = F.transform(F.array(F.struct(clear.alias("own"), pieces.alias("pieces"))), lambda b: F.transform(b["pieces"], lambda x, i: piece(x, i, b["own"])))
    return F.array_join(F.flatten(bound), "")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets, e.g. [EMAIL]; same columns,
    whatever their names. Null texts stay null.
    """
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    rows = cut(scan(own.select("doc_id", "text")).withColumn("_cand", candidates(F.coalesce("text", F.lit("")))).where(F.size("_cand") > 0).drop("text"))
    joined = _with_finds(scan(own), discover(rows))
    spans = F.array_sort(F.transform(F.concat("_base", "_found"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.when(F.size(spans) > 0, replaced(F.col("text"), spans)).otherwise(F.col("text"))
    return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "found")).alias("spans"))
