"""Main text of web pages by wrappers: union-free expressions inferred from all pages of the same host."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

#: Longest wrapper in items.
LONGEST = 400
#: A text that all different pages of a host have (so many pages at least, and all but one in twenty of many) is template text, unless
#: such texts make up more than this share of the pages: then the pages are copies of each other and nothing is known about their template.
PAGES, COMMON, COPIES = 3, 0.95, 0.25
#: Expressions that one task merges; entries that a task holds before it sends them on.
MERGED, HELD = 64, 20_000
#: Wrappers are broadcast up to this many bytes; beyond it, pages are joined on (host, salt).
BROADCAST_BYTES, SALTS = 16_000_000, 64

# Element names of HTML.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNCLOSED = set("p li dt dd td th tr thead tbody tfoot option html body head".split())
VOID = set("area base br col embed hr img input link meta param source track".split())
HIDDEN = "script|style|noscript|template|svg|iframe|object|textarea|select|button"
ASIDE = set("nav header footer aside form menu dialog title".split())
# Words in a class, id or role that mark what is no part of an article.
ASIDE_WORDS = set(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar side widget "
    "header masthead footer foot comment comments reply replies respond disqus notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social related recommended recommendations pagination pager copyright legal form".split())

_SPLIT = re.compile(
    rf"<!--.*?(?:-->|$)|<({HIDDEN})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.S | re.I)
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

TEXT = "#"
#: End of the tokens of elements set aside; class words hold no space, so none reads like it.
FLAG = ". aside"


def tokens(page: str) -> list[tuple[str, str]]:
    """Pairs (structural token, text): element names with their class, ``/name`` where one closes, ``#`` for text.

    Inline elements are part of the text around them. Elements whose end tag may be left out (p, li, ...) have no
    closing token, so pages that write the tag and pages that don't have the same stream.
    """
    out: list[tuple[str, str]] = []
    text: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            out.append((TEXT, joined))
        text.clear()

    at = 0
    for m in _SPLIT.finditer(page):
        text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name or name in INLINE:
            continue
        if name == "br":
            text.append(" ")
            continue
        flush()
        if name in VOID or (m.group(2) and name in UNCLOSED):
            continue
        if m.group(2):
            out.append(("/" + name, ""))
        else:
            out.append((_opening(name, " ".join("".join(x) for x in _MARK.findall(m.group(4))).lower()), ""))
            if m.group(4).rstrip().endswith("/") and name not in UNCLOSED:
                out.append(("/" + name, ""))
    text.append(html.unescape(page[at:]))
    flush()
    return out


@lru_cache(maxsize=4096)
def _opening(name: str, marks: str) -> str:
    """The token of an element: its name and three of its class, id and role words. FLAG is decided from all of them."""
    words = sorted(set(marks.split()))
    aside = name in ASIDE or any(part in ASIDE_WORDS for w in words for part in re.split(r"[-_.]+", w))
    return name + "".join("." + w for w in words[:3]) + (FLAG if aside else "")


def is_aside(token: str) -> bool:
    return token.endswith(FLAG)


def text_key(place: tuple[str, str]) -> int:
    """A pair (element, text) as a 64-bit hash."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest("\0".join(place).encode("utf-8", "replace")) - (1 << 63)


def texts_of(stream: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Pairs (element, text) of a page, in order, and the signs that each has in all; texts set aside are none."""
    stack: list[str] = []
    own: dict[tuple[str, str], int] = {}
    for token, text in stream:
        if token != TEXT:
            _move(stack, token)
        elif not any(map(is_aside, stack)):
            place = (stack[-1] if stack else "", text)
            own[place] = own.get(place, 0) + len(text)
    return own


def marked(stream: list[tuple[str, str]], constants: set) -> list[tuple[str, str]]:
    """``stream`` with template texts (pairs, or their keys) as tokens of their own (``=`` and the text); other texts stay slots."""
    if not constants:
        return stream
    out, stack = [], []
    for token, text in stream:
        if token == TEXT:
            place = (stack[-1] if stack else "", text)
            out.append(("=" + text, text) if place in constants or text_key(place) in constants else (token, text))
        else:
            _move(stack, token)
            out.append((token, text))
    return out


def template_texts(streams: list[list[tuple[str, str]]]) -> set[tuple[str, str]]:
    """Pairs (element, text) that all different pages have: strings that match on every page are the template's, strings
    that don't are slots. None for fewer than PAGES different pages, or where COPIES says that the pages are copies."""
    pages: dict[tuple, dict[tuple[str, str], int]] = {}
    for stream in streams:
        own = texts_of(stream)
        if own:
            pages[tuple(own.items())] = own
    if len(pages) < PAGES:
        return set()
    many = Counter(x for own in pages.values() for x in own)
    common = {x for x, n in many.items() if n >= COMMON * len(pages)}
    size = sum(n for own in pages.values() for n in own.values())
    return common if sum(own.get(x, 0) for own in pages.values() for x in common) <= COPIES * size else set()


# --- inference: items are tokens, ("+", items) for a repeated group and ("?", items) for an optional one


def fold(items: list) -> list:
    """Adjacent repeats become repeated groups, shortest ones first, until there are none."""
    items, width = list(items), 1
    while width <= len(items) // 2 and width <= 24:
        i, changed = 0, False
        while i + 2 * width <= len(items):
            unit = items[i : i + width]
            n = 1
            while items[i + n * width : i + (n + 1) * width] == unit:
                n += 1
            if n > 1 and not (width == 1 and unit[0] == TEXT):
                group = unit[0] if width == 1 and unit[0][0] == "+" else ("+", tuple(unit))
                items[i : i + n * width] = [group]
                changed = True
            i += 1
        width = 1 if changed and width > 1 else width + 1
    return items


def align(a: list, b: list) -> list:
    """The wrapper of what ``a`` and ``b`` both describe: equal items stay, the rest is resolved.

    Two repeated groups merge; a repeated group absorbs single occurrences of its unit; what only one side has becomes
    optional. Texts that differ are slots already, and those of the template are tokens: see ``template_texts``.
    """
    out: list = []
    match = SequenceMatcher(None, [repr(x) for x in a], [repr(x) for x in b], autojunk=False)
    for kind, i, j, k, m in match.get_opcodes():
        if kind == "equal":
            out += a[i:j]
        else:
            out += _resolve(a[i:j], b[k:m])
    return out


def _resolve(x: list, y: list) -> list:
    for one, two in ((x, y), (y, x)):
        if len(one) == 1 and one[0][0] == "+":
            unit = list(one[0][1])
            if len(two) == 1 and two[0][0] == "+" and unit[0] == two[0][1][0]:
                return [("+", tuple(align(unit, list(two[0][1]))))]
            if two and len(two) % len(unit) == 0 and all(two[i : i + len(unit)] == unit for i in range(0, len(two), len(unit))):
                return [one[0]]
    return [s if s == TEXT or s[0] == "?" else ("?", (s,) if isinstance(s, str) or s[0] == "+" else s) for part in (x, y) for s in _grouped(part)]


def _grouped(part: list) -> list:
    """Neighbouring plain items as one group, so that an optional group is a whole element and not each tag of it."""
    out: list = []
    run: list = []
    for s in part:
        if s == TEXT or s[0] == "?":
            if run:
                out.append(tuple(run))
            run = []
            out.append(s)
        else:
            run.append(s)
    return out + ([tuple(run)] if run else [])


def infer(pages: list[str]) -> dict:
    """The wrapper of a host: ``main``, the token of the element with the article, the ``constants`` of the template, and
    ``wrapper``, the items of the expression around them."""
    streams = [tokens(p) for p in pages]
    constants = template_texts(streams)
    streams = [marked(x, constants) for x in streams]
    main = main_element(streams)
    wrapper = merged([fold([t for t, _ in x]) for x in streams])
    return {"main": main, "wrapper": wrapper, "constants": sorted(constants)}


def merged(parts: list[list]) -> list:
    """The expression that describes all ``parts``, short ones first; one that would make it longer than LONGEST is passed over."""
    wrapper: list | None = None
    for own in sorted(parts, key=lambda x: (len(x), json.dumps(x))):
        both = own if wrapper is None else fold(align(wrapper, own))
        if len(both) <= LONGEST:
            wrapper = both
    return wrapper or []


def items_of(found: list) -> list:
    """Items as ``fold`` has them from their JSON."""
    return [s if isinstance(s, str) else (s[0], tuple(items_of(s[1]))) for s in found]


def main_element(streams: list[list[tuple[str, str]]]) -> str | None:
    """The innermost element that holds most of the text in slots that is not set aside, over all pages.

    An element named article or main wins over others where one holds text.
    """
    mass: dict[str, int] = {}
    depth: dict[str, int] = {}
    total = sum([weigh(stream, mass, depth) for stream in streams])
    named = [t for t in mass if t.split(".")[0] in ("article", "main") and mass[t] > 0]
    if named:
        return max(named, key=lambda t: (t.split(".")[0] == "article", mass[t], t))
    most = [t for t in mass if mass[t] >= 0.6 * total and t.split(".")[0] not in UNCLOSED]
    return max(most, key=lambda t: (depth.get(t, 0), t)) if most else None


def weigh(stream: list[tuple[str, str]], mass: dict, depth: dict, host: tuple = ()) -> int:
    """Add a page's signs in slots to the elements around them, and how deep elements stand; the signs of all slots."""
    stack: list[str] = []
    total = 0
    at = (lambda token: (*host, token)) if host else (lambda token: token)
    for token, text in stream:
        if token == TEXT:
            if not any(is_aside(s) for s in stack):
                total += len(text)
                for s in set(stack):
                    mass[at(s)] = mass.get(at(s), 0) + len(text)
        elif token[0] != "=":
            _move(stack, token)
            if token[0] != "/":
                depth[at(token)] = max(depth.get(at(token), 0), len(stack))
    return total


def _move(stack: list[str], token: str) -> None:
    """Open or close an element; closing one closes all within it, and an end tag without a start is ignored."""
    if token[0] == "/":
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].split(".")[0] == token[1:]:
                del stack[i:]
                return
    else:
        if token.split(".")[0] in UNCLOSED and stack and stack[-1].split(".")[0] == token.split(".")[0]:
            stack.pop()
        stack.append(token)


@lru_cache(maxsize=512)
def compiled(wrapper: str) -> tuple[dict[str, str], re.Pattern, str | None]:
    """The wrapper as a regular expression over one character per token, with the main element as a named group.

    Template texts have characters of their own range, so that a slot that may be empty never stands before one.
    """
    found = json.loads(wrapper)
    letters: dict[str, str] = {TEXT: "\ue000"}
    main, close = found["main"], "/" + found["main"].split(".")[0] if found["main"] else None
    state = {"open": 0, "done": False}

    def write(items: list) -> str:
        out = []
        for s in items:
            if isinstance(s, str):
                c = letters.setdefault(s, chr((0xF0000 if s[0] == "=" else 0xE001) + len(letters)))
                if s == TEXT:
                    out.append(c + "?(?![\U000F0000-\U000FFFFD])")
                elif s == main and not state["done"] and not state["open"]:
                    state["open"] = 1
                    out.append("(?P<main>" + c)
                elif s == close and state["open"] == 1:
                    state.update(open=2, done=True)
                    out.append(c + ")")
                else:
                    out.append(c)
            else:
                before = state["open"]
                inner = write(s[1])
                if state["open"] != before:  # the main element is never part of an optional or repeated group
                    raise ValueError("main inside a group")
                out.append(f"(?:{inner}){'*' if s[0] == '+' else '?'}+")
        return "".join(out)

    try:
        body = write(found["wrapper"])
        return letters, re.compile(body + (")" if state["open"] == 1 else "")), main
    except (ValueError, re.error):
        return letters, re.compile(r"(?!)"), main


@lru_cache(maxsize=512)
def constants_of(wrapper: str) -> set:
    """Pairs (element, text) of a wrapper's template, or the keys of them."""
    found = json.loads(wrapper)
    return {(element, text) for element, text in found.get("constants", [])} | set(found.get("keys", []))


def extract(page: str | None, wrapper: str | None) -> str:
    """The article of ``page``: the slots of the main group of the host's expression, where that fits. Template texts are no
    slots and are left out. A page that it doesn't fit (cut off, or of another kind) is read up to the main element's end or
    its own, without the template's texts."""
    letters, expression, main = compiled(wrapper) if wrapper else ({}, None, None)
    stream = marked(tokens(page or ""), constants_of(wrapper) if wrapper else set())
    start, end = 0, len(stream)
    fits = expression.match("".join(letters.get(t, "\uf8ff") for t, _ in stream)) if expression else None
    if fits and "main" in expression.groupindex and fits.group("main"):
        start, end = fits.span("main")
    else:
        if main not in [t for t, _ in stream]:
            main = next((t for want in ("article", "main") for t, _ in stream if t.split(".")[0] == want), None)
        if main:
            start = next(i for i, (t, _) in enumerate(stream) if t == main)
            level = 0
            for i in range(start, len(stream)):
                if stream[i][0][0] == "=":
                    continue
                name = stream[i][0].split(".")[0]
                level += (name == main.split(".")[0]) - (name == "/" + main.split(".")[0])
                if level == 0:
                    end = i + 1
                    break
    stack: list[str] = []
    out = []
    for token, text in stream[start:end]:
        if token == TEXT:
            if not any(map(is_aside, stack)):
                out.append(text)
        elif token[0] != "=":
            _move(stack, token)
    return " ".join(out)


def host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def template_keys(pages: DataFrame) -> DataFrame:
    """Rows ``host, keys``: the template's texts by their keys, from all different pages of ``pages(host, html)``; see ``template_texts``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("k", pa.int64()), ("n", pa.int64())]))
        for batch in batches:
            for b in slices(batch, "html"):
                rows = [(h, own) for h, own in zip(b.column("host").to_pylist(), (texts_of(tokens(t)) for t in b.column("html").to_pylist())) if own]
                page = [text_key(("", repr(tuple(own.items())))) for _, own in rows]
                places = [[{"k": text_key(x), "n": n} for x, n in own.items()] for _, own in rows]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array(page, pa.int64()), pa.array(places, kind)], names=["host", "page", "places"])

    different = pages.mapInArrow(run, "host string, page long, places array<struct<k:long,n:long>>").dropDuplicates(["host", "page"])
    each = different.select("host", F.posexplode("places").alias("at", "x"))
    # a page is counted at its first text
    totals = F.count_if(F.col("at") == 0)
    counted = cut(each.groupBy("host", F.col("x.k").alias("k")).agg(F.count("*").alias("pages"), F.sum("x.n").alias("signs"), totals.alias("first")))
    hosts = counted.groupBy("host").agg(F.sum("first").alias("all_pages"), F.sum("signs").alias("all_signs")).where(F.col("all_pages") >= PAGES)
    common = counted.where(F.col("pages") >= COMMON * PAGES).join(hosts, "host").where(F.col("pages") >= COMMON * F.col("all_pages"))
    common = common.groupBy("host").agg(F.collect_list("k").alias("keys"), F.sum("signs").alias("signs"), F.first("all_signs").alias("all_signs"))
    return common.where(F.col("signs") <= COPIES * F.col("all_signs")).select("host", F.array_sort("keys").alias("keys"))


def with_host(rows: DataFrame, found: DataFrame, size: int, salt: str) -> DataFrame:
    """``rows`` with what ``found`` has of their host: broadcast up to BROADCAST_BYTES, by (host, salt) beyond, so that no host burdens a task."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), "host", "left")
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "_salt"], "left").drop("_salt")


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows ``host, wrapper`` (JSON), one per host, inferred from all of its pages.

    The template's texts come first, by counts. Then each task sends on the different expressions of its pages and the signs by
    element; expressions are merged by groups of MERGED, in an order of their own, so the parts of the table that they came from don't matter.
    """
    rows = pages.where("html is not null").select(host().alias("host"), "html")
    keys = cut(template_keys(rows))
    size = keys.agg(F.coalesce(F.sum(8 * F.size("keys") + F.length("host")), F.lit(0))).first()[0]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set = set()
        mass: dict = {}
        depth: dict = {}

        def flush() -> Iterator:
            out = [(h, x, None, None) for h, x in seen] + [(h, x, mass.get((h, x), 0), depth.get((h, x), 0)) for h, x in mass.keys() | depth.keys()]
            for at in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 5000]), (pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["host", "item", "mass", "depth"])
            for held in (seen, mass, depth):
                held.clear()

        for batch in batches:
            for b in slices(batch, "html"):
                for h, own, constants in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("keys").to_pylist()):
                    stream = marked(tokens(own), set(constants or ()))
                    seen.add((h, json.dumps(fold([t for t, _ in stream]))))
                    mass[h, ""] = mass.get((h, ""), 0) + weigh(stream, mass, depth, (h,))
                if len(seen) + len(depth) > HELD:
                    yield from flush()
        yield from flush()

    found = cut(with_host(rows, keys, size, "html").select("host", "html", "keys").mapInArrow(run, "host string, item string, mass long, depth int"))
    sums = found.where("mass IS NOT NULL").groupBy("host", "item").agg(F.sum("mass").alias("mass"), F.max("depth").alias("depth"))
    totals = sums.where("item = ''").select("host", F.col("mass").alias("total"))
    name = F.substring_index("item", ".", 1)
    named, most = name.isin("article", "main") & (F.col("mass") > 0), (F.col("mass") >= 0.6 * F.col("total")) & ~name.isin(*UNCLOSED)
    best = F.max(F.struct(named.alias("a"), (named & (name == "article")).alias("b"), F.when(named, F.col("mass")).otherwise(F.col("depth")).alias("c"), F.col("item").alias("main")))
    main = sums.where("item <> ''").join(totals, "host").where(named | (most & (F.col("mass") > 0))).groupBy("host").agg(best.alias("best")).select("host", "best.main")

    def merge(group):
        import pandas as pd

        return pd.DataFrame({"host": [group["host"].iloc[0]], "item": [json.dumps(merged([items_of(json.loads(x)) for x in group["item"]]))]})

    parts = found.where("mass IS NULL").select("host", "item").distinct()
    while True:
        sizes = parts.groupBy("host").agg(F.ceil(F.count("*") / MERGED).cast("int").alias("groups"))
        left = sizes.agg(F.max("groups")).first()[0] or 1
        dealt = parts.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("item"), F.col("groups")))
        parts = cut(dealt.groupBy("host", "part").applyInPandas(merge, "host string, item string")).distinct()
        if left == 1:
            break
    whole = parts.join(main, "host", "left").join(keys, "host", "left")
    other = F.to_json(F.struct("main", "keys"), {"ignoreNullFields": "false"})
    held = F.coalesce("keys", F.array().cast("array<long>"))
    return whole.withColumn("keys", held).select("host", F.concat(F.regexp_replace(other, r"\}$", ""), F.lit(',"wrapper":'), "item", F.lit("}")).alias("wrapper"))


def main_text(pages: DataFrame) -> DataFrame:
    """Rows ``page_id, url, text, n_chars``, one per row of ``pages(page_id, url, html, ...)``.

    ``text`` is the article of the whole page, blocks joined by one space, character references decoded. Null and empty
    html, and pages without an article, give an empty text. Pages whose url is null or has no host share the host "".
    Repeated rows get a row each; an empty table gives no rows.
    """
    found = cut(wrappers(pages))
    size = found.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).first()[0]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host().alias("host"))
    joined = with_host(rows, found, size, "page_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for b in slices(batch, "html"):
                texts = [extract(h, w) for h, w in zip(b.column("html").to_pylist(), b.column("wrapper").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
