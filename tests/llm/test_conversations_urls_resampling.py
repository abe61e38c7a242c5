"""Conversation repair, URL filters and importance resampling against plain versions and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from foliant.llm import conversations, resampling, urls

GRAMMAR = re.compile("(s?(ua)+)?")
CONV = "conv_id long, turn long, role string, text string, gone int, fault string, audit int, part string"


def convs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], CONV)


def plain_repair(rows):
    """All edit sequences, with up to two inserts in each gap, of a conversation of few turns."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    best = None
    for edits in itertools.product(*[["D"] if f in (1, 2) else ["K", "Ru", "Ra", "D"] for f in faults]):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            names, audit, cost, lines = "", "", 0, []
            for i in range(len(rows) + 1):
                for g in gaps[i]:
                    names, audit, cost = names + g, audit + "I", cost + 2
                    lines.append(("user" if g == "u" else "assistant") + ":")
                if i < len(rows):
                    e, (_, role, text) = edits[i], rows[i]
                    audit += e[0]
                    if e == "D":
                        cost += 3
                    else:
                        role = role if e == "K" else "user" if e == "Ru" else "assistant"
                        cost += (0 if e == "K" else 2) + (faults[i] == 3)
                        names += role[:1] or "?"  # a turn without a role is in no state of the grammar
                        lines.append(f"{role}:{text}")
            if GRAMMAR.fullmatch(names) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3), illegal, *best)


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repairs_equal_all_edit_sequences(spark):
    rng, rows = random.Random(5), []
    for c in range(60):
        for t in range(rng.randint(1, 3)):
            rows.append((c, rng.choice([None, t, t, t + 2]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Hi.", "Go on", " ", "Why?", None])))
    found = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in conversations.plans(convs(spark, rows)).collect()}
    for c in range(60):
        assert found[c] == plain_repair([r[1:] for r in rows if r[0] == c]), [r for r in rows if r[0] == c]


def test_long_conversations_and_odd_rows(spark):
    rng = random.Random(1)
    long = [(7, t, rng.choice(["user", "assistant", "tool"]), f"Text {t}{rng.choice('.!x')}") for t in range(1500)]
    tools = [(8, t, "tool", f"Step {t}" + "y" * 300 + ".") for t in range(700)]
    odd = [(None, None, None, None), (9, 1, "user", "A."), (9, 1, "user", "A."), (10, 5, "user", "z" * 400_000 + ".")]
    df = convs(spark, long + tools + odd).repartition(7)
    found = {r["conv_id"]: r for r in conversations.plans(df).collect()}
    assert set(found) == {7, 8, 9, 10, None} and found[None]["audit"] == "D" and found[9]["duplicate"] == 1 and found[10]["audit"] == "KI"
    # an even number of tools is all given roles; none is inserted or dropped
    assert found[8]["audit"] == "R" * 700 and found[8]["cost"] == 1400
    turns = conversations.repaired(df).orderBy("conv_id", "place").collect()
    for c, r in found.items():
        mine = [t for t in turns if t["conv_id"] == c]
        assert [t["place"] for t in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in mine).encode()).hexdigest() == r["repaired_sha256"]
        assert GRAMMAR.fullmatch("".join(t["role"][:1] for t in mine)) and [t["edit"] for t in mine] == [e for e in r["audit"] if e != "D"]
    gone = conversations.plans(df, F.lit(True)).collect()
    assert len(gone) == 5 and all(r["audit"] == "" and r["cost"] == 0 and r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() for r in gone)
    assert conversations.plans(df.limit(0)).count() == 0 and conversations.repaired(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    found = {}
    for r in conversations.damaged(convs(spark, rows)).collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"], r["gone"]))
    for c, t, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (c, t))
        kind, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        want = {0: [(role, text, True)], 1: [(role, "", False)], 2: [(role, re.sub("[.!?]", "", text), False)], 3: [(role, text, False)] * 2, 4: [("user", text, False)]}
        assert found[(c, t)] == want.get(kind, [(role, text, False)])


PAGES = "page_id long, url string, html string, at string, path string, rule int, key string, row int, listed string"


def pages(spark, found):
    return spark.createDataFrame([(i, u, "<p>", "x", "y", 1, "k", 2, "z") for i, u in enumerate(found)], PAGES)


def plain_judge(url, rules, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(h) + len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit) if fit else None
    return host, path, rule and rule[2], rule[1] if rule else "block" if host in listed else "allow"


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "a.net", ""), ("block", "net", "/x")]


@pytest.mark.parametrize("bits", [urls.FILTER_BITS, 128])
def test_urls_equal_plain_rules(spark, monkeypatch, bits):
    monkeypatch.setattr(urls, "FILTER_BITS", bits)
    rng = random.Random(3)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "notexample.com", "net", "a.net", "b.a.net", "ba.net", "x.org", "com", "EXAMPLE.com", "h\n.org"] + [f"h{i}.org" for i in range(300)]
    made = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en', '/es/1?x', '/x/y#z', '?q', '#f', '/en/a://b'])}" for _ in range(1500)]
    made += [None, "", "no scheme", "://", "://net/es/", made[0], made[0], "http://" + "a." * 3000 + "net/es/" + "p" * 5000]
    listed = [h for h in hosts if h.startswith("h") and len(h) % 2]
    found = urls.judged(pages(spark, made), RULES, spark.createDataFrame([(h,) for h in [*listed, None, "unseen.org"]], "host string")).collect()
    assert len(found) == len(made) and found[0].asDict().keys() == {"page_id", "url", "html", "at", "key", "row", "listed", "host", "path", "rule", "verdict"}
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(r["url"], RULES, listed), r["url"]


def test_url_rules_may_be_missing(spark):
    some = pages(spark, ["http://a.b/c", None])
    assert [r["verdict"] for r in urls.judged(some, []).collect()] == ["allow", "allow"]
    assert urls.judged(some.limit(0), RULES).count() == 0
    assert urls.query_hosts(pages(spark, ["http://a.b/c?x", "http://a.b/?", "http://a.b", "http://c.d/?", None])).collect()[0]["host"] == "a.b"


def test_cascade_is_exact_for_its_universe(spark):
    keys = [f"k{i}" for i in range(20_000)]
    listed = set(random.Random(2).sample(keys, 6_000))
    universe = spark.createDataFrame([(k,) for k in [*keys, keys[0], None]], "key string")
    c = urls.Cascade(spark.createDataFrame([(k,) for k in listed] + [("elsewhere",), (None,)], "key string"), universe)
    assert len(c.cascades[0]) > 1
    got = universe.select("key", c.lists(F.col("key")).alias("in")).collect()
    assert all(r["in"] == (r["key"] in listed) for r in got)
    none = urls.Cascade(universe.limit(0), universe)
    assert not any(r[0] for r in universe.select(none.lists(F.col("key"))).collect())


def plain_features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 50 for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, run, percent):
    count = lambda texts: [sum(fs.count(b) for fs in texts) for b in range(50)]
    mine = [plain_features(t, run) for _, t in docs]
    s, t = count([f for _, f in mine]), count([plain_features(x, run)[1] for x in target])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 50) / ((s[b] + 1) * (sum(t) + 50)))) for b in range(50)]
    out = []
    for (i, _), (n, f) in zip(docs, mine):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[2] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return out


@pytest.mark.parametrize("run, size", [(1, 4096), (3, 7), (2, 1)])
def test_resampling_equals_a_plain_version(spark, monkeypatch, run, size):
    monkeypatch.setattr(resampling.chunks, "__defaults__", (run, size))
    monkeypatch.setattr(resampling, "features", lambda run=run, buckets=50, _f=resampling.features: _f(run, 50))
    rng = random.Random(run)
    vocab = [f"W{i}é" for i in range(30)] + ["a1", "x-y", "ÀB", "_"]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 19, 20, 60, 400])))) for i in range(120)] + [(None, "b " * 30), (None, "b " * 30), (3, None), (4, ""), (5, "..."), (6, docs_long())]
    docs += [docs[0], docs[1]]
    target = [" ".join(rng.choices(vocab[:8], k=40)), None, ""]
    df = spark.createDataFrame([(i, t, 1, "c", 2) for i, t in docs], "doc_id long, text string, weight int, chunk string, first int").repartition(5)
    found = resampling.drawn(resampling.weighted(df, spark.createDataFrame([(t,) for t in target], "text string"), run, 50), 30)
    got = [tuple(r[c] for c in ("doc_id", "n_features", "n_words", "weight", "score", "rank")) for r in found.collect()]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    want = [tuple(r) for r in plain_resample(docs, target, run, 30)]
    # equal rows may swap their ranks
    assert sorted(got, key=key) == sorted(want, key=key)


def docs_long():
    return " ".join(f"w{i % 997}" for i in range(20_000))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 25)], "doc_id long, text string")
    assert resampling.resampled(none, some).count() == 0
    assert resampling.resampled(some, none.select("text")).first()["rank"] is None
    assert resampling.resampled(some, none.select("text"), percent=100).first()["rank"] == 1
