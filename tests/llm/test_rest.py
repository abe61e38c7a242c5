"""Mixing, packing, search, personal data, pages, toxicity and scoring on small tables and odd rows."""

import collections
import json
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import attention, mixing, packing, pii, registry, scoring, topk, toxicity, wrappers

#: Columns beside those of documents carry names that the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, key string, _key string, _base int, name int, rate int, row int, gone int, again int, one int"
FOLDER = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "clash", "clash", *range(7)) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{FOLDER}/{t}.parquet'")
    found, want = registry.QUERIES[name](spark, FOLDER).toPandas(), con.sql(registry.ORACLES[name]).df()
    own = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), "none").map(lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)).to_numpy().tolist()))
    assert own(found) == own(want)


def test_mixing_reaches_the_weights(spark):
    rows = [(i, "t", "a" if i % 10 else "b") for i in range(4000)] + [(None, None, None), (5, "t", "a"), (5, "t", "a")]
    found = mixing.mix(docs(spark, rows), {"a": 1.0, "b": 1.0}, rows=2000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in found}
    assert abs(n["a"] - 1000) < 150 and abs(n["b"] - 1000) < 150 and None not in n
    again = mixing.mix(docs(spark, rows[::-1]), {"a": 1.0, "b": 1.0}, rows=2000).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in again} == n
    assert mixing.mix(docs(spark, [])).count() == 0


def test_poisson_draws_at_high_rates(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"))
    n = mixing.mix(df, rows=3000 * 21.5).groupBy("doc_id").count().select(F.avg("count"), F.variance("count")).first()
    assert abs(n[0] - 21.5) < 0.5 and abs(n[1] - 21.5) < 2.5


def test_many_sources_are_joined_by_salt(spark, monkeypatch):
    rows = [(i, "t", f"s{i % 7}" if i % 7 else None) for i in range(300)]
    one = sorted(map(tuple, mixing.mixed(docs(spark, rows)).select("row.doc_id", "copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mixed(docs(spark, rows)).select("row.doc_id", "copy").collect())) == one


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["Alpha,", "beta.", "don't", "4,5", "é", "<|endoftext|>", "x.y."]) for _ in range(rng.choice([0, 1, 30, 300, 900, 2500]))), "s") for i in range(60)]
    rows += [(5, rows[5][1], "s"), (5, rows[5][1], "s"), (70, None, None), (None, "no id", "s")]
    found = packing.pack_documents(docs(spark, rows)).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], dtype="<u4")
            want[i, k, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r["length"] for r in found)
    assert len(sequences) <= math.ceil(total / 2048) + 2
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(6)
    for shape in (rng.integers(0, 40, 65), np.eye(1, 65, 33, dtype=int)[0] * 9, np.zeros(65, dtype=int)):
        shape = shape.copy()
        shape[0] = 0
        used = np.zeros(65, dtype=int)
        for own, times in packing.plan(shape, 64):
            assert sum(own) <= 64
            for x in own:
                used[x] += times
        assert (used == shape).all()


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(0, 300)]
    rows += [(50, rows[50][1]), (1000, None), (1050, [float("nan")] * 6), (1100, [1.0]), (1101, [2.0]), (1150, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(3)).withColumn("rank", F.lit(1))
    found = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect()))
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and not math.isnan(x) for x in v)]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            want.append([(i, -s) for s, i in scored[:5]])
    asked = [q for q, _ in fine if q % 50 == 0]
    assert collections.Counter((r[0], r[2], r[3]) for r in found if asked.count(r[0]) == 1) == collections.Counter((q, i, s) for q, own in zip(asked, want) for i, s in own if asked.count(q) == 1)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(n[::-1])) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            n = re.sub("[^0-9]", "", m.group())
            fits = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda: 13 <= len(n) <= 19 and luhn(n), "phone": lambda: 9 <= len(n) <= 15}[kind]()
            if fits:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("a.@_%1234 56-+()x\n\U0001f600é") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    texts += ["a@b.com_x@y.z a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (415) 555-2671x+44.20.7946.0958 +1", "a" * 20000, "7" * 20000, None, ""]
    found = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert found == {i: plain(t) for i, t in enumerate(texts)}


def test_contexts_discover_identifiers_and_leave_others(spark):
    lead = "please write to user"
    rows = [(i, f"some words {lead} a{i}@b.com and more", "s") for i in range(9)]
    rows += [(20, f"some words {lead} agent_7731x and more", "s"), (21, "in the year 19999 and more", "s"), (20, f"some words {lead} agent_7731x and more", "s"), (None, None, None)]
    got = pii.find(docs(spark, rows)).collect()
    by = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in got}
    assert len(got) == len(rows) and by[20] == [("id", 32, 43)] and by[21] == []
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, rows)).collect()}
    assert text[3] == f"some words {lead} [EMAIL] and more" and text[20] == f"some words {lead} [ID] and more" and text[None] is None
    assert pii.redact(docs(spark, rows)).columns == docs(spark, rows).columns
    assert pii.find(docs(spark, [])).count() == 0


def test_identifiers_side_by_side_and_many_in_a_long_text(spark):
    lead = "please write to user"
    rows = [(i, f"some words {lead} a{i}@b.com and more", "s") for i in range(9)]
    rows += [(i, f"ask for number {i}77 b{i}@c.org", "s") for i in range(10, 19)]
    rows += [(20, "ask for number 12345 agent_7731x and", "s"), (21, f"{lead}{' ' * 300}agent_7731x", "s"), (22, f"{lead} agent_7731x", "s")]
    text = " ".join(f"x{i} m{i}@y.org" for i in range(3000))
    rows.append((23, text, "s"))
    by = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).collect()}
    own = lambda i: [rows[[r[0] for r in rows].index(i)][1][s["start"] : s["end"]] for s in by[i]["found"]]
    assert "agent_7731x" in own(20) and own(21) == own(22) == ["agent_7731x"]
    assert [(s["start"], s["end"]) for s in by[23]["base"]] == [m.span() for m in re.finditer(r"m\S+", text)]
    out = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, rows)).collect()}
    assert out[23].split()[1::2] == ["[EMAIL]"] * 3000 and len(out[23].split()) == 6000


def test_rows_without_an_id_draw_each(spark):
    rows = [(None, f"t{i}", "s") for i in range(2000)]
    n = mixing.mix(docs(spark, rows)).groupBy("text").count().count()
    assert 1150 < n < 1380  # 1 - 1/e of them


PAGE = "<html><head><title>t</title><script>if (a<b) x('</p>')</script></head><body><nav><ul>{menu}</ul></nav><div class='ad'>buy</div><article><h1>{h}</h1>{p}{c}</article><footer>f</footer></body></html>"


def test_wrappers_find_the_article(spark):
    rows, want = [], {}
    for i in range(30):
        menu = "".join(f"<li><a href=/{k}>m{k}</a>" for k in range(i % 4 + 2))
        p = "".join(f"<p>Text <b>{i}</b>.{k}&nbsp;&amp;\n x" + "</p>" * (k % 2) for k in range(i % 5 + 1))
        c = "<section class='comments'><p>nice</p></section>" if i % 3 == 0 else ""
        rows.append((i, "http://h.example.com/" + str(i), PAGE.format(menu=menu, h=f"H {i}", p=p, c=c)))
        want[i] = " ".join([f"H {i}"] + [f"Text {i}.{k} & x" for k in range(i % 5 + 1)])
    rows += [(40, rows[7][1], rows[7][2][: rows[7][2].index("</article>") - 4]), (41, None, None), (42, "no url", ""), (43, "http://other.example/", "<p>alone</p>"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = wrappers.main_text(df).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["page_id"] in want:
            assert r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"])
    text = {r["page_id"]: r["text"] for r in found}
    assert text[41] == text[42] == "" and text[43] == "alone" and want[7].startswith(text[40][:10])
    assert wrappers.main_text(df.limit(0)).count() == 0


def test_wrappers_generalise_repeats_and_options():
    a = wrappers.fold(["ul", "li", "#", "li", "#", "/ul", "div", "#", "/div"])
    assert a == ["ul", ("+", ("li", "#")), "/ul", "div", "#", "/div"]
    b = wrappers.align(a, wrappers.fold(["ul", "li", "#", "/ul", "aside", "/aside", "div", "#", "/div"]))
    assert b == ["ul", ("+", ("li", "#")), "/ul", ("?", ("aside", "/aside")), "div", "#", "/div"]
    _, expression, _ = wrappers.compiled(json.dumps({"main": "div", "wrapper": b}))
    assert expression.groupindex == {"main": 1}


def labelled(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        own = [word() for _ in range(rng.randint(5, 60))] + [rng.choice(["zorgle", "zorglish", "quxbad"]) for _ in range(3 * bad)]
        rng.shuffle(own)
        rows.append((i, " ".join(own), "s"))
        if i < 300:
            labels.append((i, int(i % 7 > 0), int(bad)))
    return rows, spark.createDataFrame(labels + [(None, 1, 1), (1, None, 0)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    odd = [(500, None, "s"), (501, "", "s"), (None, "zorgle quxbad zorgle", "s"), (3, rows[3][1], "s")]
    found = toxicity.score_documents(docs(spark, rows + odd), labels).collect()
    assert len(found) == len(rows) + len(odd)
    held = [r for r in found if r["doc_id"] is not None and 300 <= r["doc_id"] < 400]
    assert np.mean([r["toxic"] == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    by = {r["doc_id"]: r["toxic"] for r in found}
    assert not by[500] and not by[501]
    kept = toxicity.drop_toxic(docs(spark, rows + odd), labels)
    assert kept.columns == docs(spark, rows).columns and kept.count() == sum(not r["toxic"] for r in found)
    assert toxicity.score_documents(docs(spark, []), labels).count() == 0
    assert not any(r["toxic"] for r in toxicity.score_documents(docs(spark, rows), labels.limit(0)).collect())


def test_scoring_base_and_each_id_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["The", "the", "cat", "sat,", "on", "mat.", "é", "x y"]) for _ in range(rng.randint(0, 40))), "s") for i in range(60)]
    rows += [(70, None, "s"), (71, "", "s"), (None, "the cat", "s"), (3, rows[3][1], "s"), (72, "unseenword " * 500, "s")]
    found = scoring.score_texts(docs(spark, rows), rounds=1).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: (t or "").encode().lower().split() + [None]
    c = collections.Counter(w for i, t, _ in rows if i is not None and not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t, _ in rows)
    got = collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert got == want and all(r["score"] < 0 for r in found)
    assert scoring.score_texts(docs(spark, []), rounds=1).count() == 0


def test_score_is_the_same_whichever_way_counts_come_and_equals_a_plain_pass(spark, monkeypatch):
    rows = [(i, f"common w{i % 13} w{i % 7} " + "more " * (i % 30), "s") for i in range(40)]
    kept = []
    monkeypatch.setattr(attention, "closed", lambda m, real=attention.closed: kept.append(real(m)) or kept[-1])
    own = lambda: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 5), round(r["score"], 3)) for r in scoring.score_texts(docs(spark, rows), rounds=1).collect())
    one = own()
    monkeypatch.setattr(scoring, "HEAD", 2)
    assert own() == one
    # the plain pass: every word by itself, every id from a forward pass over its own window
    path = scoring.tokenizer_path("byte_bpe_50k.tiktoken")
    end, model = len(scoring.encoder(path)[1]), kept[0]
    net = attention.Attention.__new__(attention.Attention)
    net.p = model["p"]
    counts = collections.Counter(w for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split() + [None])
    for i, t, _ in rows[:6]:
        words = t.encode().split()
        ids = [scoring._word_ids({w}, path)[w] for w in words]
        ids = [np.frombuffer(x, dtype="<u4").astype(int).tolist() for x in ids] + [[end]]
        flat, logs = [x for w in ids for x in w], []
        for at in range(len(flat)):
            first = at // attention.SCORED * attention.SCORED
            places = range(first - attention.BEFORE - 1, first + attention.SCORED - 1)
            x = np.array([[model["row"][flat[k]] if 0 <= k < len(flat) else model["rows"] for k in places]])
            z = net.forward(x, np.array([[k >= -1 for k in places]]))["logits"][0, at - first].astype(float)
            logs.append(z[model["group"][flat[at]]] - np.log(np.exp(z).sum()) + model["share"][flat[at]])
        total, at = 0.0, 0
        for w, some in zip(words + [None], ids):
            p = np.exp(sum(logs[at : at + len(some)]))
            at += len(some)
            total += np.log10((1 - scoring.OWN) * p + scoring.OWN * counts[w.decode() if w else None] / sum(counts.values()))
        assert abs(total - dict((r[0], r[3]) for r in one)[i]) < 0.02


def test_attention_is_a_distribution_and_learns():
    rng = np.random.default_rng(1)
    texts = [np.array([(s + k) % 7 for k in range(rng.integers(1, 60))] + [7]) for s in rng.integers(0, 7, 80)]
    counts = np.bincount(np.concatenate(texts), minlength=8).astype(float)
    windows = np.stack([attention.window(t[at:], at == 0) for i, t in enumerate(texts) for at in attention.starts_of(len(t), i, 8)]).astype(np.int64)
    model = attention.start(counts, windows)
    for turn in range(40):
        model["p"] = attention.fit(model, np.tile(windows, (4, 1)), turn, 40)
    model = attention.closed(model)
    lengths = np.array([len(t) for t in texts])
    each = attention.log_probabilities(model, np.concatenate(texts), lengths)
    unigram = np.log(counts / counts.sum())[np.concatenate(texts)]
    assert each.sum() > 0.5 * unigram.sum() and len(each) == lengths.sum()
    # the probabilities of all next ids after a prefix sum to one, for places in the first and in later windows
    for prefix in (texts[0][:0], np.arange(40) % 7):
        p = [np.exp(attention.log_probabilities(model, np.append(prefix, i), np.array([len(prefix) + 1]))[-1]) for i in range(8)]
        assert abs(sum(p) - 1) < 1e-4
    # a text's scores don't hang on the texts beside it
    alone = attention.log_probabilities(model, texts[5], lengths[5:6])
    at = lengths[:5].sum()
    assert np.allclose(alone, each[at : at + lengths[5]], atol=1e-4)


def test_attention_gradient():
    net = attention.Attention(5, 4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, seen = rng.integers(0, 6, (3, attention.SPAN)), np.ones((3, attention.SPAN), dtype=bool)
    pull = rng.standard_normal((3, attention.SCORED, 4))
    g = net.backward(net.forward(x, seen), x, pull)
    for name in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        if name == "E":
            at = (int(x[0, 10]), 3)
        old, e = net.p[name][at], 1e-5
        net.p[name][at] = old + e
        up = (net.forward(x, seen)["logits"] * pull).sum()
        net.p[name][at] = old - e
        down = (net.forward(x, seen)["logits"] * pull).sum()
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_pipeline_equals_its_stages_by_hand(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "source_mixing", "bestfit_packing"]
    own = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, own, FOLDER)
        assert after.columns == own.columns, name
        own = after
    last = c.STAGES[-1][1](spark, own, FOLDER)
    found = c.run(spark, FOLDER)
    assert sorted(map(tuple, found.drop("sequence_id", "offset").collect())) == sorted(map(tuple, last.drop("sequence_id", "offset").collect()))


@pytest.mark.parametrize("marks", ["block clearfix col-4 sidebar", "box card clearfix comments", "a b c d share-box"])
def test_aside_is_decided_by_all_class_words(marks):
    page = f"<html><body><article><p>First words.</p><div class='{marks}'><p>Not this.</p></div><p>Last words.</p></article></body></html>"
    assert wrappers.extract(page, None) == wrappers.extract(page, json.dumps(wrappers.infer([page]))) == "First words. Last words."
    assert wrappers.extract(page.replace(marks, "a b c d e"), None) == "First words. Not this. Last words."


SLOTS = [
    "<html><body><div class='top'><p>Welcome to {host}.</p></div><article><h1>{h}</h1><p>Log in to read on.</p>{p}<p>Was this helpful?</p></article></body></html>",
    "<html><body><div class='wrap'><p>All our sites.</p><div class='x1 y2 z3 body'><h2>{h}</h2>{p}<div class='q'><p>Printed by {host}.</p></div></div><p>Write to us.</p></div></body></html>",
    "<html><body><main><p>Our readers help us.</p><h1>{h}</h1>{p}</main><footer>f</footer></body></html>",
]


@pytest.mark.parametrize("template", SLOTS)
def test_slots_and_template_texts_decide(spark, template):
    """Template texts without any marking word are told from the article by the wrapper alone; an independent reading of the
    planted blocks says what is right."""
    word = lambda i, k: "".join("bcdfgklmnr"[(i * 7 + k * 3 + j * j) % 10] + "aeiou"[(i + k * j) % 5] for j in range(4))
    rows, want, whole = [], {}, {}
    for i in range(40):
        h, blocks = f"Head {i}", [" ".join(word(i, 10 * k + j) for j in range(30)) for k in range(i % 4 + 1)]
        page = template.format(host="a site", h=h, p="".join(f"<p>{b}</p>" for b in blocks))
        rows.append((i, f"http://s.example/{i}", page))
        want[i] = " ".join([h, *blocks])
        whole[i] = wrappers.extract(page, json.dumps({"main": None, "wrapper": []}))
    rows += [(100 + i, "http://copies.example/", rows[5][2].replace("Head 5", f"Head 5{i}")) for i in range(6)]
    found = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: found[i] for i in want} == want
    assert all(whole[i] != want[i] for i in want)  # without the expression the template's texts stay
    # copies of one page say nothing about a template: no text of theirs is lost
    assert all(want[5].replace("Head 5", f"Head 5{i}") in found[100 + i] or set(want[5].split()[2:]) <= set(found[100 + i].split()) for i in range(6))


def test_toxicity_equals_a_plain_chain(spark):
    """Every document's probabilities and verdict against a plain walk along the chain, and the cutoff against all others."""
    rows, labels = labelled(spark)
    odd = [(900, None), (901, ""), (902, rows[0][1]), (902, rows[5][1])]
    frame = spark.createDataFrame([(r[0], r[1]) for r in rows] + odd, "doc_id long, text string")
    model = toxicity.train(frame, labels)
    weight = dict(zip(model["buckets"].tolist(), model["weights"].tolist()))
    want = {}
    for doc_id, text in frame.collect():
        own = {f for w in toxicity.tokens(text) for f in toxicity.features(w) if f in weight}
        p = []
        for c in range(len(toxicity.CHAIN)):
            z = model["bias"][c] + sum(weight[f][c] for f in own) + sum(model["extra"][c][k] * p[k] for k in range(c))
            p.append(1 / (1 + np.exp(-z)))
        want.setdefault(doc_id, []).append((p[0], p[1]))
    found = toxicity.score_documents(frame, labels).collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        assert any(abs(r["p_low_quality"] - a) < 2e-6 and abs(r["p_toxic"] - b) < 2e-6 for a, b in want[r["doc_id"]])
        assert r["toxic"] == (r["p_toxic"] >= model["cutoff"])


def test_cutoff_is_the_lowest_that_is_precise_enough():
    rng = np.random.default_rng(5)
    for n in (1, 7, 60):
        p, y = rng.random(n).round(3), rng.integers(0, 2, n).astype(float)
        p, at = np.unique(p, return_index=True)
        y = y[at]
        got = toxicity.cutoff(p, y, 0.7)
        fine = [x for x, own in zip(p, y) if own > 0 and y[p >= x].mean() >= 0.7]
        assert got == 1.1 if not fine else (p >= got).tolist() == (p >= min(fine)).tolist()


def test_all_pages_of_a_host_decide_what_its_template_is(spark):
    """A text that only the pages whose ids hash lowest share is no template; one that nearly all pages have is."""
    ids = spark.range(40).withColumn("url", F.concat(F.lit("http://one.example/"), "id")).withColumn("h", F.xxhash64("id", "url"))
    order = [(r["id"], r["url"]) for r in ids.orderBy("h").collect()]
    body = "words of page {0} that nobody else has, number {0} of many, and some more of them for the share {0}"
    rows = []
    for place, (i, url) in enumerate(order):
        line = "<p>A line of a dozen</p>" if place < 12 else ""
        foot = "" if place == 39 else "<p>All the same</p>"
        rows.append((i, url, f"<html><body><div class=\"x\"><div class=\"y\"><p>{body.format(i)}</p>{line}</div>{foot}</div></body></html>"))
    found = {r["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    for place, (i, _) in enumerate(order):
        assert found[i] == body.format(i) + (" A line of a dozen" if place < 12 else "")


def test_every_id_of_every_text_is_learned_from_once():
    texts = [np.arange(n) for n in (1, 15, 16, 17, 400)]
    for t in texts:
        rows = attention.windows_of(t)
        targets = rows[:, -attention.SCORED:]
        assert targets[targets >= 0].tolist() == t.tolist()
        for row in rows:
            seen = row[row >= 0]
            assert (np.diff(seen) == 1).all() and seen[0] == max(0, row[-attention.SCORED] - attention.BEFORE - 1)


def test_training_takes_all_windows_of_all_documents(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i + k) % 9}" for k in range(700))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    weights = []
    monkeypatch.setattr(scoring, "_merged", lambda parts, wide, real=scoring._merged: weights.append(parts.agg(F.sum("weight")).first()[0]) or real(parts, wide))
    path = scoring.tokenizer_path("byte_bpe_50k.tiktoken")
    counts = np.zeros(len(scoring.encoder(path)[1]) + 1)
    size = [len(list(texts[0])) for texts in scoring._texts_ids(iter(df.select("text").toArrow().to_batches()), path, len(counts) - 1)][0]
    counts[-1] = len(rows)
    scoring.trained(df, counts, path, rounds=2)
    assert sum(weights) == len(rows) * -(-size // attention.SCORED)
