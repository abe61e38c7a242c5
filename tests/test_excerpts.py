"""Excerpts against a plain version."""

import math
import random
import re

from foliant.operators import excerpts as X


def plain(pages, text, limit, budget):
    terms = set(re.findall(X.TERM, (text or "").lower()))
    ranked = []
    for paper, page, title, body in sorted(pages, key=lambda p: p[:2]):
        for start in range(0, len(body or ""), X.STEP):
            chunk = body[start : start + X.CHUNK]
            if chunk.strip():
                tokens = re.findall(X.TERM, chunk.lower())
                score = sum(1 + math.log(1 + tokens.count(t)) for t in terms if t in tokens)
                bonus = X.TITLE_HIT * len(terms & set(re.findall(X.TERM, (title or "").lower())))
                ranked.append([round(score + bonus, 9), paper, page, start, chunk, score > 0])
    hit = {r[1] for r in ranked if r[5]}
    first = {}
    for r in ranked:
        first.setdefault(r[1], r)
    ranked = sorted((r for r in ranked if r[5] or (r[0] > 0 and r[1] not in hit and r is first[r[1]])), key=lambda r: (-r[0], *r[1:4]))
    seen, chosen, rest = set(), [], []
    for r in ranked:
        (rest if r[1] in seen else chosen).append(r)
        seen.add(r[1])
    out, room = [], budget
    for r in [*chosen, *rest][:limit]:
        if room > 0:
            out.append((len(out) + 1, *r[1:4], round(r[0], 4), r[4][:room]))
            room -= len(r[4])
    return out


def test_excerpts_equal_a_plain_version(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma2", "1.5", "delta", "클럭", "x", "filler", "text"] + [f"w{i}" for i in range(300)]
    pages = [(p, q, " ".join(rng.choices(words[:40], k=3)), " ".join(rng.choices(words, k=rng.choice([0, 5, 300, 1500])))) for p in range(12) for q in (1, 2)]
    pages += [(50, 1, "alpha beta", "nothing " * 10), (51, 1, None, None), (52, 1, "x", " \n" * 900), (53, 1, "t", "alpha " * 5000)]
    asks = [(1, "Alpha beta"), (2, "gamma2 1.5 클럭"), (3, None), (4, "absent"), (5, "alpha alpha delta x filler")]
    df = spark.createDataFrame([(*p, "z", 1) for p in pages], "paper long, page int, title string, text string, term string, n int").repartition(3)
    q = spark.createDataFrame(asks, "question int, text string")
    for limit, budget in ((6, 14_000), (20, 64_000), (3, 2000)):
        found = {}
        for r in X.excerpts(df, q, limit, budget).orderBy("question", "place").collect():
            found.setdefault(r["question"], []).append(tuple(r)[1:])
        assert found == {i: p for i, t in asks if (p := plain(pages, t, limit, budget))}
    assert X.excerpts(df.limit(0), q).count() == 0
