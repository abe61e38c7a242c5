"""References from several sources against a plain version."""

import random
import re

from foliant.operators import supplement


def key(t):
    return " ".join(w for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in ("a", "an", "the"))


def name(a):
    return ((a or "").split(",")[0].lower().split() or [""])[-1]


def plain(papers, works, stages):
    doi = lambda d: (d or "").lower().strip() or None
    out = set()
    for p, pd in papers:
        for stage, rows in stages:
            mine = sorted((e for e in rows if e[0] == p), key=lambda e: e[1])
            if not any(doi(e[2]) or key(e[3]) for e in mine):
                continue
            seen = set()
            for _, number, d, t, a, y in mine:
                hits = [w[0] for w in works if doi(d) and doi(w[1]) == doi(d)]
                how = "doi"
                if not hits:
                    same = {doi(w[1]) or str(w[0]): w for w in sorted(works, reverse=True) if key(t) and key(w[2]) == key(t) and name(a) and name(w[3]) == name(a) and y is not None and w[4] is not None and abs(w[4] - y) <= 1}
                    hits, how = ([min(w[0] for w in works if (doi(w[1]) or str(w[0])) in same and key(w[2]) == key(t) and name(w[3]) == name(a) and w[4] is not None and abs(w[4] - y) <= 1)] if len(same) == 1 else []), "identity"
                work = min(hits) if hits else None
                if work is not None and (work == p or (doi(pd) and doi(next(w[1] for w in works if w[0] == work)) == doi(pd))):
                    work = None
                if work is None:
                    out.add((p, number, stage, None, "unresolved"))
                elif work not in seen:
                    seen.add(work)
                    out.add((p, number, stage, work, how))
            break
    return out


def test_supplement_equals_a_plain_version(spark):
    rng = random.Random(12)
    titles, authors = [f"The Work {'abcdefgh'[i % 8]} of {i % 9}" for i in range(30)], ["Kim", "B. Lee", "C. Park, D. Choi", None]
    works = [(i, rng.choice([None, f"10.1109/x{i % 25}", f"10.1109/X{i % 25}"]), rng.choice(titles), rng.choice(authors), rng.choice([2018, 2019, 2021, None])) for i in range(60)]
    papers = [(i, rng.choice([None, works[i][1]])) for i in range(20)]
    stages = []
    for s in ("catalogue", "registry", "file"):
        rows = []
        for p in range(22):
            for n in range(rng.choice([0, 0, 4, 8])):
                blank = rng.random() < 0.3
                rows.append((p, n, None if blank or rng.random() < 0.6 else f"10.1109/x{rng.randrange(30)}", None if blank else rng.choice(titles).upper(), rng.choice(authors), rng.choice([2018, 2019, 2020, None])))
        stages.append((s, rows))
    entry = "paper long, number int, doi string, title string, author string, year int"
    found = supplement.supplemented(
        spark.createDataFrame([(*p, "x") for p in papers], "paper long, doi string, work string"), spark.createDataFrame([(*w, 1) for w in works], "work long, doi string, title string, author string, year int, paper int"),
        [(s, spark.createDataFrame(rows, entry)) for s, rows in stages]).collect()
    want = plain(papers, works, stages)
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert len({(r["stage"], r["how"]) for r in found}) >= 6
    none = spark.createDataFrame([], entry)
    assert supplement.supplemented(spark.createDataFrame(papers, "paper long, doi string"), spark.createDataFrame(works, "work long, doi string, title string, author string, year int"), [("s", none)]).count() == 0


def test_tasks_hold_few_sorters(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    entries = frame([(1, 1, "10.1109/a", "T", "Kim", 2018), (1, 2, None, "T", "Kim", 2018)], "paper int, number int, doi string, title string, author string, year int")
    found = supplement.supplemented(frame([(1, None)], "paper int, doi string"), frame([(7, "10.1109/a", "T", "Kim", 2018)], "work int, doi string, title string, author string, year int"), [("registry", entries), ("file", entries)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and len(re.findall(r"\bJoin ", plan)) <= 11, plan
    assert [tuple(r) for r in found.collect()] == [(1, 1, "registry", 7, "doi")]
