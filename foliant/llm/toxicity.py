"""Toxicity by a classifier chain of linear models over hashed word features."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, claim, cut, slices, table

#: Labelled rows that the models are fitted on at most (the ones whose id hashes lowest), hash buckets, folds.
SAMPLE, BUCKETS, FOLDS = 8000, 1 << 20, 3
#: Features that a model keeps and labelled documents that each needs; weight of the ridge, steps of the fit, and the least
#: precision on out-of-fold predictions that a rejection needs.
KEPT, LEAST_DOCS, RIDGE, STEPS, PRECISION = 3000, 3, 0.1, 80, 0.99
#: Tokens whose features a task remembers.
REMEMBERED = 300_000
CHAIN = ("low_quality", "toxic")
_OTHER = re.compile(r"[\W\d_]+")


def features(token: bytes) -> list[int]:
    """Buckets of one token: its letters, their beginnings (inflected forms share these) and its other signs."""
    text = token.decode("utf-8", "replace").lower()
    core = _OTHER.sub("", text)
    names = ["w:" + core] + [f"{n}:{core[:n]}" for n in (4, 5) if len(core) > n] if core else []
    signs = text if not core else "".join(c for c in text if c not in core)
    if signs:
        names.append("x:" + re.sub(r"\d+", "0", signs))
    return [zlib.crc32(n.encode()) % BUCKETS for n in names]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Linear:
    """Logistic regression on sparse rows, by L-BFGS."""

    def __init__(self, buckets: int, extra: int):
        self.w = np.zeros(buckets + extra + 1)

    def fit(self, rows: tuple[np.ndarray, np.ndarray], extra: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> Linear:
        start, idx = rows
        n = len(y)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
        buckets = len(self.w) - extra.shape[1] - 1
        used = telling(row, idx, y, buckets)
        place = np.full(buckets, -1, dtype=np.int32)
        place[used] = np.arange(len(used))
        idx = place[idx]
        row, idx = row[idx >= 0], idx[idx >= 0]
        m = len(used) + extra.shape[1] + 1
        weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) ** 0.5

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = np.bincount(row, w[idx], n) + extra @ w[len(used) : -1] + w[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            r = weight * (p - y)
            g = np.concatenate([np.bincount(idx, r[row], len(used)), extra.T @ r, [r.sum()]])
            pull = w.copy()
            pull[-1] = 0
            value = float(-(weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() + ridge * (pull @ pull) / 2)
            return value, g + ridge * pull

        w = _lbfgs(loss, np.zeros(m), steps)
        self.w[used] = w[: len(used)]
        self.w[buckets:] = w[len(used) :]
        return self

    def predict(self, rows: tuple, extra: np.ndarray) -> np.ndarray:
        start, idx = rows
        n, buckets = len(start) - 1, len(self.w) - extra.shape[1] - 1
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(start))
        live = self.w[:buckets] != 0
        row, idx = row[live[idx]], idx[live[idx]]
        return _sigmoid(np.bincount(row, self.w[idx], n) + extra @ self.w[buckets:-1] + self.w[-1])


def telling(row: np.ndarray, idx: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """The KEPT buckets whose share of positive documents differs most from that of the others, in standard errors."""
    n1 = max(1.0, y.sum())
    n0 = max(1.0, len(y) - y.sum())
    df = np.bincount(idx, minlength=buckets)
    pos = np.bincount(idx[(y > 0)[row]], minlength=buckets)
    gap = np.abs(pos / n1 - (df - pos) / n0) / np.sqrt((df + 2.0) / len(y))
    gap[df < LEAST_DOCS] = -1
    best = np.argsort(-gap, kind="stable")[:KEPT]
    return best[gap[best] > 0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _lbfgs(loss, w: np.ndarray, steps: int, memory: int = 6) -> np.ndarray:
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y, r in reversed(past):
            a = r * (s @ d)
            kept.append(a)
            d -= a * y
        if past:
            s, y, _ = past[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.linalg.norm(g))
        for (s, y, r), a in zip(past, reversed(kept)):
            d += s * (a - r * (y @ d))
        slope, t = g @ d, 1.0
        while t > 1e-6:
            there, new = loss(w - t * d)
            if there <= value - 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = -t * d, new - g
        if s @ y > 1e-10:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - there < 1e-6 * max(1.0, abs(value))
        w, value, g = w - t * d, there, new
        if done:
            break
    return w


def _take(rows: tuple, at: np.ndarray) -> tuple:
    start, idx = rows
    pick = [idx[start[i] : start[i + 1]] for i in at.tolist()]
    return np.concatenate([[0], np.cumsum([len(x) for x in pick])]).astype(np.int64), np.concatenate([*pick, idx[:0]])


def fit_chain(rows: tuple, y: np.ndarray, fold: np.ndarray) -> tuple[list[Linear], np.ndarray]:
    """One model per column of ``y`` in order, and every column's out-of-fold probabilities.

    Model k sees the features and the probabilities of columns before k. In training these are predictions of models
    that have not seen the row (out of fold), so later models learn how good earlier ones are on new rows.
    """
    n, k = y.shape
    out = np.zeros((n, k))
    models = []
    for c in range(k):
        for f in range(FOLDS):
            test, train = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(test) and len(train):
                part = Linear(BUCKETS, c).fit(_take(rows, train), out[train, :c], y[train, c])
                out[test, c] = part.predict(_take(rows, test), out[test, :c])
        models.append(Linear(BUCKETS, c).fit(rows, out[:, :c], y[:, c]))
    return models, out


def cutoff(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest probability from which on at least ``precision`` of the rows are positive, halfway to the next row."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    good = np.flatnonzero((right >= precision) & (y[order] > 0))
    if not len(good):
        return 1.1
    last = good[-1]
    below = p[order[last + 1]] if last + 1 < len(p) else 0.0
    return float((p[order[last]] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit the chain on at most ``sample`` labelled documents.

    ``labels`` has doc_id, quality and toxic (0 or 1). Rows with a null in any of these are left out, and rows of one
    doc_id count once, as toxic or poor if any says so; documents of one doc_id count once, with the least text. The sample is the ids that hash lowest, so it is bounded and
    hangs on no order; its ids are broadcast, the documents are scanned once, one task fits their features, and only the model reaches the driver.
    Without labels of both kinds the chain rejects nothing.
    """
    picked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    picked = picked.agg((1 - F.min("quality")).cast("double").alias("low_quality"), F.max("toxic").cast("double").alias("toxic"))
    picked = cut(picked.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))))
    # the lowest hashes lie below this place, so no task sorts or sends on more than about the sample
    below = int((1 << 40) * min(1.0, (1.2 * sample + 100) / max(1, picked.count())))
    picked = picked.where(F.col("place") <= below).orderBy("place", "doc_id").limit(sample).drop("place")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("toxicity", lambda: None)
        for whole in batches:
            for batch in slices(whole, "text"):
                idx = []
                for t in batch.column("text"):
                    found = {f for w in set(tokens(t.as_py())) for f in features(w)}
                    idx.append(np.array(sorted(found), dtype="<i4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("low_quality"), batch.column("toxic"), pa.array(idx, pa.binary())], names=["doc_id", "low_quality", "toxic", "idx"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    found = found.groupBy("doc_id", *CHAIN).agg(F.min("text").alias("text"))
    found = cut(found.select("doc_id", "text", *CHAIN).mapInArrow(run, "doc_id long, low_quality double, toxic double, idx binary"))

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("toxicity", lambda: None)
        own = [b.to_pydict() for b in batches]
        column = lambda c: [x for b in own for x in b[c]]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_model(column("doc_id"), np.array([column(c) for c in CHAIN]).T, column("idx")))], pa.binary())], names=["model"])

    # one task fits the bounded sample, away from the driver; without a labelled row there is none to run
    made = found.repartition(1).mapInArrow(fit, "model binary").first()
    return pickle.loads(made["model"]) if made else _model([], np.zeros((0, len(CHAIN))), [])


def _model(ids: list[int], y: np.ndarray, idx: list[bytes]) -> dict:
    order = np.argsort(np.array(ids, dtype=np.int64), kind="stable")
    ids, y, idx = [ids[i] for i in order], y[order], [np.frombuffer(idx[i], dtype="<i4") for i in order]
    if len(y) < 2 * FOLDS or (y[:, -1].min() == y[:, -1].max()):
        return {"buckets": np.zeros(0, dtype=np.int64), "weights": np.zeros((0, len(CHAIN))), "extra": np.zeros((len(CHAIN), len(CHAIN))), "bias": np.full(len(CHAIN), -30.0), "cutoff": 1.1}
    rows = (np.concatenate([[0], np.cumsum([len(x) for x in idx])]), np.concatenate(idx))
    fold = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in ids])
    models, out = fit_chain(rows, y, fold)
    extra = np.zeros((len(CHAIN), len(CHAIN)))
    for c, m in enumerate(models):
        extra[c, :c] = m.w[BUCKETS:-1]
    weights = np.stack([m.w[:BUCKETS] for m in models], axis=1)
    used = np.flatnonzero(weights.any(axis=1))
    return {"buckets": used, "weights": weights[used], "extra": extra, "bias": np.array([m.w[-1] for m in models]), "cutoff": cutoff(out[:, -1], y[:, -1])}


def scorer(model: dict):
    """A function from texts to an array of probabilities, one column per category of the chain.

    Only the kept features count, once per document. Which of them a token has is remembered; most have none.
    """
    place = {int(b): i for i, b in enumerate(model["buckets"])}
    seen: set[bytes] = set()
    telling_: dict[bytes, list[int]] = {}

    def score(texts: Sequence[str | None]) -> np.ndarray:
        p = np.zeros((len(texts), len(CHAIN)))
        for i, t in enumerate(texts):
            words = set(tokens(t))
            for w in words.difference(seen):
                if kept := [place[f] for f in features(w) if f in place]:
                    telling_[w] = kept
            seen.update(words)
            own = list({f for w in words if w in telling_ for f in telling_[w]})
            z = model["weights"][own].sum(axis=0) + model["bias"]
            for c in range(len(CHAIN)):
                p[i, c] = _sigmoid(z[c] + model["extra"][c] @ p[i])
            if len(seen) > REMEMBERED:
                seen.clear()
                telling_.clear()
        return p

    return score


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows ``doc_id, p_low_quality, p_toxic, toxic``, one per row of ``docs(doc_id, text, ...)``.

    ``toxic`` is whether p_toxic reaches the cutoff, chosen on out-of-fold predictions. Null and empty texts have no
    features and get the models' base rate. Whole texts are scored. Repeated rows get a row each, rows without a doc_id
    too; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("toxicity", lambda: None)
        score = scorer(model.value)
        for batch in batches:
            for b in slices(batch, "text"):
                p = np.round(score(b.column("text").to_pylist()), 6)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= model.value["cutoff"])], names=["doc_id", "p_low_quality", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, p_low_quality double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the chain does not call toxic, with all their columns, whatever their names.

    Only texts go to Python, and only the 128-bit names of rejected texts come back; rows are dropped by an anti join,
    a broadcast one if the names are few enough. A null text is judged as an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        claim("toxicity", lambda: None)
        score = scorer(model.value)
        for batch in batches:
            for b in slices(batch, "text"):
                bad = np.round(score(b.column("text").to_pylist())[:, -1], 6) >= model.value["cutoff"]
                yield b.select(["one", "two"]).filter(pa.array(bad))

    text = F.coalesce(docs["text"], F.lit(""))
    name = [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    bad = docs.select(name[0].alias("one"), name[1].alias("two"), text.alias("text")).mapInArrow(run, "one long, two long")
    bad = bounded(bad.distinct())
    return docs.join(bad, (name[0] == bad["one"]) & (name[1] == bad["two"]), "left_anti")


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
