"""Toxicity categories by a chain of linear classifiers.

The categories are predicted one after the other. Each is a logistic model with
an L1 penalty over the presence of words and word beginnings, and over the
log-odds that the models before it gave. For training, those come from models
that didn't see the row (out of fold); for scoring, from the models fitted on
all rows. The decision is the last category's.

Models are fitted on the driver on at most SAMPLE labelled documents, those
whose ids have the smallest hashes, and on the FEATURES features of the clearest
connection with the category among those that RARE documents have at least.
Scoring is one pass over all documents that
shuffles nothing. Features are 32-bit hashes.

Defined results: a null or empty text has no features, so it gets the
intercepts' probabilities. Labels: of repeated ids the largest counts, null ids
and null labels don't; of documents with the same id that with the smallest
hash trains; a category with no labels, or only one value of them,
gets the smoothed share of positives, so that without labels nothing is
rejected. Rows count for themselves, so
repeated rows get equal scores. Other columns are ignored by ``score`` and kept
by ``drop_toxic``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import kernels as K

#: Labelled documents used for training, at most.
SAMPLE = 6000
#: Category and the SQL of its label, in the chain's order; the last decides.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"))
BEGINNINGS = (3, 4, 5, 6)
FOLDS = 3
FEATURES = 4096
RARE = 3
L1 = 2e-4
STEPS = 200
DECISION = 0.5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), with repetitions."""
    t = K.tokenise(texts)
    doc, key = [t.doc], [t.h]
    for n in BEGINNINGS:
        long = t.end - t.start > n
        start = t.start[long]
        doc.append(t.doc[long])
        key.append(K.mix(t.span_hash(start, start + n) + np.uint64(n)))
    return np.concatenate(doc), (np.concatenate(key) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Linear:
    keys: np.ndarray  # sorted
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(row: np.ndarray, col: np.ndarray, keys: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> Linear:
    """L1-penalised logistic regression by accelerated proximal steps. row, col: places of the ones; earlier: dense columns."""
    n = len(y)
    share = (y.sum() + 1) / (n + 2)
    none = Linear(np.zeros(0, np.uint32), np.zeros(0), np.zeros(earlier.shape[1]), float(logit(np.array([share]))[0]))
    if n == 0 or y.min() == y.max():
        return none
    df = np.bincount(col, minlength=len(keys))
    pull = np.bincount(col, weights=(y - y.mean())[row], minlength=len(keys))
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(df >= RARE, np.abs(pull) / np.sqrt(df * (1 - df / (n + 1))), 0)
    chosen = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    chosen = chosen[z[chosen] > 0]
    new = np.full(len(keys), -1)
    new[chosen] = np.arange(len(chosen))
    keep = new[col] >= 0
    row, col = row[keep], new[col[keep]]
    m, k = len(chosen), earlier.shape[1]
    weight = np.where(y > 0, np.sqrt((n - y.sum()) / y.sum()), 1.0)  # the rarer side counts more
    weight *= n / weight.sum()

    def times(w):
        return np.bincount(row, weights=w[col], minlength=n) + earlier @ w[m : m + k] + w[-1]

    def back(r):
        return np.concatenate([np.bincount(col, weights=r[row], minlength=m), earlier.T @ r, [r.sum()]]) / n

    v = np.ones(m + k + 1)
    for _ in range(15):  # the largest eigenvalue bounds the step
        v = back(weight * times(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (0.25 * size * 1.05 + 1e-9)
    w = np.zeros(m + k + 1)
    w[-1] = np.log(share / (1 - share))
    ahead, t = w.copy(), 1.0
    for _ in range(STEPS):
        g = ahead - step * back(weight * (sigmoid(times(ahead)) - y))
        shrunk = np.sign(g) * np.maximum(np.abs(g) - step * L1, 0)
        shrunk[m:] = g[m:]
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = shrunk + (t - 1) / u * (shrunk - w), shrunk, u
    live = np.flatnonzero(w[:m])
    return Linear(keys[chosen[live]], w[live], w[m : m + k].copy(), float(w[-1]))


def predict(model: Linear, row: np.ndarray, key: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    """Probabilities; (row, key) without repetitions."""
    at = K.lookup(model.keys, key)
    hit = at >= 0
    z = np.bincount(row[hit], weights=model.weights[at[hit]], minlength=len(earlier)) if len(model.keys) else np.zeros(len(earlier))
    return sigmoid(z + earlier @ model.earlier + model.intercept)


def fit_chain(row: np.ndarray, key: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """Models of all categories. labels: a column each, NaN where unknown; (row, key) without repetitions."""
    keys, col = np.unique(key, return_inverse=True)
    earlier = np.zeros((len(labels), 0))
    models = []
    for y in labels.T:
        known = ~np.isnan(y)

        def train(on, y=y, earlier=earlier):
            place = np.cumsum(on) - 1
            own = on[row]
            return fit(place[row[own]], col[own], keys, earlier[on], y[on])

        models.append(train(known))
        unseen = predict(models[-1], row, key, earlier)
        for f in range(FOLDS):
            held = known & (fold == f)
            if held.any() and (known & ~held).any():
                unseen[held] = predict(train(known & ~held), row, key, earlier)[held]
        earlier = np.column_stack([earlier, logit(unseen)])
    return models


def once(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((doc.astype(np.uint64) << np.uint64(32)) | key)
    return (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)


def train(documents: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> list[Linear]:
    """The chain's models, from the labelled documents (at most sample of them)."""
    names = [name for name, _ in chain]
    values = [F.expr(sql).cast("double").alias(f"y{i}") for i, (_, sql) in enumerate(chain)]
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), *values)
    known = known.groupBy("id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))))
    known = known.where(F.coalesce(*(F.col(f"y{i}") for i in range(len(names)))).isNotNull()).orderBy(F.xxhash64("id"), "id").limit(sample)

    def gather(batches):
        for batch in batches:
            for part in K.chunks(batch):
                doc, key = once(*features(part.column("text")))
                cuts = np.searchsorted(doc, np.arange(part.num_rows + 1))
                blobs = [key[cuts[i] : cuts[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.record_batch([*(part.column(c) for c in part.schema.names if c != "text"), pa.array(blobs, pa.binary())], [*(c for c in part.schema.names if c != "text"), "keys"])

    ys = [f"y{i}" for i in range(len(names))]
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("pick"))
    rows = docs.join(F.broadcast(known), "id")  # the sample's size bounds what is broadcast
    rows = rows.groupBy("id", *ys).agg(F.min_by("text", "pick").alias("text"))  # of rows that share an id one trains
    table = rows.mapInArrow(gather, ", ".join(["id long", *(f"{y} double" for y in ys), "keys binary"])).toArrow()
    ids = table["id"].to_numpy()
    one = np.argsort(ids)
    blobs = table["keys"].combine_chunks() if table.num_rows else pa.array([], pa.binary())
    keys = [np.frombuffer(blobs[int(i)].as_buffer(), np.uint32) for i in one]
    row = np.repeat(np.arange(len(one)), [len(k) for k in keys]).astype(np.int64)
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint32)
    y = np.column_stack([table[c].to_numpy()[one] for c in ys]) if len(one) else np.zeros((0, len(ys)))
    fold = (K.mix(ids[one].astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    return fit_chain(row, key, y, fold)


class Scorer:
    def __init__(self, models: list[Linear]):
        self.models = models
        self.keys = np.unique(np.concatenate([m.keys for m in models]))
        self.mask = np.zeros(1 << 20, bool)
        self.mask[self.keys & np.uint32((1 << 20) - 1)] = True

    def __call__(self, texts: pa.Array) -> np.ndarray:
        """A column of probabilities for each category."""
        doc, key = features(texts)
        likely = self.mask[key & np.uint32((1 << 20) - 1)]
        row, key = once(doc[likely], key[likely])
        earlier = np.zeros((len(texts), 0))
        out = []
        for model in self.models:
            out.append(predict(model, row, key, earlier))
            earlier = np.column_stack([earlier, logit(out[-1])])
        return np.column_stack(out)


def score(documents: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_<category>..., is_toxic) of every document."""
    scorer = Scorer(train(documents, labels, chain, sample))
    columns = [f"p_{name}" for name, _ in chain]

    def run(batches):
        for batch in batches:
            for part in K.chunks(batch):
                p = scorer(part.column("text"))
                yield pa.record_batch([part.column("doc_id"), *map(pa.array, p.T), pa.array(p[:, -1] > DECISION)], ["doc_id", *columns, "is_toxic"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} double" for c in columns), "is_toxic boolean"]))


def drop_toxic(documents: DataFrame, labels: DataFrame, chain=CHAIN, sample: int = SAMPLE) -> DataFrame:
    """The documents that the chain doesn't reject."""
    scorer = Scorer(train(documents, labels, chain, sample))
    return K.filtered(documents, lambda: lambda texts: scorer(texts)[:, -1] <= DECISION)
