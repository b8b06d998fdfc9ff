"""Toxicity by a classifier chain: linear models for categories in sequence, each fed the earlier categories' probabilities.

Categories are conditions on the columns of the labels, in the order of the chain. Features are words and the beginnings of words (so
that stems of invented or inflected forms count), present or not, plus a few ratios of the text. The FEATURES most telling ones are
chosen, as many for each category, by their document frequencies under its labels; the counting is a Spark job over the sample. The
models are trained on a bounded sample of the labelled rows: SAMPLE of them at most (expected), even over the label patterns and weighted
back to their shares. Earlier probabilities enter training as out-of-fold predictions, so that later models see them as uncertain as they
will be; decision thresholds come from out-of-fold predictions as well. A fold's predictions come from features chosen and models fitted
without its rows. Scoring reads every document whole and is one narrow pass; what is sent to the executors has a fixed size.

Nulls: a null text has no features; rows of labels with a null id or label are left out. Repeated rows are scored one by one.
Without labelled rows of both kinds a category has the prior probability. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SLICE_BYTES, sliced, written

SAMPLE = 8_000
FEATURES = 2_000
FOLDS = 3
#: A category is set where its probability exceeds the threshold with the best F-score of this beta out of fold (below 1: precision counts more).
BETA = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 500_000
_SYMBOLS = "#*$%&|<>"
#: Characters looked at together, so that memory beside a long text stays small.
_BLOCK = 1 << 20
_UPPER = np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)


def word_features(piece: str) -> list[int]:
    """Hashes of the words in a piece of text and of their beginnings."""
    out = []
    for w in _WORD.findall(piece.lower()):
        out.append(xxhash.xxh3_64_intdigest("=" + w) >> 1)
        out += [xxhash.xxh3_64_intdigest("^" + w[:k]) >> 1 for k in range(3, min(7, len(w) + 1))]
    return out


def capitals(text: str) -> int:
    """How many characters of the text are upper case."""
    blocks = (text[k : k + _BLOCK].encode("utf-32-le", "surrogatepass") for k in range(0, len(text), _BLOCK))
    return sum(int(np.count_nonzero(_UPPER[np.frombuffer(b, "<u4")])) for b in blocks)


def ratios(text: str, pieces: list[str], distinct: int) -> list[float]:
    n = max(1, len(pieces))
    return [min(1.0, np.log1p(n) / 10), distinct / n, min(1.0, sum(map(text.count, _SYMBOLS)) / n), capitals(text) / max(1, len(text))]


N_RATIOS = 4


class Features:
    """Chosen features of a text, with what pieces of text have of them remembered up to a bound."""

    def __init__(self, chosen: Sequence[int]) -> None:
        self.place = {h: i for i, h in enumerate(chosen)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[float]]:
        text = text or ""
        pieces = text.split()
        own, known, found = set(pieces), self.known, set()
        for piece in own:
            has = known.get(piece)
            if has is None:
                has = tuple({self.place[h] for h in word_features(piece) if h in self.place})
                if len(known) >= _REMEMBERED:
                    known.clear()
                known[piece] = has
            if has:
                found.update(has)
        return sorted(found), ratios(text, pieces, len(own))


@dataclass
class Data:
    """Rows of chosen features in sparse form, with dense ratios and weights."""

    rows: np.ndarray
    columns: np.ndarray
    dense: np.ndarray
    weights: np.ndarray
    n_features: int


@dataclass
class Linear:
    sparse: np.ndarray
    dense: np.ndarray
    bias: float

    def logits(self, data: Data, dense: np.ndarray) -> np.ndarray:
        n = len(data.dense)
        return np.bincount(data.rows, self.sparse[data.columns], n)[:n] + dense @ self.dense + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(data: Data, dense: np.ndarray, y: np.ndarray, on: np.ndarray, steps: int = 200, penalty: float = 0.2) -> Linear:
    """Weighted logistic regression with an L2 penalty by accelerated gradient steps on the rows where ``on``."""
    n, k = len(y), dense.shape[1]
    w = np.where(on, data.weights, 0.0)
    total = max(w.sum(), 1e-12)
    model, prior = Linear(np.zeros(data.n_features), np.zeros(k), 0.0), np.clip((w * y).sum() / total, 1e-4, 1 - 1e-4)
    model.bias = float(np.log(prior / (1 - prior)))
    if not 0 < (w * y).sum() < total:
        return model
    # A bound of the curvature for each weight apart, so that rare features move as fast as common ones.
    per_row = w * (np.bincount(data.rows, minlength=n)[:n] + (dense**2).sum(axis=1) + 1)
    ridge = penalty / max(1, on.sum())
    curve = np.concatenate([np.bincount(data.columns, per_row[data.rows], data.n_features), (dense**2).T @ per_row, [per_row.sum()]])
    rate = 1 / (0.25 * curve / total + ridge)
    theta = np.concatenate([model.sparse, model.dense, [model.bias]])
    ahead, last = theta.copy(), theta.copy()
    for step in range(1, steps + 1):
        now = Linear(ahead[: data.n_features], ahead[data.n_features : -1], ahead[-1])
        error = w * (_sigmoid(now.logits(data, dense)) - y) / total
        gradient = np.concatenate([np.bincount(data.columns, error[data.rows], data.n_features), dense.T @ error, [error.sum()]])
        gradient[:-1] += ridge * ahead[:-1]
        theta = ahead - rate * gradient
        ahead = theta + (step / (step + 3)) * (theta - last)
        last = theta
    return Linear(theta[: data.n_features], theta[data.n_features : -1], float(theta[-1]))


@dataclass
class Chain:
    categories: list[str]
    chosen: list[int]  # features of the final models
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    out_of_fold: np.ndarray | None = None

    def predict(self, data: Data) -> np.ndarray:
        """Probabilities, one column for each category."""
        dense, out = data.dense, []
        for model in self.models:
            p = _sigmoid(model.logits(data, dense))
            out.append(p)
            dense = np.column_stack([dense, p])
        return np.column_stack(out)


def _only(data: Data, columns: np.ndarray) -> Data:
    """The data with the given columns alone, renumbered in their order."""
    place = np.full(data.n_features, -1)
    place[columns] = np.arange(len(columns))
    on = place[data.columns] >= 0
    return Data(data.rows[on], place[data.columns[on]], data.dense, data.weights, len(columns))


def train(chain: Chain, data: Data, labels: np.ndarray, folds: np.ndarray, own: list[np.ndarray]) -> Chain:
    """Fit the chain; ``labels`` has a column for each category, ``own`` the columns of each fold's features and last those of the final models."""
    dense, everything, held = data.dense, np.ones(len(labels), bool), []
    parts = [_only(data, columns) for columns in own]
    for k in range(labels.shape[1]):
        y, p = labels[:, k].astype(float), np.zeros(len(labels))
        for fold in range(FOLDS):
            out = folds == fold
            p[out] = _sigmoid(fit(parts[fold], dense, y, ~out).logits(parts[fold], dense))[out]
        chain.models.append(fit(parts[-1], dense, y, everything))
        chain.thresholds.append(_threshold(p, y, data.weights))
        held.append(p)
        dense = np.column_stack([dense, p])
    chain.out_of_fold = np.column_stack(held)
    return chain


def _threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut with the best weighted F-score, in the middle of the gap it falls into."""
    if not 0 < y.sum() < len(y):
        return 1.0
    order = np.argsort(-p, kind="stable")
    right, said, true = np.cumsum((w * y)[order]), np.cumsum(w[order]), (w * y).sum()
    best = int(np.argmax((1 + BETA**2) * right / (said + BETA**2 * true)))
    below = p[order[best + 1]] if best + 1 < len(p) else 0.0
    return float((p[order[best]] + below) / 2)


def conditions() -> dict[str, Column]:
    """Categories that the labels quality and toxic can tell: they hold no finer kinds of toxicity."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_and_low": toxic & low}


def _fold(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(11)), F.lit(FOLDS)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, size: int, categories: dict[str, Column]) -> DataFrame:
    """Written table of key, text, y (an array of 0 and 1), weight and fold: about ``size`` labelled rows, by a hash of the id.

    An id stands for one row, however often it is labelled or among the documents: the largest of its labels, and one of its texts by hash.
    """
    known = labels.select("doc_id", F.array(*[c.cast("int") for c in categories.values()]).alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & ~F.exists("y", lambda v: v.isNull())).groupBy("doc_id").agg(F.max("y").alias("y"))
    patterns = {tuple(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one for each label pattern
    each = max(1, size // max(1, len(patterns)))
    rate = F.lit(0.0)
    for y, n in patterns.items():
        rate = F.when(F.col("y") == F.array(*map(F.lit, y)), F.lit(min(1.0, each / n))).otherwise(rate)
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) * F.lit(2.0**-53)
    drawn = known.withColumn("rate", rate).where(u < F.col("rate"))
    drawn = written(drawn.select(F.col("doc_id").alias("key"), "y", F.try_divide(F.lit(1.0), F.col("rate")).alias("weight")), "drawn")
    body = docs.select(F.col(doc_id).alias("own_id"), F.col(text).alias("text"))
    met = body.join(F.broadcast(drawn), F.col("own_id") == F.col("key")).groupBy("key", "y", "weight").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return written(met.select("key", "text", "y", "weight", _fold(F.col("key")).alias("fold")), "sample")


def choose(rows: DataFrame, n: int, k: int) -> list[list[int]]:
    """For each fold, from the rows of the others, and last from all rows: the features that speak most for each of k categories, by the
    log-odds of their document frequencies in standard errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in sliced(batches, 0):
            for t, y, fold in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = np.fromiter({h for p in set((t or "").split()) for h in word_features(p)}, np.int64)
                held.append((own, sum(v << i for i, v in enumerate(y)), fold))
                size += own.nbytes
                if size > SLICE_BYTES:
                    yield _spread(held)
                    held, size = [], 0
        if held:
            yield _spread(held)

    def _spread(held: list[tuple]) -> pa.RecordBatch:
        lengths = [len(own) for own, _, _ in held]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([own for own, _, _ in held])), *(pa.array(np.repeat([x[c] for x in held], lengths).astype(np.int32)) for c in (1, 2))], names=["h", "y", "fold"])

    says = lambda y, i: F.shiftright(y, i).bitwiseAND(F.lit(1))
    counted = rows.select("text", "y", "fold").mapInArrow(run, "h bigint, y int, fold int")
    sums = [F.sum((F.col("fold") == f).cast("int") * (F.lit(1) if i < 0 else says(F.col("y"), i))).alias(f"f{f}_{i}") for f in range(FOLDS) for i in range(-1, k)]
    counted = counted.groupBy("h").agg(*sums)
    counted = written(counted.where(sum(F.col(f"f{f}_-1") for f in range(FOLDS)) >= 5), "features")
    sizes = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("-1"), *[F.sum(F.col("y")[i]).alias(str(i)) for i in range(k)]).collect()}  # a row for each fold
    out = []
    for left_out in [*range(FOLDS), None]:
        on = [f for f in range(FOLDS) if f != left_out]
        size = {i: sum(sizes[f][str(i)] for f in on if f in sizes) for i in range(-1, k)}
        count = {i: sum(F.col(f"`f{f}_{i}`") for f in on) for i in range(-1, k)}
        usable = [i for i in range(k) if 0 < size[i] < size[-1]]
        chosen: dict[int, None] = {}
        for i in usable:
            a, b = count[i], count[-1] - count[i]
            odds = F.ln((a + 0.5) / F.lit(size[i] + 1.0)) - F.ln((b + 0.5) / F.lit(size[-1] - size[i] + 1.0))
            top = counted.where(count[-1] >= 5).select("h", (odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))).alias("gain")).orderBy(F.desc("gain"), "h").limit(n // len(usable))
            chosen.update(dict.fromkeys(r["h"] for r in top.collect()))
        out.append([*chosen])
    return out


def _data(found: list[tuple[list[int], list[float]]], weights: np.ndarray, n_features: int) -> Data:
    rows = np.repeat(np.arange(len(found)), [len(f) for f, _ in found])
    columns = np.fromiter((c for f, _ in found for c in f), np.int64, len(rows))
    return Data(rows, columns, np.array([d for _, d in found], float).reshape(len(found), N_RATIOS), weights, n_features)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SAMPLE, n_features: int = FEATURES, categories: dict[str, Column] | None = None) -> Chain:
    """The chain for ``categories``, conditions on the labels' columns by name; by default those of ``conditions``."""
    categories = categories or conditions()
    rows = sample(docs, labels, doc_id, text, size, categories)
    lists = choose(rows, n_features, len(categories))
    union = [*dict.fromkeys(h for own in lists for h in own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(union)
        for batch in sliced(batches, 1):
            found = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([d for _, d in found], pa.list_(pa.float64())), *batch.columns[2:]],
                names=["key", "columns", "dense", "y", "weight", "fold"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    drawn = rows.mapInArrow(run, f"key {kind}, columns array<int>, dense array<double>, y array<int>, weight double, fold int")
    drawn = sorted(drawn.collect(), key=lambda r: (str(r["key"]), r["columns"]))  # bounded by the sample
    chain = Chain([*categories], lists[-1])
    if not drawn:
        chain.models = [Linear(np.zeros(0), np.zeros(N_RATIOS + k), -35.0) for k in range(len(categories))]
        chain.thresholds = [1.0] * len(categories)
        return chain
    data = _data([(r["columns"], r["dense"]) for r in drawn], np.array([r["weight"] for r in drawn]), len(union))
    place = {h: i for i, h in enumerate(union)}
    own = [np.array([place[h] for h in x], np.int64) for x in lists]
    return train(chain, data, np.array([r["y"] for r in drawn]), np.array([r["fold"] for r in drawn]), own)


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, p_<category> and, for each category, whether it is set."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = chain.categories

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        features = Features(chain.chosen)
        for batch in sliced(batches, 1):
            data = _data([features(t) for t in batch.column(1).to_pylist()], np.ones(batch.num_rows), len(chain.chosen))
            p = chain.predict(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(len(names))), *(pa.array(p[:, k] > chain.thresholds[k]) for k in range(len(names)))], names=["doc_id", *(f"p_{n}" for n in names), *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join([*(f"p_{n} double" for n in names), *(f"{n} boolean" for n in names)]))
