"""Toxicity categories by a chain of linear classifiers.

The chain predicts one category after the other; each model sees how often the document has each word (the logarithm of the count
and one) and the probabilities of the categories before it. While learning, these probabilities come from models that were
fitted without the document (out of fold), so that a later model learns how far an earlier one can be trusted; words and
terms of a fold are chosen without its documents, too.

Labels hold one mark, ``toxic``. The categories before it are derived from the learning rows alone: the words that
tell toxic rows from the others best are its terms; ``abusive`` marks toxic rows with a term, ``severe``
those with at least three different ones.

Words are runs of letters, A-Z lower-cased, hashed to 2^20 bins; the models see the ``width`` bins at most that tell the labels
apart best, by a two-sample z of ``least`` or more: fewer would be chance, among so many words. Learning reads a sample of at most about ``bound`` labelled documents that aren't held out. Defined
results: a null or empty text has no word and gets the chain's bias. Without both labels every probability
is 0. The cut of toxic is where unseen learning rows (out of fold) are told apart with the fewest errors; a tie counts as toxic. The result's row follows the input's row, repeated rows included;
other columns of the input aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import NOT_LETTERS, fold, learned_rows, sigmoid, steps, utf8, words

CHAIN = ("abusive", "severe", "toxic")
BITS = 20


def bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word bins of all texts, and where each text's begin."""
    raw, at = utf8(texts)
    word, _, _, of = words(raw, at, NOT_LETTERS)
    return (word >> np.uint64(64 - BITS)).astype(np.int64), of


def counted(found: np.ndarray, of: np.ndarray, place: np.ndarray, width: int, many: np.ndarray | None = None) -> np.ndarray:
    """Logarithm of one and how often each text has each chosen bin: texts by ``width``. ``place``: index of each bin, or -1; ``many``: counts of ``found``, else one each."""
    x = np.zeros((len(of) - 1, width), np.float32)
    index = place[found]
    hit = np.flatnonzero(index >= 0)
    np.add.at(x, (np.searchsorted(of, hit, side="right") - 1, index[hit]), 1 if many is None else many[hit])
    return np.log1p(x)


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by Newton's steps until the loss stays."""
    x = np.hstack([x.astype(float), np.ones((len(x), 1))])
    w, shrink = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, l2), 1e-9)
    loss = lambda w: np.mean(np.logaddexp(0, z := x @ w) - y * z) + (shrink * w * w).sum() / 2
    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(shrink), x.T @ (p - y) / len(y) + shrink * w)
        size = 1.0
        while (new := loss(w - size * step)) > now and size > 1e-9:
            size /= 2
        if now - new < 1e-10:
            break
        w, now = w - size * step, new
    return w[:-1], float(w[-1])


def pick(found: np.ndarray, of: np.ndarray, y: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The bins that tell the rows' labels apart best, and which of them are terms. ``found``: each row's bins, once each."""
    n1, n0 = max(1, y.sum()), max(1, len(y) - y.sum())
    mark = np.repeat(y, np.diff(of))
    a = np.bincount(found[mark == 1], minlength=1 << BITS)
    b = np.bincount(found[mark == 0], minlength=1 << BITS)
    p, q, all_ = a / n1, b / n0, (a + b) / len(y)
    apart = np.where(a + b >= 3, (p - q) / np.sqrt(np.maximum(all_ * (1 - all_), 1e-9) * (1 / n1 + 1 / n0)), 0)
    chosen = np.argsort(-np.abs(apart), kind="stable")[:width]
    chosen = chosen[np.abs(apart[chosen]) >= least]
    return chosen, (apart[chosen] > 8) & (p[chosen] > 5 * q[chosen])


class View:
    """Features of all rows, and the chain's targets, by the words that some rows choose."""

    def __init__(self, found: np.ndarray, of: np.ndarray, many: np.ndarray, y: np.ndarray, rows: np.ndarray, width: int, least: float) -> None:
        own = np.repeat(rows, np.diff(of))
        self.chosen, terms = pick(found[own], np.append(0, np.cumsum(np.diff(of)[rows])), y[rows], width, least)
        place = np.full(1 << BITS, -1, np.int32)
        place[self.chosen] = np.arange(len(self.chosen))
        self.x = counted(found, of, place, len(self.chosen), many)
        hits = (self.x[:, terms] > 0).sum(1) if terms.any() else np.zeros(len(y))
        self.target = {"abusive": y * (hits >= 1.0), "severe": y * (hits >= 3.0), "toxic": y.astype(float)}


def fit_chain(found: np.ndarray, of: np.ndarray, many: np.ndarray, y: np.ndarray, part: np.ndarray, width: int, least: float) -> tuple[View, dict, np.ndarray]:
    """The view and models of all rows, and each row's probabilities by models, words and terms that didn't see its ``part``."""
    everything = np.ones(len(y), bool)
    whole = View(found, of, many, y, everything, width, least)
    folds = [(part == k, View(found, of, many, y, part != k, width, least)) for k in np.unique(part)] if len(np.unique(part)) > 1 else []
    models, unseen = {}, np.zeros((len(y), 0), np.float32)
    for name in CHAIN:
        out = np.zeros(len(y), np.float32)
        for own, view in folds:
            seen = np.hstack([view.x, unseen])
            w, bias = fit(seen[~own], view.target[name][~own])
            out[own] = sigmoid(seen[own] @ w + bias)
        models[name] = fit(np.hstack([whole.x, unseen]), whole.target[name])
        unseen = np.hstack([unseen, out[:, None]])
    return whole, models, unseen


def learn(docs: DataFrame, labels: DataFrame, bound: int = 6000, width: int = 1024, least: float = 5.0, folds: int = 3) -> dict | None:
    """The chain's models from a bounded sample of labelled documents; None without both labels."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                found, of = bins(part.column("text"))
                own = [np.unique(found[of[k] : of[k + 1]], return_counts=True) for k in range(part.num_rows)]
                packed = (pa.array([x[i].astype(np.int32).tobytes() for x in own], pa.binary()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *packed], ["doc_id", "toxic", "bins", "many"])

    sample = learned_rows(docs, labels.where("toxic in (0, 1)").select("doc_id", "toxic"), bound, "toxic")
    got = sample.selectExpr("cast(doc_id as bigint) doc_id", "cast(toxic as int) toxic", "text").mapInArrow(extract, "doc_id long, toxic int, bins binary, many binary").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    y = got["toxic"].to_numpy(dtype=int)
    if len(set(y)) < 2:
        return None
    rows = [np.frombuffer(b, np.int32) for b in got["bins"]]
    of = np.append(0, np.cumsum([len(r) for r in rows]))
    found = np.concatenate([*rows, np.zeros(0, np.int32)])
    many = np.concatenate([*(np.frombuffer(b, np.int32) for b in got["many"]), np.zeros(0, np.int32)])
    part = np.random.default_rng(5).integers(0, folds, len(y))
    view, models, unseen = fit_chain(found, of, many, y, part, width, least)
    return {"chosen": view.chosen, "models": models, "threshold": _threshold(unseen[:, -1], y)}


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where unseen rows are told apart with the fewest errors: between the two neighbouring probabilities."""
    order = np.argsort(p, kind="stable")
    errors = np.append(0, np.cumsum(y[order])) + np.append(np.cumsum((1 - y[order])[::-1])[::-1], 0)
    at = np.flatnonzero(errors == errors.min())
    at = int(at[len(at) // 2])
    low, high = (p[order[at - 1]] if at else 0.0), (p[order[at]] if at < len(p) else 1.0)
    return float(low + high) / 2


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, the probability of each category, score (that of toxic) and predicted (1: toxic) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = np.full(1 << BITS, -1, np.int32)
        if m:
            place[m["chosen"]] = np.arange(len(m["chosen"]))
        for batch in batches:
            for part in steps(batch, "text"):
                p = np.zeros((part.num_rows, len(CHAIN)), np.float32)
                if m:
                    x = counted(*bins(part.column("text")), place, len(m["chosen"]))
                    for k, name in enumerate(CHAIN):
                        w, bias = m["models"][name]
                        p[:, k] = sigmoid(x @ w[: x.shape[1]] + p[:, :k] @ w[x.shape[1] :] + bias)
                toxic = (p[:, -1] >= m["threshold"]) if m else np.zeros(part.num_rows, bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), *(pa.array(p[:, k].astype(float)) for k in (0, 1, 2)), pa.array(toxic.astype(np.int32))],
                    ["doc_id", "held_out", "p_abusive", "p_severe", "score", "predicted"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, p_abusive double, p_severe double, score double, predicted int")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that aren't held out, then score all."""
    return score(docs, learn(docs, labels))
