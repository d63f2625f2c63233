"""Document quality by a Bradley-Terry ranking of preference pairs.

Pairs of a document labelled 1 and one labelled 0 are preferences. The strength of a document is linear in its
features, and the weights minimise the logistic loss on feature differences. The cut between good
and poor is a quantile of the strengths of all labelled documents that aren't held out: the share of
label 0 among them. A logistic curve through the cut, where it gives 0.7, turns strengths into scores.

Features are the shares of three neighbouring character classes and some rates over words; they come from
bytes alone, so that script and language matter little.

The weights are learned on a sample of about ``bound`` labelled documents that aren't held out, the cut on all of them. Defined results: a null or
empty text gets the score of a text without any characters. If no pair can be formed, every score is 0.5.
The result's row follows the input's row, repeated rows included; other columns of the input aren't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import fold, known_labels, learned_rows, sigmoid, steps, utf8, words, written

CUT = 0.7

#: Class of each byte: other ASCII signs, space, newline, digit, lower, upper, above ASCII, full stop, comma, ! or ?, bar, quote or dash.
_CLASS = np.zeros(256, np.int32)
_CLASS[[9, 11, 12, 13, 32]] = 1
_CLASS[10] = 2
_CLASS[48:58] = 3
_CLASS[97:123] = 4
_CLASS[65:91] = 5
_CLASS[128:] = 6
for _k, _signs in ((7, b"."), (8, b","), (9, b"!?"), (10, b"|"), (11, b"'\"-")):
    _CLASS[list(_signs)] = _k
KINDS = 12
RATES = 7


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    raw, at = utf8(texts)
    out = np.zeros((len(texts), KINDS**3 + RATES), np.float32)
    c = _CLASS[raw]
    three = (c[:-2] * KINDS + c[1:-1]) * KINDS + c[2:] if len(c) > 2 else np.zeros(0, np.int32)
    word, start, end, of = words(raw, at)
    size = end - start
    for k in range(len(texts)):
        n = at[k + 1] - at[k]
        own = three[at[k] : max(at[k], at[k + 1] - 2)]
        if len(own):
            out[k, : KINDS**3] = np.sqrt(np.bincount(own, minlength=KINDS**3) / len(own))
        w = word[of[k] : of[k + 1]]
        if len(w):
            each, count = np.unique(w, return_counts=True)
            pairs = len(np.unique(w[:-1] + w[1:] * np.uint64(3))) / (len(w) - 1) if len(w) > 1 else 1.0
            out[k, KINDS**3 :] = (
                len(each) / len(w), pairs, (w[1:] == w[:-1]).mean() if len(w) > 1 else 0,
                count.max() / len(w), min(size[of[k] : of[k + 1]].mean(), 40) / 10, np.log1p(len(w)) / 5, np.log1p(n) / 5,
            )
    return out


def rank(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 250, rate: float = 0.05, seed: int = 7) -> np.ndarray:
    """Weights that make preferred rows (y 1) strong against the others, by Adam on fresh pairs each round."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    draw = np.random.default_rng(seed)
    for k in range(1, rounds + 1):
        a, b = draw.choice(good, 4 * len(x)), draw.choice(poor, 4 * len(x))
        strength = x @ w.astype(x.dtype)
        off = sigmoid(strength[b] - strength[a])  # the chance the model gives to the wrong order
        pull = np.bincount(b, off, len(x)) - np.bincount(a, off, len(x))
        g = x.T @ pull.astype(x.dtype) / len(a) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def learn(docs: DataFrame, labels: DataFrame, bound: int = 5000) -> dict | None:
    """Weights from a bounded sample of labelled documents; None if no pair can be formed."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                rows = features(part.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("quality"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "x"]
                )

    sample = learned_rows(docs, labels.where("quality in (0, 1)").select("doc_id", "quality"), bound, "quality")
    got = sample.selectExpr("cast(doc_id as bigint) doc_id", "cast(quality as int) quality", "text").mapInArrow(extract, "doc_id long, quality int, x binary").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    y = got["quality"].to_numpy(dtype=int)
    if len(set(y)) < 2:
        return None
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    mean, spread = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / spread
    w = rank(x, y)
    return {"w": (w / spread).astype(np.float32), "shift": float((mean / spread) @ w)}


def strengths(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out and strength of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                strength = (features(part.column("text")) @ m["w"]).astype(float) - m["shift"]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(strength)], ["doc_id", "held_out", "strength"])

    return _rows(docs).mapInArrow(run, "doc_id long, held_out boolean, strength double")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")


def cut(rows: DataFrame, labels: DataFrame) -> tuple[float, float]:
    """Cut and scale of strengths (``rows``: doc_id, strength), from all labelled documents that aren't held out: one aggregate."""
    marks = known_labels(labels.where("quality in (0, 1)").selectExpr("cast(doc_id as bigint) doc_id", "cast(quality as int) quality"))
    grid = [k / 1000 for k in range(1001)]
    got = rows.select("doc_id", "strength").join(marks, "doc_id").agg(F.avg(1 - F.col("quality")), F.stddev_pop("strength"), F.percentile_approx("strength", grid, 100_000)).first()
    low, high = np.interp([max(0, got[0] - 0.01), min(1, got[0] + 0.01)], grid, got[2])
    return float((low + high) / 2), float(max(got[1], 1e-6))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.7 on) and strength of each document.

    Learn from the labels that aren't held out; the texts are read once more for the strengths, which are written, as the cut and the scores need both.
    """
    model = learn(docs, labels)
    if model is None:
        rows, z = _rows(docs).drop("text").withColumn("strength", F.lit(0.0)), F.lit(0.0)
    else:
        rows = written(strengths(docs, model), "strengths")
        middle, scale = cut(rows, labels)
        z = 2 * (F.col("strength") - middle) / scale + float(np.log(CUT / (1 - CUT)))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))))
    predicted = F.when(score >= CUT, 1).otherwise(0) if model is not None else F.lit(0)
    return rows.select("doc_id", "held_out", score.alias("score"), predicted.alias("predicted"), "strength")
