"""Languages of documents, each taken as a mixture, by expectation-maximisation.

Learning counts the byte 4-grams of every labelled document that isn't held out, by language, in
hashed bins: one pass, summed before the shuffle. The table has 2^16 numbers of 4 bytes for each language that ``lang`` names,
whatever the number of documents. For a document, expectation-maximisation estimates the share of each language from the
likelihoods of its n-grams, each bin counted once with its number, so that a very long text needs no more than the table. Sets of the most likely languages, from one upwards, are compared by their
likelihood less a penalty for each language (BIC, with a factor, as neighbouring n-grams overlap); the
best set stays, and its largest share names the document.

Defined results: ``und`` with score 0 and no share where the text is null or has no letter, or where
nothing could be learned. A tie of shares goes to the first language by name. The result's row follows the
input's row, repeated rows included; other columns of the input aren't returned.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import fold, steps, utf8
from vaultspark.llm.tables import merged, packed, unpacked

BITS = 16
GRAM = 4

_CLASS = np.full(256, 32, np.uint32)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams of each text, spaces around it included, and where each text's begin."""
    padded = pc.binary_join_element_wise(pc.fill_null(column, ""), pa.scalar("  "), pa.scalar("  "))
    raw, at = utf8(pc.binary_join_element_wise(pa.scalar(""), padded, pa.scalar("  ")))
    c = _CLASS[raw]
    code = (c[:-3] << 24) | (c[1:-2] << 16) | (c[2:-1] << 8) | c[3:] if len(c) >= GRAM else np.zeros(0, np.uint32)
    bins = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    blank = (code == 0x20202020) if len(code) else np.zeros(0, bool)
    bins[blank] = -1
    return bins, at


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their log-likelihood of each bin (bins by languages)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                bins, at = grams(part.column("text"))
                langs = part.column("lang").to_pylist()
                owner = np.repeat(np.arange(len(langs)), np.diff(at))[: len(bins)]
                names = sorted(set(langs))
                lang = np.searchsorted(names, langs)[owner] if names else owner
                ok = bins >= 0
                got = np.bincount(lang[ok] * (1 << BITS) + bins[ok], minlength=len(names) << BITS).reshape(len(names), -1)
                for name, row in zip(names, got, strict=True):
                    found[name] = found[name] + row if name in found else row
        for name, row in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed(row.astype(np.int64))], pa.binary())], ["slice", "payload"])

    def add(payloads: Iterator[bytes]) -> bytes:
        total = np.zeros(1 << BITS, np.int64)
        for p in payloads:
            total += unpacked(p, np.int64)
        return packed(total)

    rows = docs.where((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = merged(rows.mapInArrow(count, "slice string, payload binary"), add, docs.rdd.getNumPartitions())
    table = {}
    for row in parts.toLocalIterator():  # one row for each language
        n = unpacked(row["payload"], np.int64) + 0.1
        table[row["slice"]] = np.log(n / n.sum()).astype(np.float32)
    langs = sorted(table)
    return langs, np.stack([table[x] for x in langs], 1) if langs else np.zeros((1 << BITS, 0), np.float32)


def shares(like: np.ndarray, start: np.ndarray, many: np.ndarray | None = None, rounds: int = 12, settled: float = 1e-3) -> tuple[np.ndarray, float]:
    """Language shares by expectation-maximisation from ``start``, and the log-likelihood they give. ``many``: how often each row counts, if not once. It ends when no share moves by ``settled``, or after ``rounds``."""
    many = np.ones(len(like), like.dtype) if many is None else many.astype(like.dtype)
    share, total = start, many.sum()
    for _ in range(rounds):
        new = share * (like.T @ (many / np.maximum(like @ share, 1e-30))) / total
        new /= new.sum()
        near = np.abs(new - share).max() < settled
        share = new
        if near:
            break
    return share, float(many @ np.log(np.maximum(like @ share, 1e-30)))


def mixture(like: np.ndarray, penalty: float, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the chosen languages, the largest share first, and their shares. ``like``: n-grams by languages, the best of each row 1."""
    k = like.shape[1]
    n = len(like) if many is None else int(many.sum())
    share, _ = shares(like, np.full(k, 1 / k, like.dtype), many)
    order = np.argsort(-share, kind="stable")
    best, chosen = -np.inf, None
    for m in range(1, k + 1):
        own = like[:, order[:m]]
        start = np.maximum(share[order[:m]], 1e-6)
        got, total = shares(own, start / start.sum(), many)
        total -= 0.5 * penalty * m * np.log(max(n, 2))
        if total <= best:
            break
        best, chosen = total, (order[:m], got)
    index, got = chosen
    by = np.lexsort((index, -got))
    return index[by], got[by]


def named(texts: pa.Array, langs: list[str], table: np.ndarray, penalty: float) -> list[tuple[str, float, str]]:
    """Language, its share and the shares of all chosen languages (JSON) of each text."""
    bins, at = grams(texts)
    lettered = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_pylist()
    out = []
    for k in range(len(texts)):
        own = bins[at[k] : at[k + 1] - GRAM + 1]
        own, many = np.unique(own[own >= 0], return_counts=True)
        if not (langs and lettered[k]) or not len(own):
            out.append(("und", 0.0, "{}"))
            continue
        like = table[own]
        like = np.exp(like - like.max(1, keepdims=True))
        index, got = mixture(like, penalty, many)
        out.append((langs[index[0]], float(min(1.0, got[0])), json.dumps({langs[i]: round(float(g), 4) for i, g in zip(index, got, strict=True)})))
    return out


def detect(docs: DataFrame, model: tuple[list[str], np.ndarray], penalty: float = 8.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score (its share) and shares (JSON of the chosen languages) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                out = named(part.column("text"), langs, table, penalty)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string())))],
                    ["doc_id", "held_out", "lang_pred", "score", "shares"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, shares string")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that aren't held out, then predict all."""
    return detect(docs, learn(docs))


def known(docs: DataFrame, penalty: float = 8.0) -> DataFrame:
    """The rows of ``docs`` whose own text is in a learned language."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                yield part.filter(pa.array([x[0] != "und" for x in named(part.column("text"), langs, table, penalty)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
