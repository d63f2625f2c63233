"""What the text operators share: tables, scratch storage, Arrow buffers, word hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.sources.scratch import bucketed, rested, scope, swept, written  # noqa: F401

#: A-Z and their lower case, for the contracts that fold only these.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one numpy step handles at most, unless a single text is longer.
STEP_BYTES = 1 << 18


#: Rows that an executor hands to its Python worker at once: texts may be long, and workers keep what they once took.
BATCH_ROWS = 500


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def ready(spark: SparkSession) -> None:
    """Before a stage: bounded Arrow batches, and nothing held any more of the stages before."""
    bounded(spark)
    swept(spark)
    rested(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows with 2 are held out of all learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def lower_az(text: Column) -> Column:
    """Lower case of A-Z alone. Where every character is one byte, lower() does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text, so that memory follows the slice."""
    _, at = utf8(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        stop = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
        stop = min(rows, max(stop, start + 1))
        yield batch.slice(start, stop - start)
        start = stop


def known_labels(labels: DataFrame) -> DataFrame:
    """Labels of documents that aren't held out. Those of one document that differ or repeat count once, as their largest."""
    named = [c for c in labels.columns if c != "doc_id"]
    return labels.where(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in named])


def learned_rows(docs: DataFrame, labels: DataFrame, bound: int, seed: str) -> DataFrame:
    """A sample of about ``bound`` labelled documents, none held out; the same rows on every run."""
    labels = known_labels(labels)
    there = max(1, labels.count())
    part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(1.0, bound / there) * (1 << 30))
    return docs.select("doc_id", "text").join(labels.where(part), "doc_id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit. Works on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


#: For ``words``: everything in ASCII but letters parts words.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[128:] = False
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = False


def words(raw: np.ndarray, at: np.ndarray, parting: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, or what else ``parting`` bytes leave, A-Z lower-cased.

    Returns a 64-bit hash for each word, its first byte and the byte after its last (in ``raw``),
    and, for each text, the index of its first word (one entry more than texts).
    """
    space = parting[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a word can't run on into the next text
    edge[at] = True
    solid = ~space
    first = solid.copy()
    if len(raw):
        first[1:] &= space[:-1] | edge[1:-1]
    last = solid
    if len(raw):
        last[:-1] &= space[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    of = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, of
    return span_hashes(raw, starts, ends), starts, ends, of


#: Spans longer than this are hashed one by one.
_LONG = 256


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z lower-cased: eight bytes after the other are mixed in, so that no sums of places can cancel."""
    size = ends - starts
    h = mix(size.astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F))
    if not len(starts):
        return h
    blocks = np.zeros((len(raw) + 31) // 8, np.uint64)
    blocks.view(np.uint8)[: len(raw)] = _FOLD[raw]
    here = np.flatnonzero((size > 0) & (size <= _LONG))
    at, left = starts[here], size[here]
    while len(here):
        low = (at & 7).astype(np.uint64) << np.uint64(3)
        block = blocks[at >> 3] >> low
        high = np.flatnonzero(low)
        block[high] |= blocks[(at[high] >> 3) + 1] << (np.uint64(64) - low[high])
        short = np.flatnonzero(left < 8)
        block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        h[here] = mix(h[here] ^ block)
        more = left > 8
        here, at, left = here[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(_FOLD[raw[starts[k] : ends[k]]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(word: np.ndarray, of: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words in each text, and where each text's runs start.

    A text with fewer words, but at least one, has one run: the whole sequence, marked by its length.
    """
    n_words = np.diff(of)
    n_runs = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(n_words.dtype))
    start = np.zeros(len(of), np.int64)
    np.cumsum(n_runs, out=start[1:])
    total = int(start[-1])
    if not total:
        return np.zeros(0, np.uint64), start
    place = np.arange(total) - np.repeat(start[:-1], n_runs) + np.repeat(of[:-1], n_runs)
    left = np.repeat(of[1:], n_runs) - place
    out = np.zeros(total, np.uint64)
    for k in range(size):
        has = left > k
        h = np.where(has, word[np.minimum(place + k, len(word) - 1)], np.uint64(0))
        out = mix(out ^ (h + np.uint64(k + 1)))
    return out, start
