"""Lines that repeat across documents, found with two Bloom filters.

One filter holds the line keys seen in a document, the other those seen in a second one. Tasks build both for
their rows; merging takes a key that two tasks have seen once as seen twice, by the bits that their first filters
share. Bits are only ever set, so a key in two documents is always in the merged second filter. Only lines in
it, the suspects, are shuffled: their keys are compared as text, and the least document of each repeated key keeps its lines.
The filters are sized by the number of lines, ``PER_LINE`` bits for each; what workers hold of them is at most ``MOST_BITS`` bits. Inputs
with more lines than that serves count the 64-bit hashes themselves in place of filters: summed before they are dealt, by hash,
they name the suspects just as well, and each document is given its own. Either way results are exact.

Defined results: a null or empty text is one empty line. A key with fewer than ``least`` code points is never dropped. If
all lines are dropped the kept text is empty. Rows that share a doc_id are one document when holders of a key are
counted, and each row keeps its own lines; a null doc_id holds no key and loses no line. Other columns of the input aren't returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import LOWER, UPPER, mix, span_hashes, steps, utf8, written
from vaultspark.llm.tables import merged, packed, unpacked

#: Bits of a filter for each line; of one slice of a filter; of a filter at most, which is 32 MB.
PER_LINE, SLICE, MOST_BITS = 8, 1 << 19, 1 << 28
SPACES = " \t\n\v\f\r"
_FOLD_AZ = str.maketrans(UPPER, LOWER)
_SOLID = np.ones(256, bool)
_SOLID[list(SPACES.encode())] = False


def lines(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line hashes of all texts (0 where the key is shorter than ``least``), and where each text's lines start; third: their spans."""
    raw, at = utf8(texts)
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(texts)), np.searchsorted(at, breaks, side="right") - 1])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    of = np.searchsorted(owner, np.arange(len(texts) + 1))
    ends = np.append(starts[1:] - 1, len(raw))
    last = of[1:] - 1
    ends[last] = at[1:]
    solid = np.flatnonzero(_SOLID[raw])
    if not len(solid):
        return np.zeros(len(starts), np.uint64), of, np.stack([starts, starts])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    blank = (i >= len(solid)) | (j < i)
    first = np.where(blank, starts, solid[np.minimum(i, len(solid) - 1)])
    after = np.where(blank, starts, solid[np.maximum(j, 0)] + 1)
    points = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=points[1:])
    h = span_hashes(raw, first, after)
    h[points[after] - points[first] < least] = 0
    return h, of, np.stack([first, after])


def places(h: np.ndarray, size: int) -> np.ndarray:
    """The two bits of each hash in a filter of ``size`` bits; both lie in the same slice."""
    slice_ = (h >> np.uint64(32)) % np.uint64(size // SLICE)
    one, two = h % np.uint64(SLICE), mix(h) % np.uint64(SLICE)
    return np.stack([slice_ * np.uint64(SLICE) + one, slice_ * np.uint64(SLICE) + two]).astype(np.int64)


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = places(h, 8 * len(bits))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def put(bits: np.ndarray, h: np.ndarray) -> None:
    at = places(h, 8 * len(bits)).ravel()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def filter_size(docs: DataFrame) -> int:
    """Bits for all lines of ``docs``: a power of two, one slice at least."""
    n = docs.agg(F.sum(1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))).first()[0] or 0
    return max(SLICE, 1 << (PER_LINE * n - 1).bit_length()) if n else SLICE


def _each(part: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Line hashes that count, and their rows: each hash of a row once, by hash and row."""
    h, of, _ = lines(part.column("text"), least)
    owner = np.repeat(np.arange(len(of) - 1), np.diff(of))
    keep = h != 0
    h, owner = h[keep], owner[keep]
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[fresh], owner[fresh]


def seen_twice(docs: DataFrame, least: int, size: int) -> np.ndarray:
    """The second filter over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(size // 8, np.uint8), np.zeros(size // 8, np.uint8)
        for batch in batches:
            for part in steps(batch, "text"):
                each, count = np.unique(_each(part, least)[0], return_counts=True)
                put(twice, each[(count > 1) | has(once, each)])
                put(once, each)
        if once.any():
            for k in np.flatnonzero(once.reshape(-1, SLICE // 8).any(1)):
                at = slice(k * SLICE // 8, (k + 1) * SLICE // 8)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(np.concatenate([once[at], twice[at]]))], pa.binary())], ["slice", "payload"])

    def join(payloads: Iterator[bytes]) -> bytes:
        total = np.zeros(2 * SLICE // 8, np.uint8)
        once, twice = total[: SLICE // 8], total[SLICE // 8 :]
        for p in payloads:
            x = unpacked(p, np.uint8)
            twice |= x[SLICE // 8 :] | (once & x[: SLICE // 8])
            once |= x[: SLICE // 8]
        return packed(total)

    parts = docs.select("text").mapInArrow(run, "slice int, payload binary")
    out = np.zeros(size // 8, np.uint8)
    for row in merged(parts, join, docs.rdd.getNumPartitions()).toLocalIterator():  # 32 MB at most
        out[row["slice"] * SLICE // 8 : (row["slice"] + 1) * SLICE // 8] = unpacked(row["payload"], np.uint8)[SLICE // 8 :]
    return out


def with_suspects(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` (doc_id, text) with ``hashes``: those of its lines that another document has as well. For inputs beyond any filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                h, owner = _each(part, least)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(h.astype(np.int64))], ["doc_id", "hash"])

    each = docs.where("doc_id is not null").mapInArrow(run, "doc_id long, hash long")
    twice = each.groupBy("hash").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high").select("hash")
    own = each.join(written(twice, "twice"), "hash").groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    return docs.join(own, "doc_id", "left")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(docs: DataFrame, least: int = 10, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 and kept_text (null where it is the input's text) of each document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = filter_size(docs)
    if size <= most_bits:
        shared = docs.sparkSession.sparkContext.broadcast(seen_twice(docs.where("doc_id is not null"), least, size))
    else:
        shared, docs = docs.sparkSession.sparkContext.broadcast(None), with_suspects(docs, least)

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        kind = pa.list_(pa.struct([("line", pa.int32()), ("key", pa.string())]))
        for batch in batches:
            for part in steps(batch, "text"):
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                ids = part.column("doc_id").to_pylist()
                h, of, _ = lines(part.column("text"), least)
                if twice is not None:
                    doubt = (h != 0) & has(twice, h)
                else:
                    doubt = np.zeros(len(h), bool)
                    for k, own in enumerate(part.column("hashes").to_pylist()):
                        if own:
                            doubt[of[k] : of[k + 1]] = np.isin(h[of[k] : of[k + 1]], np.array(own, np.int64).astype(np.uint64))
                n, sha, kept, found = [], [], [], []
                for k, text in enumerate(texts):
                    n.append(int(of[k + 1] - of[k]))
                    own = np.flatnonzero(doubt[of[k] : of[k + 1]]) if ids[k] is not None else ()
                    if len(own):
                        split = text.split("\n")
                        found.append([{"line": int(i), "key": split[i].strip(SPACES).translate(_FOLD_AZ)} for i in own])
                        sha.append(None)
                        kept.append(text)
                    else:
                        found.append(None)
                        sha.append(_digest(text))
                        kept.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), pa.array(found, kind)],
                    ["doc_id", "n_lines", "kept_sha256", "text", "suspects"],
                )

    rows = docs.mapInArrow(suspect, "doc_id long, n_lines long, kept_sha256 string, text string, suspects array<struct<line:int,key:string>>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "lines")
    clean = rows.where("suspects is null").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"))
    doubt = rows.where("suspects is not null")
    each = doubt.select("row", "doc_id", F.inline("suspects"))
    repeated = each.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").drop("last")
    drop = each.join(written(repeated, "repeated"), "key").where("doc_id != first").groupBy("row").agg(F.collect_list("line").alias("drop"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                gone, kept = part.column("drop").to_pylist(), []
                for text, lost in zip(part.column("text").to_pylist(), gone, strict=True):
                    lost = set(lost or ())
                    kept.append("\n".join([x for i, x in enumerate(text.split("\n")) if i not in lost]) if lost else text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_lines"), pa.array([len(x or ()) for x in gone], pa.int64()), pa.array(map(_digest, kept), pa.string()),
                     pa.array([t if x else None for t, x in zip(kept, gone, strict=True)], pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
                )

    joined = doubt.select("row", "doc_id", "n_lines", "text").join(drop, "row", "left").drop("row")
    return clean.unionByName(joined.mapInArrow(remove, clean.schema))


ORACLE = """
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
r AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, r.first IS NOT NULL AND l.doc_id <> r.first AS gone FROM l LEFT JOIN r ON l.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
