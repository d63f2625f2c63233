"""Documents that hold test items, by n-gram seeds and Smith-Waterman alignment.

A seed is a run of three words of a test item. All of them count, common ones too: how many documents hold a seed says
nothing about which of them an edited copy still has. Pairs of neighbouring words are seeds as well if they are rare, which is in at
most ``RARE`` items; a quarter of an item's rare pairs, and two at least, make a candidate, so that copies are found in which
no three words in a row are left. One pass finds the seeds in all documents; the passage around any seed
and the item are aligned word by word (Smith-Waterman), unless the passage lacks so many of the item's words that no alignment could
reach the score. The document holds the item if the alignment's score is at least ``least`` of what an unchanged copy would get.

Words are runs of letters, A-Z lower-cased: digits, punctuation and case don't matter. Test items are read in
blocks of at most ``BLOCK`` words, or one item id, each with its own pass, so that what the workers hold is bounded however large the benchmark is.

Defined results: one row for each document and item that it holds, with the best alignment; clean documents have none. A
null or empty text holds nothing; an item with fewer than three words is held by none. Texts of one item id are all looked
for, and give one row for a document. Ties of alignments go to the first passage. Rows that repeat give rows each, but an
item that repeats gives one. Other columns of the input aren't returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vaultspark.llm.common import NOT_LETTERS, mix, steps, utf8, words

SEED = 3
#: A pair of words in more items than this is no seed.
RARE = 8
#: Words of test items that are handled at once: about 50 MB on each worker.
BLOCK = 1_000_000
MATCH, MISMATCH, GAP = 2, -1, -1


def seeds(word: np.ndarray) -> np.ndarray:
    """Hashes of the runs of three words; the last two places, where no run starts, get 0."""
    out = np.zeros(len(word), np.uint64)
    if len(word) >= SEED:
        h = word[: len(word) - 2]
        for k in (1, 2):
            h = mix(h ^ (word[k : len(word) - 2 + k] + np.uint64(k)))
        out[: len(word) - 2] = h | np.uint64(1)
    return out


def pairs(word: np.ndarray) -> np.ndarray:
    """Hashes of the runs of two words, 0 at the last place."""
    out = np.zeros(len(word), np.uint64)
    if len(word) > 1:
        out[:-1] = mix(word[:-1] ^ (word[1:] + np.uint64(7))) | np.uint64(1)
    return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: its share of an unchanged copy's score, and the words of the passage it spans."""
    n = len(passage)
    steps_ = -GAP * np.arange(n + 1, dtype=np.int32)
    row, begin = np.zeros(n + 1, np.int32), np.arange(n + 1)
    best, span = 0, (0, 0)
    for w in item:
        down = row + GAP
        slant = np.zeros(n + 1, np.int32)
        slant[1:] = row[:-1] + np.where(passage == w, MATCH, MISMATCH).astype(np.int32)
        new = np.maximum(np.maximum(down, slant), 0)
        origin = np.where(new == 0, np.arange(n + 1), begin)
        from_slant = (new > 0) & (slant == new)
        origin[1:][from_slant[1:]] = begin[:-1][from_slant[1:]]
        lifted = new + steps_
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, np.arange(n + 1), 0))
        row = reach - steps_
        begin = np.where(row == 0, np.arange(n + 1), origin[source])
        top = int(row.argmax())
        if row[top] > best:
            best, span = int(row[top]), (int(begin[top]), top)
    return best / (MATCH * len(item)), *span


class Index:
    """Hashes of items, by which their places are found."""

    def __init__(self, found: list[np.ndarray]) -> None:
        owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
        place = np.concatenate([np.arange(len(x)) for x in found]) if found else owner
        h = np.concatenate([*found, np.zeros(0, np.uint64)])
        order = np.lexsort((place, owner, h))
        order = order[h[order] != 0]
        self.h, self.owner, self.place = h[order], owner[order], place[order]
        self.each = np.unique(self.h)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` and entries of the index that agree."""
        if not len(self.each):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.each[np.minimum(np.searchsorted(self.each, h), len(self.each) - 1)] == h)
        low, high = np.searchsorted(self.h, h[at]), np.searchsorted(self.h, h[at], side="right")
        many = high - low
        entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(at, many), entry


class Items:
    """A block of test items with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        raw, at = utf8(pa.array(texts, pa.string()))
        word, _, _, of = words(raw, at, NOT_LETTERS)
        self.ids, self.words = ids, [word[of[k] : of[k + 1]] for k in range(len(ids))]
        self.runs = Index([seeds(w) for w in self.words])
        two = [pairs(w) if len(w) >= SEED else w[:0] for w in self.words]
        each, items = np.unique(np.concatenate([*(np.unique(x) for x in two), np.zeros(0, np.uint64)]), return_counts=True)
        rare = [np.where(np.isin(x, each[items <= RARE]), x, np.uint64(0)) for x in two]
        self.pairs = Index(rare)
        self.need = np.array([max(2, len(np.unique(x[x > 0])) // 4) for x in rare], np.int64)

    def hits(self, word: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, item, place in ``word`` and place in the item of each seed hit that counts. ``of``: where each document's words begin."""
        out = []
        for index, h, size in ((self.runs, seeds(word), SEED), (self.pairs, pairs(word), 2)):
            at, entry = index.hits(h)
            doc = np.searchsorted(of, at, side="right") - 1
            inside = at + size <= of[doc + 1]
            at, entry, doc = at[inside], entry[inside], doc[inside]
            owner, place = index.owner[entry], index.place[entry]
            if index is self.pairs and len(at):
                both = doc * len(self.ids) + owner
                _, of_pair = np.unique(both, return_inverse=True)
                seen = np.unique(np.stack([of_pair, index.h[entry].astype(np.int64)]), axis=1)[0]
                enough = np.bincount(seen, minlength=of_pair.max() + 1)[of_pair] >= self.need[owner]
                doc, owner, at, place = doc[enough], owner[enough], at[enough], place[enough]
            out.append((doc, owner, at, place))
        doc, owner, at, place = (np.concatenate([x[i] for x in out]) for i in range(4))
        order = np.argsort(doc, kind="stable")
        return doc[order], owner[order], at[order], place[order]

    def held(self, word: np.ndarray, owner: np.ndarray, at: np.ndarray, place: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """Items that a document holds, from its seed hits: id, score and span in words, one for each id."""
        out: dict[int, tuple[int, float, int, int]] = {}
        for k in np.unique(owner):
            mine = owner == k
            item = self.words[k]
            where = at[mine] - place[mine]  # where the item would begin
            slack = max(4, len(item) // 2)
            order = np.argsort(where, kind="stable")
            where = where[order]
            groups = np.split(where, np.flatnonzero(np.diff(where) > slack) + 1)
            best = (0.0, 0, 0)
            for g in groups:
                start, stop = max(0, int(g[0]) - slack), min(len(word), int(g[-1]) + len(item) + slack)
                for s in range(start, stop, 8 * len(item)):  # long runs of hits in overlapping stretches
                    passage = word[s : min(stop, s + 10 * len(item))]
                    most = np.isin(item, passage).mean()  # a score is at most the share of the item's words that match
                    if most < least or most <= best[0]:
                        continue
                    got, a, b = align(item, passage)
                    if got > best[0]:
                        best = (got, s + a, s + b)
            if best[0] >= max(least, out.get(self.ids[k], (0, 0.0))[1]):
                out[self.ids[k]] = (self.ids[k], *best)
        return list(out.values())


def found(mine: Items, batch: pa.RecordBatch, least: float) -> list[tuple[int, int, float, int, int]]:
    """Row, item id, score and span of each item that a row's text holds."""
    word, _, _, of = words(*utf8(batch.column("text")), NOT_LETTERS)
    doc, owner, at, place = mine.hits(word, of)
    edges, out = np.searchsorted(doc, np.arange(batch.num_rows + 1)), []
    for k in np.unique(doc):
        own = slice(edges[k], edges[k + 1])
        out += [(int(k), *x) for x in mine.held(word[of[k] : of[k + 1]], owner[own], at[own] - of[k], place[own], least)]
    return out


def _block(docs: DataFrame, items: Items, least: float) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(items)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = index.value
        for batch in batches:
            for part in steps(batch, "text"):
                if out := found(mine, part, least):
                    ids = part.column("doc_id").to_pylist()
                    kinds = (pa.int64(), pa.float64(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x[0]] for x in out], pa.int64()), *(pa.array([x[i + 1] for x in out], t) for i, t in enumerate(kinds))], ["doc_id", "item_id", "score", "first_word", "last_word"])

    return docs.mapInArrow(find, "doc_id long, item_id long, score double, first_word int, last_word int")


def blocks(items: DataFrame) -> Iterator[Items]:
    """Test items in blocks of bounded size, all texts of an id in one; null items and ids are left out, repeated ones count once."""
    ids, texts, size = [], [], 0
    rows = items.selectExpr("cast(item_id as bigint) item_id", "text").where("item_id is not null and text is not null").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if size + len(row["text"]) > 5 * BLOCK and ids and row["item_id"] != ids[-1]:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += len(row["text"])
    if ids:
        yield Items(ids, texts)


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score and the words it spans (first, after the last) of each document and item that it holds."""
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    parts = [_block(docs, block, least) for block in blocks(items)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word int, last_word int")
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that hold no item, in one pass for all blocks, each row by its own text."""

    def without(block: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        index = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in steps(batch, "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in found(index.value, part, least)]] = False
                    yield part.filter(pa.array(keep))

        return run

    for block in blocks(items):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs
