"""Encoding into the pieces of a SentencePiece model, and decoding, by Aho-Corasick and Viterbi.

An Aho-Corasick automaton over all pieces reads a text once. At each position its output links give
every piece that ends there; each relaxes that position (Viterbi). What a path costs depends on the kind of the model:

* Pieces with probabilities (unigram): the sum of the scores; the best path is the segmentation of the highest total score.
* Pieces with merge ranks (BPE): nothing for two neighbours that the merges leave side by side, and infinitely much for two that they would
  have joined or cut otherwise. Whether two pieces can be neighbours is found by merging them alone, and remembered. A path
  without cost is what the merges make of the text: a merge across a border of pieces only depends on the two pieces at
  it. So one piece at most can end a free path at a position, and it's the library's segmentation.

A character that is no piece is bridged, at less than the least score, by its byte pieces, or by the unknown piece
where the vocabulary has none.

Two exact shortcuts are proven from the vocabulary when it is loaded. A piece whose own string the model
cuts into other pieces is never part of a segmentation, so the automaton leaves it
out. Where no piece left holds two neighbouring characters together, every segmentation is cut between
them, so what lies between such cuts is encoded by itself. These parts repeat; their codes are
remembered up to a bound.

Defined results: null text is empty and has no piece. The normalisation is the one of models whose
rule is identity, which is checked on a probe: spaces become word marks and one mark is put in front. Decoding undoes both.
A word mark that a text itself holds is written with its byte pieces, so that it stays apart from a space; the library
takes it for one. So a text comes back exactly, whatever it holds, if the vocabulary has the byte pieces; ``decoded_ok``
says whether it did. Ties go to the longer last piece. Rows
that repeat are encoded each. Other columns of the input aren't returned.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Stands for a word mark of the text itself while it is encoded; no text can hold it.
OWN_MARK = "\ud800"
#: Added to the least score for the bridge over a character that is no piece.
BRIDGE = -10.0
#: Normalising this shows whether a model's rule is identity.
PROBE = "ﬁ  Å\tA\u0301 ① x"


class _Remembered(dict):
    """What ``make`` gives for a string, as the bytes of 32-bit numbers, kept for up to ``bound`` short strings: the younger half here, the older one aside, from where what is asked for again comes back."""

    def __init__(self, make: Callable[[str], list[int] | array], bound: int) -> None:
        self.make, self.half, self.older = make, bound // 2, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = array("i", self.make(text)).tobytes()
        if len(text) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class _Neighbours(dict):
    """Whether merges leave two pieces, numbered first * 2^24 + second, side by side; kept for up to ``bound`` pairs."""

    def __init__(self, model: Pieces, bound: int) -> None:
        self.model, self.bound = model, bound

    def __missing__(self, pair: int) -> bool:
        a, b = pair >> 24, pair & 0xFFFFFF
        if len(self) >= self.bound:
            self.clear()
        self[pair] = found = self.model.merged(self.model.pieces[a] + self.model.pieces[b]) == [a, b]
        return found


class Pieces:
    """A model's pieces; one for each file and process."""

    def __init__(self, path: str, remember: int = 300_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(PROBE) != MARK + PROBE.replace(" ", MARK):
            raise ValueError("the model's normalisation isn't the identity")
        self.pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.scores = [model.get_score(i) for i in range(len(model))]
        self.unknown = model.unk_id()
        self.bytes = {}
        usable = []
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usable.append((piece, i))
        self.lengths = [len(piece) for piece in self.pieces]
        self.raw = [piece.replace(MARK, " ").encode() for piece in self.pieces]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.singles = {piece for piece, _ in usable if len(piece) == 1}
        self.number = dict(usable)
        self.bridge = min(self.scores[i] for _, i in usable) + BRIDGE
        ranks = [self.scores[i] for piece, i in usable if len(piece) > 1]
        self.by_merges = all(r <= 0 and r == int(r) for r in ranks)
        self.neighbours = _Neighbours(self, 1_000_000)
        if self.by_merges:
            best = [(piece, i) for piece, i in usable if self.merged(piece) == [i]]
        else:
            self.machine = self._automaton(usable)
            best = [(piece, i) for piece, i in usable if len(piece) == 1 or sum(map(self.scores.__getitem__, self.viterbi(piece))) <= self.scores[i]]
        self.machine = self._automaton(best)
        self.joined = {piece[k : k + 2] for piece, _ in best for k in range(len(piece) - 1)}
        free = not any(pair[1] == MARK and pair[0] != MARK for pair in self.joined)
        self.segments = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if free else "(?s).+").findall
        self.parts = _Remembered(self.viterbi, remember // 2)
        self.known = _Remembered(self._segment, remember)

    def _automaton(self, pieces: list[tuple[str, int]]):  # noqa: ANN202
        import ahocorasick

        machine = ahocorasick.Automaton()
        for piece, i in pieces:
            machine.add_word(piece, (len(piece), i))
        machine.make_automaton()
        return machine

    def _segment(self, text: str) -> array:
        """Codes of a segment, from those of its parts between forced cuts."""
        out, at, joined, parts = array("i"), 0, self.joined, self.parts
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in joined:
                out.frombytes(parts[text[at:k]])
                at = k
        out.frombytes(parts[text[at:]])
        return out

    def merged(self, text: str) -> list[int | None]:
        """Ids of a short string by merging: of all neighbours that form a piece the one with the highest score is joined, the first of equal ones, until none is left."""
        parts, number, scores = list(text), self.number, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = number.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [number.get(x) for x in parts]

    def free_path(self, text: str) -> list[int]:
        """The ids of ``text`` for a model of merges, in one pass over the automaton's matches: the path without cost."""
        n, neighbours, lengths = len(text), self.neighbours, self.lengths
        last: list[int | None] = [None] * (n + 1)  # the piece that ends the free path to each position; -1: none before or a bridge
        last[0] = -1
        if not self.singles.issuperset(text):
            for k, c in enumerate(text):
                if c not in self.singles:
                    last[k + 1] = -1
        for end, (length, i) in self.machine.iter(text):
            end += 1
            if last[end] is None:
                before = last[end - length]
                if before is not None and (before < 0 or neighbours[before << 24 | i]):
                    last[end] = i
        out, at = [], n
        while at:
            i = last[at]
            if i < 0:
                out.extend(self._spelt(text[at - 1]))
                at -= 1
            else:
                out.append(i)
                at -= lengths[i]
        return out[::-1]

    def _spelt(self, c: str) -> list[int]:
        """Byte pieces of a character, the last first, or the unknown piece."""
        known = [self.bytes.get(b) for b in c.replace(OWN_MARK, MARK).encode()]
        return known[::-1] if None not in known else [self.unknown]

    def viterbi(self, text: str) -> list[int]:
        """The best ids of ``text``."""
        return self.free_path(text) if self.by_merges else self.best_path(text)

    def best_path(self, text: str) -> list[int]:
        """The best-scoring ids of ``text``, in one pass over the automaton's matches.

        Matches come by their end, longest first, so a position's score is final before any piece starts there.
        """
        n, low, scores = len(text), float("-inf"), self.scores
        best, back = [0.0] + [low] * n, [None] * (n + 1)
        if self.singles.issuperset(text):
            for end, (length, i) in self.machine.iter(text):
                total = best[end + 1 - length] + scores[i]
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (length, i)
        else:
            done = 0  # positions up to here are final
            for end, (length, i) in self.machine.iter(text):
                while done < end:
                    done += 1
                    self._bridge(text, done, best, back)
                total = best[end + 1 - length] + scores[i]
                if total > best[end + 1]:
                    best[end + 1], back[end + 1] = total, (length, i)
            for k in range(done + 1, n + 1):
                self._bridge(text, k, best, back)
        out, at = [], n
        while at:
            length, i = back[at]
            if i is not None:
                out.append(i)
            else:
                out.extend(self._spelt(text[at - 1]))
            at -= length
        return out[::-1]

    def _bridge(self, text: str, at: int, best: list[float], back: list) -> None:
        """The way to ``at`` over one character that is no piece."""
        over = best[at - 1] + self.bridge
        if text[at - 1] not in self.singles and over > best[at]:
            best[at], back[at] = over, (1, None)

    def encode(self, text: str) -> array:
        ids = array("i")
        if text:
            if MARK in text:
                text = text.replace(MARK, OWN_MARK)
            ids.frombytes(b"".join(map(self.known.__getitem__, self.segments(MARK + text.replace(" ", MARK)))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _flat(arrays: list[array]) -> pa.ListArray:
    at, flat = [0], array("i")
    for x in arrays:
        flat.extend(x)
        at.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids, and whether decoding gives the text back (decoded_ok)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = ["" if t is None else t for t in part.column("text").to_pylist()]
                ids = [p.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in ids], pa.int64()),
                        _flat(ids),
                        pa.array([p.decode(x) == t for t, x in zip(texts, ids, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "piece_ids", "decoded_ok"],
                )

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, piece_ids array<int>, decoded_ok boolean")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and piece_ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            texts = [p.decode(x or []) for x in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.selectExpr("cast(doc_id as bigint) doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")
