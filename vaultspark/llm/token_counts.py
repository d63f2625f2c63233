"""Token counts for a BPE vocabulary with word ends, by a whole-token shortcut.

Offline, each vocabulary string that could be a pre-token is encoded alone by the library; those
that come back as one token form the shortcut table. At run time a text is normalised and cut into
pre-tokens as the library does it; a pre-token in the table counts one, and only the rest is merged.
What a merge gave is remembered, up to a bound, as words repeat.

Defined results: null text is empty and has no token. The vocabulary's special strings inside a text
count one token each, as is the library's default. Rows that repeat are counted each. Other columns
of the input aren't returned.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-tokens of the vocabulary, for any text and for ASCII alone.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
PRE_TOKEN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"
WORD_END = "</w>"


@functools.lru_cache(1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next free code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Counter:
    """Counts the tokens of texts; one for each vocabulary file and process."""

    def __init__(self, path: str, remember: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.any, self.ascii = regex.compile(PRE_TOKEN), re.compile(PRE_TOKEN_ASCII)
        self.letters = byte_letters()
        self.whole = self.prove()
        counter, merge, whole = self, self.library.model.tokenize, self.whole

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                if piece in whole:
                    return 1
                n = len(merge("".join([counter.letters[b] for b in piece.encode()])))
                if len(self) >= remember:
                    self.clear()
                if len(piece) <= 64:
                    self[piece] = n
                return n

        self.known = Known()

    def prove(self) -> frozenset[str]:
        """Strings that are one pre-token and that the library encodes as one token."""
        back = {c: b for b, c in enumerate(self.letters)}
        strings = []
        for token in self.library.get_vocab():
            if token.endswith(WORD_END):
                try:
                    text = bytes(back[c] for c in token[: -len(WORD_END)]).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if self.pre_tokens(text) == [text]:
                    strings.append(text)
        encoded = self.library.encode_batch(strings, add_special_tokens=False)
        return frozenset(s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1)

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.any.findall(text.replace("Σ", "σ").lower())  # the library knows no final sigma

    def count(self, text: str) -> int:
        if self.special and "<|" in text:
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(map(self._count, parts))
        return self._count(text)

    def _count(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.pre_tokens(text)))


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([x > limit for x in n], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
