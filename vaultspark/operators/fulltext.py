"""Keyword search: boolean retrieval, BM25 ranking, snippets, backlinks.

An indexed table holds the words of each searched column as one string with single spaces. A query is compiled to expressions over these
strings, so that finding, counting and scoring happen in one scan; only three numbers and one for each phrase are gathered
over the corpus, and the top rows leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.functions import text as X
from vaultspark.functions.query import Node, Phrase, parse, words
from vaultspark.operators.keyword_index import K1, LEAST_IDF, B, KeywordIndex

FILE_COLUMNS = ("title", "content", "tags")
CONVERSATION_COLUMNS = ("summary", "topics", "outcome", "next_actions")


def _words(name: str) -> str:
    return f"{name}__words"


def indexed(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``rows`` with the words of each of ``columns``, each between spaces; lists are searched as their JSON text."""
    kinds = dict(rows.dtypes)
    text = {c: F.to_json(c) if kinds[c].startswith("array") else F.col(c) for c in columns}
    return rows.withColumns({_words(c): X.spaced(text[c]) for c in columns})


def _pattern(phrase: Phrase) -> str:
    """A regular expression that takes in the phrase's first word only, so that phrases may overlap."""
    rest = "".join(f" {w}" for w in phrase.words[1:]) + ("" if phrase.prefix else " ")
    return f"{'^ ' if phrase.first else '(?<= )'}{phrase.words[0]}(?={rest})"


def _hits(phrase: Phrase, columns: tuple[str, ...]) -> Column:
    """How often the phrase occurs in its columns."""
    return reduce(Column.__add__, [F.regexp_count(_words(c), F.lit(_pattern(phrase))) for c in phrase.columns or columns])


def _near(node: Node, columns: tuple[str, ...]) -> Column:
    """All phrases begin no more than ``distance`` words after the end of the first, in one column."""
    phrases = [p.parts[0] for p in node.parts]

    def whole(p: Phrase) -> str:
        return " ".join(p.words) + ("[^ ]*" if p.prefix else "")

    tests = []
    for k, first in enumerate(phrases):
        others = "".join(rf"(?=(?: [^ ]+){{0,{node.distance}}} {whole(p)} )" for j, p in enumerate(phrases) if j != k)
        pattern = f"(?<= ){whole(first)}(?= ){others}"
        tests += [F.col(_words(c)).rlike(pattern) for c in phrases[0].columns or columns]
    return reduce(Column.__or__, tests)


def _matches(node: Node, columns: tuple[str, ...], hits: dict[Phrase, Column]) -> Column:
    if node.op == "phrase":
        return hits[node.parts[0]] > 0 if node.parts[0] in hits else _hits(node.parts[0], columns) > 0
    if node.op == "near":
        return _near(node, columns)
    parts = [_matches(p, columns, hits) for p in node.parts]
    if node.op == "not":
        return parts[0] & ~parts[1]
    return reduce(Column.__and__ if node.op == "and" else Column.__or__, parts)


def match(index: DataFrame | KeywordIndex, columns: tuple[str, ...], query: str) -> DataFrame:
    """Rows that match, with ``score``: BM25, negative, the least is the best.

    Counts are over the whole of ``index``, a table from ``indexed`` or a stored index; filters belong on the result. A query without
    any word matches nothing.
    """
    if isinstance(index, KeywordIndex):
        return index.match(query)
    tree = parse(query, columns)
    if tree is None:
        return index.withColumn("score", F.lit(0.0)).where(F.lit(False))
    phrases = list(dict.fromkeys(tree.phrases()))
    name = {p: f"__hits_{k}" for k, p in enumerate(phrases)}
    length = reduce(Column.__add__, [F.regexp_count(_words(c), F.lit(" ")) - 1 for c in columns])
    rows = index.withColumns({name[p]: _hits(p, columns) for p in phrases} | {"__length": length})
    totals = rows.agg(
        F.count("*").cast("double").alias("__rows"),
        F.avg("__length").alias("__mean"),
        *[F.sum((F.col(h) > 0).cast("double")).alias(f"{h}_n") for h in name.values()],
    )
    score = F.lit(0.0)
    for p in phrases:
        f, n = F.col(name[p]).cast("double"), F.col(f"{name[p]}_n")
        idf = F.log((F.col("__rows") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("__length") / F.col("__mean")))
    found = rows.where(_matches(tree, columns, {p: F.col(h) for p, h in name.items()}))
    found = found.join(F.broadcast(totals)).withColumn("score", F.round(-score, 12))  # totals is one row; rounded, so that equal scores tie
    return found.drop("__length", "__rows", "__mean", *name.values(), *[f"{h}_n" for h in name.values()])


def file_filter(rows: DataFrame, directory: str | None = None, tag: str | None = None, since: int | str | None = None, until: int | str | None = None, compat: bool = True) -> DataFrame:
    """Files of a directory, with a tag (any part of the JSON of its tags, whatever its case, if ``compat``), changed in a span of ms or from the start of one day to the start of another."""
    if directory is not None:
        rows = rows.where(F.col("directory") == directory)
    if tag is not None:
        rows = rows.where(F.to_json("tags").ilike(f"%{tag}%") if compat else F.array_contains("tags", tag))
    at = lambda x: X.day_ms(F.lit(x)) if isinstance(x, str) else F.lit(x)
    if since is not None:
        rows = rows.where(F.col("modified_at") >= at(since))
    return rows if until is None else rows.where(F.col("modified_at") <= at(until))


#: What a stored index of files keeps of each.
FILE_KEPT = ("path", "title", "directory", "tags", "modified_at")


def search_files(index: DataFrame | KeywordIndex, query: str, limit: int = 20, marks: tuple[str, str] | None = None, files: DataFrame | None = None, **filters: object) -> DataFrame:
    """The best files for a query: path, title, directory, tags, modified_at, score, and a snippet if ``marks`` are given.

    With a stored index, the texts of the best files come from ``files``.
    """
    out = [*FILE_KEPT, "score"]
    if isinstance(index, KeywordIndex) and not any(v is not None for v in filters.values()):
        found = index.top(query, limit, "path")
    else:
        found = file_filter(match(index, FILE_COLUMNS, query), **filters).orderBy("score", "path").limit(limit)
    if marks:
        if "content" not in found.columns:
            found = files.select("id", "content").join(F.broadcast(found), "id")  # the side of ``limit`` rows
        found = found.withColumn("snippet", snippet(F.col("content"), query, *marks))
        out.append("snippet")
    return found.select(*out).orderBy("score", "path")


class Marker:
    """Cuts and marks texts for one query."""

    def __init__(self, query: str, open_: str = "<mark>", close: str = "</mark>", more: str = "...", size: int = 40) -> None:
        import regex

        tree = parse(query, FILE_COLUMNS)
        phrases = tree.phrases() if tree else []
        self.whole = {w for p in phrases for w in (p.words[:-1] if p.prefix else p.words)}
        self.starts = tuple({p.words[-1] for p in phrases if p.prefix})
        self.word = regex.compile(r"[\p{L}\p{N}]+")
        self.open, self.close, self.more, self.size = open_, close, more, size

    def __call__(self, text: str | None) -> str:
        text, size = text or "", self.size
        spans = [m.span() for m in self.word.finditer(text)]
        known = [(words(text[a:b]) or [""])[0] for a, b in spans]
        hit = [k in self.whole or (bool(self.starts) and k.startswith(self.starts)) for k in known]
        best, at = -1, 0
        for s in {max(0, min(i, len(spans) - size)) for i, h in enumerate(hit) if h} | {0}:
            seen = len({k for k, h in zip(known[s : s + size], hit[s : s + size], strict=True) if h})
            if (seen, -s) > (best, -at):
                best, at = seen, s
        end = min(len(spans), at + size)
        begin = 0 if at == 0 else spans[at][0]
        stop = len(text) if end == len(spans) else spans[end - 1][1]
        out, last, k = [self.more if at else ""], begin, at
        while k < end:
            if hit[k]:
                j = k
                while j + 1 < end and hit[j + 1]:
                    j += 1
                out += [text[last : spans[k][0]], self.open, text[spans[k][0] : spans[j][1]], self.close]
                last, k = spans[j][1], j
            k += 1
        return "".join([*out, text[last:stop], self.more if end < len(spans) else ""])


def marked(text: str | None, query: str) -> str:
    return Marker(query)(text)


def snippet(text: Column, query: str, open_: str, close: str, more: str = "...", size: int = 40) -> Column:
    """The stretch of at most ``size`` words with most different query words, these marked; the start of the text without any.

    It begins as early as it can; each run of marked words is one mark. Meant for the few texts of a result's page.
    """

    @F.pandas_udf("string")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mark = Marker(query, open_, close, more, size)
        for series in texts:
            yield series.map(mark)

    return cut(text)


def backlinks(files: DataFrame, title: str, compat: bool = False) -> DataFrame:
    """path and title of files that link to ``title``; with ``compat``, where it is any part of the links' JSON."""
    test = F.to_json("wiki_links").ilike(f"%{title}%") if compat else F.array_contains("wiki_links", title)
    return files.where(test).select("path", "title")
