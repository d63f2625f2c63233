"""Markdown notes: scanning folders, reading files, front-matter, tags and links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark.functions import text as X


def scan(spark: SparkSession, root: str, skip_dirs: Iterable[str] = (), top_level_only: bool = False) -> DataFrame:
    """path (below ``root``), modified_at (ms) and raw text of every Markdown note.

    Hidden files and folders are left out, and folders named in ``skip_dirs``: at any depth, or only directly below
    ``root`` with ``top_level_only``. Spark's reader lists no file or folder whose name begins with a dot or an underscore.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreMissingFiles", True).load(root)
    below = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z]+:/*", "/")
    path = F.regexp_replace(below, "^" + re.escape("/" + re.sub(r"^[a-z]+:/*", "", root).strip("/")) + "/", "")
    rows = found.select(path.alias("path"), F.unix_millis("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("raw"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    skip = F.array(*[F.lit(x) for x in skip_dirs]).cast("array<string>")
    if top_level_only:
        return rows.where(~F.col("path").startswith(".") & ~F.coalesce(F.array_contains(skip, F.get(folders, F.lit(0))), F.lit(False)))
    hidden = F.exists(F.split("path", "/"), lambda x: x.startswith("."))
    return rows.where(~hidden & ~F.arrays_overlap(folders, skip) if skip_dirs else ~hidden)


class NoteSource(Protocol):
    """Where notes come from: ``notes`` gives path, modified_at and raw of all, and the rest follows from it."""

    def notes(self) -> DataFrame: ...


class Folder:
    """The Markdown notes below a folder that Spark can read."""

    def __init__(self, spark: SparkSession, root: str, skip_dirs: Iterable[str] = (), top_level_only: bool = False) -> None:
        self.spark, self.root, self.skip_dirs, self.top_level_only = spark, root, tuple(skip_dirs), top_level_only

    def notes(self) -> DataFrame:
        return scan(self.spark, self.root, self.skip_dirs, self.top_level_only)


class Rows:
    """Notes that are a table already."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows

    def notes(self) -> DataFrame:
        return self.rows.select("path", "modified_at", "raw")


def read_if_exists(source: NoteSource, paths: DataFrame) -> DataFrame:
    """path and raw of each of ``paths``; raw is null where there is no such note."""
    return paths.join(source.notes().select("path", "raw"), "path", "left")


def sub_directories(source: NoteSource, parent: str) -> DataFrame:
    """Names of the folders directly below ``parent`` that hold notes; no row if it doesn't exist."""
    rest = F.substring("path", len(parent) + 2, 1 << 30)
    return source.notes().where(F.col("path").startswith(f"{parent}/") & rest.contains("/")).select(F.split(rest, "/")[0].alias("name")).distinct()


def _plain(value: object) -> object:
    """A YAML value as JSON holds it: dates become ISO text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if hasattr(value, "isoformat"):
        day = value.isoformat()
        return day if "T" in day else f"{day}T00:00:00.000Z"
    return value


def front_matter(raw: Column) -> Column:
    """JSON of a note's front-matter; ``{}`` without one, or where its YAML can't be read."""

    @F.pandas_udf("string")
    def read(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import yaml

        def one(block: str | None) -> str:
            try:
                data = yaml.safe_load(block) if block else None
            except yaml.YAMLError:
                data = None
            return json.dumps(_plain(data) if isinstance(data, dict) else {}, ensure_ascii=False)

        for series in blocks:
            yield series.map(one)

    block = F.nullif(F.regexp_extract(raw, FRONT, 1), F.lit(""))
    return F.when(block.isNull(), F.lit("{}")).otherwise(read(block))


#: A block between lines of three dashes at the very start.
FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\z)"


def parse(notes: DataFrame) -> DataFrame:
    """path, title, directory, tags, frontmatter (JSON), wiki_links, content and modified_at of raw notes."""
    content = F.regexp_replace("raw", FRONT, "")
    rows = notes.select("path", "modified_at", content.alias("content"), front_matter(F.col("raw")).alias("frontmatter"))
    listed = F.from_json(F.get_json_object("frontmatter", "$.tags"), "array<string>")
    given = F.get_json_object("frontmatter", "$.tags")
    tags = F.when(given.startswith("["), F.coalesce(listed, F.array().cast("array<string>"))).when(given.isNotNull(), X.comma_list(given)).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "path",
        X.base_name(F.col("path")).alias("title"),
        X.directory(F.col("path")).alias("directory"),
        F.array_union(tags, X.inline_tags(F.col("content"))).alias("tags"),
        "frontmatter",
        X.wiki_links(F.col("content")).alias("wiki_links"),
        "content",
        "modified_at",
    )


def parse_cached(notes: DataFrame, cache: DataFrame) -> DataFrame:
    """As ``parse``, with what a host knows of each note: ``cache`` has path, tags, links and frontmatter (JSON).

    Tags are the host's and those of its front-matter, links the host's and those of the raw text; the content is what follows the second
    three dashes, trimmed, if the note begins with three.
    """
    end = F.locate("---", F.col("raw"), 4)
    content = F.when(F.col("raw").startswith("---") & (end > 0), X.trimmed(F.expr("substring(raw, locate('---', raw, 4) + 3)"))).otherwise(F.col("raw"))
    rows = notes.join(cache.select("path", F.col("tags").alias("__tags"), F.col("links").alias("__links"), "frontmatter"), "path", "left")
    given = F.get_json_object("frontmatter", "$.tags")
    own = F.when(given.startswith("["), F.from_json(given, "array<string>")).when(given.isNotNull(), X.comma_list(given))
    none = F.array().cast("array<string>")
    links = F.transform(F.coalesce("__links", none), lambda x: X.trimmed(F.regexp_extract(x, r"^[^#|]*", 0)))
    return rows.select(
        "path",
        X.base_name(F.col("path")).alias("title"),
        X.directory(F.col("path")).alias("directory"),
        F.array_union(F.transform(F.coalesce("__tags", none), lambda x: F.regexp_replace(x, "^#", "")), F.coalesce(own, none)).alias("tags"),
        F.coalesce("frontmatter", F.lit("{}")).alias("frontmatter"),
        F.array_union(links, X.wiki_links(F.col("raw"))).alias("wiki_links"),
        content.alias("content"),
        "modified_at",
    )
